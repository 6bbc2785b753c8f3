"""Exact histogram of encoded lengths, and what its suffix sums answer for every context limit.

Edge cases: a null text counts as empty (one token, the end mark); repeated rows count each; no documents give an
empty histogram, of which totals are 0 and quantiles null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagetrail.llm.common import small_batches, staged, text_or_empty
from stagetrail.llm.tokens import encoded

#: Lengths that share a block when sums run on: whole blocks are summed first, so no task sees all lengths.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id and n_tokens, the end mark included."""

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in small_batches(batches):
            n = [len(ids) // 4 + 1 for ids in encoded(batch.column(1).to_pylist(), tokenizer_path)]
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "utf-8").alias("text"))
    return source.mapInArrow(count, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame, column: str = "n_tokens") -> DataFrame:
    """A row per length that occurs: documents of it, and sums over the documents of at least and of under it."""
    # Written, as both blocks and rows are made from it: texts are not tokenised for each.
    counts = staged(lengths.groupBy(F.col(column).alias("length")).agg(F.count(F.lit(1)).alias("n_docs")), "length-counts")
    counts = counts.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK)})
    down = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum("n_tokens").alias("tokens"))
    everything = Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(down), F.lit(0)).alias("docs_over"),
        F.coalesce(F.sum("tokens").over(down), F.lit(0)).alias("tokens_over"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.select(
        "length", "n_docs", "n_tokens", "block", F.sum("n_docs").over(inside).alias("docs_in"), F.sum("n_tokens").over(inside).alias("tokens_in")
    ).join(blocks, "block")
    at_least, tokens = F.col("docs_in") + F.col("docs_over"), F.col("tokens_in") + F.col("tokens_over")
    return summed.select(
        "length",
        "n_docs",
        "n_tokens",
        at_least.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("all_docs") - at_least).alias("docs_below"),
        (F.col("all_tokens") - tokens).alias("tokens_below"),
        # Under a limit of this length: shorter documents whole, the others cut to it.
        (F.col("all_tokens") - tokens + at_least * F.col("length")).alias("truncated_total"),
        (tokens - at_least * F.col("length")).alias("tokens_cut"),
        "all_docs",
        "all_tokens",
        # The quantile of a share is the first length of which at least that share of documents is no longer.
        (F.col("all_docs") - at_least + F.col("n_docs")).alias("docs_upto"),
        ((F.col("all_docs") - at_least + F.col("n_docs")) / F.col("all_docs")).alias("share_upto"),
    )


def totals_at(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each row of `limits` (limit): documents over it, tokens kept when all are cut to it, tokens cut.

    The histogram's first length over the limit has the suffix sums; a limit beyond all lengths cuts nothing. Limits and
    lengths are put on one line, which is ordered within blocks; the first length of the next block answers what is
    beyond a block's last one."""
    whole = histogram.agg(F.coalesce(F.max("all_docs"), F.lit(0)).alias("d"), F.coalesce(F.max("all_tokens"), F.lit(0)).alias("t"))
    sums = F.struct(F.col("docs_at_least").alias("docs"), F.col("tokens_at_least").alias("tokens"))
    lengths = histogram.select(F.col("length").cast("long").alias("at"), sums.alias("sums"))
    asked = limits.select(F.col("limit").cast("long").alias("at")).filter("at is not null").distinct()
    line = lengths.unionByName(asked.withColumn("sums", F.lit(None).cast(lengths.schema["sums"].dataType)))
    line = line.withColumn("block", F.floor(F.col("at") / BLOCK))
    # From the longest down; a limit comes before the length that equals it.
    down = Window.partitionBy("block").orderBy(F.desc("at"), F.col("sums").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    inside = line.withColumn("next", F.last("sums", ignorenulls=True).over(down)).filter("sums is null")
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = line.groupBy("block").agg(F.min_by("sums", F.when(F.col("sums").isNotNull(), F.col("at"))).alias("least"))
    blocks = blocks.select("block", F.last("least", ignorenulls=True).over(over).alias("beyond"))
    found = inside.join(blocks, "block").select("at", F.coalesce("next", "beyond").alias("sums"))
    docs, tokens = F.coalesce("sums.docs", F.lit(0)), F.coalesce("sums.tokens", F.lit(0))
    return (
        limits.join(found, F.col("limit") == F.col("at"), "left")
        .join(F.broadcast(whole))
        .select("limit", docs.alias("docs_over"), (F.col("t") - tokens + docs * F.col("limit")).alias("tokens_kept"), (tokens - docs * F.col("limit")).alias("tokens_cut"))
    )


def quantile(histogram: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least `share` of the documents do not exceed; one row, null without documents."""
    reached = F.col("docs_upto") >= F.ceil(F.col("all_docs") * F.lit(share))
    return histogram.agg(F.min(F.when(reached, F.col("length"))).alias("length"))
