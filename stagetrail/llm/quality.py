"""Quality rules: counted limits, then robust multivariate outliers by language and source.

Statistics of each whole text are transformed to a vector, and the minimum covariance determinant of each (language,
source) gives a centre and a scatter that bad documents can't move: from two starts (all rows; medians and quartiles)
the `share` of rows closest to the estimate so far re-estimate it, until the steps are done; the smaller determinant
stays. A document goes if its Mahalanobis distance is over `far`.

All rows take part in every step. Vectors are whole 1/1024ths, so sums are exact and the same in any order; a step is
one aggregate of moments by distance bin, whose rows are bounded by groups and bins, so a source with a third of all
rows costs no task more than another. A group of under `least` rows is judged by the estimate of all rows of its
language, or of the whole table if these are too few; only a table of under `least` rows rejects nothing more.
A statistic that hardly varies in a group counts with a least spread instead of its own.

Edge cases: a null text has no words and fails the base rules; null language or source is a group of its own; ties in
distance stay together; repeated rows count each; no rows give no rows; other columns are ignored, or kept by
`kept_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stagetrail.llm.common import CONTINUATION, forget, staged

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Least spread that counts, per statistic: none is so constant that a harmless difference is far.
SPREADS = {"words": 1.0, "word_length": 0.15, "symbols": 0.2, "dup_lines": 0.15, "repeats": 0.15}
UNIT = 1024
BINS = 32
STEPS = 6
MEDIAN_CHI2_5 = 4.351460191095527
#: Distance that one of a thousand points of five normal statistics exceeds: the root of the chi-square quantile.
FAR = 20.515005652432873**0.5
D = len(SPREADS)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def text_counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """The base counts, and the number of lines with a word."""
    import numpy as np

    words = text.split()
    chars = len(text.translate(None, SPACES + CONTINUATION))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats, n = 0, len(words)
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words])
        pair = ids[:-1] * len(number) + ids[1:]
        if len(number) > 2_000_000:
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * len(number) + ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        if same.any():
            found = np.zeros(n, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            for k in range(3):
                found[at + k] = True
            repeats = int(found.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


_COUNTS = StructType([StructField(c, LongType()) for c in (*BASE, "n_lines")])


@F.arrow_udf(_COUNTS)
def _counts(text):
    import pyarrow as pa

    forget()
    # One text at a time is a Python object; the rest of the batch stays as it came.
    columns = zip(*[text_counts(t.as_py() or b"") for t in text], strict=True) if len(text) else [()] * len(_COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=_COUNTS.names)


def counted(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """`docs` with a struct of the base counts and base_failed."""
    source = docs.withColumn(into, _counts(F.encode(F.coalesce(F.col(f"`{text}`"), F.lit("")), "utf-8")))
    n = F.col(f"{into}.n_words")
    return source.withColumn(into, F.col(into).withField("base_failed", (n < 50) | (F.col(f"{into}.n_repeat_words") * 100 > n * 50)))


def vector(counts: Column) -> list[Column]:
    """The transformed statistics in 1/1024ths."""
    n, lines = F.greatest(counts["n_words"], F.lit(1)), F.greatest(counts["n_lines"], F.lit(1))
    made = (
        F.log(n.cast("double")),
        F.log(F.greatest(counts["word_chars"], F.lit(1)) / n),
        F.log1p(counts["n_symbols"] * 10 / n),
        counts["n_dup_lines"] / lines,
        counts["n_repeat_words"] / n,
    )
    return [F.round(x * UNIT).cast("long") for x in made]


def _pool(by: str, *columns: str) -> Column:
    return F.to_json(F.struct(F.lit(by).alias("by"), *columns))


def _groups(rows: DataFrame, least: int) -> DataFrame:
    """lang, source, gid: the pool that judges a (language, source); null if even the table is too small. gids: the pools
    that its rows are part of, which are those that judge anything."""
    n = rows.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    everywhere = n.agg(F.sum("n").alias("n_all"))
    n = n.withColumn("n_lang", F.sum("n").over(Window.partitionBy("lang"))).join(F.broadcast(everywhere))
    gid = (
        F.when(F.col("n") >= least, _pool("source", "lang", "source"))
        .when(F.col("n_lang") >= least, _pool("language", "lang"))
        .when(F.col("n_all") >= least, F.lit("all"))
    )
    n = n.withColumn("gid", gid)
    pools = F.array(_pool("source", "lang", "source"), _pool("language", "lang"), F.lit("all"))
    # A (language, source) has one row here, so these are few.
    judges = n.agg(F.collect_set("gid").alias("judges"))
    return n.join(F.broadcast(judges)).select("lang", "source", "gid", F.array_intersect(pools, "judges").alias("gids"))


def _moments() -> list[Column]:
    return (
        [F.count(F.lit(1)).alias("n")]
        + [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)]
        + [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS]
    )


_ESTIMATE = ", ".join(
    ["gid string", "start int", "det double", "scale double", *[f"m{i} double" for i in range(D)], *[f"p{i}{j} double" for i, j in PAIRS]]
)


def _estimates(moments: DataFrame) -> DataFrame:
    """Centre and inverse scatter from sums: a row from a row, whatever the number of groups."""

    def solve(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        floor = np.square(list(SPREADS.values()))
        for b in batches:
            n = b["n"].to_numpy(float)
            mean = b[[f"s{i}" for i in range(D)]].to_numpy(float) / n[:, None] / UNIT
            scatter = np.empty((len(b), D, D))
            for i, j in PAIRS:
                scatter[:, i, j] = scatter[:, j, i] = b[f"s{i}{j}"].to_numpy(float) / n / UNIT**2 - mean[:, i] * mean[:, j]
            own = np.diagonal(scatter, axis1=1, axis2=2)
            scatter = scatter + np.maximum(floor - own, 0)[:, :, None] * np.eye(D)
            inverse = np.linalg.inv(scatter)
            made = {"gid": b["gid"], "start": b["start"], "det": np.linalg.det(scatter), "scale": 1.0}
            made |= {f"m{i}": mean[:, i] for i in range(D)} | {f"p{i}{j}": inverse[:, i, j] for i, j in PAIRS}
            yield pd.DataFrame(made)

    return moments.mapInPandas(solve, _ESTIMATE)


def _distance() -> Column:
    """Squared distance of the row's vector from its group's estimate."""
    off = [F.col(f"x{i}") / UNIT - F.col(f"m{i}") for i in range(D)]
    return sum((off[i] * off[j] * F.col(f"p{i}{j}") * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _binned(rows: DataFrame, estimates: DataFrame, aggregates: list[Column]) -> DataFrame:
    distance = F.floor(F.log(F.greatest(_distance(), F.lit(0.0)) + 1e-9) * BINS).cast("int")
    return rows.join(estimates, "gid").withColumn("bin", distance).groupBy("gid", "start", "bin").agg(*aggregates)


def _upto(binned: DataFrame, share: float) -> DataFrame:
    """The bins, nearest first, that hold the first `share` of a group's rows."""
    key = Window.partitionBy("gid", "start")
    before = key.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return binned.withColumns({"before": F.coalesce(F.sum("n").over(before), F.lit(0)), "of": F.sum("n").over(key)}).filter(
        F.col("before") < F.ceil(F.col("of") * share)
    )


def robust_estimates(rows: DataFrame, share: float = 0.75) -> DataFrame:
    """The minimum covariance determinant of each gid's vectors (x0 to x4), scaled so that the median distance is that
    of five normal statistics."""
    classic = rows.groupBy("gid").agg(*_moments()).withColumn("start", F.lit(0))
    quarters = rows.groupBy("gid").agg(*[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(D)])
    middle = {f"s{i}": F.col(f"q{i}")[1] for i in range(D)}
    spread = {
        f"s{i}{j}": F.col(f"q{i}")[1] * F.col(f"q{j}")[1] + (F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349, F.lit(2)) if i == j else F.lit(0.0))
        for i, j in PAIRS
    }
    medians = quarters.select("gid", F.lit(1).alias("n"), F.lit(1).alias("start"), *[c.alias(k) for k, c in (middle | spread).items()])
    estimates = staged(_estimates(classic.unionByName(medians)), "estimates")
    for _ in range(STEPS):
        nearest = _upto(_binned(rows, estimates, _moments()), share)
        sums = [c for c in nearest.columns if c == "n" or c.startswith("s") and c != "start"]
        estimates = staged(_estimates(nearest.groupBy("gid", "start").agg(*[F.sum(c).alias(c) for c in sums])), "estimates")
    least = Window.partitionBy("gid").orderBy("det", "start")
    best = estimates.withColumn("nth", F.row_number().over(least)).filter("nth = 1").drop("nth")
    half = _upto(_binned(rows, best, [F.count(F.lit(1)).alias("n")]), 0.5).groupBy("gid").agg(F.max("bin").alias("bin"))
    scale = F.greatest(F.lit(1.0), F.exp((F.col("bin") + 1) / BINS) / MEDIAN_CHI2_5)
    return staged(best.drop("scale").join(half.select("gid", scale.alias("scale")), "gid"), "estimates")


def group_estimates(docs: DataFrame, counts: str, share: float, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source) to gid, and the estimate of each gid, from rows that pass the base rules."""
    rows = docs.filter(f"not `{counts}`.base_failed").select(
        F.col("lang").cast("string"), F.col("source").cast("string"), *[x.alias(f"x{i}") for i, x in enumerate(vector(F.col(counts)))]
    )
    rows = staged(rows, "vectors")
    groups = staged(_groups(rows, least), "groups")
    same = (rows["lang"].eqNullSafe(groups["lang"])) & (rows["source"].eqNullSafe(groups["source"]))
    vectors = staged(rows.join(groups, same).select(F.explode("gids").alias("gid"), *[f"x{i}" for i in range(D)]), "vectors")
    return groups, robust_estimates(vectors, share)


def judged(
    docs: DataFrame, into: str = "quality", share: float = 0.75, far: float = FAR, least: int = 50, keep: list[str] | None = None
) -> DataFrame:
    """`docs` (its columns `keep`, or all) with a struct `into`: the base counts, base_failed, distance (null without an
    estimate), kept."""
    names = docs.columns if keep is None else keep
    source = counted(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_own(docs)), "counts")
    source = source.drop("text")
    groups, estimates = group_estimates(source, "counts", share, least)
    # Written once more so that its size is known before the texts move: a small one is then sent to them.
    known = staged(groups.drop("gids").join(estimates, "gid", "left").withColumnsRenamed({"lang": "_lang", "source": "_source"}), "known")
    same = source["lang"].eqNullSafe(known["_lang"]) & source["source"].eqNullSafe(known["_source"])
    near = source.join(known, same, "left").withColumns({f"x{i}": x for i, x in enumerate(vector(F.col("counts")))})
    distance = F.sqrt(F.greatest(_distance(), F.lit(0.0)) / F.col("scale"))
    near = near.withColumn("distance", F.when(~F.col("counts.base_failed"), distance))
    kept = ~F.col("counts.base_failed") & (F.col("distance").isNull() | (F.col("distance") <= far))
    verdict = F.col("counts").withField("distance", F.col("distance")).withField("kept", kept)
    return near.select("row.*", verdict.alias(into))


def _own(docs: DataFrame) -> list[Column]:
    return [F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")]


def kept_documents(docs: DataFrame, **options) -> DataFrame:
    """`docs` without the rows that the rules reject; columns as they are."""
    into = "_" + "_".join(["quality", *docs.columns])
    return judged(docs, into, **options).filter(f"`{into}`.kept").drop(into)
