"""Byte passages that occur again anywhere in the corpus, removed by suffix arrays over shards.

Every substring of `SIZE` bytes has an anchor, its smallest hashed gram of 32 bytes, so equal substrings have equal
anchors in equal places. Neighbouring substrings of one anchor are one context, the bytes that they cover. Anchors
that occur once can't repeat. Equal contexts of an anchor are counted before anything else moves: if one occurs twice,
all its substrings do. Where an anchor has different contexts, the shard of the anchor sorts all their suffixes by
induction and reads the repeats off the permuted common prefixes. Anchors with more than `GROUP` different contexts
would not fit a shard: they are parted once more, by the bytes that neighbouring substrings have in common, and if
even then too many agree, their substrings are counted one by one, spread over all tasks.

The result depends on none of these splits: a substring counts if it starts at two places, in the input as given.

Edge cases: a null text is empty; texts under `SIZE` bytes lose nothing; equal rows repeat each other and lose all
that is long enough; ids may be null or repeat; no rows give no rows; other columns are ignored. Very long texts are
read in segments of `SEGMENT` bytes whose contexts end with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagetrail.llm.common import hash_filter, mixed, passes, staged, text_or_empty
from stagetrail.llm.suffixes import repeated

SIZE, GRAM = 200, 32
SEGMENT = 1 << 20
GROUP = 1000
BLOCK = 16
#: Bytes of contexts that one suffix array takes; whole groups, so a little more at times.
SHARD = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_ANCHORS = "k1 long, k2 long, first long, last long, a long, c long"


@cache
def _tables():
    """A random number for each byte, powers of an odd number and of its inverse modulo 2^64."""
    import numpy as np

    n = SEGMENT + 2 * SIZE + 2
    each = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    up = np.cumprod(np.full(n, _BASE, np.uint64))
    down = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))
    return each, up, down


def contexts(data, ends):
    """Runs of substrings with one anchor: first and last start, place of the anchor, anchor hash, context hash.

    `data`: bytes as numpy numbers; `ends`: where texts end in it. Substrings do not reach over an end."""
    import numpy as np

    none = (np.empty(0, np.int64),) * 5
    n = len(data)
    if n < SIZE:
        return none
    each, up, down = _tables()
    byte = each[data]
    gram, width = byte, 1
    while width < GRAM:
        gram = gram[: len(gram) - width] * np.uint64(_BASE + 2 * width) + gram[width:]
        gram ^= gram >> np.uint64(31)
        width *= 2
    gram = mixed(gram)
    low = np.uint64((1 << 22) - 1)
    least, width = (gram & ~low) | np.arange(len(gram), dtype=np.uint64), 1
    window = SIZE - GRAM + 1
    while 2 * width <= window:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: n - SIZE + 1], least[window - width : window - width + n - SIZE + 1])
    anchor = (least & low).astype(np.int64)
    good = np.ones(n - SIZE + 1, bool)
    for end in ends[:-1].tolist():
        good[max(0, end - SIZE + 1) : end] = False
    new = np.ones(len(good), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~good[:-1]
    first = np.flatnonzero(new & good)
    if not len(first):
        return none
    over = np.ones(len(good), bool)
    over[:-1] = new[1:] | ~good[1:]
    last = np.flatnonzero(over & good)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * up[:n])])
    whole = (sums[last + SIZE] - sums[first]) * down[first]
    size = (last - first + (anchor[first] - first) * (1 << 16)).astype(np.uint64)
    c = mixed(whole ^ mixed(size + np.uint64(_BASE)))
    return first, last, anchor[first], gram[anchor[first]].view(np.int64), c.view(np.int64)


def _segments(texts: list[bytes]):
    """Parts of about a segment: (row, place of the part in its text, bytes) of each text in it."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text) - SIZE) + 1, SEGMENT):
            part = text[at : at + SEGMENT + SIZE - 1]
            if len(part) < SIZE:
                continue
            if held and size + len(part) > SEGMENT + SIZE:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
    if held:
        yield held


def _runs(texts: list[bytes]):
    """The bytes of a segment, and of its runs: row, shift of the bytes' places to the text's, and the run itself."""
    import numpy as np

    for parts in _segments(texts):
        data = b"".join(p for _, _, p in parts)
        ends = np.cumsum([len(p) for _, _, p in parts])
        first, last, anchor, a, c = contexts(np.frombuffer(data, np.uint8), ends)
        part = np.searchsorted(ends, first, "right")
        shift = np.array([at for _, at, _ in parts]) - (ends - [len(p) for _, _, p in parts])
        row = np.array([r for r, _, _ in parts])
        yield data, row[part], shift[part], first, last, anchor, a, c


def _source(docs: DataFrame) -> Column:
    return F.encode(text_or_empty(docs["text"]), "utf-8")


def _text_hash(text: Column, half: int) -> Column:
    """Half of a text's md5 as a number."""
    return F.conv(F.substring(F.md5(text), 1 + 16 * half, 16), 16, -10).cast("long")


def anchored(docs: DataFrame) -> DataFrame:
    """The contexts of all texts: md5 of the text (k1, k2), first and last start, anchor, context."""

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for _, row, shift, first, last, _, a, c in _runs(batch.column(2).to_pylist()):
                columns = [keys[0][row], keys[1][row], first + shift, last + shift, a, c]
                yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in columns], ["k1", "k2", "first", "last", "a", "c"])

    text = _source(docs)
    return docs.select(text.alias("text")).select(_text_hash(F.col("text"), 0).alias("k1"), _text_hash(F.col("text"), 1).alias("k2"), "text").mapInArrow(find, _ANCHORS)


def _place_hash() -> Column:
    """Of a context at a place in a text; the same as in `context_bytes`."""
    place = F.shiftleft("first", 40)
    return F.col("a").bitwiseXOR(F.col("c")).bitwiseXOR(F.col("k1")).bitwiseXOR(place)


def context_bytes(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, c, bytes and rel (place of the anchor) of the contexts (a, c, k1, first: a text that has it), each once.

    Every text is read again, as its contexts are not kept; a filter lets few pass but those of the named places."""
    may = hash_filter(wanted.select(_place_hash().alias("hash")), "hash")

    def find(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for data, row, shift, first, last, anchor, a, c in _runs(batch.column(1).to_pylist()):
                on = passes(may.value, (a ^ c ^ keys[row] ^ ((first + shift) << 40)).view(np.uint64))
                if on.any():
                    made = [data[f : e + SIZE] for f, e in zip(first[on].tolist(), last[on].tolist(), strict=True)]
                    rel = (anchor - first)[on].astype(np.int32)
                    yield pa.record_batch([pa.array(a[on]), pa.array(c[on]), pa.array(made, pa.binary()), pa.array(rel)], ["a", "c", "bytes", "rel"])

    text = docs.select(_source(docs).alias("text"))
    found = text.select(_text_hash(F.col("text"), 0).alias("k1"), "text").mapInArrow(find, "a long, c long, bytes binary, rel int")
    return found.groupBy("a", "c").agg(F.first("bytes").alias("bytes"), F.first("rel").alias("rel")).join(wanted.select("a", "c"), ["a", "c"])


def _sorted_shards(strings: DataFrame) -> DataFrame:
    """a, c and the runs of repeated starts of each context, from suffix arrays over whole groups."""

    def sort(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def done(rows: list[tuple]):
            made = []
            for found in repeated([r[2] for r in rows], SIZE):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
                made.append([{"first": int(x), "last": int(y) - 1} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(made, kind)], ["a", "c", "runs"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if size > SHARD and row[0] != held[-1][0]:
                    yield done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield done(held)

    number = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = strings.select("a", "c", "bytes").repartition(number, "a").sortWithinPartitions("a", "c")
    return shards.mapInArrow(sort, "a long, c long, runs array<struct<first:bigint,last:bigint>>")


def _in_groups(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strings (a, c, ...) whose group a fits a shard, and the others; those alone in their group are neither."""
    sizes = staged(strings.groupBy("a").agg(F.count(F.lit(1)).alias("of")).filter("of > 1"), "groups")
    cut = F.xxhash64("a")
    strings = strings.withColumn("cut", cut).join(sizes.withColumn("cut", cut), ["a", "cut"]).drop("cut")
    return strings.filter(F.col("of") <= GROUP).drop("of"), strings.filter(F.col("of") > GROUP).drop("of")


def _in_blocks(strings: DataFrame) -> DataFrame:
    """The same for groups beyond a shard. Starts that lie `BLOCK` by `BLOCK` before the anchor have the bytes between
    the last start and the first end in common: these part the group anew, so that few strings stay together."""
    far, near = F.col("rel"), F.col("rel") - (F.octet_length("bytes") - SIZE)
    blocks = F.sequence((near / BLOCK).cast("int"), (far / BLOCK).cast("int"))
    each = strings.select("a", "c", "bytes", "rel", F.explode(blocks).alias("block"))
    low = F.greatest(F.lit(0), F.col("rel") - F.col("block") * BLOCK - (BLOCK - 1))
    high = F.least(F.octet_length("bytes") - SIZE, F.col("rel") - F.col("block") * BLOCK)
    core = F.col("bytes").substr(F.col("rel") - F.col("block") * BLOCK + 1, F.lit(SIZE - BLOCK + 1))
    each = each.select("a", "c", low.cast("long").alias("low"), F.xxhash64("a", "block", core).alias("g"), F.col("bytes").substr(low + 1, high - low + SIZE).alias("bytes"))
    each = staged(each.withColumn("h", F.md5("bytes")), "blocks")
    kinds = staged(each.groupBy("g", "h").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes")), "blocks")
    small, large = _in_groups(kinds.select(F.col("g").alias("a"), F.xxhash64("h").alias("c"), "bytes"))
    found = _sorted_shards(small).unionByName(_counted_one_by_one(large)).select(F.col("a").alias("g"), F.col("c").alias("hash"), "runs")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), (F.octet_length("bytes") - SIZE).cast("long").alias("last")))
    known = kinds.withColumn("hash", F.xxhash64("h")).join(found, ["g", "hash"], "left")
    known = known.select("g", "h", F.when(F.col("n") > 1, whole).otherwise(F.col("runs")).alias("runs")).filter(F.size("runs") > 0)
    cut = F.xxhash64("g", "h")
    met = each.drop("bytes").withColumn("cut", cut).join(known.withColumn("cut", cut), ["g", "h", "cut"])
    moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("low")).alias("first"), (r["last"] + F.col("low")).alias("last")))
    return met.groupBy("a", "c").agg(F.flatten(F.collect_list(moved)).alias("runs"))


def _counted_one_by_one(strings: DataFrame) -> DataFrame:
    """The same for strings of which too many agree on all but a block: every substring of `SIZE` bytes by its digest."""
    last = F.octet_length("bytes") - SIZE
    each = strings.select("a", "c", "bytes", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    each = staged(each.select("a", "c", F.col("at").cast("long").alias("at"), F.unhex(F.md5(F.col("bytes").substr(F.col("at") + 1, F.lit(SIZE)))).alias("h")), "substrings")
    twice = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    cut = F.xxhash64("h")
    found = each.withColumn("cut", cut).join(twice.withColumn("cut", cut), ["h", "cut"], "left_semi")
    return found.groupBy("a", "c").agg(F.collect_list(F.struct(F.col("at").alias("first"), F.col("at").alias("last"))).alias("runs"))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """k1, k2 and ranges (from, to: bytes) of each text that has passages to remove. Ranges may overlap."""
    places = staged(anchored(docs), "anchors")
    anchors = places.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("least"), F.max("c").alias("most"))
    anchors = staged(anchors.filter("n > 1").select("a", (F.col("least") != F.col("most")).alias("mixed")), "anchors")
    cut = F.xxhash64("a")
    met = places.withColumn("cut", cut).join(anchors.withColumn("cut", cut), ["a", "cut"]).drop("cut")
    met = staged(met.select("k1", "k2", "first", "last", "a", "c", "mixed"), "repeats")
    place = F.min(F.struct("k1", "first")).alias("place")
    counts = met.filter("mixed").groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), place)
    counts = staged(counts.select("a", "c", "n", "place.*"), "contexts")
    small, large = _in_groups(staged(context_bytes(docs, counts), "context-bytes"))
    single = _sorted_shards(small).unionByName(_in_blocks(large))
    single = counts.filter("n = 1").select("a", "c").join(single, ["a", "c"]).filter(F.size("runs") > 0)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))
    known = staged(counts.filter("n > 1").select("a", "c", whole.alias("runs")).unionByName(single), "runs")
    cut = F.xxhash64("a", "c")
    some = met.filter("mixed").withColumn("cut", cut).join(known.withColumn("cut", cut), ["a", "c", "cut"])
    some = some.select("k1", "k2", "first", "last", F.explode("runs").alias("r")).select(
        "k1",
        "k2",
        (F.col("first") + F.col("r.first")).alias("from"),
        (F.coalesce(F.col("first") + F.col("r.last"), F.col("last")) + SIZE).alias("to"),
    )
    same = met.filter("not mixed").select("k1", "k2", F.col("first").alias("from"), (F.col("last") + SIZE).alias("to"))
    # Copies of a text say the same; each range is kept once.
    ranges = same.unionByName(some).distinct()
    return ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, spans (from, to; maximal, in order), kept (the remaining bytes) of every row."""
    ranges = staged(repeated_ranges(docs), "ranges")
    text = _source(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumns({"k1": _text_hash(F.col("text"), 0), "k2": _text_hash(F.col("text"), 1)})
    met = rows.join(ranges, ["k1", "k2"], "left").select("doc_id", "text", "ranges")

    def remove(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for batch in batches:
            sizes, spans, kept = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                sizes.append(len(text))
                if not ranges.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                start, end = (ranges.values.field(k).to_numpy() for k in ("from", "to"))
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                new = np.concatenate([[True], start[1:] > end[:-1]])
                start, end = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                spans.append([{"from": int(x), "to": int(y)} for x, y in zip(start, end, strict=True)])
                cuts = zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)
                kept.append(b"".join(text[x:y] for x, y in cuts))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return met.mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<from:bigint,to:bigint>>, kept binary")


def repeats_digest(cut: DataFrame) -> DataFrame:
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
