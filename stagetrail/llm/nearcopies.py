"""Near copies by BagMinHash: signatures of weighted word windows, banded, verified by multiset overlap.

A text is the multiset of its windows of five lower-cased words (a shorter one is one window). A window's weight, its
count, is cut into dyadic intervals [0,1), [1,2), [2,4) and so on; each interval has a Poisson process over the
signature's components, as long as the interval, whose points carry a discretised place in it and count only below
the weight. A component is its earliest point, so two texts agree on it with exactly their weighted Jaccard
probability. Points come in ascending order and a process stops once it is later than all components: a text costs
its length and the signature's, not their product.

Equal texts are one class before anything is compared. In a bucket of a band every text is first compared with the
bucket's leader, which is linear; components of the links found are formed; then texts of one bucket that are still in
different components are compared with each other, unless what is known of them and the leader excludes the similarity
by an exact bound. So no link of a bucket is left out, and a large group of copies costs its size as far as the bound
reaches.

Edge cases: null, empty and wordless texts are equal, one class; ids may be null or repeat, each row keeps its own;
ties go to the smaller id; no rows give no rows; other columns are ignored, or kept by `one_of_each`.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stagetrail.llm.common import batches_of_bytes, components, forget, hash_filter, hashed_words, mixed, passes, staged, text_or_empty, windows_hashed

WIDTH = 5
SIMILAR = 0.8
BANDS, ROWS = 24, 4
COMPONENTS = BANDS * ROWS
#: Numbers of 64 bits that mark which items a text has and its bucket's leader lacks.
WORDS = 16
_COMPARED = StructType([StructField(c, LongType()) for c in ("n_a", "n_b", "both", *[f"m{k}" for k in range(WORDS)])])


def text_key(words: bytes) -> bytes:
    import hashlib

    return hashlib.md5(words, usedforsecurity=False).digest()


def _words(text: bytes) -> bytes:
    return b" ".join(text.split()).lower()


def bag(text: bytes):
    """Windows of a text, and how often each occurs."""
    import numpy as np

    words = hashed_words(text)
    windows = windows_hashed(words, min(WIDTH, max(1, len(words))))
    return np.unique(windows, return_counts=True)


def signatures(bags: list, components: int = COMPONENTS):
    """Earliest point of each component, a row per bag; infinite for an empty bag."""
    import numpy as np

    made = np.full((len(bags), components), np.inf)
    sizes = [len(b[0]) for b in bags]
    doc, seed = np.repeat(np.arange(len(bags)), sizes), np.concatenate([b[0] for b in bags]) if bags else np.empty(0, np.uint64)
    weight = np.concatenate([b[1] for b in bags]) if bags else np.empty(0, np.int64)
    start, parts = np.zeros(len(doc), np.int64), []
    rows = np.arange(len(doc))
    while len(rows):
        parts.append((rows, start[rows]))
        start[rows] = np.maximum(1, start[rows] * 2)
        rows = rows[weight[rows] > start[rows]]
    rows, start = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 2
    length = np.maximum(1, start)
    doc, weight, seed = doc[rows], weight[rows], mixed(seed[rows] + start.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    time, flat = np.zeros(len(doc)), made.reshape(-1)
    while len(doc):
        seed = mixed(seed + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((seed >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / (length * components)
        other = mixed(seed ^ np.uint64(0x5851F42D4C957F2D))
        component = ((other & np.uint64(0xFFFFFFFF)) * np.uint64(components) >> np.uint64(32)).astype(np.int64)
        place = start + ((other >> np.uint64(32)) * 2.0**-32 * length).astype(np.int64)
        counts = place < weight
        np.minimum.at(flat, (doc * components + component)[counts], time[counts])
        some, back = np.unique(doc, return_inverse=True)
        on = time < made[some].max(axis=1)[back]
        doc, weight, seed, time, start, length = (x[on] for x in (doc, weight, seed, time, start, length))
    return made


def _source(docs: DataFrame) -> Column:
    return F.encode(text_or_empty(docs["text"]), "utf-8")


def signed(docs: DataFrame, row: Column) -> DataFrame:
    """A row per row: doc_id, row, text_key, n (windows), signature (an int per component)."""

    def sign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget()
        for some in batches_of_bytes(batches, 2):
            texts = [_words(t) for t in some.column(2).to_pylist()]
            bags = [bag(t) for t in texts]
            bits = signatures(bags).astype("<f4").view("<i4")
            made = [
                pa.array([text_key(t) for t in texts], pa.binary()),
                pa.array([int(c.sum()) for _, c in bags], pa.int64()),
                pa.ListArray.from_arrays(np.arange(0, bits.size + 1, COMPONENTS, dtype=np.int32), pa.array(bits.reshape(-1))),
            ]
            yield pa.record_batch([some.column(0), some.column(1), *made], ["doc_id", "row", "text_key", "n", "signature"])
        forget()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), _source(docs).alias("text"))
    return source.mapInArrow(sign, "doc_id long, row long, text_key binary, n long, signature array<int>")


def _banded(texts: DataFrame) -> DataFrame:
    bands = [F.struct(F.lit(b).alias("band"), F.xxhash64(F.lit(b), F.slice("signature", b * ROWS + 1, ROWS)).alias("bucket")) for b in range(BANDS)]
    return texts.select("text_key", F.explode(F.array(*bands)).alias("b")).select("text_key", "b.band", "b.bucket")


def _key_hash(key: str) -> Column:
    """The first eight bytes of a key as a number."""
    return F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long")


def unit_items(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_key and items of the wanted texts (text_key): a number for each window and each further occurrence of it,
    in order. Texts that are certainly not wanted stay in their task."""
    may = hash_filter(wanted.select(_key_hash("text_key").alias("hash")), "hash")

    def items(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        forget()
        for batch in batches_of_bytes(batches, 0):
            texts = [_words(t) for t in batch.column(0).to_pylist()]
            keys = [text_key(t) for t in texts]
            on = passes(may.value, np.array([int.from_bytes(k[:8], "big") for k in keys], np.uint64))
            some, made = np.flatnonzero(on).tolist(), []
            for i in some:
                windows, counts = bag(texts[i])
                nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                made.append(np.sort(mixed(np.repeat(windows, counts) + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))).tobytes())
            if some:
                yield pa.record_batch([pa.array([keys[i] for i in some], pa.binary()), pa.array(made, pa.binary())], ["text_key", "items"])

    found = docs.select(_source(docs).alias("text")).mapInArrow(items, "text_key binary, items binary")
    return found.groupBy("text_key").agg(F.first("items").alias("items"))


def compared(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs (a, b) with their sizes, the overlap of their multisets, and marks of the items of b that a lacks: one
    of 64 bits in each of `WORDS` numbers for every item."""

    @F.pandas_udf(_COMPARED)
    def overlap(a, b):
        import numpy as np
        import pandas as pd

        made = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            lacks = np.setdiff1d(y, x, assume_unique=True)
            marks = np.zeros(WORDS, np.uint64)
            np.bitwise_or.at(marks, (lacks % np.uint64(WORDS)).astype(np.intp), np.uint64(1) << (lacks >> np.uint64(58)))
            made.append((len(x), len(y), len(y) - len(lacks), *marks.view(np.int64).tolist()))
        return pd.DataFrame(made, columns=_COMPARED.names)

    one, other = (items.select(F.col("text_key").alias(k), F.col("items").alias(f"items_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(other, "b")
    return both.select("a", "b", overlap("items_a", "items_b").alias("r")).select("a", "b", "r.*")


def _enough(both: Column, a: Column, b: Column) -> Column:
    return both >= F.lit(SIMILAR) * (a + b - both)


def linked(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """node and root of the texts (text_key, n, signature) that are similar to another one."""
    rows = _banded(texts)
    shared = rows.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = staged(rows.join(shared, ["band", "bucket"]), "buckets")
    # The text that meets most others leads a bucket: of edited copies that is the one they were made from.
    known = met.groupBy("text_key").agg(F.sum("size").alias("known"))
    led = met.join(known, "text_key").groupBy("band", "bucket").agg(F.max(F.struct("known", "text_key")).alias("most"))
    met = staged(met.join(led.select("band", "bucket", F.col("most.text_key").alias("leader")), ["band", "bucket"]), "buckets")
    stars = met.filter("text_key != leader").select(F.col("leader").alias("a"), F.col("text_key").alias("b")).distinct()
    items = staged(unit_items(docs, met.select("text_key").distinct()), "items")
    stars = staged(compared(stars, items), "stars")
    links = stars.filter(_enough(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")
    roots = components(links)
    more = staged(_between(met, stars, roots, items), "links")
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _between(met: DataFrame, stars: DataFrame, roots: DataFrame, items: DataFrame) -> DataFrame:
    """Links between texts of one bucket that its leader did not bring together.

    Two texts share at most what both share with the leader, and of the items that the leader lacks no more than their
    marks allow. Only pairs for which this could suffice are compared; the bound leaves out no link. One of a pair is
    not linked with the leader, else they would be together."""
    placed = met.join(roots.withColumnRenamed("node", "text_key"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    placed = staged(placed.select("band", "bucket", "text_key", "leader", "root"), "buckets")
    apart = placed.groupBy("band", "bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).filter("least != most")
    placed = placed.join(apart.select("band", "bucket"), ["band", "bucket"])
    own = stars.withColumnsRenamed({"a": "leader", "b": "text_key", "n_b": "n"}).withColumn("linked", _enough(F.col("both"), F.col("n_a"), F.col("n")))
    members = staged(placed.join(own, ["leader", "text_key"]).drop("leader", "n_a"), "members")
    x, y = members.filter(~F.col("linked")).alias("x"), members.alias("y")

    def lacked(one: str, other: str) -> Column:
        """At most how many of one's items that the leader lacks the other can share."""
        alone = sum((F.bit_count(F.col(f"{one}.m{k}").bitwiseAND(F.bitwise_not(F.col(f"{other}.m{k}")))) for k in range(WORDS)), F.lit(0))
        return F.col(f"{one}.n") - F.col(f"{one}.both") - alone

    most = F.least("x.both", "y.both") + F.least(lacked("x", "y"), lacked("y", "x"))
    once = ~F.col("y.linked") & (F.col("x.text_key") < F.col("y.text_key")) | F.col("y.linked")
    near = (
        (F.col("x.band") == F.col("y.band"))
        & (F.col("x.bucket") == F.col("y.bucket"))
        & (F.col("x.root") != F.col("y.root"))
        & once
        & (F.least("x.n", "y.n") >= F.lit(SIMILAR) * F.greatest("x.n", "y.n"))
        & _enough(most, F.col("x.n"), F.col("y.n"))
    )
    pairs = x.join(y, near).select(F.least("x.text_key", "y.text_key").alias("a"), F.greatest("x.text_key", "y.text_key").alias("b")).distinct()
    return compared(pairs, items).filter(_enough(F.col("both"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def classed(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, row, text_key and the key of its class, for every row."""
    rows = staged(signed(docs, F.lit(0).cast("long") if row is None else row), "signatures")
    texts = staged(rows.groupBy("text_key").agg(F.first("n").alias("n"), F.first("signature").alias("signature")), "texts")
    roots = staged(linked(docs, texts), "roots").withColumnRenamed("node", "text_key")
    return rows.select("doc_id", "row", "text_key").join(roots, "text_key", "left").withColumn("class", F.coalesce("root", "text_key")).drop("root")


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size."""
    rows = staged(classed(docs).select("doc_id", "class"), "classes")
    classes = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return _split_join(rows, classes).select("doc_id", "class_id", "class_size")


def _split_join(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """By class. The second key keeps the aggregate's partitioning from being reused, so a large class is split."""
    cut = F.xxhash64("class")
    return rows.withColumn("cut", cut).join(classes.withColumn("cut", cut), ["class", "cut"]).drop("cut")


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class, that of the smallest id; columns, of whatever type, as they are.

    Rows are numbered and written once, so a number stays with its row whatever `docs` is made from."""
    number = "_" + "_".join(["row", *docs.columns])
    numbered = staged(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = classed(numbered, F.col(number))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    stay = rows.groupBy("class").agg(F.min(first).alias("first")).select(F.col("first.row").alias(number))
    kept = numbered.join(stay, number, "left_semi")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
