"""What the operators share: tables, staged results, the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow and Python take a text in UTF-8; `bytes.split()` then cuts at exactly x20 and x09-x0D.
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder. Where none is set, a new one of this machine's, but only if it runs everything."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Spark's setting by which what a query has shuffled is removed when it ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, name: str, last: bool = False, by: str | None = None) -> DataFrame:
    """`df`, written to the shared folder and read from there: lineage ends, every executor can read it again. `last`:
    `df` itself is not read again, so what it has shuffled need not stay on disk; `by`: a column whose values get folders
    of their own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    if last:
        spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path, partitionBy=by)
    finally:
        if last:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def unstaged(df: DataFrame) -> None:
    """Deletes the folder of a staged result that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def small_batches(batches: Iterator, rows: int = 1000) -> Iterator:
    """Arrow batches of fewer rows, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batches_of_bytes(batches: Iterator, column: int, size: int = 4 << 20, rows: int = 1000) -> Iterator:
    """Arrow batches cut so that the texts of each hold about `size` bytes at most, or are one row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + size, "right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


#: By name, what empties a store that a worker keeps from task to task.
STORES: dict[str, Callable[[], None]] = {}


def forget(but: str = "") -> None:
    """Empties the worker's stores but one, left by operators before, and gives freed memory back to the system."""
    import ctypes

    for name, empty in STORES.items():
        if name != but:
            empty()
    # Only some C libraries have it.
    getattr(ctypes.CDLL(None), "malloc_trim", id)(0)


def kept_whole(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with `columns`, computed once a row: a later lambda that uses one does not compute it again."""
    made = F.struct(*[c.alias(k) for k, c in columns.items()])
    return df.select("*", F.explode(F.array(made)).alias("_made")).select("*", "_made.*").drop("_made")


def hashed_words(text: bytes):
    """A 64-bit hash of each word, as numpy numbers."""
    import numpy as np
    import xxhash

    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x):
    """The finalizer of splitmix64: every bit of the result depends on every bit of `x`."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows_hashed(hashes, width: int, at=None):
    """A hash of each `width` neighbours; none if there are fewer. `at`: of those only that begin there."""
    import numpy as np

    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    made = np.zeros(n if at is None else len(at), np.uint64)
    for k in range(width):
        made = made * np.uint64(0x9E3779B97F4A7C15) + (hashes[k : k + n] if at is None else hashes[at + k])
        made ^= made >> np.uint64(29)
    return mixed(made)


#: log2 of the bits of a filter of hashes. Its size is fixed: with more hashes it only lets more pass, and whoever
#: uses it joins exactly afterwards.
FILTER_BITS = 26


def hash_filter(hashes: DataFrame, column: str, bits: int = FILTER_BITS):
    """A Spark broadcast of a bit per hash (long), set if a hash with these top bits is in `hashes`."""
    import numpy as np

    slot = F.shiftrightunsigned(F.col(column), 64 - bits)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))
    found = hashes.groupBy(F.shiftright(slot, 5).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    made = np.zeros(1 << (bits - 5), np.uint32)
    made[found["word"].to_numpy()] = found["bits"].to_numpy().astype(np.uint32)
    return hashes.sparkSession.sparkContext.broadcast(made)


def passes(bitmap, hashes):
    """Which of the numpy hashes the filter lets pass."""
    import numpy as np

    slot = hashes >> np.uint64(64 - (len(bitmap).bit_length() - 1 + 5))
    return (bitmap[slot >> np.uint64(5)] >> (slot & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def components(edges: DataFrame) -> DataFrame:
    """node and root of each node of `edges` (a, b): the smallest node that it is connected with.

    Large star and small star in turn: a node's neighbours are linked with its smallest one. Every round is written,
    minima combine before their shuffle, and the joins are split if one node has very many links. It ends when the
    links no longer change."""
    links = staged(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = staged(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 2**31)).first()
        if now == state:
            break
        state = now
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
