"""Exact distinct counts by bitmaps over dense entity numbers.

A bitmap of 32768 numbers takes 4 KB, is built in the task that reads the rows and is merged by ``or``. So what is
shuffled for a group are its bitmaps, at most one per 32768 entities and task, in place of its (group, entity) pairs.
That pays where the numbers are dense and many entities share a group; sparse numbers stay right, but make a bitmap for
every few entities.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pivot import StageSpec, any_stage

#: Parts in which entities are numbered; the parts' sizes are the only thing that one task sees of all.
PARTS = 1024
NUMBER = "entity_no"


def entity_numbers(log: DataFrame, known: DataFrame | None = None, parts: int = PARTS) -> DataFrame:
    """``entity`` and ``entity_no`` of the log's entities that ``known`` lacks, dense from 1 or after the last known."""
    found, base = log.select("entity").filter(F.col("entity").isNotNull()).distinct(), 0
    if known is not None:
        found, base = found.join(known, "entity", "left_anti"), known.agg(F.max(NUMBER)).first()[0] or 0
    found = found.withColumn("part", F.pmod(F.xxhash64("entity"), F.lit(parts)))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = found.groupBy("part").agg(F.count("*").alias("entities")).select("part", F.coalesce(F.sum("entities").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("entity"))
    return found.withColumn("place", place).join(F.broadcast(starts), "part").select("entity", (F.col("place") + F.col("start") + base).alias(NUMBER))


def with_numbers(log: DataFrame, numbers: DataFrame) -> DataFrame:
    """The log with its entities' numbers, to be stored with it; nobody has none."""
    return log.join(numbers, "entity", "left").select(*log.columns, NUMBER)


def _bitmaps(rows: DataFrame, keys: Sequence[str], number: Column) -> DataFrame:
    return rows.groupBy(*keys, F.bitmap_bucket_number(number).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits"))


def distinct_entities(rows: DataFrame, keys: Sequence[str], number: Column | str = NUMBER, out: str = "distinct_users") -> DataFrame:
    """Distinct numbers per group; a group of nobody counts 0."""
    number = F.col(number) if isinstance(number, str) else number
    return _bitmaps(rows, keys, number).groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias(out))


def period_stage_distincts_by_bitmap(
    cohorts: Mapping[str, StageSpec],
    events: DataFrame,
    stages: Sequence[StageSpec],
    cohort_stage: str = "app_installed",
    number: Column | str = NUMBER,
) -> DataFrame:
    """``period_stage_distincts`` of cohorts found in the same log, by the ``and`` of a cohort's and a stage's bitmaps."""
    number = F.col(number) if isinstance(number, str) else number
    specs, labels = [*cohorts.values(), *stages], list(cohorts)
    n = len(specs)
    # Which of the sets (cohorts, then stages) a row puts its entity into.
    sets = F.filter(F.array(*[F.when(s.matches(), F.lit(i)) for i, s in enumerate(specs)]), lambda i: i.isNotNull())
    rows = events.filter(any_stage(specs) & number.isNotNull()).select(number.alias("number"), F.explode(sets).alias("set"))
    bitmaps = _bitmaps(rows, ["set"], F.col("number"))
    # A cohort's set meets itself and every stage's: p * n + s.
    meets = F.array(*[F.struct(F.lit(x).alias("set"), F.lit(p * n + s).alias("pair")) for p in range(len(labels)) for s in [p, *range(len(labels), n)] for x in {p, s}])
    pairs = bitmaps.select("bucket", "bits", F.explode(F.filter(meets, lambda m: m["set"] == F.col("set"))["pair"]).alias("pair"))
    both = pairs.groupBy("pair", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("sets"))
    alone = F.floor(F.col("pair") / n) == F.col("pair") % n
    sizes = both.filter(alone | (F.col("sets") == 2)).select("pair", F.bitmap_count("bits").alias("entities"))
    totals = sizes.agg(
        *[F.coalesce(F.sum(F.when(F.col("pair") == p * n + s, F.col("entities"))), F.lit(0).cast("bigint")).alias(f"c{p}_{s}") for p in range(len(labels)) for s in [p, *range(len(labels), n)]]
    )
    lines = [
        F.struct(
            F.lit(label).alias("period"),
            F.col(f"c{p}_{p}").alias(cohort_stage),
            *[F.col(f"c{p}_{len(labels) + k}").alias(stage.name) for k, stage in enumerate(stages)],
        )
        for p, label in enumerate(labels)
    ]
    return totals.select(F.inline(F.array(*lines)))
