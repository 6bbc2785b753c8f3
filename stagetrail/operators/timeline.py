"""Ordering per entity without putting a whole entity into one task.

A window over ``partitionBy(entity)`` sorts everything an entity ever did in one task. Here the
timeline is cut into slices of the clock. Rows are ordered inside (entity, slice), and what one slice
hands to the next is worked out on a summary of one row per slice, whose size per entity is bounded by
the length of the log and not by its traffic. Rows of one entity at one instant are alike to the
timeline, so callers merge them first (in each task, before the shuffle) or keep instants with very
many rows out of it, see ``crowded_instants``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import slice_index

SLICE = "time_slice"
SLICE_MINUTES = 10
# Events of one entity at one instant that a task may sort, and the numbers by which they are counted first.
CROWD = 100_000
BUCKETS = 1 << 16


def with_next_time(
    rows: DataFrame, key: str, time: str, out: str, tie: Sequence[str] = (), slice_minutes: int = SLICE_MINUTES
) -> DataFrame:
    """Add the time of the key's next row, NULL for its last; a NULL key is a key of its own.

    Rows of nothing but key and time are counted per instant before anything is ordered, so any number of equal
    ones is one row; with other columns every row is ordered.
    """
    if set(rows.columns) != {key, time}:
        return _led(rows, key, time, out, tie, slice_minutes)
    led = _led(rows.groupBy(key, time).agg(F.count("*").alias("copies")), key, time, out, (), slice_minutes)
    # All but one of equal rows are followed by another at their own time.
    copies = led.select(*rows.columns, out, F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    return copies.select(*rows.columns, F.when(F.col("copy") == 1, F.col(out)).otherwise(F.col(time)).alias(out))


def with_next_instant(rows: DataFrame, key: str, time: str, out: str, last: str, slice_minutes: int = SLICE_MINUTES) -> DataFrame:
    """One row per key and instant, with the largest of the column ``last`` there and the time of the next instant."""
    instants = rows.groupBy(key, time).agg(F.max(last).alias(last))
    return _led(instants, key, time, out, (), slice_minutes)


def _led(rows: DataFrame, key: str, time: str, out: str, tie: Sequence[str], slice_minutes: int) -> DataFrame:
    in_slice = Window.partitionBy(key, SLICE)
    ordered = in_slice.orderBy(time, *[F.asc_nulls_first(c) for c in tie])
    sliced = rows.withColumn(SLICE, slice_index(F.col(time), slice_minutes))
    led = sliced.withColumn(out, F.lead(time).over(ordered))
    inner = led.filter(F.col(out).isNotNull()).select(*rows.columns, out)
    # The last row of each slice looks at the first time of the key's next slice.
    last = (
        led.withColumn("first_time", F.min(time).over(in_slice))
        .filter(F.col(out).isNull())
        .withColumn(out, F.lead("first_time").over(Window.partitionBy(key).orderBy(SLICE)))
        .select(*rows.columns, out)
    )
    return inner.unionByName(last)


def carry_forward(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    used: Sequence[str] = (),
    slice_minutes: int = SLICE_MINUTES,
) -> DataFrame:
    """Replace each value by the running maximum up to the row; ``order`` starts with the time.

    For values that only grow along a key's timeline the running maximum is the latest value. Name in
    ``used`` the other columns that are sure to be read from the result: then the rows are scanned and
    shuffled once, otherwise a narrow second time for the summary of the slices.
    """
    sliced = rows.withColumn(SLICE, slice_index(F.col(order[0]), slice_minutes)).repartition(*keys, SLICE)
    up_to_row = (
        Window.partitionBy(*keys, SLICE)
        .orderBy(*[F.asc_nulls_last(c) for c in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before_slice = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    running = sliced.withColumns({f"running_{v}": F.max(v).over(up_to_row) for v in values})
    # Touching the used columns here makes both branches read the same ones, so Spark shares the shuffle.
    carried = (
        sliced.groupBy(*keys, SLICE)
        .agg(*[F.max(v).alias(v) for v in values], F.max(F.xxhash64(*order, *used)).alias("touched"))
        .filter(F.col("touched").isNotNull())
        .select(*keys, SLICE, *[F.max(v).over(before_slice).alias(f"carried_{v}") for v in values])
        .filter(F.coalesce(*[F.col(f"carried_{v}") for v in values]).isNotNull())
    )
    return running.join(carried, [*keys, SLICE], "left").select(
        *[c for c in rows.columns if c not in values],
        *[F.coalesce(f"running_{v}", f"carried_{v}").alias(v) for v in values],
    )


def _crowded_buckets(events: DataFrame, key: str, time: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Key and time of the events with a hash of both, and the hashes that so many events have that an instant may be
    crowded. What is counted has ``BUCKETS`` rows a task at most, and at most 8192 hashes are above an 8192nd."""
    told = events.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time)
    told = told.withColumn("bucket", F.pmod(F.xxhash64(key, time), F.lit(BUCKETS)))
    counted = told.groupBy("bucket").agg(F.count("*").alias("events"))
    limit = F.greatest(F.lit(rows), F.sum("events").over(Window.partitionBy()) / 8192).alias("limit")
    return told, counted.select("bucket", "events", limit).filter(F.col("events") > F.col("limit")).select("bucket", "limit")


def any_crowd(events: DataFrame, key: str = "entity", time: str = "event_time", rows: int = CROWD) -> bool:
    """Whether some instant may be crowded. Reads the events' keys and times now; an operator that asks gives the same
    result either way."""
    return not _crowded_buckets(events, key, time, rows)[1].isEmpty()


def crowded_instants(events: DataFrame, key: str = "entity", time: str = "event_time", rows: int = CROWD) -> DataFrame:
    """The instants of a key with more than ``rows`` events, and more than an 8192nd of all: at most 8192.

    Only events whose hash is that of a possibly crowded instant are counted by instant. A NULL key or time has none.
    """
    told, full = _crowded_buckets(events, key, time, rows)
    some = told.join(F.broadcast(full), "bucket")
    return some.groupBy(key, time).agg(F.count("*").alias("events"), F.max("limit").alias("limit")).filter(F.col("events") > F.col("limit")).select(key, time)
