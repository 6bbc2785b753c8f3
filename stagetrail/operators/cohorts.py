"""Cohorts: who enters an analysis, and when."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import TimeWindow, json_int, json_text, json_upper
from .timeline import SLICE_MINUTES, with_next_instant, with_next_time


def anchor_events(log: DataFrame, anchor: str, window: TimeWindow, key_floor: str | None = None) -> DataFrame:
    """Log rows of the anchor event inside the window; the floor compares keys as text."""
    rows = log.filter((F.col("event_name") == anchor) & window.contains(F.col("event_time")))
    return rows if key_floor is None else rows.filter(F.col("entity") >= key_floor)


def booking_cohort(log: DataFrame, anchor: str, window: TimeWindow, key_floor: str | None = None) -> DataFrame:
    """Distinct entities with the anchor event in the window."""
    return anchor_events(log, anchor, window, key_floor).select("entity").distinct()


def first_booking_cohort(log: DataFrame, anchor: str, window: TimeWindow, key_floor: str | None = None) -> DataFrame:
    """Entities with the time of their earliest anchor event in the window."""
    return (
        anchor_events(log, anchor, window, key_floor)
        .groupBy("entity")
        .agg(F.min("event_time").alias("booking_time"))
    )


def first_time_users(log: DataFrame, event: str, window: TimeWindow, counter_key: str, count: int = 1) -> DataFrame:
    """Distinct entities whose lifetime counter, as recorded on the event, equals ``count``."""
    return (
        anchor_events(log, event, window)
        .filter(json_int(F.col("payload"), counter_key) == count)
        .select("entity")
        .distinct()
    )


def variant_touch_columns(allowed: Sequence[str]) -> list[str]:
    return [f"touch_{i}" for i in range(len(allowed))]


def variant_first_touch(
    log: DataFrame, event: str, window: TimeWindow, variant_key: str, allowed: Sequence[str]
) -> DataFrame:
    """Variant and time of each entity's earliest qualifying event.

    One ``min`` per allowed variant, compared afterwards in the row: no sort and no ranking of a hot
    entity's events. Two variants at the same instant resolve in the order of ``allowed``.
    """
    touches = anchor_events(log, event, window).select(
        "entity", "event_time", json_upper(F.col("payload"), variant_key).alias("variant")
    )
    names = variant_touch_columns(allowed)
    firsts = (
        touches.filter(F.col("variant").isin(*allowed))
        .groupBy("entity")
        .agg(
            *[
                F.min(F.when(F.col("variant") == v, F.col("event_time"))).alias(n)
                for n, v in zip(names, allowed, strict=True)
            ]
        )
    )
    return pick_first_touch(firsts, allowed)


def pick_first_touch(firsts: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Replace the per-variant touch times by ``variant`` and ``gs_time``."""
    names = variant_touch_columns(allowed)
    earliest = F.least(*names) if len(names) > 1 else F.col(names[0])
    chosen = F.coalesce(
        *[F.when(F.col(n) == earliest, F.lit(v)) for n, v in zip(names, allowed, strict=True)]
    )
    kept = [c for c in firsts.columns if c not in names and c != "entity"]
    return firsts.select("entity", chosen.alias("variant"), earliest.alias("gs_time"), *kept)


def latest_per_transaction(log: DataFrame, json_key: str) -> DataFrame:
    """Latest row of each transaction id; all rows without an id count as one transaction.

    The rank filter runs before the shuffle as well as after it, so the shared NULL id sends at most
    one row per map task. Rows equal in time are ordered by their remaining columns.
    """
    by_transaction = Window.partitionBy("transaction_id").orderBy(
        F.desc("event_time"), F.asc_nulls_first("entity"), F.asc_nulls_first("event_name"), F.asc_nulls_first("payload")
    )
    return (
        log.withColumn("transaction_id", json_text(F.col("payload"), json_key))
        .withColumn("rank", F.row_number().over(by_transaction))
        .filter(F.col("rank") == 1)
        .drop("rank")
    )


def booking_intervals(
    log: DataFrame,
    anchor: str,
    window: TimeWindow,
    dedupe_key: str | None = None,
    key_floor: str | None = None,
    slice_minutes: int = SLICE_MINUTES,
) -> DataFrame:
    """Bookings with the time of the entity's next booking in the window.

    The next time is taken before duplicates of a transaction are removed, so a removed booking still
    ends the interval before it. Of equal rows the one with the later end survives.
    """
    bookings = anchor_events(log, anchor, window, key_floor).select("entity", "event_time", "payload")
    if dedupe_key is None:
        times = with_next_time(bookings.select("entity", "event_time"), "entity", "event_time", "next_booking_time", slice_minutes=slice_minutes)
        return times.withColumnRenamed("event_time", "booking_time")
    # Of the rows of one instant only the last by payload, one row, looks for the next time; that of all others is their
    # own. It is among the others too, but there with the earlier end, and one row of a transaction survives.
    # Both read the count of equal rows, so Spark shuffles them once for both.
    rows = bookings.groupBy(*bookings.columns).agg(F.count("*").alias("copies"))
    marked = rows.withColumn("last", F.struct("payload", "copies"))
    last = with_next_instant(marked, "entity", "event_time", "next_booking_time", "last", slice_minutes)
    others = rows.filter("copies > 0").select("entity", "event_time", "payload", F.col("event_time").alias("next_booking_time"))
    followed = last.select("entity", "event_time", "last.payload", "next_booking_time").unionByName(others).withColumnRenamed("event_time", "booking_time")
    latest = Window.partitionBy("transaction_id").orderBy(
        F.desc("booking_time"),
        F.asc_nulls_first("entity"),
        F.asc_nulls_first("payload"),
        F.desc_nulls_first("next_booking_time"),
    )
    return (
        followed.withColumn("transaction_id", json_text(F.col("payload"), dedupe_key))
        .withColumn("rank", F.row_number().over(latest))
        .filter(F.col("rank") == 1)
        .select("entity", "booking_time", "next_booking_time")
    )
