"""A log stored by day, of which a query reads the days that its windows touch."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import TimeWindow, business_day
from .logs import EVENT_LOG_COLUMNS

DAY = "day"
SCHEMA = f"source string, entity string, event_name string, event_time timestamp_ntz, payload string, {DAY} date"


def write_days(log: DataFrame, path: str, shift_minutes: int = 0, files_per_day: int = 8) -> None:
    """Write the log's rows by local day; days that ``log`` has rows of replace what was stored of them.

    The rows of a day are dealt over ``files_per_day`` files by entity and time, so one entity does not make one large
    file, and lie there by event name, so a reader that wants a few names skips most row groups.
    """
    rows = log.select(*EVENT_LOG_COLUMNS, business_day(F.col("event_time"), shift_minutes).alias(DAY))
    file = F.pmod(F.xxhash64("entity", "event_time"), F.lit(files_per_day))
    (
        rows.repartition(F.col(DAY), file)
        .sortWithinPartitions(DAY, "event_name", "entity")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(DAY)
        .parquet(path)
    )


def day_range(window: TimeWindow, shift_minutes: int = 0) -> tuple[date | None, date | None]:
    """First and last local day that the window touches; None where it is open."""
    lo, hi = window.bounds()
    shift = timedelta(minutes=shift_minutes)
    return (lo if lo is None else (lo + shift).date()), (hi if hi is None else (hi + shift).date())


def in_days(windows: Iterable[TimeWindow], shift_minutes: int = 0, column: str = DAY) -> Column:
    """Whether a day is touched by any of the windows."""

    def touched(window: TimeWindow) -> Column:
        first, last = day_range(window, shift_minutes)
        tests = [F.col(column) >= F.lit(first)] if first is not None else []
        tests += [F.col(column) <= F.lit(last)] if last is not None else []
        return reduce(lambda a, b: a & b, tests) if tests else F.lit(True)

    return reduce(lambda a, b: a | b, [touched(w) for w in windows])


def read_days(spark: SparkSession, path: str, windows: Iterable[TimeWindow] | None = None, shift_minutes: int = 0) -> DataFrame:
    """The stored log; with ``windows``, only the days that one of them touches.

    The days are whole, so operators still test the windows themselves. Rows without a time are in no day.
    """
    stored = spark.read.schema(SCHEMA).parquet(path)
    if windows is not None:
        stored = stored.filter(in_days(windows, shift_minutes))
    return stored.select(*EVENT_LOG_COLUMNS)
