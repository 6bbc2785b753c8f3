"""Reach funnels from a table of what each entity did on each day.

The table has a row per day and entity with the entity's stage masks, without any window. Masks of days are merged by
``bit_or``, so a refresh computes the days that are new and a funnel over any windows merges the days inside them; only
where a window begins or ends within a day are the log's rows of that day read. The table is partitioned by day, so days
outside all windows are not opened, and bucketed by entity, so its rows are merged without a shuffle. An entity has at
most one row a day there, however much of the log is its; the log itself is not bucketed, as a third of it may be one
entity's, which would then be one task's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import TimeWindow, business_day
from ..functions.time import Moment, _moment
from .pivot import StageSpec, any_stage, bit, entity_masks, has, masks_of, member_masks, merged

_TICK = timedelta(microseconds=1)


def _between(first: date, end: date) -> Column:
    """Whether the row's day lies between; the first of all dates is no bound."""
    test = F.col("day") <= F.lit(end.isoformat()).cast("date")
    return test if first == date.min else test & (F.col("day") >= F.lit(first.isoformat()).cast("date"))


class DailyMasks:
    """Masks of a cohort's event and a funnel's stages by local day, stored under ``path``.

    The specs say what counts; their windows are left out and given to ``reach``. The path belongs to these specs.
    """

    def __init__(self, spark: SparkSession, path: str, cohort: StageSpec, stages: Sequence[StageSpec], buckets: int = 64, shift_minutes: int = 0):
        self.spark, self.path, self.buckets, self.shift = spark, path, buckets, shift_minutes
        self.specs = [replace(s, window=None) for s in (cohort, *stages)]
        self.masks = [*self._masks(self.specs)]
        self.table = f"daily_masks_{hashlib.md5(path.encode()).hexdigest()}"
        self._open()

    def _masks(self, specs: Sequence[StageSpec]) -> dict[str, Column]:
        return member_masks(specs[0].matches(), [s.matches() for s in specs[1:]])

    def _open(self) -> None:
        columns = ", ".join(["entity STRING", *[f"{m} BIGINT" for m in self.masks], "day DATE"])
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(folder)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({columns}) USING parquet PARTITIONED BY (day) "
            f"CLUSTERED BY (entity) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        self.spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def last_day(self) -> date | None:
        """The last day in the table."""
        days = [r[0].removeprefix("day=") for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect()]
        return max((date.fromisoformat(d) for d in days), default=None)

    def refresh(self, log: DataFrame, as_of: Moment, again: int = 0) -> tuple[date | None, date]:
        """Add the days that are over by ``as_of`` and not yet stored, and compute the last ``again`` of the stored days
        once more, for rows that came late. Returns the first and the last day computed.

        Days replace themselves, so a refresh that died can be repeated.
        """
        over = (_moment(as_of) + timedelta(minutes=self.shift)).date() - timedelta(days=1)
        last = self.last_day()
        first = None if last is None else last + timedelta(days=1 - again)
        if first is not None and first > over:
            return first, over
        new = TimeWindow(first, over + timedelta(days=1), self.shift)
        rows = log.filter(any_stage([replace(s, window=new) for s in self.specs]))
        marked = rows.select("entity", *[m.alias(n) for n, m in self._masks(self.specs).items()], business_day(F.col("event_time"), self.shift).alias("day"))
        masks = marked.groupBy("entity", "day").agg(*merged(self.masks)).select("entity", *self.masks, "day")
        # The last day is there even if nothing happened on it, else it would be read again every time.
        end = self.spark.range(1).select(F.lit(None).cast("string").alias("entity"), *[F.lit(0).cast("bigint").alias(m) for m in self.masks], F.lit(over).alias("day"))
        rows = masks.unionByName(end).repartition(F.col("day"), F.pmod(F.hash("entity"), F.lit(self.buckets)))
        # A writer's own option for this does not reach a table of the catalog.
        mode = "spark.sql.sources.partitionOverwriteMode"
        before = self.spark.conf.get(mode)
        self.spark.conf.set(mode, "dynamic")
        try:
            rows.write.insertInto(self.table, overwrite=True)
        finally:
            self.spark.conf.set(mode, before)
        return first, over

    def _whole_days(self, window: TimeWindow | None, last: date | None) -> tuple[date, date] | None:
        """First and last stored day that lies in the window as a whole."""
        if last is None:
            return None
        lo, hi = (None, None) if window is None else window.bounds()
        shift = timedelta(minutes=self.shift)
        first = date.min if lo is None else (lo + shift - _TICK).date() + timedelta(days=1)
        end = last if hi is None else min(last, (hi + shift + _TICK).date() - timedelta(days=1))
        return (first, end) if first <= end else None

    def _rest(self, window: TimeWindow | None, days: tuple[date, date] | None) -> list[TimeWindow]:
        """What of the window the days leave."""
        window = window or TimeWindow()
        if days is None:
            return [window]
        lo, hi = window.bounds()
        shift = timedelta(minutes=self.shift)
        start, after = (datetime.combine(d, time()) for d in (days[0], days[1] + timedelta(days=1)))
        before = [TimeWindow(lo, start - shift)] if lo is not None and days[0] > date.min and lo < start - shift else []
        return before + ([TimeWindow(after - shift, None, 0, hi)] if hi is None or hi >= after - shift else [])

    def reach(self, log: DataFrame, windows: Mapping[str, TimeWindow | None], cutoff: date | None = None) -> DataFrame:
        """``reach_funnel`` of the cohort and stages in ``windows`` (by name; a stage without one counts at any time).

        ``log`` is read for parts of days, and for days that are not stored, only.
        """
        last = self.last_day()
        days = [self._whole_days(windows.get(s.name), last) for s in self.specs]
        parts = []
        if whole := [d for d in days if d is not None]:
            first, end = min(d[0] for d in whole), max(d[1] for d in whole)
            stored = self.spark.table(self.table).filter(_between(first, end))
            counted = [F.lit(False) if d is None else has("mask", i) & _between(*d) for i, d in enumerate(days)]
            parts.append(stored.select("entity", *[m.alias(n) for n, m in masks_of(counted).items()]))
        rest = [[replace(s, window=w) for w in self._rest(windows.get(s.name), d)] for s, d in zip(self.specs, days, strict=True)]
        if some := [s for specs in rest for s in specs]:
            tests = [reduce(lambda a, b: a | b, [s.matches() for s in specs], F.lit(False)) for specs in rest]
            rows = log.filter(any_stage(some))
            parts.append(rows.select("entity", *[m.alias(n) for n, m in member_masks(tests[0], tests[1:]).items()]))
        rows = reduce(DataFrame.unionByName, parts)
        masks = entity_masks(rows, {n: F.col(n) for n in self.masks}).filter(has("mask", 0))
        names = [s.name for s in self.specs[1:]]
        totals = masks.agg(F.count("*").alias("total_customers"), *[F.sum(bit("mask", i + 1)).alias(n) for i, n in enumerate(names)])
        extra = [] if cutoff is None else [F.lit(cutoff).alias("post_end_date")]
        return totals.select("total_customers", *extra, *names)
