"""Time windows and clock arithmetic on TIMESTAMP_NTZ columns.

Nothing here depends on the session time zone: every function reads the wall-clock fields of the
NTZ value directly.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Moment = str | date | datetime


def _moment(value: Moment) -> datetime:
    """The moment on the log's clock, which is UTC: a time with an offset is moved there, one without is taken as it is."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if not isinstance(value, datetime):
        return datetime(value.year, value.month, value.day)
    return value if value.tzinfo is None else value.astimezone(timezone.utc).replace(tzinfo=None)


def timestamp_literal(value: Moment) -> Column:
    return F.lit(_moment(value).isoformat(sep=" ")).cast("timestamp_ntz")


@dataclass(frozen=True)
class TimeWindow:
    """Half-open window ``[lo, hi)`` in local time; the log is ``shift_minutes`` behind local time.

    The shift is taken off the bounds instead of being added to the column, so the comparison is a
    plain ``column >= literal`` that reaches the Parquet reader. ``not_after`` is an inclusive upper
    bound in log time ("up to now").
    """

    lo: Moment | None = None
    hi: Moment | None = None
    shift_minutes: int = 0
    not_after: Moment | None = None

    def contains(self, column: Column) -> Column:
        shift = timedelta(minutes=self.shift_minutes)
        tests = []
        if self.lo is not None:
            tests.append(column >= timestamp_literal(_moment(self.lo) - shift))
        if self.hi is not None:
            tests.append(column < timestamp_literal(_moment(self.hi) - shift))
        if self.not_after is not None:
            tests.append(column <= timestamp_literal(self.not_after))
        return reduce(lambda a, b: a & b, tests) if tests else column.isNotNull()

    def bounds(self) -> tuple[datetime | None, datetime | None]:
        """First and last instant of the window on the log's clock, both in it; None where it is open."""
        shift, tick = timedelta(minutes=self.shift_minutes), timedelta(microseconds=1)
        ends = [] if self.hi is None else [_moment(self.hi) - shift - tick]
        ends += [] if self.not_after is None else [_moment(self.not_after)]
        return None if self.lo is None else _moment(self.lo) - shift, min(ends, default=None)

    def from_start(self) -> TimeWindow:
        """The window without its end: everything a booking inside it can be followed by."""
        return TimeWindow(self.lo, None, self.shift_minutes)


def cutoff_date(as_of: Moment, lag_days: int = 5) -> date:
    """Last excluded day of a rolling window: ``as_of`` minus the maturity lag."""
    return (_moment(as_of) - timedelta(days=lag_days)).date()


def rolling(lo: Moment, as_of: Moment, lag_days: int = 5, shift_minutes: int = 0) -> TimeWindow:
    """Window from ``lo`` to the maturity cutoff before ``as_of``."""
    return TimeWindow(lo, cutoff_date(as_of, lag_days), shift_minutes)


def in_any(column: Column, windows: Iterable[TimeWindow]) -> Column:
    return reduce(lambda a, b: a | b, [w.contains(column) for w in windows])


def period_label(column: Column, windows: Mapping[str, TimeWindow]) -> Column:
    """Label of the first window that holds the time, NULL outside all of them."""
    return F.coalesce(*[F.when(w.contains(column), F.lit(label)) for label, w in windows.items()])


def business_day(column: Column, shift_minutes: int) -> Column:
    return (column + F.make_dt_interval(mins=F.lit(shift_minutes))).cast("date")


def _minute_index(column: Column) -> Column:
    return F.unix_date(column.cast("date")).cast("bigint") * 1440 + F.hour(column) * 60 + F.minute(column)


def hour_index(column: Column) -> Column:
    return F.unix_date(column.cast("date")).cast("bigint") * 24 + F.hour(column)


def hours_between(start: Column, end: Column) -> Column:
    """Hour boundaries crossed from ``start`` to ``end``: 10:59 to 11:01 is 1; may be negative."""
    return hour_index(end) - hour_index(start)


def slice_index(column: Column, minutes: int) -> Column:
    """Number of the ``minutes``-long slice of the clock that holds the time."""
    if minutes < 1:
        raise ValueError(f"a slice has at least one minute, not {minutes}")
    return F.floor(_minute_index(column) / F.lit(minutes)).cast("bigint")
