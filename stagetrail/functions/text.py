"""Report arithmetic and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, total: Column) -> Column:
    """``part`` as an unrounded percentage of ``total``; 0 where the total is not positive."""
    return F.when(total > 0, part / total * 100).otherwise(F.lit(0.0))


def pct(part: Column, total: Column) -> Column:
    return F.round(share(part, total), 1)


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def percent_text(number: Column) -> Column:
    return F.format_string("%.1f%%", number)


def signed_percent_text(number: Column) -> Column:
    return F.format_string("%+.1f%%", number)


def iso_date(day: Column) -> Column:
    return day.cast("date").cast("string")


def short_date(day: Column) -> Column:
    return F.date_format(day, "MMM d")


def minute_stamp(time: Column) -> Column:
    return F.substring(time.cast("timestamp_ntz").cast("string"), 1, 16)
