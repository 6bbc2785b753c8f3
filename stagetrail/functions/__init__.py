"""Column-level helpers: time windows, JSON payload access, report text."""

from .payload import json_int, json_text, json_upper
from .text import iso_date, minute_stamp, pct, percent_text, share, short_date, signed_percent_text, thousands
from .time import TimeWindow, business_day, hour_index, hours_between, in_any, period_label, rolling, slice_index

__all__ = [
    "TimeWindow",
    "business_day",
    "hour_index",
    "hours_between",
    "in_any",
    "iso_date",
    "json_int",
    "json_text",
    "json_upper",
    "minute_stamp",
    "pct",
    "percent_text",
    "period_label",
    "rolling",
    "share",
    "short_date",
    "signed_percent_text",
    "slice_index",
    "thousands",
]
