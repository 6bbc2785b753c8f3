"""Event-log sources and the snapshot sink."""

from .days import day_range, in_days, read_days, write_days
from .logs import APP_LOG, BOOKING_LOG, TASK_LOG, LogLayout, event_log, read_log, union_logs
from .snapshot import metric_columns, read_snapshot, rename_metrics, snapshot_versions, write_snapshot

__all__ = [
    "APP_LOG",
    "BOOKING_LOG",
    "TASK_LOG",
    "LogLayout",
    "day_range",
    "event_log",
    "in_days",
    "metric_columns",
    "read_days",
    "read_log",
    "read_snapshot",
    "rename_metrics",
    "snapshot_versions",
    "union_logs",
    "write_days",
    "write_snapshot",
]
