"""Event logs, normalised to one shape.

``EventLog`` columns: ``source`` (which log), ``entity`` (whose event), ``event_name``,
``event_time`` (TIMESTAMP_NTZ) and ``payload`` (JSON text). Every operator reads these five.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampNTZType

EVENT_LOG_COLUMNS = ("source", "entity", "event_name", "event_time", "payload")


def event_log(
    df: DataFrame,
    source: str,
    entity: Column | str,
    event_name: Column | str,
    event_time: Column | str,
    payload: Column | str | None = None,
) -> DataFrame:
    def column(c: Column | str) -> Column:
        return F.col(c) if isinstance(c, str) else c

    return df.select(
        F.lit(source).alias("source"),
        column(entity).cast("string").alias("entity"),
        column(event_name).alias("event_name"),
        column(event_time).cast("timestamp_ntz").alias("event_time"),
        (F.lit(None).cast("string") if payload is None else column(payload)).alias("payload"),
    )


@dataclass(frozen=True)
class LogLayout:
    """How a stored log names its columns."""

    source: str
    entity: str
    event_name: str
    event_time: str
    payload: str | None = None

    def schema(self) -> StructType:
        fields = [
            StructField(self.entity, StringType()),
            StructField(self.event_name, StringType()),
            StructField(self.event_time, TimestampNTZType()),
        ]
        if self.payload is not None:
            fields.append(StructField(self.payload, StringType()))
        return StructType(fields)


# Column names of the three stored logs.
BOOKING_LOG = LogLayout("booking", "mobile", "event_name", "added_time", "data")
TASK_LOG = LogLayout("task", "mobile", "event_name", "added_time")
APP_LOG = LogLayout("app", "user_id", "event_name", "timestamp", "properties")


def read_log(spark: SparkSession, path: str, layout: LogLayout) -> DataFrame:
    """Read a Parquet log with its declared schema, so no file is opened to infer one.

    Times must be stored as wall-clock timestamps. Pass a log that stores instants to ``event_log``,
    which casts them in the session's zone.
    """
    stored = spark.read.schema(layout.schema()).parquet(path)
    return event_log(stored, layout.source, layout.entity, layout.event_name, layout.event_time, layout.payload)


def union_logs(*logs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), logs)
