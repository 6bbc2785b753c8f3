"""Exploratory counts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import TimeWindow, in_any, period_label
from ..functions.membership import may_be_in
from .distinct import distinct_entities

#: log2 of the bits of a filter of event names: 128 KB.
NAME_BITS = 20


def event_search_by_period(
    log: DataFrame,
    pattern: str,
    windows: Mapping[str, TimeWindow],
    number: Column | str | None = None,
    names: DataFrame | None = None,
) -> DataFrame:
    """Distinct entities per (period, event) for events whose name contains the text in any case.

    ``number``: the entities' dense numbers, if the log has them; they are then counted by bitmaps. ``names``: the log's
    event names (``event_name``, at least all of them), as ``event_names`` gives; they are searched first, and only
    rows that may have a name found there are searched again.
    """
    time, matches = F.col("event_time"), F.lower("event_name").contains(pattern.lower())
    found = log.filter(in_any(time, windows.values()))
    if names is not None:
        found = found.filter(may_be_in(names.filter(matches), "event_name", NAME_BITS)(F.col("event_name")))
    found = found.filter(matches)
    found = found.withColumn("period", period_label(time, windows))
    keys = ["period", "event_name"]
    if number is None:
        counted = found.groupBy(*keys).agg(F.count_distinct("entity").alias("distinct_users"))
    else:
        counted = distinct_entities(found, keys, number)
    return counted.orderBy("period", F.desc("distinct_users"), "event_name")


def event_names(log: DataFrame) -> DataFrame:
    """The dictionary of a log's event names, to be stored beside it."""
    return log.select("event_name").distinct()


def cohort_top_events(cohort: DataFrame, log: DataFrame, window: TimeWindow, k: int = 30, prune: bool = False) -> DataFrame:
    """The cohort's ``k`` events with most distinct entities; ties go to the name that sorts first.

    The log is reduced to distinct (entity, event) pairs before it meets the cohort, so the join never
    sees more than one row per event name for any entity.

    ``prune``: for logs of very many names. A name has at most as many entities as rows, so names with fewer rows than
    the ``k``-th best of the ``k`` most frequent ones has entities are out, and their pairs are not made. The log is read
    three times then, the first time for its names only.
    """
    inside = log.filter(window.contains(F.col("event_time")))
    members = cohort.select("entity").distinct()

    def users(rows: DataFrame) -> DataFrame:
        pairs = rows.select("entity", "event_name").distinct()
        return pairs.join(members, "entity").groupBy("event_name").agg(F.count("*").alias("distinct_users"))

    if prune:
        sizes = inside.groupBy("event_name").agg(F.count("*").alias("rows"))
        # At most k names.
        most = sizes.orderBy(F.desc("rows"), "event_name").limit(k).select(F.col("event_name").alias("name"))
        counted = users(inside.join(F.broadcast(most), F.col("event_name").eqNullSafe(F.col("name"))).drop("name"))
        least = counted.agg(F.when(F.count("*") >= k, F.min("distinct_users")).otherwise(0)).scalar()
        hopeful = sizes.filter(F.col("rows") >= least)
        inside = inside.filter(may_be_in(hopeful, "event_name", NAME_BITS)(F.col("event_name")) | F.col("event_name").isNull())
    return users(inside).orderBy(F.desc("distinct_users"), F.asc_nulls_first("event_name")).limit(k)
