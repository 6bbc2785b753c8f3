"""Stage times after a booking, stuck stage, cancellations and the churn matrix."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hour_index, json_text
from ..functions.membership import may_be_in
from ..functions.time import Moment, timestamp_literal
from .pivot import StageSpec, any_stage, has, masks_of

DONE = 99


def stage_first_times(
    cohort: DataFrame | StageSpec, events: DataFrame, stages: Sequence[StageSpec], rare: bool = False
) -> DataFrame:
    """First time of each stage at or after the booking, one row per cohort entity, named as the stage.

    ``rare``: the cohort is a small part of the log's entities. It is then read first for a filter of fixed size, which
    keeps nearly all rows of others from the shuffle.

    A cohort DataFrame has ``entity`` and ``booking_time``, of which the earliest counts. A cohort given
    as a stage of the log is taken from it, and the log is then read only from the start of its window.

    The join has one booking on its right side and a log on its left, so a hot entity's events can be
    split over tasks by Spark's skew join. Spark does that only where the join's own partitioning is not
    used further up; hashing the key into the join keys sees to it, as the entity alone then does not
    describe the partitioning and the times are combined map-side before a shuffle of their own.
    """
    if isinstance(cohort, StageSpec):
        anchors = events.filter(cohort.matches()).withColumnRenamed("event_time", "booking_time")
        if cohort.window is not None:
            events = events.filter(cohort.window.from_start().contains(F.col("event_time")))
    else:
        anchors = cohort
    bookings = anchors.groupBy("entity").agg(F.min("booking_time").alias("booking_time"))
    masks = masks_of([s.matches() for s in stages])
    marked = (
        events.filter(any_stage(stages) & F.col("entity").isNotNull())
        .select("entity", "event_time", *[m.alias(n) for n, m in masks.items()])
        .filter(reduce(lambda a, b: a | b, [F.col(n) != 0 for n in masks]))
    )
    if rare:
        marked = marked.filter(may_be_in(bookings, "entity")(F.col("entity")))
    hashed = F.xxhash64("entity").alias("entity_hash")
    hits = (
        marked.select("*", hashed)
        .join(bookings.select("*", hashed), ["entity_hash", "entity"])
        .filter(F.col("event_time") >= F.col("booking_time"))
        .select("entity", "booking_time", "event_time", *masks)
    )
    members = bookings.select(
        "entity",
        "booking_time",
        F.lit(None).cast("timestamp_ntz").alias("event_time"),
        *[F.lit(0).cast("bigint").alias(n) for n in masks],
    )
    return (
        hits.unionByName(members)
        .groupBy("entity")
        .agg(
            F.min("booking_time").alias("booking_time"),
            *[F.min(F.when(has("mask", i), F.col("event_time"))).alias(s.name) for i, s in enumerate(stages)],
        )
        # Always true; it keeps the booking time in use, so that both readers of the bookings share a shuffle.
        .filter("booking_time IS NOT NULL")
    )


Rule = Callable[[Column], Column]


def initiator_is(value: str, key: str = "initiated_by") -> Rule:
    return lambda payload: json_text(payload, key) == value


def initiator_starts(prefix: str, key: str = "initiated_by") -> Rule:
    return lambda payload: json_text(payload, key).startswith(prefix)


def cancel_stages(event: str, customer_rule: Rule, system_rule: Rule, source: str | None = None) -> list[StageSpec]:
    return [
        StageSpec("t_cust_cancel", (event,), where=customer_rule, source=source),
        StageSpec("t_sys_cancel", (event,), where=system_rule, source=source),
    ]


def cancel_attribution(
    cohort: DataFrame | StageSpec, log: DataFrame, event: str, customer_rule: Rule, system_rule: Rule
) -> DataFrame:
    """First customer and first system cancellation at or after the booking."""
    return stage_first_times(cohort, log, cancel_stages(event, customer_rule, system_rule))


def stuck_stage(times: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Add the number of the first stage without a time, 99 where none is missing."""
    first_gap = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(stages, 1)], F.lit(DONE))
    return times.withColumn("stuck_stage", first_gap)


def stage_overdue_flags(
    times: DataFrame, stages: Sequence[str], limits: Mapping[int, int], as_of: Moment
) -> DataFrame:
    """Add ``s<k>_pred``: stage k-1 reached, k not, and the limit in hours used up.

    The clock stops at the customer's cancellation, else the system's, else ``as_of``.
    """
    end = F.coalesce("t_cust_cancel", "t_sys_cancel", timestamp_literal(as_of))
    if wrong := [k for k in limits if not 2 <= k <= len(stages)]:
        raise ValueError(f"only stages 2 to {len(stages)} have one before them, not {wrong}")
    flags = {}
    for k, hours in limits.items():
        before, here = F.col(stages[k - 2]), F.col(stages[k - 1])
        overdue = here.isNull() & (F.col("end_hour") - hour_index(before) >= hours)
        flags[f"s{k}_pred"] = F.when(overdue, 1).otherwise(0)
    return times.withColumn("end_hour", hour_index(end)).withColumns(flags).drop("end_hour")


def churn_classified(
    times: DataFrame, stages: Sequence[str], limits: Mapping[int, int], as_of: Moment
) -> DataFrame:
    return stage_overdue_flags(stuck_stage(times, stages), stages, limits, as_of)


def churn_matrix(classified: DataFrame, n_stages: int, limits: Mapping[int, int]) -> DataFrame:
    """One row: per stage, entities that got there and those stuck in it by kind of cancellation or delay."""
    steps = range(1, n_stages + 1)
    return classified.selectExpr(
        *[f"sum(if(stuck_stage >= {k}, 1, 0)) AS s{k}_entry" for k in steps],
        *[f"sum(if(stuck_stage = {k} AND t_cust_cancel IS NOT NULL, 1, 0)) AS s{k}_cust" for k in steps],
        *[f"sum(if(stuck_stage = {k} AND t_sys_cancel IS NOT NULL, 1, 0)) AS s{k}_sys" for k in steps],
        *[f"sum(s{k}_pred) AS s{k}_pred" for k in limits],
    )


def churn_matrix_long(matrix: DataFrame) -> DataFrame:
    """The matrix as (stage, metric, value)."""
    cells = [n[1:].split("_") for n in matrix.columns]
    return matrix.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(int(k)).alias("stage"), F.lit(metric).alias("metric"), F.col(n).alias("value"))
                    for n, (k, metric) in zip(matrix.columns, cells, strict=True)
                ]
            )
        )
    )
