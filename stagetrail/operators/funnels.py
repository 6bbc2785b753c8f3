"""Reach, sequence and mixed funnels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import TimeWindow, json_upper
from .cohorts import pick_first_touch, variant_touch_columns
from .pivot import (
    MEMBERS,
    StageSpec,
    any_stage,
    as_members,
    bit,
    entity_masks,
    has,
    masks_of,
    member_masks,
    merged,
)


def _with_cohort(cohort: DataFrame | StageSpec, events: DataFrame, stages: Sequence[StageSpec]):
    """Rows to read and the test for cohort membership.

    A cohort given as a stage of the same log is found in the same scan; one given as a DataFrame is
    unioned in, and may repeat entities.
    """
    if isinstance(cohort, StageSpec):
        return events.filter(any_stage([cohort, *stages])), cohort.matches()
    members = as_members(cohort)
    return events.filter(any_stage(stages)).unionByName(members), F.col("source") == MEMBERS


def reach_funnel(
    cohort: DataFrame | StageSpec, events: DataFrame, stages: Sequence[StageSpec], cutoff: date | None = None
) -> DataFrame:
    """One row: cohort size and how many of it reached each stage, in any order.

    ``cutoff`` adds the maturity date as ``post_end_date``. Sums over an empty cohort are NULL.
    """
    rows, member = _with_cohort(cohort, events, stages)
    masks = entity_masks(rows, member_masks(member, [s.matches() for s in stages]))
    extra = [] if cutoff is None else [F.lit(cutoff).alias("post_end_date")]
    totals = (
        masks.filter(has("mask", 0))
        .agg(
            F.count("*").alias("total_customers"),
            *[F.sum(bit("mask", i + 1)).alias(s.name) for i, s in enumerate(stages)],
        )
    )
    return totals.select("total_customers", *extra, *[s.name for s in stages])


def period_stage_distincts(
    cohorts: Mapping[str, DataFrame | StageSpec],
    events: DataFrame,
    stages: Sequence[StageSpec],
    cohort_stage: str = "app_installed",
) -> DataFrame:
    """One row per period: cohort users, and how many of them reached each stage.

    An entity may belong to several cohorts; a period with no users is a row of zeros.
    """
    labels = list(cohorts)
    specs = [c for c in cohorts.values() if isinstance(c, StageSpec)]
    rows = events.filter(any_stage([*specs, *stages]))
    members = []
    for i, cohort in enumerate(cohorts.values()):
        if isinstance(cohort, StageSpec):
            members.append(cohort.matches())
        else:
            rows = rows.unionByName(as_members(cohort, f"{MEMBERS} {i}"))
            members.append(F.col("source") == f"{MEMBERS} {i}")
    masks = entity_masks(
        rows.filter(F.col("entity").isNotNull()), masks_of([*members, *[s.matches() for s in stages]])
    )
    counts = masks.agg(
        *[
            F.count_if(has("mask", p) if s is None else has("mask", p) & has("mask", len(labels) + s)).alias(f"c{p}_{s}")
            for p in range(len(labels))
            for s in [None, *range(len(stages))]
        ]
    )
    lines = [
        F.struct(
            F.lit(label).alias("period"),
            F.col(f"c{p}_None").alias(cohort_stage),
            *[F.col(f"c{p}_{s}").alias(stage.name) for s, stage in enumerate(stages)],
        )
        for p, label in enumerate(labels)
    ]
    return counts.select(F.inline(F.array(*lines)))


def cohort_flag_cooccurrence(
    cohort: DataFrame | StageSpec,
    log: DataFrame,
    window: TimeWindow,
    stages: Sequence[StageSpec],
    click: str,
    names: tuple[str, str, str] = ("total_first_time", "any_serviceability", "auto_no_click"),
) -> DataFrame:
    """Totals of each flag, of any flag, and of entities flagged by something other than ``click``.

    Counts cohort entities that have at least one event of any kind in the window.
    """
    in_window = window.contains(F.col("event_time"))
    if isinstance(cohort, StageSpec):
        rows, member = log.filter(in_window | cohort.coarse()), cohort.matches()
    else:
        rows, member = log.filter(in_window).unionByName(as_members(cohort)), F.col("source") == MEMBERS
    marks = masks_of([member, in_window, *[in_window & s.matches() for s in stages]])
    masks = entity_masks(rows.filter(F.col("entity").isNotNull()), marks).filter(has("mask", 0) & has("mask", 1))
    flags = {s.name: bit("mask", i + 2) for i, s in enumerate(stages)}
    # Any bit above the first two.
    some = reduce(lambda a, b: a | b, [F.col(n) >= (4 if n == "mask" else 1) for n in marks])
    flagged = F.when(some, 1).otherwise(0)
    total, any_name, others_name = names
    return masks.agg(
        F.count("*").alias(total),
        *[F.sum(f).alias(n) for n, f in flags.items()],
        F.sum(flagged).alias(any_name),
        F.sum(flagged * (1 - flags[click])).alias(others_name),
    )


def variant_times(
    log: DataFrame,
    event: str,
    window: TimeWindow,
    variant_key: str,
    allowed: Sequence[str],
    stages: Sequence[StageSpec],
    unordered: Sequence[StageSpec] = (),
) -> DataFrame:
    """Variant, its time, every ``<stage>_time`` and the masks of unordered stages, in one pass.

    Entities without a variant have NULL ``variant`` and ``gs_time``; a NULL entity keeps its masks.
    """
    touch = StageSpec("touch", (event,), window)
    masks = masks_of([s.matches() for s in unordered])
    rows = log.filter(any_stage([touch, *stages, *unordered])).select(
        "entity",
        "event_time",
        F.when(touch.matches(), json_upper(F.col("payload"), variant_key)).alias("variant"),
        *[F.when(s.matches(), F.col("event_time")).alias(f"{s.name}_time") for s in stages],
        *[m.alias(n) for n, m in masks.items()],
    )
    names = variant_touch_columns(allowed)
    pivoted = rows.groupBy("entity").agg(
        *[
            F.min(F.when(F.col("variant") == v, F.col("event_time"))).alias(n)
            for n, v in zip(names, allowed, strict=True)
        ],
        *[F.min(f"{s.name}_time").alias(f"{s.name}_time") for s in stages],
        *merged(masks),
    )
    return pick_first_touch(pivoted, allowed)


def sequence_reached(start: str, links: Sequence[tuple[str, str]]) -> dict[str, Column]:
    """Per stage, whether its first time lies strictly after that of the stage it follows.

    ``links`` are (stage, stage it follows), the first following ``start``; a missed link is false for
    everything that hangs on it.
    """
    times = {start: F.col(start)}
    reached = {start: F.col(start).isNotNull() & F.col("entity").isNotNull()}
    for stage, after in links:
        times[stage] = F.col(f"{stage}_time")
        reached[stage] = reached[after] & F.coalesce(times[stage] > times[after], F.lit(False))
    return reached


def strict_sequence_funnel(
    times: DataFrame,
    links: Sequence[tuple[str, str]],
    start: str = "gs_time",
    start_name: str = "get_started",
    by: str | None = "variant",
    names: Mapping[str, str] | None = None,
) -> DataFrame:
    """Entities reaching each stage in strict order, per ``by``; takes one row per entity."""
    names = dict(names or {})
    reached = sequence_reached(start, links)
    counts = [
        F.count_if(test).alias(start_name if stage == start else names.get(stage, stage))
        for stage, test in reached.items()
    ]
    started = times.filter(F.col(start).isNotNull())
    return started.agg(*counts) if by is None else started.groupBy(by).agg(*counts)


def overall_mixed_funnel(
    log: DataFrame,
    unordered: Sequence[StageSpec],
    event: str,
    window: TimeWindow,
    variant_key: str,
    allowed: Sequence[str],
    stages: Sequence[StageSpec],
    links: Sequence[tuple[str, str]],
    start_name: str = "get_started",
) -> DataFrame:
    """One row: distinct entities of each unordered stage, then the ordered tail.

    Unordered stages keep their own windows and count a NULL entity once; the tail leaves it out.
    """
    times = variant_times(log, event, window, variant_key, allowed, stages, unordered)
    reached = sequence_reached("gs_time", links)
    return times.agg(
        *[F.count_if(has("mask", i)).alias(s.name) for i, s in enumerate(unordered)],
        *[F.count_if(test).alias(start_name if n == "gs_time" else n) for n, test in reached.items()],
    )
