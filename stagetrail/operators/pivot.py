"""One pass over a log, one row per entity.

Reach flags travel as BIGINT bit masks and are merged with ``bit_or``; first times are plain
``min``. Both combine on the map side, so an entity that owns a third of the log sends one row per
map task into the shuffle, and both fit the hash aggregate's fixed-width buffer.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import TimeWindow

#: Bits of one mask column; further conditions take further columns.
MASK_BITS = 62


@dataclass(frozen=True)
class StageSpec:
    """A funnel stage: which log rows count as reaching it.

    ``where`` tests the payload, ``source`` limits the stage to one of several unioned logs and
    ``key_floor`` keeps entities that sort at or after it as text.
    """

    name: str
    events: Sequence[str] | str
    window: TimeWindow | None = None
    where: Callable[[Column], Column] | None = None
    source: str | None = None
    key_floor: str | None = None

    def __post_init__(self):
        if isinstance(self.events, str):
            object.__setattr__(self, "events", (self.events,))
        if not self.events:
            raise ValueError(f"stage {self.name} has no events")

    def coarse(self) -> Column:
        """The part of the test a Parquet reader can evaluate."""
        return _coarse(self.events, self.source, self.window, self.key_floor)

    def matches(self) -> Column:
        return self.coarse() if self.where is None else self.coarse() & self.where(F.col("payload"))


def _coarse(
    events: Sequence[str], source: str | None, window: TimeWindow | None, key_floor: str | None = None
) -> Column:
    name = F.col("event_name")
    tests = [name == events[0] if len(events) == 1 else name.isin(*events)]
    if source is not None:
        tests.append(F.col("source") == source)
    if window is not None:
        tests.append(window.contains(F.col("event_time")))
    if key_floor is not None:
        tests.append(F.col("entity") >= key_floor)
    return reduce(lambda a, b: a & b, tests)


def any_stage(stages: Sequence[StageSpec]) -> Column:
    """Rows that may reach some stage, as a test the Parquet reader can evaluate.

    Stages that differ only in their events share one test. The key floor stands outside the
    alternatives, because a computed key inside one would keep all of them from being pushed down.
    """
    groups: dict[tuple, dict[str, None]] = {}
    for s in stages:
        groups.setdefault((s.source, s.window), {}).update(dict.fromkeys(s.events))
    some = reduce(lambda a, b: a | b, [_coarse(list(events), *shared) for shared, events in groups.items()])
    floors = [s.key_floor for s in stages]
    return some if None in floors else some & (F.col("entity") >= min(floors))


def _mask_name(mask: str, i: int) -> str:
    """The column that holds bit i, counted through all masks of this name."""
    return mask if i < MASK_BITS else f"{mask}_{i // MASK_BITS}"


def masks_of(conditions: Sequence[Column], first_bit: int = 0) -> dict[str, Column]:
    """Columns ``mask``, ``mask_1`` and so on, as many as the conditions need.

    Bit i is set where condition i holds; a NULL condition counts as false.
    """
    bits: dict[str, list[Column]] = {"mask": []}
    for i, c in enumerate(conditions, first_bit):
        bits.setdefault(_mask_name("mask", i), []).append(F.when(c, 1 << i % MASK_BITS).otherwise(0))
    return {n: reduce(lambda a, b: a.bitwiseOR(b), some or [F.lit(0)]).cast("bigint") for n, some in bits.items()}


def mask_of(conditions: Sequence[Column]) -> Column:
    """The mask of conditions that fit one."""
    (mask,) = masks_of(conditions).values()
    return mask


def member_masks(member: Column, conditions: Sequence[Column]) -> dict[str, Column]:
    """Bit 0 is membership, the rest are the conditions.

    A NULL entity can be a member, but as it never matches in a join it reaches no stage.
    """
    known = F.col("entity").isNotNull()
    masks = {n: F.when(known, m).otherwise(0) for n, m in masks_of(conditions, 1).items()}
    return masks | {"mask": mask_of([member]).bitwiseOR(masks["mask"])}


def merged(masks: Mapping[str, Column] | Sequence[str]) -> list[Column]:
    """Aggregates that merge the masks of rows."""
    return [F.bit_or(n).alias(n) for n in masks]


def bit(mask: str, i: int) -> Column:
    """Bit i, counted through all masks of this name, as 0 or 1."""
    return F.expr(f"shiftright({_mask_name(mask, i)}, {i % MASK_BITS}) & 1")


def has(mask: str, i: int) -> Column:
    return F.expr(f"shiftright({_mask_name(mask, i)}, {i % MASK_BITS}) & 1 = 1")


MEMBERS = "cohort members"


def as_members(cohort: DataFrame, tag: str = MEMBERS) -> DataFrame:
    """Cohort rows in log shape, to be unioned with a log instead of joined to it.

    Only the source tells them apart; without a name or time they match no stage.
    """
    return cohort.select(
        F.lit(tag).alias("source"),
        F.col("entity"),
        F.lit(None).cast("string").alias("event_name"),
        F.lit(None).cast("timestamp_ntz").alias("event_time"),
        F.lit(None).cast("string").alias("payload"),
    )


def entity_masks(rows: DataFrame, masks: Mapping[str, Column]) -> DataFrame:
    marked = rows.select("entity", *[m.alias(n) for n, m in masks.items()])
    return marked.groupBy("entity").agg(*merged(masks))


def first_event_times(log: DataFrame, stages: Sequence[StageSpec], window: TimeWindow | None = None) -> DataFrame:
    """Earliest time per entity of each stage, as ``<stage>_time``; entities without any are absent."""
    rows = log if window is None else log.filter(window.contains(F.col("event_time")))
    times = [F.when(s.matches(), F.col("event_time")).alias(f"{s.name}_time") for s in stages]
    names = [f"{s.name}_time" for s in stages]
    return (
        rows.filter(any_stage(stages))
        .select("entity", *times)
        .filter(F.coalesce(*names).isNotNull())
        .groupBy("entity")
        .agg(*[F.min(n).alias(n) for n in names])
    )
