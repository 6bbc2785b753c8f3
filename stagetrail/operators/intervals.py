"""Attribution of events to the booking interval that contains them.

An interval starts at a booking and ends before the entity's next one. Bookings and events are put on
one timeline and each event takes the latest booking at or before it; nothing is joined on the entity
alone, so cost stays linear in the rows however many bookings and events one entity has.

All that happens to an entity at one instant falls into the same interval. Operators that aggregate merge
it to one row first, in each task before the shuffle, so that no more rows than distinct instants enter
the timeline. The one that returns events keeps instants with very many events out of it: such an instant
enters as one row, and its events, which stay in the tasks that read them, look its booking up.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hours_between, json_text
from ..functions.time import timestamp_literal
from .churn import Rule
from .pivot import bit, has, mask_of, masks_of
from .timeline import CROWD, SLICE_MINUTES, any_crowd, carry_forward, crowded_instants

# Stands for "no next booking" while ends are compared.
OPEN_END = "9999-12-31 23:59:59.999999"


def _who() -> list[Column]:
    """A booking of nobody is kept but gets no events. Its key is made non-NULL, because a nullable join
    key would add a NULL filter to one of the two branches that are to share a shuffle."""
    return [F.coalesce("entity", F.lit("")).alias("entity"), F.col("entity").isNull().alias("nobody")]


def _on_timeline(intervals: DataFrame, events: DataFrame, carried: Sequence[str], slice_minutes: int) -> DataFrame:
    """Bookings, and events that fall into an interval, with ``booking_time`` and ``end_time``.

    Booking rows have ``is_event`` 0 and NULL in the ``carried`` event columns.
    """
    types = {f.name: f.dataType for f in events.schema.fields}
    no_time = F.lit(None).cast("timestamp_ntz")
    starts = intervals.select(
        *_who(),
        F.col("booking_time").alias("event_time"),
        F.lit(0).alias("is_event"),
        F.col("booking_time"),
        F.coalesce("next_booking_time", timestamp_literal(OPEN_END)).alias("end_time"),
        *[F.lit(None).cast(types[c]).alias(c) for c in carried],
    )
    happened = events.filter(F.col("entity").isNotNull()).select(
        *_who(),
        "event_time",
        F.lit(1).alias("is_event"),
        no_time.alias("booking_time"),
        no_time.alias("end_time"),
        *carried,
    )
    # At one instant bookings come before events, and of equal bookings the one that lasts comes last.
    placed = carry_forward(
        starts.unionByName(happened),
        ["entity", "nobody"],
        ["event_time", "is_event", "end_time"],
        ["booking_time", "end_time"],
        (),
        slice_minutes,
    )
    inside = placed.filter((F.col("is_event") == 0) | _before(F.col("end_time")))
    return inside.withColumn("entity", F.when(~F.col("nobody"), F.col("entity"))).drop("nobody")


def _before(end: Column) -> Column:
    """An open interval holds its last instant too: a booking at that instant would have taken the event."""
    return (F.col("event_time") < end) | (end == timestamp_literal(OPEN_END))


def _instants(
    intervals: Sequence[DataFrame], events: DataFrame, states: Mapping[str, Callable[[Column], Column]], slice_minutes: int
) -> DataFrame:
    """A row per entity and instant at which it booked or something happened: the merged ``states`` of the instant's
    events, NULL if none, and for each of the ``intervals`` (by place) ``start_n``, the latest booking at or before the
    instant, ``end_n``, and ``booked_n``, whether it is at the instant."""
    types = {f.name: f.dataType for f in events.schema.fields}
    no_time = F.lit(None).cast("timestamp_ntz")
    values = [f"{end}_{n}" for n in range(len(intervals)) for end in ("start", "end")]

    def row(rows: DataFrame, time: str, own: Mapping[str, Column]) -> DataFrame:
        return rows.select(
            *_who(),
            F.col(time).alias("event_time"),
            *[own.get(v, no_time).alias(v) for v in values],
            *[(F.col(c) if c in rows.columns else F.lit(None).cast(types[c])).alias(c) for c in states],
        )

    parts = [row(events.filter(F.col("entity").isNotNull()), "event_time", {})]
    for n, bookings in enumerate(intervals):
        end = F.coalesce("next_booking_time", timestamp_literal(OPEN_END))
        parts.append(row(bookings.select("entity", "booking_time", "next_booking_time"), "booking_time", {f"start_{n}": F.col("booking_time"), f"end_{n}": end}))
    # Of equal bookings the one that lasts holds the events, and a booking comes before the events of its instant.
    merged = (
        reduce(DataFrame.unionByName, parts)
        .groupBy("entity", "nobody", "event_time")
        .agg(*[F.max(v).alias(v) for v in values], *[merge(F.col(c)).alias(c) for c, merge in states.items()])
    )
    placed = carry_forward(merged, ["entity", "nobody"], ["event_time"], values, [*states], slice_minutes)
    entity = F.when(~F.col("nobody"), F.col("entity")).alias("entity")
    booked = [(F.col(f"start_{n}") == F.col("event_time")).alias(f"booked_{n}") for n in range(len(intervals))]
    return placed.select(entity, "event_time", *states, *values, *booked)


def _held(n: int, states: Sequence[str]) -> list[Column]:
    """``booking_time`` of the n-th intervals, and the states of an instant that falls into it, else NULL."""
    inside = _before(F.col(f"end_{n}"))
    return [F.col(f"start_{n}").alias("booking_time"), *[F.when(inside, F.col(c)).alias(c) for c in states]]


def interval_attribution(
    intervals: DataFrame, events: DataFrame, how: str = "left", slice_minutes: int = SLICE_MINUTES, crowd: int = CROWD
) -> DataFrame:
    """Each event with the booking whose interval holds it; ``left`` keeps bookings without events.

    ``crowd``: events of one entity at one instant beyond which they stay out of the timeline. Whether there are any
    is found out here, from the events' keys and times; the result does not depend on it.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    output = ["entity", "booking_time", "event_name", "event_time", "payload"]
    nothing = F.lit(None).cast("string")
    # Of the bookings of one instant all but the last end where they begin: they hold nothing and stay out as well.
    empty = F.coalesce(F.col("next_booking_time") <= F.col("booking_time"), F.lit(False))
    lasting = intervals.filter(~empty)
    if any_crowd(events, rows=crowd):
        instant = ["entity", "event_time"]
        crowds = crowded_instants(events, rows=crowd)
        quiet = events.select(*instant, "event_name", "payload", F.lit(False).alias("crowd")).join(F.broadcast(crowds), instant, "left_anti")
        marks = crowds.select(*instant, nothing.alias("event_name"), nothing.alias("payload"), F.lit(True).alias("crowd"))
        placed = _on_timeline(lasting, quiet.unionByName(marks), ["event_name", "payload", "crowd"], slice_minutes)
        found = placed.filter((F.col("is_event") == 1) & ~F.col("crowd")).select(*output)
        # The crowds' own small timeline; as few rows as there are crowds take the events to their bookings.
        theirs = lasting.join(F.broadcast(crowds.select("entity").distinct()), "entity", "left_semi")
        held = _on_timeline(theirs, crowds, [], slice_minutes).filter(F.col("is_event") == 1).select(*instant, "booking_time")
        found = found.unionByName(events.join(F.broadcast(held), instant).select(*output))
    else:
        placed = _on_timeline(lasting, events, ["event_name", "payload"], slice_minutes)
        found = placed.filter(F.col("is_event") == 1).select(*output)
    if how == "inner":
        return found
    idle = (
        placed.groupBy("entity", "booking_time", "end_time")
        .agg(F.max("is_event").alias("used"), F.count_if(F.col("is_event") == 0).alias("copies"))
        .filter(F.col("used") == 0)
        .select("entity", "booking_time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select("entity", "booking_time")
        .unionByName(intervals.filter(empty).select("entity", "booking_time"))
        .select(
            "entity",
            "booking_time",
            nothing.alias("event_name"),
            F.lit(None).cast("timestamp_ntz").alias("event_time"),
            nothing.alias("payload"),
        )
    )
    return found.unionByName(idle)


def interval_event_coverage(
    intervals: Mapping[str, DataFrame],
    events: DataFrame,
    names: Sequence[str],
    any_name: str = "any_cnt",
    slice_minutes: int = SLICE_MINUTES,
) -> DataFrame:
    """One row per period: bookings, those with each named event in their interval, those with any.

    One timeline carries the latest booking of every period, so events are shuffled once however many there are.
    """
    masks = masks_of([F.col("event_name") == n for n in names])
    wanted = events.filter(F.col("event_name").isin(*names)).select("entity", "event_time", *[m.alias(n) for n, m in masks.items()])
    placed = _instants([*intervals.values()], wanted, {n: F.bit_or for n in masks}, slice_minutes)
    each = [
        F.struct(F.lit(label).alias("period"), *_held(p, [*masks]), F.col(f"booked_{p}").alias("booked"))
        for p, label in enumerate(intervals)
    ]
    # A booking is its own instant; an instant that holds nothing for it adds nothing.
    some = reduce(lambda a, b: a | b, [F.col(n).isNotNull() for n in masks])
    bookings = (
        placed.select("entity", F.explode(F.array(*each)).alias("each"))
        .select("entity", "each.*")
        .filter(F.col("booking_time").isNotNull() & (F.col("booked") | some))
        .groupBy("period", "entity", "booking_time")
        .agg(*[F.coalesce(F.bit_or(n), F.lit(0).cast("bigint")).alias(n) for n in masks])
    )
    some = reduce(lambda a, b: a | b, [F.col(n) != 0 for n in masks])
    measures = [bit("mask", i) for i in range(len(names))] + [F.when(some, 1).otherwise(0)]
    outputs = [f"{n}_cnt" for n in names] + [any_name]
    # One global aggregate with a column per period keeps a period that has no bookings.
    totals = bookings.agg(
        *[F.count_if(F.col("period") == label).alias(f"p{p}") for p, label in enumerate(intervals)],
        *[
            F.sum(F.when(F.col("period") == label, m)).alias(f"p{p}_{i}")
            for p, label in enumerate(intervals)
            for i, m in enumerate(measures)
        ],
    )
    return totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(label).alias("period"),
                        F.col(f"p{p}").alias("total_bookings"),
                        *[F.col(f"p{p}_{i}").cast("bigint").alias(o) for i, o in enumerate(outputs)],
                    )
                    for p, label in enumerate(intervals)
                ]
            )
        )
    )


def time_to_cancel_by_initiator(
    intervals: DataFrame,
    assigned: DataFrame,
    cancels: DataFrame,
    initiator_key: str = "initiated_by",
    slice_minutes: int = SLICE_MINUTES,
) -> DataFrame:
    """Bookings both assigned and cancelled: count and mean hours between, by initiator.

    The initiator is the one that sorts first among the booking's cancellations, not the earliest one's.
    """
    no_time, nobody = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
    events = assigned.select("entity", "event_time", F.col("event_time").alias("assigned_time"), no_time.alias("cancelled_time"), nobody.alias("initiated_by"))
    by = json_text(F.col("payload"), initiator_key).alias("initiated_by")
    events = events.unionByName(cancels.select("entity", "event_time", no_time.alias("assigned_time"), F.col("event_time").alias("cancelled_time"), by))
    states = ("assigned_time", "cancelled_time", "initiated_by")
    bookings = (
        _instants([intervals.filter(F.col("entity").isNotNull())], events, {c: F.min for c in states}, slice_minutes)
        .filter(F.col("start_0").isNotNull())
        .select("entity", *_held(0, states))
        .groupBy("entity", "booking_time")
        .agg(*[F.min(c).alias(c) for c in states])
        .filter(F.col("assigned_time").isNotNull() & F.col("cancelled_time").isNotNull())
    )
    hours = hours_between(F.col("assigned_time"), F.col("cancelled_time"))
    return bookings.groupBy("initiated_by").agg(
        F.count("*").alias("cnt"), F.round(F.avg(hours), 0).alias("avg_hours")
    )


def assigned_cancel_edges(
    intervals: DataFrame,
    events: DataFrame,
    assigned: str,
    reached: str,
    cancelled: str,
    customer_rule: Rule,
    system_rule: Rule,
    delay_pattern: str = "delay",
    delay_keys: Sequence[str] = ("reason", "reason_type"),
    slice_minutes: int = SLICE_MINUTES,
) -> DataFrame:
    """One row on bookings both assigned and cancelled, in whichever order the two happened."""
    name, payload = F.col("event_name"), F.col("payload")
    is_cancel = name == cancelled
    delayed = reduce(lambda a, b: a | b, [F.lower(json_text(payload, k)).contains(delay_pattern.lower()) for k in delay_keys])
    marked = events.filter(name.isin(assigned, reached, cancelled)).select(
        "entity",
        "event_time",
        mask_of(
            [
                name == assigned,
                name == reached,
                is_cancel,
                is_cancel & customer_rule(payload),
                is_cancel & system_rule(payload),
                is_cancel & delayed,
            ]
        ).alias("mask"),
    )

    def first(i: int) -> Column:
        return F.min(F.when(has("mask", i), F.col("event_time")))

    bookings = (
        _instants([intervals], marked, {"mask": F.bit_or}, slice_minutes)
        .filter(F.col("start_0").isNotNull())
        .select("entity", "event_time", *_held(0, ["mask"]))
        .groupBy("entity", "booking_time")
        .agg(F.bit_or("mask").alias("flags"), first(0).alias("assigned_time"), first(2).alias("cancelled_time"))
    )
    both = has("flags", 0) & has("flags", 2)
    hours = hours_between(F.col("assigned_time"), F.col("cancelled_time"))

    def total(test: Column) -> Column:
        return F.sum(F.when(test, 1).otherwise(0))

    return bookings.agg(
        total(both).alias("cancelled_at_assigned_stage"),
        total(both & has("flags", 1)).alias("reached_and_cancelled"),
        F.round(F.avg(F.when(both & has("flags", 3), hours)), 0).alias("avg_hours_cust_cancel"),
        F.round(F.avg(F.when(both & has("flags", 4), hours)), 0).alias("avg_hours_sys_cancel"),
        total(both & has("flags", 5)).alias("delay_reason_count"),
    )
