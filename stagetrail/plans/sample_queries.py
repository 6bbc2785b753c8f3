"""Every operator applied to the supplied tables, whole.

Orders and their lines play the booking and task logs of customers; ``events`` plays the app log of
users. An order's priority names the booking event, ship flags name the task event. ``visits`` cuts a
user into business days, so that reaching a stage is no matter of course.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import (
    TimeWindow,
    business_day,
    hours_between,
    in_any,
    iso_date,
    json_int,
    json_text,
    json_upper,
    minute_stamp,
    period_label,
    rolling,
    short_date,
)
from ..functions.time import cutoff_date, timestamp_literal
from ..operators import (
    DailyMasks,
    StageSpec,
    assigned_cancel_edges,
    booking_cohort,
    booking_intervals,
    cancel_attribution,
    churn_classified,
    churn_matrix,
    churn_matrix_long,
    cohort_delta,
    cohort_flag_cooccurrence,
    cohort_top_events,
    entity_numbers,
    event_names,
    event_search_by_period,
    first_booking_cohort,
    first_event_times,
    first_time_users,
    headline_rates,
    interval_attribution,
    interval_event_coverage,
    latest_per_transaction,
    maturity_label,
    metrics_snapshot,
    overall_mixed_funnel,
    period_stage_distincts,
    period_stage_distincts_by_bitmap,
    reach_funnel,
    report_lines,
    stage_dropoff,
    stage_first_times,
    stage_overdue_flags,
    strict_sequence_funnel,
    stuck_stage,
    time_to_cancel_by_initiator,
    variant_first_touch,
    variant_ranking,
    variant_times,
    with_numbers,
)
from ..operators.churn import cancel_stages, initiator_is, initiator_starts
from ..operators.timeline import with_next_time
from ..sources import event_log, read_days, rename_metrics, union_logs, write_days, write_snapshot

Query = Callable[[SparkSession, str], DataFrame]

SHIFT = 330
KEY_FLOOR = "0"  # sorts before every numeric key and after NULL, '+' and blank ones

BOOKED = "1-URGENT"
CANCELLED = "5-LOW"
ORDER_STAGES = {"high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED"}
LINE_STAGES = {"af": "AF", "ao": "AO", "nf": "NF", "no": "NO", "rf": "RF", "ro": "RO"}
STEPS = ["total_customers", *ORDER_STAGES, *LINE_STAGES]

ORDERS_AS_OF = "2001-08-01 12:00:00"
PRE_ORDERS = TimeWindow("1995-01-01", "1998-04-01", SHIFT)
PRE_LINES = TimeWindow("1997-06-01", "1998-06-01", SHIFT)
POST_ORDERS = rolling("1998-04-01", ORDERS_AS_OF, 5, SHIFT)
POST_LINES = TimeWindow("2000-12-01", None, SHIFT, not_after=ORDERS_AS_OF)
MATURED_ORDERS = TimeWindow("1998-04-01", "2000-01-01", SHIFT)
MATURED_LINES = TimeWindow("1999-06-01", "2000-06-01", SHIFT)
OVERDUE_HOURS = {4: 4800, 5: 4800, 6: 4800, 7: 600, 8: 2400, 9: 2400}

EVENTS_AS_OF = "2024-02-05 00:00:00"
PRE_EVENTS = TimeWindow("2024-01-01", "2024-01-15")
POST_EVENTS = TimeWindow("2024-01-17", "2024-02-01")
PRE_BOOKINGS = TimeWindow("2024-01-01", "2024-01-16", SHIFT)
POST_BOOKINGS = TimeWindow("2024-01-16", "2024-02-01", SHIFT)
RELEASE = rolling("2024-01-02", EVENTS_AS_OF)
RELEASE_TOP = rolling("2024-01-01", EVENTS_AS_OF)
FLOW_KEY = "event_props.flow"
FLOWS = ("A", "B", "C", "D")
LINKS = (("view", "gs_time"), ("click", "view"), ("error", "click"), ("purchase", "click"))

SNAPSHOT_POST = {"total": "total_customers", **{s: s for s in [*ORDER_STAGES, *LINE_STAGES]}, "cancelled": "cancelled"}
SNAPSHOT_RELEASE = {"installs": "signups", "views": "views", "started": "get_started", "paid": "purchase"}
SNAPSHOT_VARIANT = {"entry": "get_started", "cost": "view", "pay": "click", "location": "error", "paid": "purchase"}


# Declared schemas: no job has to open the files to infer one.
SCHEMAS = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder where all executors see it; the session names the place, unless this machine runs everything."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="stagetrail-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Logs ---------------------------------------------------------------------------------------------


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(
        table(spark, sf_dir, "orders"),
        "booking",
        "o_custkey",
        "o_orderpriority",
        "o_orderdate",
        F.to_json(F.struct(F.col("o_orderstatus").alias("initiated_by"))),
    )


def line_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    lines = table(spark, sf_dir, "lineitem").join(owners, "l_orderkey")
    return event_log(lines, "task", "o_custkey", F.concat("l_returnflag", "l_linestatus"), "l_shipdate")


def customer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_logs(order_log(spark, sf_dir), line_log(spark, sf_dir))


def app_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = json_text(F.col("props"), "k")
    payload = F.struct(
        k.alias("k"),
        F.translate(F.substring(k, 1, 1), "1234", "abcd").alias(FLOW_KEY),
        F.concat_ws("-", F.col("user_id"), k).alias("transaction_id"),
    )
    return event_log(table(spark, sf_dir, "events"), "app", "user_id", "event_type", "ts", F.to_json(payload))


def dirty_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The app's log with a share of broken payloads, by event id."""
    k = json_text(F.col("props"), "k")
    whole = F.to_json(
        F.struct(k.alias("k"), F.translate(F.substring(k, 1, 1), "1234", "abcd").alias(FLOW_KEY), F.concat_ws("-", F.col("user_id"), k).alias("transaction_id"), k.alias("it's?"))
    )
    kind = F.col("event_id") % 10
    payload = (
        F.when(kind == 3, F.substring(whole, F.lit(1), F.length(whole) - 1)).when(kind == 4, F.lit(None)).when(kind == 5, F.concat(whole, F.lit(" x"))).when(kind == 6, F.lit("[1]")).otherwise(whole)
    )
    return event_log(table(spark, sf_dir, "events"), "app", "user_id", "event_type", "ts", payload)


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(table(spark, sf_dir, "events"), "app", "user_id", "event_type", "ts", "props")


def visit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    visit = F.concat_ws("@", F.col("user_id"), business_day(F.col("ts"), SHIFT))
    return event_log(table(spark, sf_dir, "events"), "app", visit, "event_type", "ts", "props")


# Bookings and tasks -------------------------------------------------------------------------------


def booked(window: TimeWindow) -> StageSpec:
    return StageSpec("booked", (BOOKED,), window, source="booking", key_floor=KEY_FLOOR)


def reach_stages(lines: TimeWindow) -> list[StageSpec]:
    return [
        *[StageSpec(n, (e,), source="booking", key_floor=KEY_FLOOR) for n, e in ORDER_STAGES.items()],
        *[StageSpec(n, (e,), lines, source="task", key_floor=KEY_FLOOR) for n, e in LINE_STAGES.items()],
        StageSpec("cancelled", (CANCELLED,), source="booking", key_floor=KEY_FLOOR),
    ]


def q_reach_funnel(spark, sf_dir):
    return reach_funnel(booked(PRE_ORDERS), customer_log(spark, sf_dir), reach_stages(PRE_LINES))


def q_reach_funnel_rolling(spark, sf_dir):
    cutoff = cutoff_date(ORDERS_AS_OF)
    return reach_funnel(booked(POST_ORDERS), customer_log(spark, sf_dir), reach_stages(POST_LINES), cutoff)


def q_reach_funnel_matured(spark, sf_dir):
    return reach_funnel(booked(MATURED_ORDERS), customer_log(spark, sf_dir), reach_stages(MATURED_LINES))


def q_reach_funnel_visits(spark, sf_dir):
    log = visit_log(spark, sf_dir)
    cohort = booking_cohort(log, "purchase", TimeWindow("2024-01-01", "2024-02-01", SHIFT), KEY_FLOOR)
    return reach_funnel(cohort, log, [StageSpec(e, (e,)) for e in ("view", "click", "signup", "error")])


def q_booking_cohort(spark, sf_dir):
    return booking_cohort(order_log(spark, sf_dir), BOOKED, PRE_ORDERS, KEY_FLOOR)


def q_first_booking_cohort(spark, sf_dir):
    return first_booking_cohort(order_log(spark, sf_dir), BOOKED, POST_ORDERS, KEY_FLOOR)


def churn_stage_specs() -> list[StageSpec]:
    return [
        *[StageSpec(f"t_{n}", (e,), source="booking") for n, e in ORDER_STAGES.items()],
        *[StageSpec(f"t_{n}", (e,), source="task") for n, e in LINE_STAGES.items()],
    ]


CHURN_STAGES = [f"t_{n}" for n in [*ORDER_STAGES, *LINE_STAGES]]
CUSTOMER_RULE, SYSTEM_RULE = initiator_is("F"), initiator_starts("P")


def q_stage_first_times(spark, sf_dir):
    cohort = first_booking_cohort(order_log(spark, sf_dir), BOOKED, POST_ORDERS, KEY_FLOOR)
    return stage_first_times(cohort, customer_log(spark, sf_dir), churn_stage_specs())


def q_rare_cohort_stage_times(spark, sf_dir):
    cohort = first_booking_cohort(order_log(spark, sf_dir), BOOKED, POST_ORDERS, KEY_FLOOR)
    return stage_first_times(cohort, customer_log(spark, sf_dir), churn_stage_specs(), rare=True)


def q_cancel_attribution(spark, sf_dir):
    log = order_log(spark, sf_dir)
    cohort = first_booking_cohort(log, BOOKED, POST_ORDERS, KEY_FLOOR)
    return cancel_attribution(cohort, log, CANCELLED, CUSTOMER_RULE, SYSTEM_RULE)


def churn_times(spark, sf_dir):
    stages = [*churn_stage_specs(), *cancel_stages(CANCELLED, CUSTOMER_RULE, SYSTEM_RULE, "booking")]
    return stage_first_times(booked(POST_ORDERS), customer_log(spark, sf_dir), stages)


def q_stuck_stage(spark, sf_dir):
    return stuck_stage(churn_times(spark, sf_dir), CHURN_STAGES).select("entity", "stuck_stage")


def q_stage_overdue_flags(spark, sf_dir):
    flagged = stage_overdue_flags(churn_times(spark, sf_dir), CHURN_STAGES, OVERDUE_HOURS, ORDERS_AS_OF)
    return flagged.select("entity", *[f"s{k}_pred" for k in OVERDUE_HOURS])


def q_churn_matrix(spark, sf_dir):
    classified = churn_classified(churn_times(spark, sf_dir), CHURN_STAGES, OVERDUE_HOURS, ORDERS_AS_OF)
    return churn_matrix(classified, len(CHURN_STAGES), OVERDUE_HOURS)


def q_churn_matrix_long(spark, sf_dir):
    return churn_matrix_long(q_churn_matrix(spark, sf_dir))


# App log ------------------------------------------------------------------------------------------


def q_first_time_users(spark, sf_dir):
    return first_time_users(raw_log(spark, sf_dir), "signup", PRE_EVENTS, "k")


def counted(event: str, window: TimeWindow, count: int) -> StageSpec:
    return StageSpec("first_timers", (event,), window, lambda payload: json_int(payload, "k") == count)


VISIT_STAGES = {"view": ("view",), "interacted": ("click", "signup"), "error": ("error",), "purchase": ("purchase",)}


def q_period_stage_distincts(spark, sf_dir):
    window = TimeWindow("2024-01-01", "2024-02-01")
    cohorts = {"PRE": booked_visits(PRE_EVENTS), "POST": booked_visits(POST_EVENTS)}
    return period_stage_distincts(
        cohorts, visit_log(spark, sf_dir), [StageSpec(n, e, window) for n, e in VISIT_STAGES.items()]
    )


def booked_visits(window: TimeWindow) -> StageSpec:
    return StageSpec("signed_up", ("signup",), window)


def q_first_timer_periods(spark, sf_dir):
    window = TimeWindow("2024-01-12", "2024-01-20")
    cohorts = {"PRE": counted("signup", PRE_EVENTS, 1), "POST": counted("signup", POST_EVENTS, 1)}
    return period_stage_distincts(
        cohorts, raw_log(spark, sf_dir), [StageSpec(n, e, window) for n, e in VISIT_STAGES.items()], "signed_up"
    )


def q_event_search_by_period(spark, sf_dir):
    return event_search_by_period(visit_log(spark, sf_dir), "I", {"PRE": PRE_EVENTS, "POST": POST_EVENTS})


def q_event_search_by_dictionary(spark, sf_dir):
    log = visit_log(spark, sf_dir)
    return event_search_by_period(log, "I", {"PRE": PRE_EVENTS, "POST": POST_EVENTS}, names=event_names(log))


def q_pruned_top_events(spark, sf_dir):
    log = visit_log(spark, sf_dir)
    return cohort_top_events(booking_cohort(log, "signup", POST_EVENTS), log, POST_EVENTS, 3, prune=True)


def q_event_search_by_bitmap(spark, sf_dir):
    log = visit_log(spark, sf_dir)
    return event_search_by_period(with_numbers(log, entity_numbers(log)), "I", {"PRE": PRE_EVENTS, "POST": POST_EVENTS}, "entity_no")


def q_period_stages_by_bitmap(spark, sf_dir):
    window = TimeWindow("2024-01-01", "2024-02-01")
    cohorts = {"PRE": booked_visits(PRE_EVENTS), "POST": booked_visits(POST_EVENTS)}
    log = visit_log(spark, sf_dir)
    stages = [StageSpec(n, e, window) for n, e in VISIT_STAGES.items()]
    return period_stage_distincts_by_bitmap(cohorts, with_numbers(log, entity_numbers(log)), stages)


def q_daily_mask_funnel(spark, sf_dir):
    """Daily masks of a stored log, refreshed twice, and the funnel that they give with parts of days from the log."""
    folder = new_folder(spark, "daily")
    write_days(app_log(spark, sf_dir), f"{folder}/log", SHIFT)
    stages = [StageSpec("viewed", "view"), StageSpec("tried", ("click", "error")), StageSpec("paid", "purchase")]
    masks = DailyMasks(spark, f"{folder}/masks", StageSpec("joined", "signup", key_floor=KEY_FLOOR), stages, 8, SHIFT)
    for as_of in ("2024-01-11 00:00:00", "2024-01-25 04:00:00"):
        masks.refresh(read_days(spark, f"{folder}/log"), as_of)
    windows = {"joined": PRE_BOOKINGS, "viewed": TimeWindow("2024-01-03 07:30:00", "2024-01-03 21:00:00", SHIFT), "tried": RELEASE, "paid": None}
    return masks.reach(read_days(spark, f"{folder}/log"), windows)


def q_cohort_top_events(spark, sf_dir):
    log = visit_log(spark, sf_dir)
    return cohort_top_events(booking_cohort(log, "signup", POST_EVENTS), log, POST_EVENTS, 3)


def q_cohort_flag_cooccurrence(spark, sf_dir):
    stages = [StageSpec(n, (e,)) for n, e in {"clicked": "click", "viewed": "view", "bought": "purchase", "failed": "error"}.items()]
    log = visit_log(spark, sf_dir)
    return cohort_flag_cooccurrence(
        booking_cohort(log, "signup", PRE_EVENTS), log, PRE_EVENTS, stages, "clicked", ("total", "any_flag", "others_without_click")
    )


def release_stages() -> list[StageSpec]:
    return [StageSpec(e, (e,), RELEASE) for e in ("view", "click", "error", "purchase")]


def q_variant_first_touch(spark, sf_dir):
    return variant_first_touch(app_log(spark, sf_dir), "signup", RELEASE, FLOW_KEY, FLOWS)


def q_first_event_times(spark, sf_dir):
    stages = [StageSpec(e, (e,)) for e in ("view", "click", "error", "purchase")]
    return first_event_times(raw_log(spark, sf_dir), stages, RELEASE)


def q_strict_sequence_funnel(spark, sf_dir):
    times = variant_times(app_log(spark, sf_dir), "signup", RELEASE, FLOW_KEY, FLOWS, release_stages())
    return strict_sequence_funnel(times, LINKS)


def q_strict_sequence_from_parts(spark, sf_dir):
    """The same funnel put together from first touches and first times."""
    log = app_log(spark, sf_dir)
    assigned = variant_first_touch(log, "signup", RELEASE, FLOW_KEY, FLOWS)
    times = first_event_times(log, release_stages())
    return strict_sequence_funnel(assigned.join(times, "entity", "left"), LINKS)


def q_overall_mixed_funnel(spark, sf_dir):
    unordered = [
        StageSpec("signups", ("signup",), RELEASE),
        StageSpec("views", ("view",), RELEASE_TOP),
        StageSpec("interactions", ("click", "purchase"), RELEASE_TOP),
        StageSpec("errors", ("error",), TimeWindow("2024-01-01", "2024-01-05")),
    ]
    return overall_mixed_funnel(
        app_log(spark, sf_dir), unordered, "signup", RELEASE, FLOW_KEY, FLOWS, release_stages(), LINKS
    )


# Booking intervals --------------------------------------------------------------------------------


def purchases(log: DataFrame, window: TimeWindow) -> DataFrame:
    return booking_intervals(log, "purchase", window, "transaction_id", KEY_FLOOR)


def q_latest_per_transaction(spark, sf_dir):
    log = app_log(spark, sf_dir).filter(F.col("event_name") == "purchase")
    return latest_per_transaction(log, "transaction_id").select("transaction_id", "entity", "event_time")


def q_booking_intervals(spark, sf_dir):
    return purchases(app_log(spark, sf_dir), PRE_BOOKINGS)


def _interval_parts(spark, sf_dir):
    log = app_log(spark, sf_dir)
    return purchases(log, PRE_BOOKINGS), log.filter(F.col("event_name").isin("click", "error"))


def q_interval_attribution(spark, sf_dir):
    intervals, events = _interval_parts(spark, sf_dir)
    return interval_attribution(intervals, events).select("entity", "booking_time", "event_name", "event_time")


def q_interval_attribution_inner(spark, sf_dir):
    intervals, events = _interval_parts(spark, sf_dir)
    return interval_attribution(intervals, events, "inner").select("entity", "booking_time", "event_name", "event_time")


def q_order_interval_lines(spark, sf_dir):
    """Lines shipped between an order of a customer and the next; one day may hold several orders."""
    orders = event_log(table(spark, sf_dir, "orders"), "booking", "o_custkey", F.lit("order"), "o_orderdate")
    intervals = booking_intervals(orders, "order", TimeWindow("1995-01-01", "2001-09-01", SHIFT))
    attributed = interval_attribution(intervals, line_log(spark, sf_dir))
    return attributed.groupBy("entity", "booking_time").agg(
        F.count("event_time").alias("lines"), F.min("event_time").alias("first_shipped")
    )


def q_interval_event_coverage(spark, sf_dir):
    log = app_log(spark, sf_dir)
    intervals = {"PRE": purchases(log, PRE_BOOKINGS), "POST": purchases(log, POST_BOOKINGS)}
    return interval_event_coverage(intervals, log, ("click", "error"))


def q_time_to_cancel_by_initiator(spark, sf_dir):
    log = app_log(spark, sf_dir)
    return time_to_cancel_by_initiator(
        purchases(log, PRE_BOOKINGS),
        log.filter(F.col("event_name") == "click"),
        log.filter(F.col("event_name") == "error"),
        FLOW_KEY,
    )


def q_assigned_cancel_edges(spark, sf_dir):
    log = app_log(spark, sf_dir)
    return assigned_cancel_edges(
        purchases(log, PRE_BOOKINGS),
        log,
        "click",
        "view",
        "error",
        initiator_is("a", FLOW_KEY),
        initiator_is("b", FLOW_KEY),
        "9",
        ("k", "reason"),
    )


def q_three_log_edges(spark, sf_dir):
    """Edges over three logs: orders book and reach, lines assign (their log has no payload), app errors cancel."""
    orders, lines, app = order_log(spark, sf_dir), line_log(spark, sf_dir), app_log(spark, sf_dir)
    intervals = booking_intervals(orders.filter(F.col("event_name") == BOOKED), BOOKED, TimeWindow("1995-01-01", "2001-09-01", SHIFT))
    events = union_logs(orders.filter(F.col("event_name") == "2-HIGH"), lines, app)
    return assigned_cancel_edges(
        intervals, events, "NO", "2-HIGH", "error", initiator_is("a", FLOW_KEY), initiator_is("b", FLOW_KEY), "9", ("k", "reason")
    )


def q_next_event_times(spark, sf_dir):
    events = app_log(spark, sf_dir).select("entity", "event_time")
    return with_next_time(events, "entity", "event_time", "next_time")


# Reports ------------------------------------------------------------------------------------------


def q_stage_dropoff(spark, sf_dir):
    return stage_dropoff(q_reach_funnel_rolling(spark, sf_dir), STEPS)


def q_cohort_delta(spark, sf_dir):
    return cohort_delta(q_stage_dropoff(spark, sf_dir), stage_dropoff(q_reach_funnel(spark, sf_dir), STEPS))


def q_report_lines(spark, sf_dir):
    dropoff = q_stage_dropoff(spark, sf_dir)
    return report_lines(dropoff, cohort_delta(dropoff, stage_dropoff(q_reach_funnel(spark, sf_dir), STEPS)))


def q_headline_rates(spark, sf_dir):
    return headline_rates(q_reach_funnel_rolling(spark, sf_dir), "total_customers", "ro")


def q_variant_ranking(spark, sf_dir):
    return variant_ranking(q_strict_sequence_funnel(spark, sf_dir), "get_started", "purchase", FLOWS)


def q_renamed_metrics(spark, sf_dir):
    return rename_metrics(q_overall_mixed_funnel(spark, sf_dir), {**SNAPSHOT_RELEASE, "absent": "not_a_column"})


def snapshot(spark, sf_dir):
    return metrics_snapshot(
        q_reach_funnel_rolling(spark, sf_dir),
        q_overall_mixed_funnel(spark, sf_dir),
        q_strict_sequence_funnel(spark, sf_dir),
        ORDERS_AS_OF,
        SNAPSHOT_POST,
        SNAPSHOT_RELEASE,
        SNAPSHOT_VARIANT,
        FLOWS,
    )


def q_metrics_snapshot(spark, sf_dir):
    return snapshot(spark, sf_dir).select(F.to_json(F.struct("*")).alias("snapshot"))


def q_snapshot_sink(spark, sf_dir):
    """The snapshot written twice, and what a reader of the folder sees."""
    folder = new_folder(spark, "snapshot")
    for _ in range(2):
        write_snapshot(snapshot(spark, sf_dir), folder)
    return spark.read.text(folder).withColumnRenamed("value", "snapshot")


def q_maturity_label(spark, sf_dir):
    return maturity_label(q_reach_funnel_rolling(spark, sf_dir))


# Column functions ---------------------------------------------------------------------------------


def q_payload_fields(spark, sf_dir):
    payload = F.col("payload")
    return app_log(spark, sf_dir).select(
        "entity",
        "event_time",
        json_text(payload, "k").alias("k_text"),
        json_int(payload, "k").alias("k_int"),
        json_int(payload, "transaction_id").alias("not_a_number"),
        json_upper(payload, FLOW_KEY).alias("flow"),
        json_text(payload, "missing").alias("missing"),
    )


def q_dirty_payload_fields(spark, sf_dir):
    """Payloads that are cut off, missing, followed by more text, or JSON but no object."""
    payload = F.col("payload")
    return dirty_log(spark, sf_dir).select(
        "event_time",
        "entity",
        json_text(payload, "k").alias("k_text"),
        json_int(payload, "k").alias("k_int"),
        json_upper(payload, FLOW_KEY).alias("flow"),
        json_text(payload, "it's?").alias("odd_key"),
    )


def q_latest_of_dirty(spark, sf_dir):
    """Rows without a transaction id, whatever the reason, are one transaction."""
    log = dirty_log(spark, sf_dir).filter(F.col("event_name") == "purchase")
    return latest_per_transaction(log, "transaction_id").select("transaction_id", "entity", "event_time")


def q_floored_cohort(spark, sf_dir):
    """Keys are compared as text, so the floor keeps 5 and 50 and drops 4 and 40."""
    return booking_cohort(order_log(spark, sf_dir), BOOKED, PRE_ORDERS, "5")


def q_clock_fields(spark, sf_dir):
    time = F.col("event_time")
    windows = {"PRE": PRE_EVENTS, "POST": POST_EVENTS}
    return raw_log(spark, sf_dir).select(
        "entity",
        "event_time",
        business_day(time, SHIFT).alias("local_day"),
        hours_between(time, timestamp_literal("2024-01-15 10:30:00")).alias("hours_left"),
        F.coalesce(period_label(time, windows), F.lit("none")).alias("period"),
        in_any(time, windows.values()).alias("in_period"),
        iso_date(time).alias("day_text"),
        short_date(time.cast("date")).alias("day_label"),
        minute_stamp(time).alias("minute_text"),
    )


def q_booking_log_scan(spark, sf_dir):
    return order_log(spark, sf_dir)


def q_task_log_scan(spark, sf_dir):
    return line_log(spark, sf_dir).select("source", "entity", "event_name", "event_time")


def q_app_log_scan(spark, sf_dir):
    return raw_log(spark, sf_dir)


QUERIES: dict[str, Query] = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
