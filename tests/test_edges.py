"""Hand-made rows, one test per rule that is easy to get wrong."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stagetrail.functions import (
    TimeWindow,
    hours_between,
    iso_date,
    json_int,
    json_text,
    minute_stamp,
    pct,
    percent_text,
    period_label,
    rolling,
    short_date,
    signed_percent_text,
    slice_index,
    thousands,
)
from stagetrail.functions.time import timestamp_literal
from stagetrail.operators import (
    StageSpec,
    assigned_cancel_edges,
    booking_cohort,
    booking_intervals,
    cancel_attribution,
    churn_classified,
    cohort_delta,
    cohort_flag_cooccurrence,
    cohort_top_events,
    first_booking_cohort,
    first_event_times,
    first_time_users,
    headline_rates,
    interval_attribution,
    interval_event_coverage,
    latest_per_transaction,
    metrics_snapshot,
    overall_mixed_funnel,
    period_stage_distincts,
    reach_funnel,
    stage_dropoff,
    stage_first_times,
    strict_sequence_funnel,
    stuck_stage,
    time_to_cancel_by_initiator,
    variant_first_touch,
    variant_ranking,
    variant_times,
)
from stagetrail.operators.churn import initiator_is, initiator_starts
from stagetrail.operators.timeline import with_next_time

DAY = TimeWindow("2024-01-01", "2024-01-08")
SCHEMA = "source string, entity string, event_name string, event_time timestamp_ntz, payload string"


def at(text):
    day, clock = text.split() if " " in text else ("2024-01-01", text)
    return datetime.fromisoformat(f"{day} {clock}")


@pytest.fixture
def log(spark):
    def make(*rows):
        full = [("log", r[0], r[1], at(r[2]), r[3] if len(r) > 3 else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


def stages(*names):
    return [StageSpec(n, (n,)) for n in names]


LINKS = (("cost", "gs_time"), ("pay", "cost"), ("location", "pay"), ("fee", "pay"))


def sequence(log):
    times = variant_times(log, "gs", DAY, "flow", ("A", "B"), stages("cost", "pay", "location", "fee"))
    return strict_sequence_funnel(times, LINKS).collect()


GS = ("u", "gs", "10:00", '{"flow": "a"}')


def test_first_time_is_taken_before_it_is_compared(log):
    (row,) = sequence(log(GS, ("u", "cost", "09:00"), ("u", "cost", "11:00")))
    assert (row.variant, row.get_started, row.cost) == ("A", 1, 0)


def test_equal_time_is_not_after(log):
    (row,) = sequence(log(GS, ("u", "cost", "10:00")))
    assert row.cost == 0


def test_broken_link_stops_everything_behind_it(log):
    (row,) = sequence(log(GS, ("u", "pay", "11:00"), ("u", "fee", "12:00")))
    assert (row.get_started, row.cost, row.pay, row.location, row.fee) == (1, 0, 0, 0, 0)


def test_fee_hangs_on_pay_and_not_on_location(log):
    (row,) = sequence(log(GS, ("u", "cost", "11:00"), ("u", "pay", "12:00"), ("u", "fee", "13:00")))
    assert (row.pay, row.location, row.fee) == (1, 0, 1)


def test_variant_of_the_earliest_qualifying_event(log):
    rows = log(
        ("u", "gs", "09:00", '{"flow": "z"}'),
        ("u", "gs", "10:00", '{"flow": "b"}'),
        ("u", "gs", "11:00", '{"flow": "a"}'),
        ("tie", "gs", "10:00", '{"flow": "b"}'),
        ("tie", "gs", "10:00", '{"flow": "a"}'),
        ("none", "gs", "10:00", "{broken"),
    )
    got = {r.entity: (r.variant, r.gs_time) for r in variant_first_touch(rows, "gs", DAY, "flow", ("A", "B")).collect()}
    assert got == {"u": ("B", at("10:00")), "tie": ("A", at("10:00"))}


def test_null_user_counts_in_unordered_stages_only(log):
    rows = log((None, "view", "10:00"), (None, "view", "11:00"), (None, "gs", "09:00", '{"flow": "a"}'))
    row = overall_mixed_funnel(
        rows, [StageSpec("views", ("view",), DAY)], "gs", DAY, "flow", ("A", "B"), stages("view"), (("view", "gs_time"),)
    ).first()
    assert (row.views, row.get_started, row.view) == (1, 0, 0)
    assert first_event_times(rows, stages("view")).count() == 1


def test_unordered_stages_keep_their_own_windows(log):
    rows = log(("u", "install", "2024-01-01 10:00"), ("u", "home", "2024-01-01 10:00"))
    row = overall_mixed_funnel(
        rows,
        [StageSpec("install", ("install",), TimeWindow("2024-01-02")), StageSpec("home", ("home",), DAY)],
        "gs",
        DAY,
        "flow",
        ("A",),
        stages("pay"),
        (("pay", "gs_time"),),
    ).first()
    assert (row.install, row.home, row.get_started, row.pay) == (0, 1, 0, 0)


def test_reach_ignores_order_but_stage_times_do_not(log):
    rows = log(("m", "ssid", "2024-01-01 10:00"), ("m", "book", "2024-01-02 10:00"))
    assert reach_funnel(booking_cohort(rows, "book", DAY), rows, stages("ssid")).first().ssid == 1
    cohort = first_booking_cohort(rows, "book", DAY)
    assert stage_first_times(cohort, rows, stages("ssid")).first().ssid is None


def test_stage_at_the_very_time_of_the_booking_counts(log):
    rows = log(
        ("m", "ssid", "09:59"),
        ("m", "book", "10:00"),
        ("m", "ssid", "10:00"),
        ("m", "book", "10:30"),
        ("m", "otp", "10:20"),
        ("m", "otp", "2024-01-03 10:20"),
        ("late", "book", "10:50"),
        ("late", "otp", "10:20"),
        ("late", "otp", "2024-01-02 10:20"),
        ("other", "otp", "10:20"),
    )
    got = stage_first_times(StageSpec("book", ("book",), DAY), rows, stages("ssid", "otp"))
    assert {r.entity: (r.booking_time, r.ssid, r.otp) for r in got.collect()} == {
        "m": (at("10:00"), at("10:00"), at("10:20")),
        "late": (at("10:50"), None, at("2024-01-02 10:20")),
    }


def times_frame(spark, *reached):
    values = {n: (at("10:00") if n in reached else None) for n in ("a", "b", "c")}
    return spark.createDataFrame([("m", *values.values())], "entity string, a timestamp_ntz, b timestamp_ntz, c timestamp_ntz")


def test_stuck_stage_is_the_first_gap(spark):
    assert stuck_stage(times_frame(spark, "b", "c"), ["a", "b", "c"]).first().stuck_stage == 1
    assert stuck_stage(times_frame(spark, "a", "c"), ["a", "b", "c"]).first().stuck_stage == 2
    assert stuck_stage(times_frame(spark, "a", "b", "c"), ["a", "b", "c"]).first().stuck_stage == 99


def test_customer_cancellation_stops_the_clock_even_when_later(spark):
    times = times_frame(spark, "a").withColumns(
        {
            "t_cust_cancel": timestamp_literal("2024-01-03 22:00:00"),
            "t_sys_cancel": timestamp_literal("2024-01-01 11:00:00"),
        }
    )
    row = churn_classified(times, ["a", "b", "c"], {2: 48}, "2024-01-01 12:00:00").first()
    assert (row.stuck_stage, row.s2_pred) == (2, 1)
    only_system = times.withColumn("t_cust_cancel", F.lit(None).cast("timestamp_ntz"))
    assert churn_classified(only_system, ["a", "b", "c"], {2: 48}, "2024-02-01").first().s2_pred == 0


def test_initiator_rules(log):
    rows = log(
        ("a", "book", "09:00"),
        ("b", "book", "09:00"),
        ("c", "book", "09:00"),
        ("a", "cancel", "10:00", '{"initiated_by": "cops"}'),
        ("a", "cancel", "11:00", '{"initiated_by": "customer"}'),
        ("b", "cancel", "10:00", '{"initiated_by": "cops_auto"}'),
        ("c", "cancel", "10:00", '{"initiated_by": "COPS"}'),
        ("c", "cancel", "08:00", '{"initiated_by": "customer"}'),
    )
    cohort = first_booking_cohort(rows, "book", DAY)
    by_prefix = cancel_attribution(cohort, rows, "cancel", initiator_is("customer"), initiator_starts("cops"))
    by_value = cancel_attribution(cohort, rows, "cancel", initiator_is("customer"), initiator_is("cops"))
    assert {r.entity for r in by_prefix.collect() if r.t_sys_cancel} == {"a", "b"}
    assert {r.entity for r in by_value.collect() if r.t_sys_cancel} == {"a"}
    assert {r.entity for r in by_prefix.collect() if r.t_cust_cancel} == {"a"}


def test_hours_count_boundaries(spark):
    pairs = [("10:59", "11:01"), ("11:01", "09:10"), ("10:00", "10:59"), ("2023-12-31 23:59", "00:00")]
    df = spark.createDataFrame([(at(a), at(b)) for a, b in pairs], "a timestamp_ntz, b timestamp_ntz")
    assert [r.h for r in df.select(hours_between(F.col("a"), F.col("b")).alias("h")).collect()] == [1, -2, 0, 1]


def test_clock_does_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([(at("2024-03-10 01:59"), at("2024-03-10 03:01"))], "a timestamp_ntz, b timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = df.select(
            hours_between(F.col("a"), F.col("b")).alias("h"),
            minute_stamp(F.col("a")).alias("s"),
            TimeWindow("2024-03-10 07:29", "2024-03-10 07:30", 330).contains(F.col("a")).alias("w"),
            slice_index(F.col("a"), 60).alias("i"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.h, row.s, row.w) == (2, "2024-03-10 01:59", True)
    assert row.i == (date(2024, 3, 10) - date(1970, 1, 1)).days * 24 + 1


def intervals_of(rows, key="txn", window=DAY, **kwargs):
    return booking_intervals(rows, "book", window, key, **kwargs)


def test_removed_duplicate_still_ends_an_interval(log):
    rows = log(
        ("m", "book", "10:00", '{"txn": "1"}'),
        ("m", "book", "12:00", '{"txn": "1"}'),
        ("m", "ssid", "11:00"),
        ("m", "ssid", "13:00"),
    )
    got = interval_attribution(intervals_of(rows), rows.filter("event_name = 'ssid'")).collect()
    assert [(r.booking_time, r.event_time) for r in got] == [(at("12:00"), at("13:00"))]


def test_booking_outside_the_window_ends_nothing(log):
    rows = log(
        ("m", "book", "10:00", '{"txn": "1"}'),
        ("m", "book", "2024-02-01 10:00", '{"txn": "2"}'),
        ("m", "ssid", "2024-02-02 10:00"),
    )
    got = interval_attribution(intervals_of(rows), rows.filter("event_name = 'ssid'")).collect()
    assert [(r.booking_time, r.event_time) for r in got] == [(at("10:00"), at("2024-02-02 10:00"))]


def test_rows_without_transaction_share_one(log):
    rows = log(("a", "book", "10:00"), ("b", "book", "12:00", "{bad"), ("c", "book", "11:00", '{"txn": null}'))
    assert [r.entity for r in intervals_of(rows).collect()] == ["b"]
    assert [r.entity for r in latest_per_transaction(rows, "txn").collect()] == ["b"]


def test_event_at_a_boundary_belongs_to_the_later_booking(log):
    rows = log(
        ("m", "book", "10:00", '{"txn": "1"}'),
        ("m", "book", "12:00", '{"txn": "2"}'),
        ("m", "ssid", "12:00"),
        ("m", "ssid", "09:00"),
        (None, "ssid", "12:00"),
        (None, "book", "10:00", '{"txn": "3"}'),
    )
    events = rows.filter("event_name = 'ssid'")
    left = interval_attribution(intervals_of(rows), events).collect()
    assert {(r.entity, r.booking_time, r.event_time) for r in left} == {
        ("m", at("10:00"), None),
        ("m", at("12:00"), at("12:00")),
        (None, at("10:00"), None),
    }
    inner = interval_attribution(intervals_of(rows), events, "inner").collect()
    assert [(r.booking_time, r.event_time) for r in inner] == [(at("12:00"), at("12:00"))]
    with pytest.raises(ValueError):
        interval_attribution(intervals_of(rows), events, "outer")


@pytest.mark.parametrize("slice_minutes", [1, 60, 10080])
def test_twin_bookings(log, slice_minutes):
    rows = log(
        ("m", "book", "10:00", '{"txn": "1"}'),
        ("m", "book", "10:00", '{"txn": "2"}'),
        ("m", "ssid", "2024-01-02 11:00"),
        ("m", "book", "2024-01-03 10:00", '{"txn": "3"}'),
    )
    spans = intervals_of(rows, slice_minutes=slice_minutes)
    ends = sorted((r.booking_time, r.next_booking_time or datetime.max) for r in spans.collect())
    third = at("2024-01-03 10:00")
    assert ends == [(at("10:00"), at("10:00")), (at("10:00"), third), (third, datetime.max)]
    events = rows.filter("event_name = 'ssid'")
    got = interval_attribution(spans, events, slice_minutes=slice_minutes).collect()
    none = datetime.max
    assert sorted((r.booking_time, r.event_time or none) for r in got) == [
        (at("10:00"), at("2024-01-02 11:00")),
        (at("10:00"), none),
        (third, none),
    ]
    covered = interval_event_coverage({"P": spans}, events, ("ssid",), slice_minutes=slice_minutes).first()
    assert (covered.total_bookings, covered.ssid_cnt) == (2, 1)


def test_next_time_per_key(log):
    rows = log(("a", "x", "10:00"), ("a", "x", "10:10"), ("a", "x", "2024-01-05 10:00"), (None, "x", "09:00"), (None, "x", "12:00"))
    got = with_next_time(rows.select("entity", "event_time"), "entity", "event_time", "after").collect()
    assert {(r.entity, r.event_time, r.after) for r in got} == {
        ("a", at("10:00"), at("10:10")),
        ("a", at("10:10"), at("2024-01-05 10:00")),
        ("a", at("2024-01-05 10:00"), None),
        (None, at("09:00"), at("12:00")),
        (None, at("12:00"), None),
    }


def test_initiator_is_the_first_by_name(log):
    rows = log(
        ("m", "book", "09:00", '{"txn": "1"}'),
        ("m", "assigned", "09:30"),
        ("m", "cancel", "10:00", '{"initiated_by": "customer"}'),
        ("m", "cancel", "11:00", '{"initiated_by": "cops"}'),
        ("n", "book", "09:00", '{"txn": "2"}'),
        ("n", "assigned", "09:30"),
        ("n", "cancel", "12:00"),
    )
    got = time_to_cancel_by_initiator(
        intervals_of(rows), rows.filter("event_name = 'assigned'"), rows.filter("event_name = 'cancel'")
    ).collect()
    assert {(r.initiated_by, r.cnt, r.avg_hours) for r in got} == {("cops", 1, 1.0), (None, 1, 3.0)}


def test_cancellation_before_assignment_counts(log):
    rows = log(
        ("m", "book", "09:00", '{"txn": "1"}'),
        ("m", "cancel", "10:00", '{"initiated_by": "customer", "reason": "Big DELAY"}'),
        ("m", "assigned", "12:00"),
    )
    row = assigned_cancel_edges(
        intervals_of(rows), rows, "assigned", "reached", "cancel", initiator_is("customer"), initiator_is("cops")
    ).first()
    assert tuple(row) == (1, 0, -2.0, None, 1)


def test_empty_cohort(log):
    rows = log(("m", "ssid", "10:00"))
    row = reach_funnel(booking_cohort(rows, "book", DAY), rows, stages("ssid"), date(2024, 1, 2)).first()
    assert tuple(row) == (0, date(2024, 1, 2), None)
    drop = stage_dropoff(reach_funnel(booking_cohort(rows, "book", DAY), rows, stages("ssid")), ["total_customers", "ssid"])
    assert tuple(drop.first()) == (1, "ssid", 0, 0, 0.0)
    covered = interval_event_coverage({"P": intervals_of(rows)}, rows, ("ssid",)).first()
    assert tuple(covered) == ("P", 0, None, None)
    periods = period_stage_distincts({"PRE": booking_cohort(rows, "book", DAY)}, rows, stages("ssid")).first()
    assert tuple(periods) == ("PRE", 0, 0)
    flags = cohort_flag_cooccurrence(booking_cohort(rows, "book", DAY), rows, DAY, stages("ssid"), "ssid").first()
    assert tuple(flags) == (0, None, None, None)
    snapshot = metrics_snapshot(
        reach_funnel(booking_cohort(rows, "book", DAY), rows, stages("ssid"), date(2024, 1, 2)),
        None,
        None,
        "2024-01-07 03:28:59",
        {"total": "total_customers", "ssid": "ssid"},
        {},
        {},
        (),
    ).first()
    assert snapshot == Row(
        refreshed_at="2024-01-07 03:28", post_end_date="2024-01-02", post_funnel=Row(total=0, ssid=0)
    )


def test_null_entity_is_a_member_but_reaches_nothing(log):
    rows = log((None, "book", "10:00"), (None, "ssid", "10:00"), ("m", "book", "10:00"), ("m", "ssid", "10:00"))
    row = reach_funnel(booking_cohort(rows, "book", DAY), rows, stages("ssid")).first()
    assert (row.total_customers, row.ssid) == (2, 1)
    assert reach_funnel(StageSpec("book", ("book",), DAY), rows, stages("ssid")).first() == row


def test_cohort_rows_are_no_events(spark, log):
    rows = log(("m", "x", "10:00"))
    cohort = spark.createDataFrame([("m",)], "entity string")
    assert tuple(reach_funnel(cohort, rows, stages("cohort", "cohort members", "x")).first()) == (1, 0, 0, 1)


def test_user_in_both_periods(log):
    rows = log(("u", "install", "2024-01-01 10:00"), ("u", "install", "2024-01-05 10:00"), ("u", "home", "2024-01-06 10:00"))
    cohorts = {
        "PRE": StageSpec("pre", ("install",), TimeWindow("2024-01-01", "2024-01-02")),
        "POST": booking_cohort(rows, "install", TimeWindow("2024-01-05", "2024-01-06")),
    }
    got = period_stage_distincts(cohorts, rows, stages("home")).collect()
    assert [tuple(r) for r in got] == [("PRE", 1, 1), ("POST", 1, 1)]


def test_flag_report_needs_an_event_in_the_window(spark, log):
    rows = log(("a", "click", "10:00"), ("b", "other", "10:00"), ("c", "click", "2024-02-01 10:00"))
    cohort = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    got = cohort_flag_cooccurrence(cohort, rows, DAY, stages("click", "page"), "click").first()
    assert tuple(got) == (2, 1, 0, 1, 0)


def test_key_floor_compares_text(log):
    rows = log(*[(k, "book", "10:00") for k in ("59", "6", "+916", None, "5999999999")])
    kept = booking_cohort(rows, "book", DAY, "5999999999").collect()
    assert {r.entity for r in kept} == {"6", "5999999999"}


def test_business_day_edges(log):
    rows = log(("in", "book", "2026-02-19 18:30:00"), ("out", "book", "2026-02-19 18:29:59"))
    window = TimeWindow("2026-02-20", "2026-03-26", 330)
    assert [r.entity for r in booking_cohort(rows, "book", window).collect()] == ["in"]


def test_rolling_window_and_now(spark):
    window = rolling("2024-01-01", "2024-01-11 15:00:00")
    assert (window.lo, window.hi) == ("2024-01-01", date(2024, 1, 6))
    df = spark.createDataFrame([(at("2024-01-05 23:59"),), (at("2024-01-06 00:00"),)], "t timestamp_ntz")
    assert df.filter(window.contains(F.col("t"))).count() == 1
    now = TimeWindow(not_after="2024-01-06 00:00:00")
    assert df.filter(now.contains(F.col("t"))).count() == 2
    label = period_label(F.col("t"), {"A": window, "B": TimeWindow("2024-01-07")})
    assert [r[0] for r in df.select(label).collect()] == ["A", None]


def test_json(spark):
    texts = ["{bad", None, '{"a.b c": null}', '{"a.b c": "v", "n": "1"}', '{"n": 1}', '{"n": "x"}', '{"n": 1.5}', "[1]"]
    df = spark.createDataFrame([(t,) for t in texts], "p string")
    got = df.select(json_text(F.col("p"), "a.b c"), json_int(F.col("p"), "n")).collect()
    assert [r[0] for r in got] == [None, None, None, "v", None, None, None, None]
    assert [r[1] for r in got] == [None, None, None, 1, 1, None, 2, None]
    with pytest.raises(ValueError):
        json_text(F.col("p"), "it's \"both\"")


def test_json_is_one_value(spark):
    whole = '{"it\'s?": 1, "say \\"x\\"": [true], "a": "}] x", "b": 1.50, "c": {"d": null}}'
    more = [" x", ", 2", ', "e": 3', "] x", "} x", '}] {"b": 1}', "] [1]", " {}", "]", "}", ","]
    df = spark.createDataFrame([(whole,), (f" {whole}\n",), *[(whole + m,) for m in more], ("{'a': 1}",), ('{"a": 1, "a": 2}',), ("",)], "p string")
    keys = ["it's?", 'say "x"', "a", "b", "c", "missing"]
    got = [tuple(r) for r in df.select(*[json_text(F.col("p"), k).alias(str(i)) for i, k in enumerate(keys)]).collect()]
    assert got[:2] == [("1", "[true]", "}] x", "1.5", '{"d":null}', None)] * 2
    assert got[2:] == [(None,) * 6] * (len(got) - 2)


def test_json_is_parsed_once(spark):
    keys = [json_text(F.col("p"), k).alias(k) for k in "abcdef"]
    plan = spark.createDataFrame([('{"a": 1}',)], "p string").filter("p is not null").select(*keys)
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan._jdf.queryExecution().sparkPlan())
    assert 0 < code.count("VariantExpressionEvalUtils.parseJson(") <= 4 or code.count("parseJson") <= 8


def test_first_time_counter(log):
    rows = log(("a", "x", "10:00", '{"c.d": "1"}'), ("b", "x", "10:00", '{"c.d": 1}'), ("c", "x", "10:00", '{"c.d": "x"}'))
    assert {r.entity for r in first_time_users(rows, "x", DAY, "c.d").collect()} == {"a", "b"}


def test_top_events_break_ties_by_name(spark, log):
    rows = log(("a", "y", "10:00"), ("a", "y", "10:01"), ("a", "x", "10:00"), ("b", "z", "10:00"), ("b", "x", "2024-02-01 10:00"))
    cohort = spark.createDataFrame([("a",), ("a",)], "entity string")
    assert [tuple(r) for r in cohort_top_events(cohort, rows, DAY, 1).collect()] == [("x", 1)]


def test_percentages_and_text(spark):
    df = spark.createDataFrame([(1, 3, 0, 1234567, 0.25, date(2024, 1, 5))], "n int, t int, z int, big long, x double, d date")
    row = df.select(
        pct(F.col("n"), F.col("t")),
        pct(F.col("n"), F.col("z")),
        thousands(F.col("big")),
        percent_text(F.col("x")),
        signed_percent_text(F.col("x")),
        iso_date(F.col("d")),
        short_date(F.col("d")),
    ).first()
    assert tuple(row) == (33.3, 0.0, "1,234,567", "0.3%", "+0.3%", "2024-01-05", "Jan 5")


def test_delta_labels(spark):
    schema = "step int, stage string, drop_pct double"
    ours = spark.createDataFrame([(1, "a", 10.29), (2, "b", 10.31), (3, "c", 9.69)], schema)
    theirs = spark.createDataFrame([(i, "", 10.0) for i in (1, 2, 3)], schema)
    got = {r.step: r.label for r in cohort_delta(ours, theirs).collect()}
    assert got == {1: "neutral", 2: "bad", 3: "good"}


def test_headline_and_negative_drop(spark):
    funnel = spark.createDataFrame([(10, 4, 6)], "total long, a long, b long")
    assert tuple(headline_rates(funnel, "total", "b").first()) == (60.0, 4, 40.0)
    drops = [(r.stage, r.enter, r.drop_n, r.drop_pct) for r in stage_dropoff(funnel, ["total", "a", "b"]).collect()]
    assert drops == [("a", 10, 6, 60.0), ("b", 4, -2, -20.0), ("TOTAL", 10, 4, 40.0)]


def test_variant_ranking(spark):
    rows = [("A", 0, 0), ("B", 10, 5), ("C", 10, 5), ("D", 4, 3), ("empty", 1, 1)]
    df = spark.createDataFrame(rows, "variant string, entry long, paid long")
    got = variant_ranking(df, "entry", "paid", ("A", "B", "C", "D")).collect()
    assert [(r["rank"], r.variant, r.conv_pct) for r in got] == [(1, "D", 75.0), (2, "B", 50.0), (3, "C", 50.0), (4, "A", 0.0)]
