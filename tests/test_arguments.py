"""Arguments in other forms, and arguments that are refused."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stagetrail.functions.time import TimeWindow, cutoff_date, rolling, slice_index, timestamp_literal
from stagetrail.operators.churn import stage_first_times, stage_overdue_flags
from stagetrail.operators.explore import event_search_by_period
from stagetrail.operators.funnels import cohort_flag_cooccurrence, period_stage_distincts, reach_funnel
from stagetrail.operators.intervals import OPEN_END, interval_attribution, interval_event_coverage
from stagetrail.operators.pivot import StageSpec

ZONE = timezone(timedelta(hours=5, minutes=30))
SAME = [datetime(2026, 5, 9, 20, 30), datetime(2026, 5, 10, 2, 0, tzinfo=ZONE), "2026-05-10 02:00+05:30", "2026-05-09T20:30:00"]


@pytest.mark.parametrize("as_of", SAME)
def test_times_with_an_offset(spark, as_of):
    assert cutoff_date(as_of) == date(2026, 5, 4)
    assert rolling("2026-05-01", as_of).hi == date(2026, 5, 4)
    times = [datetime(2026, 5, 9, 20, 29), datetime(2026, 5, 9, 20, 30), datetime(2026, 5, 9, 20, 31)]
    log = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    inside = TimeWindow(lo=as_of).contains(F.col("t")), TimeWindow(hi=as_of).contains(F.col("t")), TimeWindow(not_after=as_of).contains(F.col("t"))
    rows = log.select(*[c.alias(f"c{i}") for i, c in enumerate(inside)], (timestamp_literal(as_of) == F.col("t")).alias("same")).collect()
    assert [tuple(r) for r in rows] == [(False, True, True, False), (True, False, True, True), (True, False, False, False)]


def test_one_event_as_text(spark):
    assert StageSpec("view", "view") == StageSpec("view", ("view",))
    with pytest.raises(ValueError):
        StageSpec("view", ())


@pytest.mark.parametrize("k", [0, 1, 4])
def test_limits_need_a_stage_before(spark, k):
    with pytest.raises(ValueError):
        stage_overdue_flags(spark.range(0), ["a", "b", "c"], {k: 1}, "2026-05-01")


def test_slices_have_a_length():
    with pytest.raises(ValueError):
        slice_index(F.lit(1), 0)


def test_search_takes_text_as_it_is(spark):
    day = datetime(2026, 5, 1)
    log = spark.createDataFrame([("u", n, day) for n in ("page_loaded", "pageXloaded", "PAGE_LOADED 5%")], "entity string, event_name string, event_time timestamp_ntz")
    found = event_search_by_period(log, "page_loaded", {"all": TimeWindow()}).collect()
    assert {r.event_name for r in found} == {"page_loaded", "PAGE_LOADED 5%"}
    assert [r.event_name for r in event_search_by_period(log, "5%", {"all": TimeWindow()}).collect()] == ["PAGE_LOADED 5%"]


def test_any_number_of_stages(spark):
    n = 130
    stages = [StageSpec(f"e{i}", f"e{i}") for i in range(n)]
    day = datetime(2026, 5, 1, 12)
    # u reaches the even stages, v (no member) all of them.
    rows = [("log", "u", "book", day, None)]
    rows += [("log", who, f"e{i}", day + timedelta(minutes=i), None) for i in range(n) for who in "uv" if who == "v" or i % 2 == 0]
    log = spark.createDataFrame(rows, "source string, entity string, event_name string, event_time timestamp_ntz, payload string")
    booked = StageSpec("booked", "book")

    row = reach_funnel(booked, log, stages).first()
    assert [row[f"e{i}"] for i in range(n)] == [1 - i % 2 for i in range(n)]
    row = period_stage_distincts({"p": booked}, log, stages).first()
    assert [row[f"e{i}"] for i in range(n)] == [1 - i % 2 for i in range(n)]
    row = stage_first_times(booked, log, stages).first()
    assert [row[f"e{i}"] for i in range(n)] == [None if i % 2 else day + timedelta(minutes=i) for i in range(n)]
    row = cohort_flag_cooccurrence(booked, log, TimeWindow(), stages[100:], "e100").first()
    assert (row.total_first_time, row.e100, row.e101, row.any_serviceability, row.auto_no_click) == (1, 1, 0, 1, 0)
    # Only a flag of a later mask.
    row = cohort_flag_cooccurrence(booked, log, TimeWindow(), [*stages[1:128:2], stages[128]], "e1").first()
    assert (row.e1, row.e128, row.any_serviceability, row.auto_no_click) == (0, 1, 1, 1)
    intervals = log.filter("event_name = 'book'").selectExpr("entity", "event_time AS booking_time", "CAST(NULL AS timestamp_ntz) AS next_booking_time")
    row = interval_event_coverage({"p": intervals}, log, [s.name for s in stages]).first()
    assert [row[f"e{i}_cnt"] for i in range(n)] == [1 - i % 2 for i in range(n)]
    assert (row.total_bookings, row.any_cnt) == (1, 1)


def test_an_open_interval_has_no_last_instant(spark):
    end = datetime.fromisoformat(OPEN_END)
    bookings = spark.createDataFrame([("u", datetime(2026, 5, 1), None)], "entity string, booking_time timestamp_ntz, next_booking_time timestamp_ntz")
    events = spark.createDataFrame([("u", end, "e", "{}")], "entity string, event_time timestamp_ntz, event_name string, payload string")
    assert [r.event_name for r in interval_attribution(bookings, events, "inner").collect()] == ["e"]
