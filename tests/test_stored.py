"""Logs stored by day, daily masks, entity numbers and the snapshot sink."""

from __future__ import annotations

import json
from datetime import date

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stagetrail.functions import TimeWindow
from stagetrail.operators import DailyMasks, StageSpec, distinct_entities, entity_numbers, event_search_by_period, period_stage_distincts, period_stage_distincts_by_bitmap, reach_funnel, with_numbers
from stagetrail.plans.sample_queries import app_log
from stagetrail.sources import day_range, read_days, read_snapshot, snapshot_versions, write_days, write_snapshot
from stagetrail.sources import snapshot as sink

SHIFT = 330
COHORT = StageSpec("joined", "signup", key_floor="1")
STAGES = [StageSpec("c", "click"), StageSpec("e", ("error", "view")), StageSpec("p", "purchase", None, lambda p: p.isNotNull()), StageSpec("never", "nothing")]
WINDOWS = {
    "whole days": {"joined": TimeWindow("2024-01-02", "2024-01-12", SHIFT), "c": TimeWindow("2024-01-03", "2024-01-15", SHIFT), "e": TimeWindow("2024-01-05", "2024-01-06", SHIFT), "p": TimeWindow("2024-01-02", "2024-01-18", SHIFT), "never": TimeWindow("2024-01-02", "2024-01-03", SHIFT)},
    "parts of days": {"joined": TimeWindow("2024-01-02 07:00:00", "2024-01-25 03:00:00", SHIFT), "c": TimeWindow("2024-01-03", None, SHIFT, "2024-01-28 11:00:00"), "e": TimeWindow("2024-01-05 05:00", "2024-01-05 09:00"), "p": TimeWindow(None, "2024-01-04 00:00:01")},
    "no bounds": {},
    "nothing stored": {"joined": TimeWindow("2024-01-25", "2024-01-28"), "c": TimeWindow("2024-01-26")},
}


@pytest.fixture(scope="module")
def log(spark):
    rows = app_log(spark, f"{DATA}/sf0.001")
    nobody = rows.limit(50).withColumn("entity", F.lit(None).cast("string"))
    return rows.unionByName(nobody).cache()


@pytest.fixture(scope="module")
def stored(spark, log, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("days"))
    write_days(log, path, SHIFT, 2)
    return path


@pytest.fixture(scope="module")
def masks(spark, stored, tmp_path_factory):
    made = DailyMasks(spark, str(tmp_path_factory.mktemp("masks")), COHORT, STAGES, 4, SHIFT)
    assert made.last_day() is None
    assert made.refresh(read_days(spark, stored), "2024-01-10 00:00:00") == (None, date(2024, 1, 9))
    assert made.refresh(read_days(spark, stored), "2024-01-20 20:00:00") == (date(2024, 1, 10), date(2024, 1, 20))
    return made


def full(log, windows, cutoff=None):
    given = [StageSpec(s.name, s.events, windows.get(s.name), s.where, key_floor=s.key_floor) for s in (COHORT, *STAGES)]
    return reach_funnel(given[0], log, given[1:], cutoff).first()


@pytest.mark.parametrize("name", sorted(WINDOWS))
def test_daily_masks_give_the_full_funnel(spark, log, stored, masks, name):
    assert masks.reach(read_days(spark, stored), WINDOWS[name], date(2024, 1, 1)).first() == full(log, WINDOWS[name], date(2024, 1, 1))


def test_a_refresh_reads_new_days_only(spark, log, stored, masks):
    before = masks.reach(log, {}).first()
    # What it would find in older days would count, so it does not look at them.
    doubled = log.filter("event_time < '2024-01-20 18:30:00'").withColumn("entity", F.lit("999999"))
    assert masks.refresh(doubled, "2024-01-21 10:00:00") == (date(2024, 1, 21), date(2024, 1, 20))
    assert masks.refresh(doubled.unionByName(log), "2024-01-23 00:00:00") == (date(2024, 1, 21), date(2024, 1, 22))
    assert masks.reach(log, {}).first().total_customers == before.total_customers
    # Late rows: the days named are computed again, in place of what was there.
    late = log.unionByName(log.filter("event_name = 'signup'").limit(1).withColumns({"entity": F.lit("late"), "event_time": F.lit("2024-01-21 09:00:00").cast("timestamp_ntz")}))
    assert masks.refresh(late, "2024-01-23 00:00:00", again=2) == (date(2024, 1, 21), date(2024, 1, 22))
    days = {"joined": TimeWindow("2024-01-21", "2024-01-22", SHIFT)}
    assert masks.reach(late, days).first().total_customers == full(late, days).total_customers == full(log, days).total_customers + 1
    masks.refresh(log, "2024-01-23 00:00:00", again=2)


def test_masks_are_merged_without_a_shuffle(spark, log, masks):
    plan = masks.reach(log, WINDOWS["whole days"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("Exchange") == 1 and "Exchange SinglePartition" in plan
    assert "Bucketed: true" in plan and "(day#" in plan[plan.index("PartitionFilters") :] and "2024-01-17" in plan


def test_a_new_session_finds_the_masks(spark, log, masks):
    spark.sql(f"DROP TABLE {masks.table}")
    again = DailyMasks(spark, masks.path, COHORT, STAGES, 4, SHIFT)
    assert again.last_day() == masks.last_day()
    assert again.reach(log, WINDOWS["whole days"]).first() == full(log, WINDOWS["whole days"])


def test_windows_prune_days(spark, log, stored):
    windows = [TimeWindow("2024-01-05", "2024-01-06", SHIFT), TimeWindow("2024-01-20 23:00:00", None, SHIFT, "2024-01-21 20:00:00")]
    assert [day_range(w, SHIFT) for w in windows] == [(date(2024, 1, 5), date(2024, 1, 5)), (date(2024, 1, 20), date(2024, 1, 22))]
    assert day_range(TimeWindow(), SHIFT) == (None, None)
    found = read_days(spark, stored, windows, SHIFT)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "2024-01-05" in plan[plan.index("PartitionFilters") : plan.index("PushedFilters")]
    inside = windows[0].contains(F.col("event_time")) | windows[1].contains(F.col("event_time"))
    assert sorted(map(str, found.filter(inside).collect())) == sorted(map(str, log.filter(inside).collect()))
    assert found.count() < 0.3 * log.count()


def test_a_day_replaces_itself(spark, log, tmp_path):
    path = str(tmp_path / "log")
    write_days(log, path, SHIFT)
    write_days(log.filter(TimeWindow("2024-01-05", "2024-01-07", SHIFT).contains(F.col("event_time"))), path, SHIFT)
    assert sorted(map(str, read_days(spark, path).collect())) == sorted(map(str, log.collect()))


def test_numbers_are_dense_and_stay(log):
    numbers = entity_numbers(log.filter("event_time < '2024-01-03'"), parts=7)
    first = {r.entity: r.entity_no for r in numbers.collect()}
    assert sorted(first.values()) == list(range(1, len(first) + 1))
    more = {r.entity: r.entity_no for r in entity_numbers(log, numbers, parts=7).collect()}
    everyone = {r.entity for r in log.select("entity").distinct().collect()} - {None}
    assert set(first) | set(more) == everyone and not set(first) & set(more)
    assert sorted([*first.values(), *more.values()]) == list(range(1, len(everyone) + 1))


def test_bitmaps_count_what_distinct_counts(spark, log):
    numbered = with_numbers(log, entity_numbers(log))
    windows = {"A": TimeWindow("2024-01-01", "2024-01-04"), "B": TimeWindow("2024-01-10", "2024-01-12")}
    assert event_search_by_period(numbered, "i", windows, "entity_no").collect() == event_search_by_period(log, "i", windows).collect()
    cohorts = {"A": StageSpec("x", "signup", windows["A"]), "B": StageSpec("x", "signup", windows["B"]), "C": StageSpec("x", "nothing")}
    stages = [StageSpec("v", "view", TimeWindow("2024-01-02", "2024-01-05")), StageSpec("s", "signup"), StageSpec("n", "nothing")]
    got = sorted(map(tuple, period_stage_distincts_by_bitmap(cohorts, numbered, stages).collect()))
    assert got == sorted(map(tuple, period_stage_distincts(cohorts, log, stages).collect()))


def test_sparse_and_negative_numbers(spark):
    rows = spark.createDataFrame([("a", n) for n in (0, -1, 1, 32768, 32769, -32768, 10**12, 1, 0, None)] + [("b", None)], "k string, n long")
    assert {r.k: r.distinct_users for r in distinct_entities(rows, ["k"], "n").collect()} == {"a": 7, "b": 0}


def test_bitmaps_are_what_is_shuffled(spark, log, tmp_path):
    with_numbers(log, entity_numbers(log)).write.parquet(str(tmp_path / "n"))
    plan = event_search_by_period(spark.read.parquet(str(tmp_path / "n")), "i", {"A": TimeWindow("2024-01-01")}, "entity_no")._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange") :]
    assert "partial_bitmap_construct_agg" in below and "entity#" not in below.split("FileScan")[0]


def test_a_snapshot_that_fails_leaves_the_last(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snap")
    one, two = (spark.range(1).select(F.lit(n).alias("n"), F.lit(None).cast("string").alias("gone")) for n in (1, 2))
    write_snapshot(one, path)
    monkeypatch.setattr(sink, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        write_snapshot(two, path)
    broken = spark.range(1).select(F.raise_error(F.lit("no")).cast("int").alias("n"))
    with pytest.raises(Exception, match="no"):
        write_snapshot(broken, path)
    assert [r.n for r in spark.read.json(path).collect()] == [1] == [r.n for r in read_snapshot(spark, path).collect()]
    monkeypatch.undo()
    version = write_snapshot(two, path)
    assert [json.loads(r.value) for r in spark.read.text(path).collect()] == [{"n": 2}]
    # The one that was written whole but never shown is a version too; the broken one is none.
    found = snapshot_versions(spark, path)
    assert len(found) == 3 and found[-1].endswith(version.rsplit("/", 1)[1])


def test_a_folder_of_the_old_kind_is_taken_over(spark, tmp_path):
    path = str(tmp_path / "old")
    spark.range(1).selectExpr("7 AS n").coalesce(1).write.json(path)
    write_snapshot(spark.range(1).selectExpr("8 AS n"), path)
    assert [r.n for r in spark.read.json(path).collect()] == [8]
    assert snapshot_versions(spark, str(tmp_path / "none")) == []
