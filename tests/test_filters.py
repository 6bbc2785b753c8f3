"""Filters of fixed size: nothing wanted is lost, and little else passes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stagetrail.functions import TimeWindow
from stagetrail.functions.membership import may_be_in
from stagetrail.operators import StageSpec, booking_cohort, cohort_top_events, event_names, event_search_by_period, stage_first_times

MONTH = TimeWindow("2024-01-01", "2024-02-01")
SCHEMA = "source string, entity string, event_name string, event_time timestamp_ntz, payload string"


@pytest.fixture(scope="module")
def log(spark):
    n = F.col("id")
    name = F.when(n % 97 == 0, None).when(n % 5 == 0, "book").otherwise(F.concat(F.lit("Event"), F.floor(F.pow(F.abs(F.hash(n)) % 1000 / 100.0, 2.0)).cast("string")))
    return spark.range(20_000).select(
        F.lit("log").alias("source"),
        F.when(n % 89 == 0, None).otherwise((F.abs(F.hash(n, F.lit(1))) % 1000).cast("string")).alias("entity"),
        name.alias("event_name"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.abs(F.hash(n, F.lit(2))) % 40_000).cast("int"))).alias("event_time"),
        F.lit(None).cast("string").alias("payload"),
    ).cache()


@pytest.mark.parametrize("bits", [8, 12, 23])
def test_nothing_is_lost(spark, bits):
    r = random.Random(bits)
    some = [str(r.random()) for _ in range(100)] + [None, ""]
    others = [f"o{r.random()}" for _ in range(5000)]
    test = may_be_in(spark.createDataFrame([(s,) for s in some], "v string"), "v", bits)
    got = spark.createDataFrame([(s,) for s in [*some, *others]], "w string").filter(test(F.col("w"))).collect()
    passed = [x.w for x in got]
    assert set(some) - {None} <= set(passed) and None not in passed
    if bits == 23:
        assert len(passed) < 110
    none = may_be_in(spark.createDataFrame([], "v string"), "v", bits)
    assert spark.createDataFrame([("a",), (None,)], "w string").filter(none(F.col("w"))).count() == 0


def test_a_rare_cohort_keeps_the_log_from_the_shuffle(spark, log):
    cohort = spark.createDataFrame([(str(i), "2024-01-03") for i in range(0, 1000, 100)] + [(None, "2024-01-01")], "entity string, t string")
    cohort = cohort.select("entity", F.col("t").cast("timestamp_ntz").alias("booking_time"))
    stages = [StageSpec("one", ("Event1", "Event2")), StageSpec("two", "Event9")]
    rare, plain = (sorted(map(str, stage_first_times(cohort, log, stages, rare=r).collect())) for r in (True, False))
    assert rare == plain and len(rare) == 11
    df = stage_first_times(cohort, log, stages, rare=True)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan[plan.rindex("Join") :]
    members = log.filter(F.col("entity").isNotNull()).count()
    passed = log.filter(may_be_in(cohort, "entity")(F.col("entity"))).count()
    assert 0 < passed < 0.02 * members


@pytest.mark.parametrize("k", [1, 3, 30, 1000])
def test_pruned_top_events(log, k):
    for cohort in (booking_cohort(log, "book", MONTH), booking_cohort(log, "book", TimeWindow("2024-01-01", "2024-01-01 01:00:00")), booking_cohort(log, "nothing", MONTH)):
        assert cohort_top_events(cohort, log, MONTH, k, prune=True).collect() == cohort_top_events(cohort, log, MONTH, k).collect()


def test_names_are_searched_first(spark, log):
    windows = {"A": TimeWindow("2024-01-01", "2024-01-10"), "B": TimeWindow("2024-01-12", "2024-01-20")}
    names = event_names(log)
    for pattern in ("event1", "OO", "nowhere", ""):
        assert event_search_by_period(log, pattern, windows, names=names).collect() == event_search_by_period(log, pattern, windows).collect()
