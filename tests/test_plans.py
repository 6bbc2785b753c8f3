"""Shapes of the physical plans, with broadcasts off as on tables too large for them."""

from __future__ import annotations

import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from stagetrail.functions import TimeWindow
from stagetrail.operators import booking_intervals, interval_attribution, reach_funnel, stage_first_times
from stagetrail.operators.pivot import StageSpec
from stagetrail.operators.timeline import with_next_time
from stagetrail.plans.sample_queries import QUERIES
from stagetrail.sources import BOOKING_LOG, read_log

SF = f"{DATA}/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scan_of(spark, df):
    """Pushed filters and read schema of a plan with one scan."""
    text = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )
    return re.search(r"PushedFilters: \[(.*)\]", text).group(1), re.search(r"ReadSchema: (.*)", text).group(1)


def count(plan, operator):
    return len(re.findall(rf"(?<![A-Za-z]){operator}\b", plan))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_python(no_broadcast, name):
    plan = plan_of(QUERIES[name](no_broadcast, SF))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert operator not in plan


@pytest.mark.parametrize(
    ("name", "scans", "exchanges", "joins"),
    [
        ("booking_cohort", 1, 1, 0),
        ("first_booking_cohort", 1, 1, 0),
        ("period_stage_distincts", 1, 2, 0),
        ("cohort_flag_cooccurrence", 2, 3, 0),
        ("variant_first_touch", 1, 1, 0),
        ("first_event_times", 1, 1, 0),
        ("strict_sequence_funnel", 1, 2, 0),
        ("overall_mixed_funnel", 1, 2, 0),
        # One join of these puts the customer on each order line.
        ("reach_funnel", 3, 4, 1),
    ],
)
def test_one_pass(no_broadcast, name, scans, exchanges, joins):
    plan = plan_of(QUERIES[name](no_broadcast, SF))
    found = (count(plan, "FileScan"), count(plan, "Exchange"), count(plan, "SortMergeJoin"))
    assert found == (scans, exchanges, joins)


@pytest.mark.parametrize(
    ("name", "scans", "joins"),
    [
        ("cancel_attribution", 2, 1),
        # Orders as bookings, as stages and as owners of the lines; lines.
        ("churn_matrix", 4, 2),
        ("booking_intervals", 1, 0),
        ("next_event_times", 1, 0),
        ("assigned_cancel_edges", 2, 1),
        ("time_to_cancel_by_initiator", 3, 1),
        # Two periods of bookings and the events.
        ("interval_event_coverage", 3, 1),
    ],
)
def test_branches_share_their_scans(no_broadcast, name, scans, joins):
    df = QUERIES[name](no_broadcast, SF)
    df.collect()
    plan = plan_of(df).split("Initial Plan")[0]
    assert (count(plan, "FileScan"), count(plan, "SortMergeJoin")) == (scans, joins)


def test_hot_entity_is_split_by_the_join(no_broadcast, fixed_partitions, tmp_path):
    spark = no_broadcast
    small = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k) for k in small}
    for k, value in small.items():
        spark.conf.set(k, value)
    try:
        skewed(spark).repartition(8).write.parquet(str(tmp_path / "log"))
        log = spark.read.parquet(str(tmp_path / "log"))
        booked = StageSpec("book", ("book",), TimeWindow("2024-01-03", "2024-01-20"))
        df = stage_first_times(booked, log, [StageSpec("ssid", ("ssid",)), StageSpec("otp", ("otp",))])
        df.collect()
        assert "SortMergeJoin(skew=true)" in plan_of(df)
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)


@pytest.mark.parametrize("name", ["reach_funnel", "period_stage_distincts", "overall_mixed_funnel", "variant_first_touch", "churn_matrix"])
def test_aggregates_stay_hashed(no_broadcast, name):
    assert "SortAggregate" not in plan_of(QUERIES[name](no_broadcast, SF))


def test_rank_is_cut_before_the_shuffle(no_broadcast):
    plan = plan_of(QUERIES["latest_per_transaction"](no_broadcast, SF))
    assert count(plan, "WindowGroupLimit") == 2


def stored_booking_log(spark, tmp_path):
    spark.createDataFrame([], BOOKING_LOG.schema()).write.parquet(str(tmp_path / "b"))
    return read_log(spark, str(tmp_path / "b"), BOOKING_LOG)


def test_shifted_bounds_reach_the_reader(spark, tmp_path):
    log = stored_booking_log(spark, tmp_path)
    window = TimeWindow("2026-02-20", "2026-03-26", 330)
    booked = StageSpec("booked", ("book",), window, key_floor="5")
    pushed, schema = scan_of(spark, reach_funnel(booked, log, [StageSpec("ssid", ("ssid",), key_floor="5")]))
    assert "GreaterThanOrEqual(added_time,2026-02-19T18:30)" in pushed
    assert "GreaterThanOrEqual(mobile,5)" in pushed
    assert "EqualTo(event_name,ssid)" in pushed
    assert schema == "struct<mobile:string,event_name:string,added_time:timestamp_ntz>"


def test_nothing_before_the_cohort_is_read_for_stage_times(spark, tmp_path):
    log = stored_booking_log(spark, tmp_path)
    booked = StageSpec("booked", ("book",), TimeWindow("2026-02-20", "2026-03-26", 330))
    pushed, _ = scan_of(spark, stage_first_times(booked, log, [StageSpec("ssid", ("ssid",))]))
    assert "GreaterThanOrEqual(added_time,2026-02-19T18:30), EqualTo(event_name,ssid)" in pushed


def skewed(spark):
    """30 days of events, a third of them by one entity."""
    n = F.col("id")
    return spark.range(30_000).select(
        F.lit("log").alias("source"),
        F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), (F.hash(n) % 200).cast("string"))).alias("entity"),
        F.element_at(F.array(*[F.lit(e) for e in ("book", "ssid", "otp", "view")]), (F.abs(F.hash(n, F.lit(1))) % 4 + 1)).alias("event_name"),
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(F.abs(F.hash(n, F.lit(2))) % (30 * 86400)))).alias("event_time"),
        F.to_json(F.struct((n % 9000).cast("string").alias("txn"))).alias("payload"),
    )


@pytest.fixture
def fixed_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_hot_entity_is_spread_over_tasks(fixed_partitions):
    log = skewed(fixed_partitions)
    hot = F.col("entity") == "hot"
    led = with_next_time(log, "entity", "event_time", "later", ("event_name", "payload"))
    assert led.filter(hot).select(F.spark_partition_id()).distinct().count() == 4 * 2  # both halves of the union
    spans = booking_intervals(log, "book", TimeWindow("2024-01-01", "2024-02-01"), "txn")
    found = interval_attribution(spans, log.filter("event_name <> 'book'"), "inner")
    assert found.filter(hot).select(F.spark_partition_id()).distinct().count() == 4


def test_skewed_log_gives_what_the_joins_give(spark, duck):
    import duckdb

    log = skewed(spark)
    con = duckdb.connect()
    con.register("log", log.toPandas())
    window = TimeWindow("2024-01-03", "2024-01-20")
    spans = booking_intervals(log, "book", window)
    expected = con.execute("""
        WITH b AS (SELECT entity, event_time AS t, lead(event_time) OVER (PARTITION BY entity ORDER BY event_time) AS n
                   FROM log WHERE event_name = 'book' AND event_time >= '2024-01-03' AND event_time < '2024-01-20')
        SELECT count(*), count(e.event_time), min(b.t), max(e.event_time), sum(date_diff('second', b.t, e.event_time))
        FROM b LEFT JOIN (FROM log WHERE event_name <> 'book') e
        ON e.entity = b.entity AND e.event_time >= b.t AND (b.n IS NULL OR e.event_time < b.n)""").fetchone()
    seconds = F.unix_timestamp(F.col("event_time").cast("timestamp")) - F.unix_timestamp(F.col("booking_time").cast("timestamp"))
    got = (
        interval_attribution(spans, log.filter("event_name <> 'book'"))
        .agg(F.count("*"), F.count("event_time"), F.min("booking_time"), F.max("event_time"), F.sum(seconds))
        .first()
    )
    assert tuple(got) == tuple(expected)

    booked = StageSpec("book", ("book",), window)
    times = stage_first_times(booked, log, [StageSpec("ssid", ("ssid",)), StageSpec("otp", ("otp",))])
    expected = con.execute("""
        WITH b AS (SELECT entity, min(event_time) AS t FROM log
                   WHERE event_name = 'book' AND event_time >= '2024-01-03' AND event_time < '2024-01-20' GROUP BY entity)
        SELECT b.entity, b.t, min(e.event_time) FILTER (WHERE event_name = 'ssid'), min(e.event_time) FILTER (WHERE event_name = 'otp')
        FROM b LEFT JOIN log e ON e.entity = b.entity AND e.event_time >= b.t GROUP BY ALL""").fetchall()
    assert sorted(map(tuple, times.collect()), key=str) == sorted(expected, key=str)
