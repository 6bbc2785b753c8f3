"""Very many rows of one entity at one instant: same results, spread over tasks, merged before the timeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stagetrail.functions import TimeWindow
from stagetrail.operators import assigned_cancel_edges, booking_intervals, interval_attribution, interval_event_coverage, time_to_cancel_by_initiator
from stagetrail.operators.churn import initiator_is
from stagetrail.operators.timeline import crowded_instants, with_next_time

MONTH = TimeWindow("2024-01-01", "2024-02-01")
SCHEMA = "source string, entity string, event_name string, event_time timestamp_ntz, payload string"


def crowd_log(spark, crowd=300):
    """Few entities, times on whole hours, and crowds: before, at and after bookings, in the last interval, of nobody."""
    n = F.col("id")
    base = spark.range(4000).select(
        F.lit("log").alias("source"),
        F.when(n % 41 == 0, None).otherwise(F.concat(F.lit("u"), (F.hash(n) % 5).cast("string"))).alias("entity"),
        F.element_at(F.array(*[F.lit(e) for e in ("book", "assigned", "cancel", "reached", "view")]), (F.abs(F.hash(n, F.lit(1))) % 5 + 1)).alias("event_name"),
        (F.lit("2024-01-02").cast("timestamp_ntz") + F.make_dt_interval(hours=F.abs(F.hash(n, F.lit(2))) % 300)).alias("event_time"),
        F.when(n % 7 == 0, None).otherwise(F.to_json(F.struct((n % 900).cast("string").alias("txn"), F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), (n % 3 + 1).cast("int")).alias("initiated_by")))).alias("payload"),
    )
    places = [("hot", "2024-01-01 05:00:00"), ("hot", "2024-01-03 00:00:00"), ("hot", "2024-01-03 00:00:01"), ("hot", "2024-01-30 00:00:00"), ("alone", "2024-01-05 00:00:00"), (None, "2024-01-05 00:00:00")]
    many = [(e, t, k) for e, t in places for k in ("view", "assigned", "cancel")]
    crowds = spark.createDataFrame(many, "entity string, t string, event_name string").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(crowd))))
    crowds = crowds.select(F.lit("log").alias("source"), "entity", "event_name", F.col("t").cast("timestamp_ntz").alias("event_time"), F.format_string('{"initiated_by":"%s","n":"%d"}', F.lit("z"), "k").alias("payload"))
    books = [("log", "hot", "book", t, f'{{"txn":"{i}"}}') for i, t in enumerate(["2024-01-02", "2024-01-03", "2024-01-03", "2024-01-04", "2024-01-20"])]
    books = spark.createDataFrame(books, "source string, entity string, event_name string, event_time string, payload string").withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
    return base.unionByName(crowds).unionByName(books)


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("crowds") / "log")
    crowd_log(spark).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def con(log):
    import duckdb

    made = duckdb.connect()
    made.register("log", log.toPandas())
    made.execute("""
        CREATE TABLE spans AS
        WITH b AS (SELECT *, lead(event_time) OVER (PARTITION BY entity ORDER BY event_time, payload NULLS FIRST) AS n
                   FROM log WHERE event_name = 'book')
        SELECT entity, event_time AS t, n FROM b
        QUALIFY row_number() OVER (PARTITION BY payload ->> '$.txn' ORDER BY event_time DESC, entity NULLS FIRST, payload NULLS FIRST, n DESC NULLS FIRST) = 1""")
    return made


def spans_of(log):
    return booking_intervals(log, "book", MONTH, "txn")


def rows_of(found):
    return sorted((tuple(r) for r in found), key=str)


def test_intervals(log, con):
    assert rows_of(spans_of(log).collect()) == rows_of(con.execute("FROM spans").fetchall())
    plain = booking_intervals(log, "book", MONTH)
    expected = con.execute("SELECT entity, event_time, lead(event_time) OVER (PARTITION BY entity ORDER BY event_time) FROM log WHERE event_name = 'book'").fetchall()
    assert rows_of(plain.collect()) == rows_of(expected)


@pytest.mark.parametrize("crowd", [10, 100, 500, 10**6])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_attribution(log, con, crowd, how):
    events = log.filter("event_name in ('view', 'assigned')")
    got = interval_attribution(spans_of(log), events, how, crowd=crowd)
    expected = con.execute(f"""
        SELECT s.entity, s.t, e.event_name, e.event_time, e.payload FROM spans s {how} JOIN (FROM log WHERE event_name IN ('view', 'assigned')) e
        ON e.entity = s.entity AND e.event_time >= s.t AND (s.n IS NULL OR e.event_time < s.n)""").fetchall()
    assert rows_of(got.collect()) == rows_of(expected)


def test_crowds_are_few(log):
    found = {(r.entity, str(r.event_time)) for r in crowded_instants(log, rows=500).collect()}
    assert found == {("hot", "2024-01-01 05:00:00"), ("hot", "2024-01-03 00:00:00"), ("hot", "2024-01-03 00:00:01"), ("hot", "2024-01-30 00:00:00"), ("alone", "2024-01-05 00:00:00")}
    assert crowded_instants(log, rows=10**6).collect() == []


def test_aggregates(log, con):
    joined = """FROM spans s JOIN log e ON e.entity = s.entity AND e.event_time >= s.t AND (s.n IS NULL OR e.event_time < s.n)"""
    got = time_to_cancel_by_initiator(spans_of(log), log.filter("event_name = 'assigned'"), log.filter("event_name = 'cancel'"))
    expected = con.execute(f"""
        WITH b AS (SELECT s.entity, s.t, min(e.event_time) FILTER (event_name = 'assigned') AS a, min(e.event_time) FILTER (event_name = 'cancel') AS c,
                     min(payload ->> '$.initiated_by') FILTER (event_name = 'cancel') AS who {joined} GROUP BY ALL)
        SELECT who, count(*), CAST(round(avg(date_diff('hour', a, c))) AS DOUBLE) FROM b WHERE a IS NOT NULL AND c IS NOT NULL GROUP BY who""").fetchall()
    assert rows_of(got.collect()) == rows_of(expected)

    got = assigned_cancel_edges(spans_of(log), log, "assigned", "reached", "cancel", initiator_is("a"), initiator_is("b"), "7", ("txn",))
    expected = con.execute(f"""
        WITH b AS (SELECT s.entity, s.t, bool_or(event_name = 'assigned') AND bool_or(event_name = 'cancel') AS both_, bool_or(event_name = 'reached') AS r,
                     bool_or(event_name = 'cancel' AND contains(payload ->> '$.txn', '7')) AS late {joined} GROUP BY ALL)
        SELECT count(*) FILTER (both_), count(*) FILTER (both_ AND r), count(*) FILTER (both_ AND late) FROM b""").fetchall()[0]
    row = got.first()
    assert (row.cancelled_at_assigned_stage, row.reached_and_cancelled, row.delay_reason_count) == expected


def test_coverage_of_any_number_of_periods(log, con):
    cuts = ["2024-01-01", "2024-01-05", "2024-01-09", "2024-02-01"]
    periods = {f"p{i}": booking_intervals(log, "book", TimeWindow(a, b), "txn") for i, (a, b) in enumerate(zip(cuts, cuts[1:]))} | {"all": spans_of(log)}
    got = rows_of(interval_event_coverage(periods, log, ("view", "cancel")).collect())
    expected = []
    for label, spans in periods.items():
        con.register("part", spans.toPandas().astype({"booking_time": "datetime64[us]", "next_booking_time": "datetime64[us]"}))
        expected += con.execute(f"""
            WITH e AS (SELECT p.entity, booking_time, bool_or(event_name = 'view') AS v, bool_or(event_name = 'cancel') AS c
              FROM part p LEFT JOIN log e ON e.entity = p.entity AND e.event_time >= booking_time
                AND (next_booking_time IS NULL OR e.event_time < next_booking_time) GROUP BY ALL)
            SELECT '{label}', count(*), count(*) FILTER (v), count(*) FILTER (c), count(*) FILTER (v OR c) FROM e""").fetchall()
    assert got == rows_of(expected)


def test_equal_times_are_one_row(spark, log, con):
    rows = log.select("entity", "event_time")
    expected = con.execute("SELECT entity, event_time, lead(event_time) OVER (PARTITION BY entity ORDER BY event_time) FROM log").fetchall()
    led = with_next_time(rows, "entity", "event_time", "later")
    assert rows_of(led.collect()) == rows_of(expected)
    plan = led._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Window") :]
    assert "Aggregate [entity" in below and "count(1)" in below


def test_a_crowd_is_many_tasks(spark, tmp_path):
    crowd = spark.range(0, 200_000, 1, 16).select(F.lit("hot").alias("entity"), F.lit("e").alias("event_name"), F.lit("2024-01-03").cast("timestamp_ntz").alias("event_time"), F.col("id").cast("string").alias("payload"))
    crowd.write.parquet(str(tmp_path / "crowd"))
    events = spark.read.parquet(str(tmp_path / "crowd"))
    bookings = spark.sql("SELECT 'hot' AS entity, TIMESTAMP_NTZ '2024-01-02 00:00:00' AS booking_time, CAST(NULL AS TIMESTAMP_NTZ) AS next_booking_time")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        found = interval_attribution(bookings, events)
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(sizes) == 200_000 and len(sizes) >= 8 and max(sizes) < 50_000
