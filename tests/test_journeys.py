"""The ready-made analyses on invented logs, against plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import brute
import pytest

from stagetrail.functions.time import cutoff_date
from stagetrail.plans import Journeys
from stagetrail.plans import vocabulary as v
from stagetrail.sources import APP_LOG, BOOKING_LOG, TASK_LOG, event_log, write_snapshot

AS_OF = datetime(2026, 5, 10, 9, 30)
CUTOFF = datetime(2026, 5, 5)
MOBILES = [*(f"6{i:09d}" for i in range(40)), "5999999998", "59", "+916000", None, "5999999999"]
USERS = [*(f"u{i}" for i in range(60)), None]


def clock(rng):
    # Half-hour steps make equal times and hour boundaries common.
    return datetime(2026, 2, 8) + timedelta(minutes=30 * rng.randrange(48 * 90))


def booking_payload(rng, i):
    if rng.random() < 0.05:
        return rng.choice([None, "{broken", "[]"])
    data = {}
    if rng.random() < 0.9:
        data["transaction_id"] = f"t{rng.randrange(150)}"
    data["initiated_by"] = rng.choice(["customer", "cops", "cops_auto", "COPS", None])
    if rng.random() < 0.3:
        data[rng.choice(["reason", "reason_type"])] = rng.choice(["Long DELAY", "price", "delayed visit"])
    return json.dumps(data)


def app_payload(rng):
    if rng.random() < 0.05:
        return rng.choice([None, "oops", "{}"])
    return json.dumps(
        {
            "profile.events.App Installed.count": rng.choice([1, "1", 2, "x", None]),
            "profile.events.booking_homepage_loaded.count": rng.choice([1, 1, 3]),
            "event_props.cost_breakdown_flow": rng.choice(["a", "B", "c", "D", "e", None]),
        }
    )


@pytest.fixture(scope="module")
def logs():
    rng = random.Random(7)
    names = ["booking_fee_captured"] * 3 + [*brute.BOOKING_STAGES, "ssid_captured", "cancelled", "cancelled", "other"]
    bookings = [(rng.choice(MOBILES), rng.choice(names), clock(rng), booking_payload(rng, i)) for i in range(1200)]
    tasks = [
        (rng.choice(MOBILES), rng.choice([*brute.TASK_STAGES, "ASSIGNED", "REACHED_HOME", "cancelled"]), clock(rng))
        for _ in range(1200)
    ]
    app_names = sorted({e for events in v.APP_STAGES.values() for e in events}) + [
        "App Installed",
        "checking_serviceablity_page_loaded",
        "Other",
    ]
    app = [(rng.choice(USERS), rng.choice(app_names), clock(rng), app_payload(rng)) for _ in range(3000)]
    return bookings, tasks, app


@pytest.fixture(scope="module")
def journeys(spark, logs):
    bookings, tasks, app = logs

    def frame(rows, layout):
        columns = [layout.entity, layout.event_name, layout.event_time] + ([layout.payload] if layout.payload else [])
        df = spark.createDataFrame(rows, layout.schema())
        return event_log(df, layout.source, *columns[:3], *columns[3:])

    return Journeys(frame(bookings, BOOKING_LOG), frame(tasks, TASK_LOG), frame(app, APP_LOG), AS_OF)


def one(df):
    return df.collect()[0].asDict()


def local(lo, hi):
    return brute.day(lo), brute.day(hi)


def test_reach_pre(journeys, logs):
    lo, hi = local("2026-02-13", "2026-04-13")
    expected = brute.reach(*logs[:2], *local("2026-02-20", "2026-03-26"), lambda t: lo <= t + brute.SHIFT < hi)
    assert one(journeys.reach_pre()) == expected


def test_reach_post(journeys, logs):
    lo = brute.day("2026-03-21")
    expected = brute.reach(
        *logs[:2], brute.day("2026-03-28"), CUTOFF, lambda t: lo <= t + brute.SHIFT and t <= AS_OF
    )
    assert one(journeys.reach_post()) == expected | {"post_end_date": CUTOFF.date()}


def test_reach_post_matured(journeys, logs):
    lo, hi = local("2026-03-21", "2026-04-15")
    expected = brute.reach(*logs[:2], *local("2026-03-28", "2026-04-05"), lambda t: lo <= t + brute.SHIFT < hi)
    assert one(journeys.reach_post_matured()) == expected


def test_churn(journeys, logs):
    result = one(journeys.churn())
    assert result == brute.churn(*logs[:2], brute.day("2026-03-28"), CUTOFF, AS_OF)
    assert len(result) == 33
    assert all(result[f"s{k}_pred"] > 0 for k in range(4, 10))


def test_ssid_coverage(journeys, logs):
    periods = {"PRE": local("2026-02-20", "2026-03-26"), "POST": local("2026-03-28", "2026-04-13")}
    got = sorted(
        (r.period, r.total_bookings, r.ssid_set_cnt, r.ssid_captured_cnt, r.any_ssid_cnt)
        for r in journeys.ssid_coverage().collect()
    )
    assert got == brute.coverage(brute.kept(logs[0]), periods)


def test_time_to_cancel(journeys, logs):
    got = {r.initiated_by: (r.cnt, r.avg_hours) for r in journeys.time_to_cancel().collect()}
    assert got == brute.time_to_cancel(brute.kept(logs[0]), brute.kept(logs[1]), *local("2026-02-20", "2026-03-26"))


def test_cancel_edges(journeys, logs):
    got = tuple(journeys.cancel_edges().collect()[0])
    assert got == brute.cancel_edges(brute.kept(logs[0]), brute.kept(logs[1]), *local("2026-02-20", "2026-03-26"))


def test_installer_funnel(journeys, logs):
    app = logs[2]
    lo, hi = local("2026-02-13", "2026-04-22")
    seen = {(r[0], r[1]) for r in app if lo <= r[2] < hi}
    for row in journeys.installer_funnel().collect():
        start, end = local(*{"PRE": ("2026-02-20", "2026-03-26"), "POST": ("2026-03-28", "2026-04-13")}[row.period])
        cohort = brute.first_timers(app, "App Installed", start, end, "profile.events.App Installed.count")
        assert row.app_installed == len(cohort) > 0
        for stage, events in v.APP_STAGES.items():
            if stage != "location_confirm":
                assert row[stage] == sum(any((u, e) in seen for e in events) for u in cohort)


def test_release_and_variant_funnels(journeys, logs):
    app = logs[2]
    lo, top = brute.day("2026-04-15"), brute.day("2026-04-14")
    chain = brute.variant_chain(app, lo, CUTOFF)
    expected = {
        stage: len({r[0] for r in app if r[1] in events and start <= r[2] < CUTOFF})  # NULL counts as one user
        for stage, events, start in [
            ("app_installed", ("App Installed",), lo),
            *[(s, v.APP_STAGES[s], top) for s in ("homepage", "check_clicked", "serviceable", "unserviceable", "how_works")],
        ]
    }
    stages = ("get_started", "cost_today", "pay_100", "location_confirm", "fee_captured")
    for stage in stages:
        expected[stage] = sum(stage in reached for _, reached in chain.values())
    assert one(journeys.release_funnel()) == expected
    rows = journeys.variant_funnel().collect()
    assert [r.variant for r in rows] == ["A", "B", "C", "D"]
    for r in rows:
        for stage in stages:
            assert r[stage] == sum(variant == r.variant and stage in reached for variant, reached in chain.values())


def test_serviceability_search(journeys, logs):
    pre, post = local("2026-02-20", "2026-03-26"), local("2026-03-28", "2026-04-13")
    users = {}
    for u, name, t, _ in logs[2]:
        period = "PRE" if pre[0] <= t < pre[1] else "POST" if post[0] <= t < post[1] else None
        if period and "serviceab" in name.lower():
            users.setdefault((period, name), set()).add(u)
    expected = {k: len(s - {None}) for k, s in users.items()}
    rows = journeys.serviceability_search().collect()
    assert {(r.period, r.event_name): r.distinct_users for r in rows} == expected
    assert rows == sorted(rows, key=lambda r: (r.period, -r.distinct_users, r.event_name))


def test_first_loader_reports(journeys, logs):
    app = logs[2]
    lo, hi = local("2026-03-28", "2026-04-13")
    cohort = brute.first_timers(app, "booking_homepage_loaded", lo, hi, "profile.events.booking_homepage_loaded.count")
    pairs = {(r[0], r[1]) for r in app if lo <= r[2] < hi and r[0] in cohort}
    counts = Counter(name for _, name in pairs)
    top = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
    assert [tuple(r) for r in journeys.first_loader_top_events(5).collect()] == top
    flags = [
        {n for n, (e,) in v.SERVICEABILITY_FLAGS.items() if (u, e) in pairs} for u in cohort
    ]
    assert one(journeys.first_loader_serviceability()) == {
        "total_first_time": len(cohort),
        **{n: sum(n in f for f in flags) for n in v.SERVICEABILITY_FLAGS},
        "any_serviceability": sum(bool(f) for f in flags),
        "auto_no_click": sum(bool(f) and "clicked" not in f for f in flags),
    }


def test_reports_and_snapshot(spark, journeys, tmp_path):
    post, pre = one(journeys.reach_post()), one(journeys.reach_pre())
    steps = ["total_customers", *brute.BOOKING_STAGES, *[s.lower() for s in brute.TASK_STAGES]]
    drops = journeys.post_dropoff().collect()
    assert [(r.enter, r.drop_n) for r in drops[:-1]] == [
        (post[a], post[a] - post[b]) for a, b in zip(steps, steps[1:], strict=False)
    ]
    assert drops[-1].stage == "TOTAL" and drops[-1].drop_n == post["total_customers"] - post["otp_verified"]
    deltas = {r.step: r for r in journeys.post_delta().collect()}
    diff = (post[steps[0]] - post[steps[1]]) / post[steps[0]] - (pre[steps[0]] - pre[steps[1]]) / pre[steps[0]]
    assert deltas[1].delta == pytest.approx(diff * 100)
    headline = one(journeys.post_headline())
    assert headline["lost"] == post["total_customers"] - post["otp_verified"]
    ranked = journeys.ranked_variants().collect()
    assert [r["rank"] for r in ranked] == [1, 2, 3, 4]
    ratios = [r.fee_captured / max(r.get_started, 1) for r in ranked]
    assert ratios == sorted(ratios, reverse=True)

    write_snapshot(journeys.snapshot(), str(tmp_path / "snapshot"))
    files = list((tmp_path / "snapshot").glob("*.json"))
    assert len(files) == 1
    record = json.loads(files[0].read_text())
    assert record["refreshed_at"] == "2026-05-10 09:30"
    assert record["post_end_date"] == str(cutoff_date(AS_OF)) == "2026-05-05"
    assert record["post_funnel"]["total"] == post["total_customers"]
    assert list(record["post_funnel"]) == list(v.POST_METRICS)
    assert list(record["variants"]) == ["A", "B", "C", "D"]
    release = one(journeys.release_funnel())
    assert record["new_release"] == {k: release[c] for k, c in v.RELEASE_METRICS.items()}


def test_read_from_parquet(spark, journeys, logs, tmp_path):
    paths = []
    for rows, layout in zip(logs, (BOOKING_LOG, TASK_LOG, APP_LOG), strict=True):
        path = str(tmp_path / layout.source)
        spark.createDataFrame(rows, layout.schema()).write.parquet(path)
        paths.append(path)
    stored = Journeys.read(spark, *paths, AS_OF)
    assert one(stored.churn()) == one(journeys.churn())
    assert one(stored.release_funnel()) == one(journeys.release_funnel())
