"""ANSI SQL counterparts of the sample queries, written as joins and subqueries for DuckDB.

They share no structure with the DataFrame operators, so that agreement means something.
"""

from __future__ import annotations

BOOKING = """
  SELECT CAST(o_custkey AS VARCHAR) AS entity, o_orderpriority AS name, o_orderdate AS t, o_orderstatus AS who
  FROM orders
"""
TASK = """
  SELECT CAST(o.o_custkey AS VARCHAR) AS entity, l.l_returnflag || l.l_linestatus AS name, l.l_shipdate AS t
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
"""
APP = """
  SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS name, ts AS t,
    json_extract_string(props, '$.k') AS k,
    translate(left(json_extract_string(props, '$.k'), 1), '1234', 'abcd') AS flow,
    CAST(user_id AS VARCHAR) || '-' || json_extract_string(props, '$.k') AS txn
  FROM events
"""
# Payloads of every tenth event are cut off, missing, followed by text, or no object; nothing can be read from them.
DIRTY = """
  SELECT CAST(user_id AS VARCHAR) AS entity, event_type AS name, ts AS t,
    CASE WHEN event_id % 10 NOT IN (3, 4, 5, 6) THEN json_extract_string(props, '$.k') END AS k,
    translate(left(CASE WHEN event_id % 10 NOT IN (3, 4, 5, 6) THEN json_extract_string(props, '$.k') END, 1), '1234', 'abcd') AS flow,
    CASE WHEN event_id % 10 NOT IN (3, 4, 5, 6) THEN CAST(user_id AS VARCHAR) || '-' || json_extract_string(props, '$.k') END AS txn
  FROM events
"""
VISIT = """
  SELECT CAST(user_id AS VARCHAR) || '@' || CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS VARCHAR) AS entity,
    event_type AS name, ts AS t
  FROM events
"""
LOGS = f"booking AS ({BOOKING}), task AS ({TASK})"

ORDER_STAGES = {"high": "2-HIGH", "medium": "3-MEDIUM", "unspecified": "4-NOT SPECIFIED"}
LINE_STAGES = {"af": "AF", "ao": "AO", "nf": "NF", "no": "NO", "rf": "RF", "ro": "RO"}
STEPS = ["total_customers", *ORDER_STAGES, *LINE_STAGES]
LIMITS = {4: 4800, 5: 4800, 6: 4800, 7: 600, 8: 2400, 9: 2400}


def _local(lo: str, hi: str) -> str:
    return f"t + INTERVAL 330 MINUTE >= TIMESTAMP '{lo}' AND t + INTERVAL 330 MINUTE < TIMESTAMP '{hi}'"


def _plain(lo: str, hi: str) -> str:
    return f"t >= TIMESTAMP '{lo}' AND t < TIMESTAMP '{hi}'"


PRE_ORDERS = _local("1995-01-01", "1998-04-01")
POST_ORDERS = _local("1998-04-01", "2001-07-27")
PRE_LINES = _local("1997-06-01", "1998-06-01")
POST_LINES = "t + INTERVAL 330 MINUTE >= TIMESTAMP '2000-12-01' AND t <= TIMESTAMP '2001-08-01 12:00:00'"
PRE_EVENTS = _plain("2024-01-01", "2024-01-15")
POST_EVENTS = _plain("2024-01-17", "2024-02-01")
PRE_BOOKINGS = _local("2024-01-01", "2024-01-16")
POST_BOOKINGS = _local("2024-01-16", "2024-02-01")
RELEASE = _plain("2024-01-02", "2024-01-31")
RELEASE_TOP = _plain("2024-01-01", "2024-01-31")


def _reach(cohort: str, lines: str, extra: str = "") -> str:
    def reached(log: str, event: str, bound: str) -> str:
        return (
            f"CAST(sum(CASE WHEN entity IN (SELECT entity FROM {log} WHERE name = '{event}' AND {bound}) "
            "THEN 1 ELSE 0 END) AS BIGINT)"
        )

    columns = [f"{reached('booking', e, 'TRUE')} AS {n}" for n, e in ORDER_STAGES.items()]
    columns += [f"{reached('task', e, lines)} AS {n}" for n, e in LINE_STAGES.items()]
    columns.append(f"{reached('booking', '5-LOW', 'TRUE')} AS cancelled")
    return f"""
WITH {LOGS},
cohort AS (SELECT DISTINCT entity FROM booking WHERE name = '1-URGENT' AND entity >= '0' AND {cohort})
SELECT count(*) AS total_customers, {extra} {", ".join(columns)} FROM cohort"""


REACH_PRE = _reach(PRE_ORDERS, PRE_LINES)
REACH_POST = _reach(POST_ORDERS, POST_LINES, "DATE '2001-07-27' AS post_end_date,")
REACH_MATURED = _reach(_local("1998-04-01", "2000-01-01"), _local("1999-06-01", "2000-06-01"))

REACH_VISITS = f"""
WITH visit AS ({VISIT}),
cohort AS (SELECT DISTINCT entity FROM visit WHERE name = 'purchase' AND entity >= '0' AND {_local("2024-01-01", "2024-02-01")})
SELECT count(DISTINCT c.entity) AS total_customers,
  {", ".join(f"count(DISTINCT c.entity) FILTER (WHERE v.name = '{e}') AS {e}" for e in ("view", "click", "signup", "error"))}
FROM cohort c LEFT JOIN visit v ON v.entity = c.entity"""

BOOKED = f"booked AS (SELECT entity, min(t) AS booking_time FROM booking WHERE name = '1-URGENT' AND entity >= '0' AND {POST_ORDERS} GROUP BY entity)"


def _stage_times(log: str, stages: dict[str, str]) -> str:
    return ", ".join(
        f"(SELECT min(x.t) FROM {log} x WHERE x.entity = b.entity AND x.name = '{e}' AND x.t >= b.booking_time) AS t_{n}"
        for n, e in stages.items()
    )


def _cancel_times() -> str:
    rules = {"t_cust_cancel": "x.who = 'F'", "t_sys_cancel": "x.who LIKE 'P%'"}
    return ", ".join(
        f"(SELECT min(x.t) FROM booking x WHERE x.entity = b.entity AND x.name = '5-LOW' AND {rule} "
        f"AND x.t >= b.booking_time) AS {name}"
        for name, rule in rules.items()
    )


STAGE_TIMES = f"{_stage_times('booking', ORDER_STAGES)}, {_stage_times('task', LINE_STAGES)}"
CHURN_STAGES = [f"t_{n}" for n in [*ORDER_STAGES, *LINE_STAGES]]
_END = "coalesce(t_cust_cancel, t_sys_cancel, TIMESTAMP '2001-08-01 12:00:00')"
_STUCK = "CASE " + " ".join(f"WHEN {c} IS NULL THEN {i}" for i, c in enumerate(CHURN_STAGES, 1)) + " ELSE 99 END"
_OVERDUE = {
    k: f"({CHURN_STAGES[k - 2]} IS NOT NULL AND {CHURN_STAGES[k - 1]} IS NULL "
    f"AND date_diff('hour', {CHURN_STAGES[k - 2]}, {_END}) >= {hours})"
    for k, hours in LIMITS.items()
}
TIMES = f"WITH {LOGS}, {BOOKED}, times AS (SELECT b.*, {STAGE_TIMES}, {_cancel_times()} FROM booked b)"
CHURN_CELLS = (
    {f"s{k}_entry": f"stuck >= {k}" for k in range(1, 10)}
    | {f"s{k}_cust": f"stuck = {k} AND t_cust_cancel IS NOT NULL" for k in range(1, 10)}
    | {f"s{k}_sys": f"stuck = {k} AND t_sys_cancel IS NOT NULL" for k in range(1, 10)}
    | {f"s{k}_pred": test for k, test in _OVERDUE.items()}
)
CLASSIFIED = f"{TIMES}, classified AS (SELECT *, {_STUCK} AS stuck FROM times)"
CHURN = f"{CLASSIFIED} SELECT {', '.join(f'count(*) FILTER (WHERE {c}) AS {n}' for n, c in CHURN_CELLS.items())} FROM classified"
CHURN_LONG = CLASSIFIED + " UNION ALL ".join(
    f" SELECT {n[1]} AS stage, '{n[3:]}' AS metric, count(*) FILTER (WHERE {c}) AS value FROM classified"
    for n, c in CHURN_CELLS.items()
)


def _period_stages(log: str, pre: str, post: str, events: str, first: str) -> str:
    kinds = {"view": "('view')", "interacted": "('click', 'signup')", "error": "('error')", "purchase": "('purchase')"}
    stages = ", ".join(
        f"count(DISTINCT CASE WHEN e.name IN {names} THEN c.entity END) AS {n}" for n, names in kinds.items()
    )
    return f"""
WITH log AS ({log}),
periods(period) AS (VALUES ('PRE'), ('POST')),
cohort AS (
  SELECT DISTINCT 'PRE' AS period, entity FROM log WHERE name = 'signup' AND {pre}
  UNION ALL
  SELECT DISTINCT 'POST' AS period, entity FROM log WHERE name = 'signup' AND {post})
SELECT p.period, count(DISTINCT c.entity) AS {first}, {stages}
FROM periods p LEFT JOIN cohort c ON c.period = p.period
LEFT JOIN (SELECT * FROM log WHERE {events}) e ON e.entity = c.entity
GROUP BY p.period"""


CHAIN = f"""
app AS ({APP}),
touch AS (
  SELECT entity, upper(flow) AS variant, t AS gs_time FROM app
  WHERE name = 'signup' AND {RELEASE} AND upper(flow) IN ('A', 'B', 'C', 'D')
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY t, upper(flow)) = 1),
firsts AS (SELECT entity, name, min(t) AS t FROM app WHERE {RELEASE} GROUP BY entity, name),
chain AS (
  SELECT s.entity, s.variant, v.t AS view_t, c.t AS click_t, e.t AS error_t, p.t AS purchase_t
  FROM touch s
  LEFT JOIN firsts v ON v.entity = s.entity AND v.name = 'view' AND v.t > s.gs_time
  LEFT JOIN firsts c ON c.entity = s.entity AND c.name = 'click' AND c.t > v.t
  LEFT JOIN firsts e ON e.entity = s.entity AND e.name = 'error' AND e.t > c.t
  LEFT JOIN firsts p ON p.entity = s.entity AND p.name = 'purchase' AND p.t > c.t)"""
CHAIN_COUNTS = (
    "count(entity) AS get_started, count(view_t) AS view, count(click_t) AS click, "
    "count(error_t) AS error, count(purchase_t) AS purchase"
)
SEQUENCE = f"WITH {CHAIN} SELECT variant, {CHAIN_COUNTS} FROM chain GROUP BY variant"
MIXED = f"""
WITH {CHAIN}
SELECT
  (SELECT count(*) FROM (SELECT DISTINCT entity FROM app WHERE name = 'signup' AND {RELEASE})) AS signups,
  (SELECT count(*) FROM (SELECT DISTINCT entity FROM app WHERE name = 'view' AND {RELEASE_TOP})) AS views,
  (SELECT count(*) FROM (SELECT DISTINCT entity FROM app WHERE name IN ('click', 'purchase') AND {RELEASE_TOP})) AS interactions,
  (SELECT count(*) FROM (SELECT DISTINCT entity FROM app WHERE name = 'error' AND {_plain("2024-01-01", "2024-01-05")})) AS errors,
  {CHAIN_COUNTS}
FROM chain"""


def _intervals(name: str, window: str) -> str:
    return f"""
{name} AS (
  SELECT entity, t AS booking_time, nxt AS next_booking_time
  FROM (SELECT *, lead(t) OVER (PARTITION BY entity ORDER BY t, k) AS nxt
        FROM app WHERE name = 'purchase' AND entity >= '0' AND {window})
  QUALIFY row_number() OVER (PARTITION BY txn ORDER BY t DESC, entity, nxt DESC NULLS FIRST) = 1)"""


_IN = "e.entity = b.entity AND e.t >= b.booking_time AND (b.next_booking_time IS NULL OR e.t < b.next_booking_time)"
INTERVALS = f"WITH app AS ({APP}), {_intervals('intervals', PRE_BOOKINGS)}"
ATTRIBUTION = f"""
{INTERVALS}
SELECT b.entity, b.booking_time, e.name AS event_name, e.t AS event_time
FROM intervals b %s JOIN (SELECT * FROM app WHERE name IN ('click', 'error')) e ON {_IN}"""


def _coverage(period: str) -> str:
    return f"""
SELECT '{period}' AS period, count(*) AS total_bookings,
  count(*) FILTER (WHERE clicks > 0) AS click_cnt, count(*) FILTER (WHERE errors > 0) AS error_cnt,
  count(*) FILTER (WHERE clicks + errors > 0) AS any_cnt
FROM (SELECT b.entity, b.booking_time, count(*) FILTER (WHERE e.name = 'click') AS clicks,
        count(*) FILTER (WHERE e.name = 'error') AS errors
      FROM {period.lower()}_intervals b LEFT JOIN app e ON {_IN} GROUP BY ALL)"""


EDGES = f"""
{INTERVALS},
per_booking AS (
  SELECT b.entity, b.booking_time,
    min(e.t) FILTER (WHERE e.name = 'click') AS assigned, min(e.t) FILTER (WHERE e.name = 'error') AS cancelled,
    count(*) FILTER (WHERE e.name = 'view') AS reached,
    count(*) FILTER (WHERE e.name = 'error' AND e.flow = 'a') AS by_customer,
    count(*) FILTER (WHERE e.name = 'error' AND e.flow = 'b') AS by_system,
    count(*) FILTER (WHERE e.name = 'error' AND e.k LIKE '%9%') AS delayed
  FROM intervals b LEFT JOIN app e ON {_IN} GROUP BY ALL),
edge AS (
  SELECT *, date_diff('hour', assigned, cancelled) AS hours,
    assigned IS NOT NULL AND cancelled IS NOT NULL AS hit FROM per_booking)
SELECT count(*) FILTER (WHERE hit) AS cancelled_at_assigned_stage,
  count(*) FILTER (WHERE hit AND reached > 0) AS reached_and_cancelled,
  round(avg(hours) FILTER (WHERE hit AND by_customer > 0), 0) AS avg_hours_cust_cancel,
  round(avg(hours) FILTER (WHERE hit AND by_system > 0), 0) AS avg_hours_sys_cancel,
  count(*) FILTER (WHERE hit AND delayed > 0) AS delay_reason_count
FROM edge"""

TIME_TO_CANCEL = f"""
{INTERVALS},
assigned AS (SELECT b.entity, b.booking_time, min(e.t) AS t FROM intervals b JOIN app e ON {_IN} AND e.name = 'click' GROUP BY ALL),
cancelled AS (SELECT b.entity, b.booking_time, min(e.t) AS t, min(e.flow) AS who
  FROM intervals b JOIN app e ON {_IN} AND e.name = 'error' GROUP BY ALL)
SELECT c.who AS initiated_by, count(*) AS cnt, round(avg(date_diff('hour', a.t, c.t)), 0) AS avg_hours
FROM assigned a JOIN cancelled c USING (entity, booking_time) GROUP BY c.who"""

ORDER_LINES = f"""
WITH {LOGS},
intervals AS (
  SELECT entity, t AS booking_time, lead(t) OVER (PARTITION BY entity ORDER BY t) AS next_booking_time
  FROM booking WHERE {_local("1995-01-01", "2001-09-01")})
SELECT b.entity, b.booking_time, count(e.t) AS lines, min(e.t) AS first_shipped
FROM intervals b LEFT JOIN task e ON {_IN} GROUP BY b.entity, b.booking_time"""


def _dropoff(funnel: str) -> str:
    lines = [
        f"SELECT {i} AS step, '{STEPS[i]}' AS stage, {STEPS[i - 1]} AS enter, {STEPS[i - 1]} - {STEPS[i]} AS drop_n, "
        f"({STEPS[i - 1]} - {STEPS[i]}) / total_customers * 100 AS drop_pct FROM funnel"
        for i in range(1, len(STEPS))
    ]
    lines.append(
        f"SELECT {len(STEPS)} AS step, 'TOTAL' AS stage, total_customers AS enter, total_customers - ro AS drop_n, "
        "(total_customers - ro) / total_customers * 100 AS drop_pct FROM funnel"
    )
    return f"WITH funnel AS ({funnel}) {' UNION ALL '.join(lines)}"


DELTA = f"""
SELECT step, a.stage, a.drop_pct - b.drop_pct AS delta,
  CASE WHEN abs(a.drop_pct - b.drop_pct) < 0.3 THEN 'neutral' WHEN a.drop_pct > b.drop_pct THEN 'bad' ELSE 'good' END AS label
FROM ({_dropoff(REACH_POST)}) a JOIN ({_dropoff(REACH_PRE)}) b USING (step)"""


def _struct(names: dict[str, str]) -> str:
    return "{" + ", ".join(f"'{k}': CAST(coalesce({c}, 0) AS BIGINT)" for k, c in names.items()) + "}"


SNAPSHOT_POST = {"total": "total_customers", **{s: s for s in [*ORDER_STAGES, *LINE_STAGES]}, "cancelled": "cancelled"}
SNAPSHOT_RELEASE = {"installs": "signups", "views": "views", "started": "get_started", "paid": "purchase"}
SNAPSHOT_VARIANT = {"entry": "get_started", "cost": "view", "pay": "click", "location": "error", "paid": "purchase"}
SNAPSHOT = f"""
SELECT CAST(to_json({{
  'refreshed_at': '2001-08-01 12:00',
  'post_end_date': (SELECT CAST(post_end_date AS VARCHAR) FROM ({REACH_POST})),
  'post_funnel': (SELECT {_struct(SNAPSHOT_POST)} FROM ({REACH_POST})),
  'new_release': (SELECT {_struct(SNAPSHOT_RELEASE)} FROM ({MIXED})),
  'variants': (SELECT map(list(variant ORDER BY variant), list({_struct(SNAPSHOT_VARIANT)} ORDER BY variant)) FROM ({SEQUENCE}))
}}) AS VARCHAR) AS snapshot"""

SQL: dict[str, str] = {
    "booking_log_scan": """
SELECT 'booking' AS source, CAST(o_custkey AS VARCHAR) AS entity, o_orderpriority AS event_name,
  o_orderdate AS event_time, '{"initiated_by":"' || o_orderstatus || '"}' AS payload FROM orders""",
    "task_log_scan": f"SELECT 'task' AS source, entity, name AS event_name, t AS event_time FROM ({TASK})",
    "app_log_scan": """
SELECT 'app' AS source, CAST(user_id AS VARCHAR) AS entity, event_type AS event_name, ts AS event_time, props AS payload
FROM events""",
    "booking_cohort": f"SELECT DISTINCT entity FROM ({BOOKING}) WHERE name = '1-URGENT' AND entity >= '0' AND {PRE_ORDERS}",
    "first_booking_cohort": f"WITH booking AS ({BOOKING}), {BOOKED} SELECT * FROM booked",
    "reach_funnel": REACH_PRE,
    "reach_funnel_rolling": REACH_POST,
    "reach_funnel_matured": REACH_MATURED,
    "reach_funnel_visits": REACH_VISITS,
    "stage_first_times": f"WITH {LOGS}, {BOOKED} SELECT b.*, {STAGE_TIMES} FROM booked b",
    "cancel_attribution": f"WITH {LOGS}, {BOOKED} SELECT b.*, {_cancel_times()} FROM booked b",
    "stuck_stage": f"{TIMES} SELECT entity, {_STUCK} AS stuck_stage FROM times",
    "stage_overdue_flags": f"{TIMES} SELECT entity, {', '.join(f'CAST({c} AS INTEGER) AS s{k}_pred' for k, c in _OVERDUE.items())} FROM times",
    "churn_matrix": CHURN,
    "churn_matrix_long": CHURN_LONG,
    "first_time_users": f"SELECT DISTINCT entity FROM ({APP}) WHERE name = 'signup' AND {PRE_EVENTS} AND TRY_CAST(k AS INTEGER) = 1",
    "period_stage_distincts": _period_stages(VISIT, PRE_EVENTS, POST_EVENTS, _plain("2024-01-01", "2024-02-01"), "app_installed"),
    "first_timer_periods": _period_stages(
        APP,
        f"TRY_CAST(k AS INTEGER) = 1 AND {PRE_EVENTS}",
        f"TRY_CAST(k AS INTEGER) = 1 AND {POST_EVENTS}",
        _plain("2024-01-12", "2024-01-20"),
        "signed_up",
    ),
    "event_search_by_period": f"""
SELECT CASE WHEN {PRE_EVENTS} THEN 'PRE' ELSE 'POST' END AS period, name AS event_name, count(DISTINCT entity) AS distinct_users
FROM ({VISIT}) WHERE name ILIKE '%I%' AND (({PRE_EVENTS}) OR ({POST_EVENTS})) GROUP BY 1, 2""",
    "daily_mask_funnel": f"""
WITH app AS ({APP}),
seen AS (
  SELECT entity, bool_or(name = 'signup' AND entity >= '0' AND {PRE_BOOKINGS}) AS member,
    bool_or(name = 'view' AND {_local("2024-01-03 07:30:00", "2024-01-03 21:00:00")}) AS v,
    bool_or(name IN ('click', 'error') AND {RELEASE}) AS c, bool_or(name = 'purchase') AS p
  FROM app GROUP BY entity)
SELECT count(*) AS total_customers, count(*) FILTER (WHERE v) AS viewed, count(*) FILTER (WHERE c) AS tried,
  count(*) FILTER (WHERE p) AS paid FROM seen WHERE member""",
    "cohort_top_events": f"""
WITH visit AS ({VISIT})
SELECT name AS event_name, count(DISTINCT entity) AS distinct_users FROM visit
WHERE {POST_EVENTS} AND entity IN (SELECT entity FROM visit WHERE name = 'signup' AND {POST_EVENTS})
GROUP BY name ORDER BY distinct_users DESC, name LIMIT 3""",
    "cohort_flag_cooccurrence": f"""
WITH visit AS ({VISIT}),
seen AS (
  SELECT entity, bool_or(name = 'signup') AS member, bool_or(name = 'click') AS c, bool_or(name = 'view') AS v,
    bool_or(name = 'purchase') AS p, bool_or(name = 'error') AS e
  FROM visit WHERE {PRE_EVENTS} GROUP BY entity)
SELECT count(*) AS total, count(*) FILTER (WHERE c) AS clicked, count(*) FILTER (WHERE v) AS viewed,
  count(*) FILTER (WHERE p) AS bought, count(*) FILTER (WHERE e) AS failed,
  count(*) FILTER (WHERE c OR v OR p OR e) AS any_flag,
  count(*) FILTER (WHERE NOT c AND (v OR p OR e)) AS others_without_click
FROM seen WHERE member""",
    "variant_first_touch": f"WITH {CHAIN} SELECT * FROM touch",
    "first_event_times": f"""
SELECT entity, {", ".join(f"min(CASE WHEN name = '{e}' THEN t END) AS {e}_time" for e in ("view", "click", "error", "purchase"))}
FROM ({APP}) WHERE {RELEASE} AND name IN ('view', 'click', 'error', 'purchase') GROUP BY entity""",
    "strict_sequence_funnel": SEQUENCE,
    "strict_sequence_from_parts": SEQUENCE,
    "overall_mixed_funnel": MIXED,
    "latest_per_transaction": f"""
SELECT txn AS transaction_id, any_value(entity) AS entity, max(t) AS event_time FROM ({APP}) WHERE name = 'purchase' GROUP BY txn""",
    "booking_intervals": f"{INTERVALS} SELECT * FROM intervals",
    "interval_attribution": ATTRIBUTION % "LEFT",
    "interval_attribution_inner": ATTRIBUTION % "",
    "order_interval_lines": ORDER_LINES,
    "interval_event_coverage": f"""
WITH app AS ({APP}), {_intervals("pre_intervals", PRE_BOOKINGS)}, {_intervals("post_intervals", POST_BOOKINGS)}
{_coverage("PRE")} UNION ALL {_coverage("POST")}""",
    "time_to_cancel_by_initiator": TIME_TO_CANCEL,
    "assigned_cancel_edges": EDGES,
    "three_log_edges": f"""
WITH {LOGS}, app AS ({APP}),
intervals AS (
  SELECT entity, t AS booking_time, lead(t) OVER (PARTITION BY entity ORDER BY t) AS next_booking_time
  FROM booking WHERE name = '1-URGENT' AND {_local("1995-01-01", "2001-09-01")}),
e AS (
  SELECT 'booking' AS source, entity, name, t, NULL AS flow, NULL AS k FROM booking WHERE name = '2-HIGH'
  UNION ALL SELECT 'task', entity, name, t, NULL, NULL FROM task
  UNION ALL SELECT 'app', entity, name, t, flow, k FROM app),
per_booking AS (
  SELECT b.entity, b.booking_time, min(e.t) FILTER (WHERE name = 'NO') AS assigned, min(e.t) FILTER (WHERE name = 'error') AS cancelled,
    count(*) FILTER (WHERE name = '2-HIGH') AS reached, count(*) FILTER (WHERE name = 'error' AND flow = 'a') AS by_customer,
    count(*) FILTER (WHERE name = 'error' AND flow = 'b') AS by_system, count(*) FILTER (WHERE name = 'error' AND k LIKE '%9%') AS delayed
  FROM intervals b JOIN e ON {_IN} GROUP BY ALL),
edge AS (SELECT *, date_diff('hour', assigned, cancelled) AS hours, assigned IS NOT NULL AND cancelled IS NOT NULL AS hit FROM per_booking)
SELECT count(*) FILTER (WHERE hit) AS cancelled_at_assigned_stage,
  count(*) FILTER (WHERE hit AND reached > 0) AS reached_and_cancelled,
  round(avg(hours) FILTER (WHERE hit AND by_customer > 0), 0) AS avg_hours_cust_cancel,
  round(avg(hours) FILTER (WHERE hit AND by_system > 0), 0) AS avg_hours_sys_cancel,
  count(*) FILTER (WHERE hit AND delayed > 0) AS delay_reason_count
FROM edge""",
    "next_event_times": f"""
SELECT entity, t AS event_time, lead(t) OVER (PARTITION BY entity ORDER BY t) AS next_time FROM ({APP})""",
    "stage_dropoff": _dropoff(REACH_POST),
    "cohort_delta": DELTA,
    "report_lines": f"""
WITH drops AS ({_dropoff(REACH_POST)}), deltas AS ({DELTA})
SELECT step, d.stage, format('{{:,}}', enter) AS enter_text, CAST(drop_n AS VARCHAR) AS drop_text,
  printf('%.1f%%', drop_pct) AS pct_text,
  CASE label WHEN 'neutral' THEN '≈' WHEN 'bad' THEN '▲ ' || printf('%+.1f%%', delta) ELSE '▼ ' || printf('%.1f%%', delta) END AS delta_text
FROM drops d JOIN deltas USING (step)""",
    "headline_rates": f"""
SELECT round(ro / total_customers * 100, 1) AS done_pct, total_customers - ro AS lost,
  round((total_customers - ro) / total_customers * 100, 1) AS lost_pct FROM ({REACH_POST})""",
    "variant_ranking": f"""
SELECT CAST(row_number() OVER (ORDER BY purchase / greatest(get_started, 1) DESC, variant) AS INTEGER) AS rank, variant, get_started, purchase,
  round(purchase / get_started * 100, 1) AS conv_pct FROM ({SEQUENCE})""",
    "renamed_metrics": f"SELECT signups AS installs, views, get_started AS started, purchase AS paid, CAST(0 AS BIGINT) AS absent FROM ({MIXED})",
    "metrics_snapshot": SNAPSHOT,
    "snapshot_sink": SNAPSHOT,
    "maturity_label": f"""
SELECT format('{{:,}}', total_customers) AS customers_text, strftime(post_end_date, '%b %-d') AS post_end_label
FROM ({REACH_POST})""",
    "payload_fields": f"""
SELECT entity, t AS event_time, k AS k_text, TRY_CAST(k AS INTEGER) AS k_int, TRY_CAST(txn AS INTEGER) AS not_a_number,
  upper(flow) AS flow, CAST(NULL AS VARCHAR) AS missing FROM ({APP})""",
    "dirty_payload_fields": f"""
SELECT t AS event_time, entity, k AS k_text, TRY_CAST(k AS INTEGER) AS k_int, upper(flow) AS flow, k AS odd_key FROM ({DIRTY})""",
    "latest_of_dirty": f"""
SELECT txn AS transaction_id, entity, t AS event_time FROM ({DIRTY}) WHERE name = 'purchase'
QUALIFY row_number() OVER (PARTITION BY txn ORDER BY t DESC, entity) = 1""",
    "floored_cohort": f"SELECT DISTINCT entity FROM ({BOOKING}) WHERE name = '1-URGENT' AND entity >= '5' AND {PRE_ORDERS}",
    "clock_fields": f"""
SELECT entity, t AS event_time, CAST(t + INTERVAL 330 MINUTE AS DATE) AS local_day,
  date_diff('hour', t, TIMESTAMP '2024-01-15 10:30:00') AS hours_left,
  CASE WHEN {PRE_EVENTS} THEN 'PRE' WHEN {POST_EVENTS} THEN 'POST' ELSE 'none' END AS period,
  ({PRE_EVENTS}) OR ({POST_EVENTS}) AS in_period,
  strftime(t, '%Y-%m-%d') AS day_text, strftime(t, '%b %-d') AS day_label, strftime(t, '%Y-%m-%d %H:%M') AS minute_text
FROM ({APP})""",
}
SQL["event_search_by_bitmap"] = SQL["event_search_by_period"]
SQL["period_stages_by_bitmap"] = SQL["period_stage_distincts"]
SQL["event_search_by_dictionary"] = SQL["event_search_by_period"]
SQL["pruned_top_events"] = SQL["cohort_top_events"]
SQL["rare_cohort_stage_times"] = SQL["stage_first_times"]
