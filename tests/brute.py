"""The journeys computed row by row in plain Python, for small logs."""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import datetime, timedelta

SHIFT = timedelta(minutes=330)
FLOOR = "5999999999"


def day(text):
    return datetime.fromisoformat(text)


def field(payload, key):
    try:
        value = json.loads(payload).get(key)
    except (TypeError, ValueError, AttributeError):
        return None
    return None if value is None else str(value)


def kept(log):
    return [r for r in log if r[0] is not None and r[0] >= FLOOR]


def booked(bookings, lo, hi):
    return [r for r in kept(bookings) if r[1] == "booking_fee_captured" and lo <= r[2] + SHIFT < hi]


def hours(a, b):
    def index(t):
        return int((t - datetime(1970, 1, 1)) / timedelta(hours=1) // 1)

    return index(b) - index(a)


def half_up(x):
    return None if x is None else float(int(abs(x) + 0.5)) * (1 if x >= 0 else -1)


def mean(values):
    values = [v for v in values if v is not None]
    return half_up(sum(values) / len(values)) if values else None


BOOKING_STAGES = ["ssid_set", "address_updated", "booking_verified"]
TASK_STAGES = ["NOTIF_SENT", "INTERESTED", "SLOT_SELECTED", "CUSTOMER_SLOT_CONFIRMED", "ASSIGNED", "OTP_VERIFIED"]


def reach(bookings, tasks, lo, hi, task_ok):
    cohort = {r[0] for r in booked(bookings, lo, hi)}
    seen = defaultdict(set)
    for r in bookings:
        seen[r[0]].add(r[1])
    done = defaultdict(set)
    for r in tasks:
        if task_ok(r[2]):
            done[r[0]].add(r[1])
    out = {"total_customers": len(cohort)}
    for s in BOOKING_STAGES:
        out[s] = sum(s in seen[c] for c in cohort)
    for s in TASK_STAGES:
        out[s.lower()] = sum(s in done[c] for c in cohort)
    out["cancelled"] = sum("cancelled" in seen[c] for c in cohort)
    return out


def churn(bookings, tasks, lo, hi, as_of):
    first = {}
    for r in booked(bookings, lo, hi):
        first[r[0]] = min(r[2], first.get(r[0], r[2]))
    out = defaultdict(int)
    for k in range(1, 10):
        for m in ("entry", "cust", "sys"):
            out[f"s{k}_{m}"] = 0
    limits = {4: 48, 5: 48, 6: 48, 7: 6, 8: 24, 9: 24}
    for k in limits:
        out[f"s{k}_pred"] = 0
    for c, start in first.items():

        def earliest(log, test, c=c, start=start):
            return min((r[2] for r in log if r[0] == c and r[2] >= start and test(r)), default=None)

        times = [earliest(bookings, lambda r, s=s: r[1] == s) for s in BOOKING_STAGES]
        times += [earliest(tasks, lambda r, s=s: r[1] == s) for s in TASK_STAGES]
        cust = earliest(bookings, lambda r: r[1] == "cancelled" and field(r[3], "initiated_by") == "customer")
        system = earliest(
            bookings, lambda r: r[1] == "cancelled" and (field(r[3], "initiated_by") or "").startswith("cops")
        )
        stuck = next((i for i, t in enumerate(times, 1) if t is None), 99)
        for k in range(1, 10):
            out[f"s{k}_entry"] += stuck >= k
            out[f"s{k}_cust"] += stuck == k and cust is not None
            out[f"s{k}_sys"] += stuck == k and system is not None
        end = cust or system or as_of
        for k, limit in limits.items():
            before, here = times[k - 2], times[k - 1]
            out[f"s{k}_pred"] += before is not None and here is None and hours(before, end) >= limit
    return dict(out)


def intervals(bookings, lo, hi):
    rows = sorted(booked(bookings, lo, hi), key=lambda r: (r[0], r[2], r[3] is not None, r[3] or ""))
    out = []
    for i, r in enumerate(rows):
        following = rows[i + 1][2] if i + 1 < len(rows) and rows[i + 1][0] == r[0] else None
        out.append((r, following))
    far = datetime.max

    def rank(item):
        r, following = item
        return (-r[2].timestamp(), r[0], r[3] is not None, r[3] or "", -(following or far).timestamp())

    chosen = {}
    for item in sorted(out, key=rank):
        chosen.setdefault(field(item[0][3], "transaction_id"), item)
    return [(r[0], r[2], following) for r, following in chosen.values()]


def attributed(spans, events):
    """(entity, booking_time) to the events inside; equal bookings share one entry."""
    found = {(e, s): [] for e, s, _ in spans}
    for e, start, end in spans:
        found[e, start] += [r for r in events if r[0] == e and r[2] >= start and (end is None or r[2] < end)]
    return found


def coverage(bookings, periods):
    out = []
    for label, (lo, hi) in periods.items():
        names = [{r[1] for r in rows} for rows in attributed(intervals(bookings, lo, hi), bookings).values()]

        def total(*wanted, names=names):
            return sum(any(w in n for w in wanted) for n in names) if names else None

        out.append((label, len(names), total("ssid_set"), total("ssid_captured"), total("ssid_set", "ssid_captured")))
    return sorted(out)


def time_to_cancel(bookings, tasks, lo, hi):
    spans = intervals(bookings, lo, hi)
    assigned = attributed(spans, [r for r in tasks if r[1] == "ASSIGNED"])
    cancelled = attributed(spans, [r for r in bookings if r[1] == "cancelled"])
    groups = defaultdict(list)
    for key in assigned:
        if assigned[key] and cancelled[key]:
            who = min((w for w in (field(r[3], "initiated_by") for r in cancelled[key]) if w is not None), default=None)
            groups[who].append(hours(min(r[2] for r in assigned[key]), min(r[2] for r in cancelled[key])))
    return {who: (len(v), mean(v)) for who, v in groups.items()}


def cancel_edges(bookings, tasks, lo, hi):
    spans = intervals(bookings, lo, hi)
    events = [r for r in tasks if r[1] in ("ASSIGNED", "REACHED_HOME")] + [r for r in bookings if r[1] == "cancelled"]
    per = attributed(spans, events)
    hit, reached, delayed, cust, system = 0, 0, 0, [], []
    for rows in per.values():
        a = [r[2] for r in rows if r[1] == "ASSIGNED"]
        c = [r for r in rows if r[1] == "cancelled"]
        if not a or not c:
            continue
        hit += 1
        reached += any(r[1] == "REACHED_HOME" for r in rows)
        gap = hours(min(a), min(r[2] for r in c))
        if any(field(r[3], "initiated_by") == "customer" for r in c):
            cust.append(gap)
        if any(field(r[3], "initiated_by") == "cops" for r in c):
            system.append(gap)
        delayed += any("delay" in (field(r[3], k) or "").lower() for r in c for k in ("reason", "reason_type"))
    if not per:
        return (None, None, None, None, None)
    return (hit, reached, mean(cust), mean(system), delayed)


def first_timers(app, event, lo, hi, key):
    return {
        r[0]
        for r in app
        if r[0] is not None and r[1] == event and lo <= r[2] < hi and (field(r[3], key) or "") in ("1", "1.0")
    }


def variant_chain(app, lo, hi):
    """Per user: variant and the stages reached in strict order."""
    touches, first = {}, defaultdict(dict)
    for u, name, t, payload in app:
        if u is None or not lo <= t < hi:
            continue
        first[u][name] = min(t, first[u].get(name, t))
        variant = (field(payload, "event_props.cost_breakdown_flow") or "").upper()
        if name == "how_to_get_started_clicked" and variant in ("A", "B", "C", "D"):
            touches[u] = min((t, variant), touches.get(u, (t, variant)))
    out = {}
    for u, (gs, variant) in touches.items():
        reached = ["get_started"]
        cost, pay = first[u].get("cost_today_clicked"), first[u].get("pay_100_to_move_forward_clicked")
        if cost is not None and cost > gs:
            reached.append("cost_today")
            if pay is not None and pay > cost:
                reached.append("pay_100")
                for stage, event in (
                    ("location_confirm", "I_AM_AT_INSTALL_LOCATION_CLICKED"),
                    ("fee_captured", "booking_fee_captured"),
                ):
                    if event in first[u] and first[u][event] > pay:
                        reached.append(stage)
        out[u] = (variant, reached)
    return out
