"""Incidents, escalation and delivery against step-by-step models."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from fleetpulse.operators import lifecycle as L

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
EVENTS = "feed_id string, seq long, id string, rule string, severity string, state string, classification string, processed_at timestamp"
TIERED = "feed_id string, seq long, rule string, severity string, tier int, processed_at timestamp"


def test_incident_steps(spark):
    rows = [
        ("f", 1, "a-1", "a", "warning", "fired", "benign", T0),                       # only noted
        ("f", 2, "a-2", "a", "warning", "cleared", "incident", T0),                   # nothing open
        ("f", 3, "a-3", "a", "warning", "fired", "anomaly", T0 + timedelta(hours=1)),
        ("f", 4, "a-4", "a", "critical", "fired", "incident", T0 + timedelta(hours=2)),
        ("f", 5, "a-4", "a", "critical", "fired", "incident", T0 + timedelta(hours=3)),  # again: re-snooze only
        ("f", 6, "a-6", "a", "warning", "fired", "incident", T0 + timedelta(hours=12)),  # after the snooze
        ("f", 7, "a-7", "a", "warning", "cleared", "incident", T0 + timedelta(hours=13)),
        ("f", 8, "a-8", "a", "warning", "fired", "incident", T0 + timedelta(hours=14)),
        ("f", 9, "b-9", "b", "info", "fired", "incident", T0 + timedelta(hours=15)),
    ]
    tagged = L.tag_incidents(spark.createDataFrame(rows, EVENTS))
    inc = {(r.rule, r.incident_no): r for r in L.incidents(tagged).collect()}
    assert set(inc) == {("a", 1), ("a", 2), ("b", 0)}
    one = inc["a", 1]
    assert (one.events, one.severity, one.classification, one.status) == (4, "critical", "incident", "closed")
    assert inc["a", 2].status == "open" and inc["a", 2].severity == "warning"
    cont = {r.seq: r.continuation for r in tagged.collect()}
    assert cont == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: False, 8: False, 9: False}


def test_tiers(spark):
    h = lambda k: T0 + timedelta(hours=k)
    rows = [
        ("f", 1, "w-1", "w", "warning", "fired", "incident", h(1)),
        ("f", 2, "w-2", "w", "warning", "fired", "incident", h(2)),
        ("f", 3, "w-3", "w", "warning", "fired", "incident", h(3)),
        ("f", 4, "i-4", "i", "info", "fired", "incident", h(4)),
        ("f", 5, "c-5", "c", "critical", "fired", "incident", h(5)),
        ("f", 6, "c-6", "c", "critical", "fired", "incident", h(6)),
        ("f", 7, "c-7", "c", "critical", "fired", "incident", h(7)),
        ("f", 8, "d-8", "d", "critical", "fired", "incident", h(8)),   # two open
        ("f", 9, "c-9", "c", "critical", "cleared", "incident", h(9)),
        ("f", 10, "d-10", "d", "critical", "fired", "incident", h(10)),  # the other is closed
    ]
    out = L.escalation_tiers(L.tag_incidents(spark.createDataFrame(rows, EVENTS)))
    assert [r.tier for r in out.orderBy("seq").collect()] == [1, 1, 2, 0, 2, 2, 3, 4, 0, 2]


def stepwise(rows, cooldown, cap):
    last, day, sent, out = {}, None, 0, {}
    for r in sorted(rows, key=lambda r: (r[5], r[1])):
        if r[4] <= 1:
            out[r[1]] = "allow"
            continue
        if r[5].date() != day:
            day, sent = r[5].date(), 0
        if r[2] in last and r[5] - last[r[2]] < cooldown:
            out[r[1]] = "suppress"
        elif sent >= cap:
            out[r[1]] = "batch"
        else:
            out[r[1]] = "allow"
            last[r[2]], sent = r[5], sent + 1
    return out


@pytest.mark.parametrize("hours, cap, steps", [(6, 2, [0, 1, 20, 90, 400, 700]), (30, 2, [0, 20, 90]), (80, 1, [1, 90, 400]), (1, 5, [0, 1, 20])])
def test_suppression_equals_the_stepwise_model(spark, hours, cap, steps):
    """Also where no feed ever pauses for as long as the cooldown, which runs over several days."""
    rng = random.Random(5)
    rows, want, seq = [], {}, 0
    for f in range(12):
        mine, t = [], T0
        for _ in range(rng.choice([3, 40, 120])):
            t += timedelta(minutes=rng.choice(steps))
            seq += 1
            mine.append((f"f{f}", seq, rng.choice("abcd"), "critical", rng.choice([0, 1, 2, 3, 4]), t))
        want.update(stepwise(mine, timedelta(hours=hours), cap))
        rows += mine
    rng.shuffle(rows)
    out = L.suppression(spark.createDataFrame(rows, TIERED), cooldown_seconds=hours * 3600, daily_cap=cap)
    got = {r.seq: r.decision for r in out.collect()}
    assert got == want and {"allow", "batch", "suppress"} == set(got.values())


def test_routes(spark):
    rows = [("f", k, "r", s, 3, T0, "allow") for k, s in enumerate(["critical", "warning", "info"])]
    df = spark.createDataFrame(rows, TIERED + ", decision string")
    got = [(r.severity, r.channel, r.route_error) for r in L.route(df, {"critical": ["phone", "mail"], "info": []}).orderBy("seq", "channel").collect()]
    assert got == [("critical", "mail", None), ("critical", "phone", None), ("warning", None, "nothing routed")]


def test_reconcile_needs_a_strictly_newer_clear(spark):
    inc = spark.createDataFrame(
        [("f", r, 0, "warning", "open", T0 + timedelta(hours=1)) for r in "abcd"] + [("g", "a", 0, "warning", "open", T0)],
        "feed_id string, rule string, incident_no long, severity string, status string, last_event timestamp")
    at = lambda k: (T0 + timedelta(hours=k)).isoformat()
    latest = spark.createDataFrame(
        [("f", "a", "cleared", at(2)), ("f", "b", "cleared", at(1)), ("f", "c", "fired", at(2)), ("g", "a", "cleared", at(5))],
        "feed_id string, rule string, state string, timestamp string")
    fresh = spark.createDataFrame([("f", True, "fresh"), ("g", False, "no samples")], "feed_id string, fresh boolean, fresh_reason string")
    got = {(r.feed_id, r.rule): (r.verdict, r.why) for r in L.reconcile(inc, latest, fresh).collect()}
    assert got == {
        ("f", "a"): ("recovered", "cleared"), ("f", "b"): ("indeterminate", "clear not newer"), ("f", "c"): ("still-firing", "fired"),
        ("f", "d"): ("indeterminate", "no transition"), ("g", "a"): ("indeterminate", "no samples")}


def test_failure_runs(spark):
    oks = [True, False, False, False, True, False]
    df = spark.createDataFrame([("f", k, ok) for k, ok in enumerate(oks)], "feed_id string, seq long, ok boolean")
    got = [(r.failures, r.blind) for r in L.failure_runs(df).orderBy("seq").collect()]
    assert got == [(0, False), (1, False), (2, False), (3, True), (0, False), (1, False)]


def test_ack_cursor_never_goes_back(spark):
    acks = spark.createDataFrame([("f", f"i{k}", s, k) for k, s in enumerate([5, 3, 9, 4])] + [("f", "i0", 5, 9)],
                                 "feed_id string, id string, seq long, ack_ord long")
    r = L.ack_cursor(acks, keep=3).collect()[0]
    assert r.last_acked_seq == 9 and r.recent_ids == ["i1", "i2", "i3"]
