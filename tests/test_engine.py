import math
import random
from datetime import datetime, timedelta, timezone

import pytest

from fleetpulse.operators import engine, readings as R
from fleetpulse.operators.rules import make_rule
from fleetpulse.schema import SAMPLE_SCHEMA
from tests.brute import run_rules

T0 = datetime(2026, 2, 18, tzinfo=timezone.utc)


def samples_frame(spark, feeds, blk=5):
    """feeds: {feed: ticks}; block size is small so that borders are crossed."""
    rows = []
    for feed, ticks in feeds.items():
        for k, tick in enumerate(ticks):
            ts = T0 + timedelta(seconds=10 * k)
            rows.append((feed, "f", k // blk, k, ts, ts.isoformat(), tick is not None,
                         None if tick is None else [tuple(r) for r in tick]))
    return spark.createDataFrame(rows, SAMPLE_SCHEMA)


def got(spark, feeds, rules, chunk):
    df = engine.transitions(R.to_stream(samples_frame(spark, feeds)), rules, chunk)
    out = {f: [] for f in feeds}
    for r in df.orderBy("feed_id", "seq").collect():
        out[r.feed_id].append((r.seq, r.tick, r.rule, r.state, r.sensor, r.reading, r.value, r.unit, r.samples_in_violation))
    return out


def plain(edges):
    """NaN is not equal to itself; compare it as text."""
    return [tuple("nan" if isinstance(x, float) and math.isnan(x) else x for x in e) for e in edges]


RULES = [
    make_rule(name="low", kind="threshold", sensor="PSU", type="voltage", op="<", threshold=3.0, clear=5.0, for_samples=2),
    make_rule(name="high", kind="threshold", reading="12", op=">=", threshold=6.0, for_samples=1, severity="critical"),
    make_rule(name="max", kind="threshold", sensor="psu", metric="max", op=">", threshold=7.0, clear=2.0, for_samples=3),
    make_rule(name="jump", kind="rate", sensor="psu", op=">", threshold=2.0, clear=1.0, window_samples=3, for_samples=1),
    make_rule(name="fall", kind="rate", sensor="cpu", op="<=", threshold=-1.0, window_samples=2, for_samples=2),
    make_rule(name="frozen", kind="stale", for_samples=2),
    make_rule(name="gone", kind="missing", sensor="psu", for_samples=2),
    make_rule(name="gone1", kind="missing", type="Fan"),
    make_rule(name="off", kind="source-unavailable", for_samples=2),
]


def random_ticks(rng, n):
    series = [("PSU", "+12V", "Voltage"), ("PSU", "+5V", "Voltage"), ("CPU", "12-core", "Temperature"), ("Case", "Fan", "Fan")]
    ticks = []
    for _ in range(n):
        if rng.random() < 0.15:
            ticks.append(None)
            continue
        tick = []
        for s, r, ty in series:
            while rng.random() < 0.75:
                v = rng.choice([math.nan, 0.0, -0.0, *map(float, range(1, 9))])
                hi = rng.choice([v, 8.0])
                ty2 = ty if rng.random() < 0.9 else "Other"
                tick.append((s, r, ty2, v, 1.0, hi, 1.0, rng.choice(["V", "mV"])))
                if rng.random() < 0.85:
                    break
        rng.shuffle(tick)
        ticks.append(tick)
    return ticks


@pytest.mark.parametrize("chunk", [3, 7, 65_536])
def test_random_streams_equal_the_stepwise_model(spark, chunk):
    rng = random.Random(chunk)
    feeds = {f"m{k}": random_ticks(rng, rng.choice([1, 5, 30, 60])) for k in range(25)}
    actual = got(spark, feeds, RULES, chunk)
    total = 0
    for f, ticks in feeds.items():
        want = run_rules(RULES, ticks)
        assert plain(actual[f]) == plain(want), f
        total += len(want)
    assert total > 500


@pytest.mark.parametrize("need", [1, 4, 9])
def test_long_runs_cross_many_chunks(spark, need):
    rng = random.Random(need)
    feeds = {}
    for k in range(12):
        ticks, v = [], 1.0
        for _ in range(80):
            if rng.random() < 0.12:
                v = rng.choice([1.0, 4.0, 9.0, math.nan])
            ticks.append([("PSU", "+12V", "Voltage", v, 0.0, 0.0, 0.0, "V")] if rng.random() < 0.97 else [])
        feeds[f"m{k}"] = ticks
    rules = [
        make_rule(name="a", kind="threshold", sensor="psu", op="<", threshold=3.0, clear=5.0, for_samples=need),
        make_rule(name="b", kind="stale", for_samples=need),
    ]
    actual = got(spark, feeds, rules, 4)
    for f, ticks in feeds.items():
        assert plain(actual[f]) == plain(run_rules(rules, ticks)), f
