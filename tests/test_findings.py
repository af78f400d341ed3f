"""What the third review found: one small case for each finding."""

import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from fleetpulse.operators import analyses as X, blocked, engine, lifecycle as L, rule_index, series as A
from fleetpulse.operators.rules import make_rule
from fleetpulse.sources import sample_log, tables, testdata as T


def test_correlation_of_a_constant_is_not_a_number(spark):
    rows = [("flat", 1.0, float(k)) for k in range(4)] + [("line", float(k), 2.0 * k) for k in range(3)] + [("one", 1.0, 1.0)]
    wide = spark.createDataFrame(rows, "feed_id string, a double, b double")
    got = {r.feed_id: (r.corr, r.n) for r in X.correlation(wide, "a", "b", ["feed_id"]).collect()}
    assert math.isnan(got["flat"][0]) and got["flat"][1] == 4
    assert got["line"] == (1.0, 3) and got["one"] == (None, 1)


def test_of_equal_gaps_the_latest_rank_first(spark):
    seconds = [50, 40, 60, 50, 50, 70, 40, 50]
    found = spark.createDataFrame([("f", k // 2, k, s) for k, s in enumerate(seconds)], "feed_id string, blk long, ord long, seconds long")
    got = sorted((r.ord, r.seconds) for r in A.latest_largest_gaps(found, 4).collect())
    assert got == [(2, 60), (4, 50), (5, 70), (7, 50)]
    assert A.latest_largest_gaps(found, 20).count() == len(seconds)


def test_day_log_of_many_feeds_has_few_files(spark, tmp_path):
    start = datetime(2026, 3, 3, tzinfo=timezone.utc)
    rows = [(f"feed {k % 300}", 0, k, start + timedelta(minutes=3 * k), f"t{k}") for k in range(1200)]  # 300 feeds, three days
    entry = F.struct(*[F.lit(x).alias(n) for n, x in (("sensor", "s"), ("reading", "r"), ("type", "Fan"))],
                     *[F.lit(1.0).alias(n) for n in ("value", "min", "max", "avg")], F.lit("u").alias("unit"))
    samples = spark.createDataFrame(rows, "feed_id string, blk long, ord long, ts timestamp, raw_timestamp string").withColumn("sensors", F.array(entry))
    root = str(tmp_path / "days")
    tables.write_day_log(samples, root)
    assert len(list(tmp_path.glob("days/dt=*/part-*"))) <= 8 + 3
    lines = sample_log.read_day_log(spark, root)
    order = {}
    for r in lines.orderBy("feed_id", "blk", "ord").collect():
        order.setdefault(r.feed_id, []).append(int(r.value.split('"t')[2].split('"')[0]))
    assert len(order) == 300 and all(v == sorted(v) and len(v) == 4 for v in order.values())
    late = start + timedelta(days=9)
    assert sample_log.read_day_log(spark, root, late, late + timedelta(hours=1)).count() == 0


def test_watched_counts_equal_counted_pairs(spark):
    rows = [("cpu", "load", "Usage"), ("cpu", "load", "Power"), ("CPU1", "temp", "Fan"), ("gpu", "load", "Clock")] * 3
    readings = spark.createDataFrame(rows, "sensor string, reading string, type string")
    rules = spark.createDataFrame(
        [(0, "cp", None, None), (1, None, None, None), (2, "cp", None, None), (3, None, "load", "Usage"), (4, "zzz", None, None)],
        "rule_idx int, sensor string, reading string, type string")
    got = sorted(map(tuple, rule_index.watched_counts(readings, rules).collect()))
    watches = lambda s, r, t, i: ("cp" in s.lower(), True, "cp" in s.lower(), "load" in r and t == "Usage", False)[i]
    want = {}
    for s, r, t in rows:
        for i in range(5):
            if watches(s, r, t, i):
                want[i, s, r] = want.get((i, s, r), 0) + 1
    assert got == sorted((*k, n) for k, n in want.items())


def test_whole_feeds_are_spread_by_the_input(spark):
    stream = T.poll_stream(spark, "/root/testdata/sf0.001")
    assert blocked.partitions_for(stream) == 8 and blocked.partitions_for(spark.range(3)) == 8
    rule = make_rule(name="hot", kind="threshold", sensor="user_", op=">", threshold=60.0, clear=30.0)
    plan = engine.transitions(stream, [rule])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [feed_id" in plan


def test_event_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([("[1]",), ("{",), ('{"seq":1}',), (None,)], "raw string").select(F.trim("raw").alias("line"))
    found = L.check_events(lines)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.lower().count("parsejson") <= 1 and plan.count("from_json") + plan.count("entries") <= 1
    got = {r.line: r.reasons for r in found.collect()}
    assert found.columns == ["line", "reasons"] and got["[1]"] == got["{"] == got[None] == ["not an object"]
    assert "seq missing" not in got['{"seq":1}'] and "seq invalid" not in got['{"seq":1}'] and "id missing" in got['{"seq":1}']
