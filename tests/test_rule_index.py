"""Rules looked up by the parts of series' names, against trying each rule on each series."""

import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import engine, readings as R
from fleetpulse.operators.rule_index import watched_readings, watched_series
from fleetpulse.operators.rules import RuleTable, make_rule
from tests.brute import run_rules
from tests.test_engine import plain, samples_frame

RULE_DDL = "rule_idx int, sensor string, reading string, type string"


def test_index_equals_trying_all(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abÄ1 ") for _ in range(n))
    series = sorted({(word(rng.randint(0, 6)), word(rng.randint(1, 6)).upper(), rng.choice(["Fan", "Power", "Clock"])) for _ in range(300)})
    rules = [(i, rng.choice([None, word(rng.randint(1, 4)).strip().lower()]), rng.choice([None, word(rng.randint(1, 4)).strip().lower()]),
              rng.choice([None, None, "Fan", "Other"])) for i in range(400)]
    got = watched_series(spark.createDataFrame(series, "sensor string, reading string, type string"), spark.createDataFrame(rules, RULE_DDL))
    want = sorted((s, r, t, i) for s, r, t in series for i, a, b, c in rules
                  if (a is None or a in s.lower()) and (b is None or b in r.lower()) and c in (None, t))
    assert sorted(tuple(x) for x in got.collect()) == want and len({w[3] for w in want}) > 100


def test_readings_keep_their_columns_and_repeat(spark):
    rows = [("cpu", "load", "Usage", 1.0), ("cpu", "load", "Usage", 1.0), ("gpu", "load", "Usage", 2.0)]
    readings = spark.createDataFrame(rows, "sensor string, reading string, type string, value double")
    rules = spark.createDataFrame([(0, "cp", None, None), (1, None, None, None), (2, None, "zzz", None)], RULE_DDL)
    got = sorted(tuple(x) for x in watched_readings(readings, rules).collect())
    assert got == sorted([(*r, 0) for r in rows[:2]] + [(*r, 1) for r in rows])
    assert watched_readings(readings.where(F.lit(False)), rules).count() == 0 and watched_readings(readings, rules.limit(0)).count() == 0


@pytest.mark.parametrize("many", [100])
def test_engine_with_many_rules_equals_the_stepwise_model(spark, many):
    """Above ``INDEX_FROM`` rules are looked up; kinds are mixed, and some watch nothing."""
    rng = random.Random(8)
    rules = []
    for i in range(many):
        sensor = rng.choice(["psu", "cpu", "c", "none"])
        rules.append(rng.choice([
            lambda: make_rule(name=f"t{i}", kind="threshold", sensor=sensor, op=">", threshold=float(rng.randint(2, 7)), for_samples=rng.randint(1, 3)),
            lambda: make_rule(name=f"m{i}", kind="missing", sensor=sensor, for_samples=rng.randint(1, 3)),
            lambda: make_rule(name=f"o{i}", kind="source-unavailable", for_samples=rng.randint(1, 3)),
            lambda: make_rule(name=f"s{i}", kind="stale", reading="12", for_samples=rng.randint(1, 3))])())
    ticks = [None if rng.random() < 0.2 else [(s, "+12V", "Voltage", float(rng.randint(0, 8)), 0.0, 0.0, 0.0, "V") for s in ("PSU", "CPU") if rng.random() < 0.7] for _ in range(40)]
    assert len(rules) > engine.INDEX_FROM
    df = engine.transitions(R.to_stream(samples_frame(spark, {"m": ticks})), rules)
    got = [(r.seq, r.tick, r.rule, r.state, r.sensor, r.reading, r.value, r.unit, r.samples_in_violation) for r in df.orderBy("seq").collect()]
    assert plain(got) == plain(run_rules(rules, ticks)) and len(got) > 100


def test_a_table_of_rules_gives_what_a_list_of_them_gives(spark):
    """Rules stay a table: same edges over chunk borders, no rule in the plan, and wrong rules are refused."""
    rng = random.Random(11)
    rules = []
    for i in range(90):
        sensor = rng.choice(["psu", "cpu", "c", "none"])
        op = rng.choice([">", "<="])
        rules.append(rng.choice([
            lambda: make_rule(name=f"t{i}", kind="threshold", sensor=sensor, op=op, threshold=float(rng.randint(2, 7)), for_samples=rng.randint(1, 3)),
            lambda: make_rule(name=f"r{i}", kind="rate", sensor=sensor, op=op, threshold=1.0, window_samples=rng.randint(2, 3), severity="info"),
            lambda: make_rule(name=f"m{i}", kind="missing", sensor=sensor, for_samples=rng.randint(1, 3)),
            lambda: make_rule(name=f"o{i}", kind="source-unavailable", for_samples=rng.randint(1, 3)),
            lambda: make_rule(name=f"s{i}", kind="stale", reading="12", for_samples=rng.randint(1, 3))])())
    ticks = [None if rng.random() < 0.2 else [(s, "+12V", "Voltage", float(rng.randint(0, 8)), 0.0, 0.0, 0.0, "V") for s in ("PSU", "CPU") if rng.random() < 0.7] for _ in range(60)]
    stream = R.to_stream(samples_frame(spark, {"m": ticks}))
    frame = engine.rules_frame(spark, rules).withColumn("metric", F.when(F.col("kind").isin("threshold", "rate"), F.col("metric")))
    table = RuleTable(frame)
    want = sorted(map(tuple, engine.transitions(stream, rules).collect()))
    for chunk in (engine.DEFAULT_CHUNK, 8):
        df = engine.transitions(stream, table, chunk)
        assert plain(sorted(map(tuple, df.collect()))) == plain(want) and len(want) > 100
    many = RuleTable(frame.limit(0).unionByName(spark.range(2000).select(
        *[F.lit(v).cast(frame.schema[n].dataType).alias(n) if n not in ("rule_idx", "name") else {"rule_idx": F.col("id").cast("int"), "name": F.concat(F.lit("table-rule-"), "id")}[n].alias(n)
          for n, v in {"rule_idx": 0, "name": "", "kind": "threshold", "sensor": "psu", "reading": None, "type": None, "metric": None, "op": ">", "threshold": 5.0,
                       "clear": None, "for_samples": None, "window_samples": None, "severity": None}.items()])))
    assert many.carried == [] and "table-rule-7" not in engine.transitions(stream, many)._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError, match="op required"):
        RuleTable(frame.withColumn("op", F.lit(None).cast("string")))
