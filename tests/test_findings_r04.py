"""What the fourth review found."""

import random

import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import engine, level_rules, readings as R, rule_index
from fleetpulse.operators.rules import RuleTable, make_rule
from tests.test_engine import plain, samples_frame


def shuffled_rows(df):
    """Rows that all exchanges of an executed frame wrote."""
    rows, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            rows += node.metrics().apply("shuffleRecordsWritten").value()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_watched_readings_are_not_shuffled(spark):
    """each of 300 readings went through an exchange with each of the 1,000 rules that watch it."""
    ticks = [[("PSU", "+12V", "Voltage", float(i * 7 % 10), 0.0, 0.0, 0.0, "V")] for i in range(300)]
    rules = [make_rule(name=f"r{i}", kind="threshold", sensor="psu", op=">", threshold=i / 100) for i in range(1000)]
    df = engine.transitions(R.to_stream(samples_frame(spark, {"m": ticks})), RuleTable(engine.rules_frame(spark, rules)))
    found = df.collect()
    assert len(found) > 100_000 and shuffled_rows(df) < 50_000
    assert sorted(r.seq for r in found) == list(range(1, len(found) + 1))


@pytest.mark.parametrize("cells", [level_rules.CELLS, 60])
def test_level_rules_of_a_table_equal_a_list_of_them(spark, cells, monkeypatch):
    """levels of both directions with and without hysteresis, all metrics, repeated readings, labels that change, polls without source."""
    monkeypatch.setattr(level_rules, "CELLS", cells)
    rng = random.Random(5)
    rules = []
    for i in range(120):
        op, level = rng.choice([">", ">=", "<", "<="]), float(rng.randint(2, 7))
        clear = rng.choice([None, level - 2 if op[0] == ">" else level + 2])
        rules.append(make_rule(
            name=f"t{i}", kind="threshold", sensor=rng.choice([None, "psu", "c", "u", "none"]), reading="v", type=rng.choice([None, "voltage", "Fan"]), op=op,
            threshold=level, clear=clear, metric=rng.choice(["value", "value", "min", "avg"]), severity=rng.choice(["info", "critical"])))
    number = lambda: rng.choice([None, float("nan"), *map(float, range(9))])
    reading = lambda s: (s, "+12V", rng.choice(["Voltage", "Voltage", "Fan"]), number(), number(), number(), number(), "V")
    feeds = {f: [None if rng.random() < 0.2 else [reading(s) for s in ("PSU", "CPU", "PSU", "gpu") if rng.random() < 0.7] for _ in range(50)] for f in ("a", "b", "c")}
    stream = R.to_stream(samples_frame(spark, feeds))
    table = RuleTable(engine.rules_frame(spark, rules))
    assert level_rules.applies(table)
    want = sorted(map(tuple, engine.transitions(stream, rules).collect()), key=str)
    for chunk in (engine.DEFAULT_CHUNK, 100):
        df = engine.transitions(stream, table, chunk)
        assert plain(sorted(map(tuple, df.collect()), key=str)) == plain(want) and len(want) > 1000
    assert [f.dataType for f in df.schema] == [f.dataType for f in engine.transitions(stream, rules).schema]


def test_rules_without_a_number_of_their_own_are_taken_as_before(spark):
    rules = engine.rules_frame(spark, [make_rule(name=f"r{i}", kind="threshold", sensor="psu", op=">", threshold=1.0 + i) for i in range(3)])
    assert level_rules.applies(RuleTable(rules))
    assert not level_rules.applies(RuleTable(rules.unionByName(rules.limit(1))))
    assert not level_rules.applies(RuleTable(rules.withColumn("for_samples", F.lit(2).cast(rules.schema["for_samples"].dataType))))


def test_rules_are_unpacked_after_the_last_join(spark, monkeypatch):
    """each row of the result was a row of the last join."""
    monkeypatch.setattr(rule_index, "PACK", 4)
    rows = [(f"cpu{i % 40}", "load", t, 1.0) for i in range(400) for t in ("Usage", "Clock")[: 1 + i % 2]] + [(None, "load", "Usage", 1.0), ("cpu1", "load", None, 1.0)]
    readings = spark.createDataFrame(rows, "sensor string, reading string, type string, value double")
    asks = [("cpu", None, None), (None, "oa", "Usage"), ("u3", "load", None), ("zzz", None, None)]
    rules = [(i if i < 90 else None if i < 95 else 7, *asks[i % 4]) for i in range(100)]
    frame = spark.createDataFrame(rules, "rule_idx int, sensor string, reading string, type string")
    df = rule_index.watched_counts(readings, frame)
    got = sorted(map(tuple, df.collect()), key=str)
    want = []
    for idx, s, r, t in rules:
        hits = [(x[0], x[1]) for x in rows if None not in x and (s is None or s in x[0]) and (r is None or r in x[1]) and t in (None, x[2])]
        want += [(idx, *x, hits.count(x)) for x in set(hits)]
    assert got == sorted(want, key=str) and len(got) > 1000
    assert made_by_joins(df) < len(got)


def made_by_joins(df):
    """The most rows that one join of an executed frame made."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind.endswith("JoinExec"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return most
