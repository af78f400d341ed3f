import random

from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.operators import blocked
from fleetpulse.operators.rules import load_rules, make_rule, prune, rule_errors
from fleetpulse.operators.engine import rules_frame


def test_running_equals_plain_windows(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else str(rng.randrange(3)), k // 7, k, rng.choice([None, 1, 2, 5])) for k in range(400)]
    df = spark.createDataFrame(rows, "key string, blk long, ord long, x long")
    specs = [blocked.Running(op, op, F.col("x")) for op in ("sum", "max", "min", "last")]
    for inclusive in (False, True):
        for derived in (False, True):
            got = blocked.running(df, ["key"], "blk", ["ord"], specs, inclusive, derived)
            w = Window.partitionBy("key").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
            want = df.select("*", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("sum"), F.max("x").over(w).alias("max"),
                             F.min("x").over(w).alias("min"), F.last("x", True).over(w).alias("last"))
            assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_numbers_and_top(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else str(rng.randrange(3)), k // 5, k, rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, blk long, ord long, x double")
    w = Window.partitionBy("key")
    want = sorted((r.key, r.ord, r.n) for r in df.withColumn("n", F.row_number().over(w.orderBy("ord"))).collect())
    assert sorted((r.key, r.ord, r.n) for r in blocked.row_numbers(df, ["key"], "blk", ["ord"], "n").collect()) == want
    want = sorted((r.key, r.ord, r.n) for r in df.withColumn("n", F.row_number().over(w.orderBy(F.desc("x")))).collect())
    assert sorted((r.key, r.ord, r.n) for r in blocked.range_row_numbers(df, ["key"], [F.desc("x")], "n").collect()) == want
    top = blocked.top_per_key(df, ["key"], [F.desc("x")], 4)
    assert sorted((r.key, r.ord) for r in top.collect()) == sorted((k, o) for k, o, n in want if n <= 4)


CASES = {
    "24h": 86400, "90m": 5400, "1d12h": 129600, "30": 30, "45S": 45, "1H1h": 7200, "": None, "0": None, "0s": None, "-5": None, "+5": None,
    "5x": None, "h": None, "5h3": None, "1 h": None, "9223372036854775807": 2**63 - 1, "9223372036854775808": None,
    "106751991167300d": 106751991167300 * 86400, "106751991167301d": None, "99999999999999999999s": None, "000000000000000000000012s": 12,
}


def test_durations(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string").select("t", S.duration_seconds(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == CASES


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(max_size=70), min_size=200, max_size=200))
def test_slug(spark, names):
    def slug(n):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in n)
        return "".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789._-" else "-" for c in low)[:50] or "rule"

    names = [n for n in names if "\x00" not in n and not any(0xD800 <= ord(c) < 0xE000 for c in n)]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string")
    got = {r.k: r.s for r in df.select("k", S.slug(F.col("n")).alias("s")).collect()}
    assert got == {k: slug(n) for k, n in enumerate(names)}


def test_type_labels(spark):
    df = spark.createDataFrame([("VOLTAGE",), ("none",), ("unknown(12)",), ("Fan ",), ("Uſage",)], "t string")
    assert [r[0] for r in df.select(S.normalize_type(F.col("t"))).collect()] == ["Voltage", "None", "unknown", "unknown", "unknown"]


def test_comparisons_with_nan_are_false(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    got = [[r[0] for r in df.select(S.compare(F.lit(op), F.col("x"), F.lit(1.0))).collect()] for op in (">", ">=", "<", "<=")]
    assert got == [[False, False], [False, True], [False, False], [False, True]]


def test_rule_table_round_trip_and_errors(spark):
    rules = [make_rule(name=" a ", kind="threshold", sensor=" PSU ", op=">", threshold=1.0), make_rule(name="b", kind="stale", type="fan")]
    frame = rules_frame(spark, rules)
    # a stale rule written with a metric is an error; the frame carries the default
    frame = frame.withColumn("metric", F.when(F.col("kind") == "threshold", F.col("metric")))
    assert load_rules(frame) == rules
    twice = frame.unionByName(frame.withColumn("rule_idx", F.col("rule_idx") + 2))
    assert sorted((e.rule_idx, e.error) for e in rule_errors(twice).collect()) == [(2, "name repeated"), (3, "name repeated")]
    assert prune(rules, ["b"]) == [rules[1]]
    for bad in (dict(names=["zzz"]), dict(min_severity="critical")):
        try:
            prune(rules, **bad)
        except ValueError:
            continue
        raise AssertionError(bad)
