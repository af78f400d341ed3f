"""Canonical JSON: numbers against Python's shortest digits, texts against its encoder, and lists cut to a budget."""

import json
import random
import struct

from pyspark.sql import functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.plans.catalog.digests import BUDGET, DOCUMENTS_SQL, feed_digests
from fleetpulse.sources import testdata as T
from tools.check import oracle


def laid_out(x: float) -> str:
    sign, text = ("-", repr(-x)) if repr(x).startswith("-") else ("", repr(x))
    if x == 0:
        return sign + "0.0"
    mantissa, _, power = text.partition("e")
    whole, _, part = mantissa.partition(".")
    point = len(whole) + int(power or 0)
    digits = whole + part
    point -= len(digits) - len(digits.lstrip("0"))
    digits = digits.strip("0")
    if len(digits) <= point <= 16:
        return sign + digits + "0" * (point - len(digits)) + ".0"
    if 0 < point <= 16:
        return sign + digits[:point] + "." + digits[point:]
    if -5 < point <= 0:
        return sign + "0." + "0" * -point + digits
    return sign + digits[0] + ("." + digits[1:] if digits[1:] else "") + f"e{point - 1}"


def test_numbers(spark):
    rng = random.Random(2)
    xs = [0.0, -0.0, 1.0, -1.5, 0.1, 1e15, 1e16, 123456789012345.6, 1234567890123456.0, 12345678901234567.0, 1e17, 1e-4, 1e-5, 1e-6, 12e-6, 5e-324, 2e23, 8.41e21, 2.0**70, 9007199254740993.0]
    xs += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)) if x - x == 0]
    xs += [rng.randrange(10 ** rng.randrange(1, 17)) / 10.0 ** rng.randrange(0, 20) for _ in range(3000)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", S.json_number(F.col("x")).alias("s")).collect()
    wrong = [(xs[r.i], r.s) for r in got if r.s != laid_out(xs[r.i])]
    # all read back, and where sixteen or more digits are needed the last one may be a neighbour's
    assert all(float(s) == x and len(s) == len(laid_out(x)) for x, s in wrong) and len(wrong) < 30, wrong[:5]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("-inf"),)], "x double").select(S.json_number(F.col("x")).alias("s")).collect()
    assert [r.s for r in odd] == ["null"] * 3


def test_texts(spark):
    texts = ["", "plain", 'quote " and \\ back', "\\u001F stays", "tab\tnew\nline", "\x00\x01\x1a\x1b\x1f", "\\\x1f", "é – 漢 \U0001f600 /", "\x7f"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", S.json_text(F.col("t")).alias("s")).collect()
    assert {r.i: r.s for r in got} == {i: json.dumps(t, ensure_ascii=False) for i, t in enumerate(texts)}


def test_a_small_budget_cuts_as_the_sql_does(spark):
    """The registered query has a larger one; here all rows and gaps go, and violations are cut."""
    sf = "/root/testdata/sf0.001"
    got = feed_digests(spark, sf, 3000, T.coarse_value()).collect()
    want = oracle(sf).execute(DOCUMENTS_SQL.replace(f"<= {BUDGET}", "<= 3000")).fetchall()
    assert sorted(tuple(r) for r in got) == sorted(want) and any(r.violations_shown < r.violations_total for r in got)
    for r in got:
        d = json.loads(r.digest)
        assert len(r.digest.encode()) == r.bytes <= 3000 and len(d["violations"]) == r.violations_shown == d["meta"]["truncated"]["violations_shown"]
