"""Hard negatives against all pairs, one by one."""

import math
import random

from pyspark.sql import functions as F

from fleetpulse.llm.hard_negatives import MOST_SCORE, hard_negatives, pack, unpack


def brute(rows):
    """rows: distinct (id, label, integer vector)."""
    out = []
    for a, label, x in rows:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, own == label) for i, own, y in rows if i != a)
        for s, p, _ in [t for t in scored if t[2]][:5]:
            fit = [(i, t) for t, i, same in scored if not same and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, r, i, -s, -t) for r, (i, t) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, kind="array<double>"):
    table = spark.createDataFrame([(*r, 7, "x") for r in rows], f"vec_id bigint, label int, embedding {kind}, tag int, score string")
    return sorted(tuple(r) for r in hard_negatives(table, F.col("vec_id") % 50 == 0).collect())


def test_keys_sort_by_anchor_then_falling_score():
    rows = [(a, t, s, k, i) for a in (-3, 2) for t in (-1, 1) for s in (MOST_SCORE, 4, 0, -9, -MOST_SCORE) for k in (0, 1) for i in (-5, 5)]
    assert sorted(pack(*r) for r in rows[::-1]) == [pack(*r) for r in rows]
    assert unpack(pack(-3, 9, -4, 1, 8)) == (-3, -4, 1, 8)


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), [rng.gauss(0.3, 1) for _ in range(6)]) for i in range(400)]
    rows[100:220] = [(i, rng.randrange(3), rows[50][2]) for i in range(100, 220)]  # ties
    ints = [(i, c, [math.floor(256 * v) for v in x]) for i, c, x in rows]
    odd = [(950, None, [1.0] * 6), (None, 1, [1.0] * 6), (1000, 1, None), (1050, 1, [None] + [1.0] * 5), (1100, 1, [float("nan")] * 6), (1150, 1, [1.0]), (1200, 1, [-float("inf")] * 6)]
    got = mined(spark, rows + odd + rows[:60])
    assert got == brute(ints) and len(got) > 80


def test_zero_scores_few_rows_and_rows_of_one_id(spark):
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 2, [0.0, 2.0]), (3, 2, [0.5, 0.0]), (4, 1, [-1.0, 0.0])]
    # the positive 1 scores 0, and so does the negative 2; the positive 4 scores less
    assert mined(spark, rows) == [(0, 1, 1, 2, 0, 0)]
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == [] and mined(spark, rows[1:]) == []
    two = [(0, 1, [1.0, 0.0]), (0, 2, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.9, 0.0])]
    assert mined(spark, two) == [(0, 1, 1, 2, 65536, 256 * 230)]
    # an anchor of label 2 with the positive 2 finds no negative below 1
    assert mined(spark, [(50, 1, [1e300, 1.0]), (1, 1, [1e300, 1.0]), (2, 2, [1e13, 1.0])]) == []
