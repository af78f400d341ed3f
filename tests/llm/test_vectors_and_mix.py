"""Nearest neighbours and source mixing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetpulse.llm.nn_descent import nearest_neighbours
from fleetpulse.llm.source_mix import keep_mixed, mix_sources


def brute(ids, x, is_query, top):
    out = {}
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i, q in enumerate(ids):
        if is_query(q):
            s = n @ n[i]
            order = [j for j in np.lexsort((ids, -s.round(12))) if j != i][:top]
            out[int(q)] = [int(ids[j]) for j in order]
    return out


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[600:900] = x[600]  # a fifth of all rows are copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] + [1.0] * 15), (None, [1.0] * 16), (5004, [1.0, 2.0]), (5005, [float("inf")] + [1.0] * 15)]
    table = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("rep", F.lit(0))
    got = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 50 == 0, leaf=128).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(1500), x.astype(np.float64), lambda q: q % 50 == 0, 5)
    hits = sum(len(set(got[q]) & set(w)) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 5 * len(want)
    assert got[600] == [601, 602, 603, 604, 605] and got[650] == [600, 601, 602, 603, 604]


def test_search_goes_on_until_nothing_is_left_to_open(spark):
    """On a circle whose nodes know two neighbours on each side, the eighth is four openings away."""
    turn = np.arange(60) * 2 * np.pi / 60
    table = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(turn)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 20 == 0, top=16, k=4, leaf=32, beam=20, width=16).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert got == {q: {(q + d) % 60 for d in range(-8, 9) if d} for q in (0, 20, 40)}


def test_very_large_and_very_small_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((40, 8)) * 10.0 ** np.array([-310, -200, -1, 0, 1, 200, 306, 150])[np.arange(40) % 8, None]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest_neighbours(table, F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect():
        assert -1.000001 <= r.score <= 1.000001
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    assert got == brute(np.arange(40), unit, lambda q: q % 10 == 0, 5)


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id bigint, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest_neighbours(table, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 2, 0.707106781), (0, 2, 1, 0.0)]
    assert nearest_neighbours(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_mix_meets_targets(spark):
    rows = []
    for i in range(3000):
        rows.append((i, "a b c " * (1 + i % 9), ["en", "de", None][i % 7 % 3], f"s{i * i % 11 % 4}", 0))
    rows += [(9000, None, "en", "s0", 0), (None, "x", "en", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, tokens int")
    out = mix_sources(docs, budget_share=0.2).cache()
    assert out.count() == len(rows)
    total = out.agg(F.sum("n_tokens")).first()[0]
    for dim in ("source", "lang", "topic"):
        got = {r[0]: (r[1], r[2]) for r in out.groupBy(dim).agg(F.sum("n_tokens"), F.sum(F.col("n_tokens") * F.col("weight"))).collect()}
        roots = {k: t**0.5 for k, (t, _) in got.items()}
        for k, (_, weighted) in got.items():
            assert weighted / total == pytest.approx(roots[k] / sum(roots.values()), abs=1e-4)
    assert out.agg(F.sum(F.col("n_tokens") * F.col("probability"))).first()[0] == pytest.approx(0.2 * total, rel=1e-3)
    kept = out.filter("kept").agg(F.sum("n_tokens")).first()[0]
    assert abs(kept - 0.2 * total) < 0.1 * total
    drawn = out.filter("kept").select("doc_id").distinct().count()
    mixed = keep_mixed(docs, budget_share=0.2)
    assert mixed.columns == docs.columns and mixed.count() == drawn
    assert mix_sources(docs.limit(0)).count() == 0
