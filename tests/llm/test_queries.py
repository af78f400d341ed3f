"""Registered queries against SQL, and the pipeline from stage to stage."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from fleetpulse.llm.common import table  # noqa: E402
from fleetpulse.llm.queries import QUERIES, SQL  # noqa: E402
from tools.check import compare, oracle  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    same, rows, why = compare(spark, oracle(SF), SF, QUERIES[name], SQL[name])
    assert same and rows, why


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))


def test_pipeline(spark):
    docs = first = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        ids, before = {r.doc_id for r in after.select("doc_id").collect()}, {r.doc_id for r in docs.select("doc_id").collect()}
        assert after.columns == first.columns and ids < before and len(ids) == after.count(), name
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == ids
