"""A selection of registered queries against their SQL on the smallest tables;
``tools/check.py`` runs all of them."""

import pytest

import __spark_entry__ as entry
from fleetpulse.plans.catalog import QUERIES, SQL
from tools.check import compare, oracle

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "scan_log_records", "scan_window_pushdown", "flat_export", "fold_nested_duplicates", "latest_snapshot", "durations", "window_bounds",
    "rule_errors", "series_aggregates", "sampling_gaps", "logger_health", "largest_gaps", "threshold_events", "all_rules_events",
    "load_profile", "pivot_readings", "incidents", "escalation_tiers", "notification_decisions", "event_contract", "stream_rule_events",
]


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    ok, rows, why = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, why


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
