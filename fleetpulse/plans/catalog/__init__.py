"""All runnable queries with the SQL that checks them."""

from fleetpulse.plans.catalog import alerts, analyses, digests, inputs, rules, streams  # noqa: F401
from fleetpulse.plans.catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
