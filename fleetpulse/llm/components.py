"""Connected components of a graph that no single task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import written


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id that each linked id can reach; ``links`` has a and b.

    Every round takes the smallest label among the neighbours and then the label of
    that label, so chains shorten by half; each round is written to the shared folder, and
    the loop ends when a round changes nothing. Labels are minima, combined before the
    shuffle, so a node with very many links costs a task only its own joins, which adaptive
    execution splits.
    """
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        low = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("far"))
        now = written(low.join(jump, "component", "left").select("id", "old", F.coalesce(F.least("component", "far"), "component").alias("component")), "labels")
        labels = now.select("id", "component")
        if now.filter("old <> component").isEmpty():
            return labels
