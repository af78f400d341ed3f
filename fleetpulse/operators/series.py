"""Per-series window aggregates, feed-level rollups and sampling gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.operators import blocked
from fleetpulse.schema import (
    DIGEST_MAX_AGE_SECONDS, GAP_DENSITY_THRESHOLD, GAP_INTERVAL_MULTIPLE, MAX_GAPS_SHOWN,
    SINGLE_GAP_MAX_SECONDS, TYPE_LABELS, UNKNOWN_LABEL,
)

SERIES = ["feed_id", "sensor", "reading"]
_LABELS = [*TYPE_LABELS, UNKNOWN_LABEL]


def series_aggregates(folded: DataFrame) -> DataFrame:
    """One row per series: counts, first/last/min/max/avg/delta over the finite
    values, the label seen first and the unit seen last.

    The first step groups by (series, unit, block) with numeric buffers only, so
    it is a hash aggregate with map-side combining and a hot series is no problem.
    The second step merges the few rows per series in block order.
    """
    v = S.finite_or_null(F.col("value"))
    label = F.array_position(F.array(*[F.lit(x) for x in _LABELS]), F.col("type")).cast("int")
    fin = F.when(v.isNotNull(), F.col("ord"))
    per_block = folded.groupBy(*SERIES, "unit", "blk").agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("finite"), F.sum(v).alias("total"),
        F.min(v).alias("low"), F.max(v).alias("high"),
        F.min_by(v, fin).alias("v_first"), F.min(fin).alias("o_first"),
        F.max_by(v, fin).alias("v_last"), F.max(fin).alias("o_last"),
        F.min_by(label, "ord").alias("label"), F.min("ord").alias("o_min"), F.max("ord").alias("o_max"),
    )
    has = F.col("o_first").isNotNull()
    merged = per_block.groupBy(*SERIES).agg(
        F.element_at(F.array(*[F.lit(x) for x in _LABELS]), F.min_by("label", F.struct("blk", "o_min"))).alias("type"),
        F.max_by("unit", F.struct("blk", "o_max")).alias("unit"),
        F.sum("n").alias("samples"), (F.sum("n") - F.sum("finite")).alias("non_finite"),
        F.min_by("v_first", F.when(has, F.struct("blk", "o_first"))).alias("first"),
        F.max_by("v_last", F.when(has, F.struct("blk", "o_last"))).alias("last"),
        F.min("low").alias("min"), F.max("high").alias("max"),
        (F.sum("total") / F.when(F.sum("finite") > 0, F.sum("finite"))).alias("avg"),
    )
    return merged.withColumn("delta", F.col("last") - F.col("first"))


def feed_meta(ticks: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Sample count and first/last raw timestamps in stream order, per feed.

    ``feeds`` names all feeds; one without a good sample has 0 of them and no times.
    """
    row = F.struct("blk", "ord", "raw_timestamp", "ts")
    meta = ticks.where("available").groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("samples"), F.min(row).alias("a"), F.max(row).alias("z"),
    ).select(
        "feed_id", "samples", F.col("a.raw_timestamp").alias("first_sample"),
        F.col("z.raw_timestamp").alias("last_sample"), F.col("z.ts").alias("last_ts"))
    if feeds is None:
        return meta
    return feeds.select("feed_id").distinct().join(meta, "feed_id", "left").na.fill(0, ["samples"])


def series_total(readings: DataFrame) -> DataFrame:
    return readings.select(*SERIES).distinct().groupBy("feed_id").agg(F.count(F.lit(1)).alias("series_total"))


def gaps(ticks: DataFrame, interval_seconds: int) -> DataFrame:
    """Pauses longer than three intervals, against the latest time seen so far.

    A sample that does not advance the time neither makes a gap nor moves the
    baseline. The running maximum is taken block by block.
    """
    t = ticks.where("available").select("feed_id", "blk", "ord", "raw_timestamp", F.unix_micros("ts").alias("us"))
    seen = F.struct(F.col("us").alias("us"), (-F.col("blk")).alias("b"), (-F.col("ord")).alias("o"), F.col("raw_timestamp").alias("raw"))
    r = blocked.running(t, ["feed_id"], "blk", ["ord"], [blocked.Running("prev", "max", seen)])
    delta = F.col("us") - F.col("prev.us")
    return r.where(delta > GAP_INTERVAL_MULTIPLE * interval_seconds * 1_000_000).select(
        "feed_id", "blk", "ord", F.col("prev.raw").alias("from"), F.col("raw_timestamp").alias("to"),
        F.floor(delta / 1_000_000).cast("long").alias("seconds"))


def latest_largest_gaps(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` largest gaps of each feed; of equal ones the latest, whenever they came."""
    return blocked.top_per_key(found, ["feed_id"], [F.desc("seconds"), F.desc("blk"), F.desc("ord")], keep)


def largest_gaps(found: DataFrame, keep: int = MAX_GAPS_SHOWN) -> DataFrame:
    """The ``keep`` largest gaps of each feed, as a stream that keeps the largest
    so far would hold them.

    Everything above the cut value stays. Of the gaps equal to it only those
    met while fewer than ``keep`` gaps of at least that size existed were ever
    taken in, and of these the latest remain. All three steps are rank limits.
    """
    cut = (
        blocked.top_per_key(found.select("feed_id", "blk", "ord", "seconds"), ["feed_id"], [F.desc("seconds")], keep)
        .groupBy("feed_id").agg(F.min("seconds").alias("__cut"), F.count(F.lit(1)).alias("__have"))
        .withColumn("__cut", F.when(F.col("__have") == keep, F.col("__cut"))).select("feed_id", "__cut")
    )
    cols = found.columns
    marked = found.join(cut, "feed_id")
    above = marked.where(F.col("__cut").isNull() | (F.col("seconds") > F.col("__cut")))
    reached = marked.where(F.col("seconds") >= F.col("__cut"))
    taken = blocked.top_per_key(reached, ["feed_id"], [F.col("blk"), F.col("ord")], keep).where(F.col("seconds") == F.col("__cut"))
    over = above.where(F.col("__cut").isNotNull()).groupBy("feed_id").agg(F.count(F.lit(1)).alias("__over"))
    late = Window.partitionBy("feed_id").orderBy(F.desc("blk"), F.desc("ord"))
    ties = (
        taken.join(over, "feed_id", "left").withColumn("__l", F.row_number().over(late))
        .where(F.col("__l") <= keep - F.coalesce("__over", F.lit(0)))
    )
    return above.select(*cols).unionByName(ties.select(*cols))


def freshness(meta: DataFrame, since: Column, until: Column, now: Column, interval_seconds: int) -> DataFrame:
    """Is the feed current enough to prove anything? Adds ``fresh`` and ``fresh_reason``."""
    age = now.cast("double") - until.cast("double")
    lag = until.cast("double") - F.col("last_ts").cast("double")
    allowed = GAP_INTERVAL_MULTIPLE * interval_seconds
    reason = (
        F.when(age < 0, "window ends after now")
        .when(age > DIGEST_MAX_AGE_SECONDS, "window is too old")
        .when(F.coalesce("samples", F.lit(0)) == 0, "no samples")
        .when(F.col("last_ts").isNull(), "no last sample")
        .when(lag < 0, "last sample after window end")
        .when(lag > allowed, "last sample too old")
        .otherwise("fresh")
    )
    return meta.withColumn("fresh_reason", reason).withColumn("fresh", F.col("fresh_reason") == "fresh")


def logger_health(fresh: DataFrame, shown_gaps: DataFrame, totals: DataFrame, window_seconds: Column) -> DataFrame:
    """Gap density and the verdict per feed. ``totals`` holds the exact
    ``gaps_total``; ``shown_gaps`` may be capped."""
    g = shown_gaps.groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("shown"), F.sum("seconds").alias("gap_seconds"), F.max("seconds").alias("largest_gap_seconds"))
    j = fresh.join(g, "feed_id", "left").join(totals, "feed_id", "left")
    j = j.withColumn("gap_count", F.coalesce("gaps_total", F.lit(0)).cast("long"))
    for c in ("shown", "gap_seconds", "largest_gap_seconds"):
        j = j.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    j = j.withColumn("__d", F.col("gap_seconds") / window_seconds)
    reason = (
        F.when(~F.col("fresh"), "not fresh")
        .when(F.col("largest_gap_seconds") > SINGLE_GAP_MAX_SECONDS, "single gap")
        .when(F.col("__d") > GAP_DENSITY_THRESHOLD, "gap density")
        .when(F.col("shown") < F.col("gap_count"), "gaps not shown")
        .otherwise("ok")
    )
    return j.select(
        "feed_id", "fresh", "fresh_reason", F.when(reason == "ok", "ok").otherwise("degraded").alias("verdict"),
        reason.alias("reason"), "gap_count", "gap_seconds", "largest_gap_seconds", F.round("__d", 6).alias("density"))


def gap_totals(found: DataFrame) -> DataFrame:
    return found.groupBy("feed_id").agg(F.count(F.lit(1)).alias("gaps_total"))
