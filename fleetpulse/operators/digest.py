"""The size-bounded digest of one window: ranked readings, largest gaps, latest
violations and exact totals, one JSON document per feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.operators import blocked, readings as R
from fleetpulse.schema import (
    DEFAULT_MAX_BYTES, DEFAULT_TOP, DIGEST_SCHEMA_VERSION, EVENT_KEYS, MAX_VIOLATIONS_SHOWN,
)

ROW_KEYS = [
    "sensor", "reading", "type", "unit", "samples", "non_finite", "first", "last", "min", "max",
    "avg", "delta", "in_violation",
]
GAP_KEYS = ["from", "to", "seconds"]
_ROW_TYPES = {
    **{k: "text" for k in ("sensor", "reading", "type", "unit")}, **{k: "number" for k in ("first", "last", "min", "max", "avg", "delta")}}


def flag_violated(series: DataFrame, events: DataFrame) -> DataFrame:
    """``in_violation`` for every series with any transition, before any cap."""
    hit = events.where(F.col("sensor").isNotNull()).select("feed_id", "sensor", "reading").distinct()
    return (
        series.join(hit.withColumn("__v", F.lit(True)), ["feed_id", "sensor", "reading"], "left")
        .withColumn("in_violation", F.col("__v").isNotNull()).drop("__v")
    )


def with_series_type(events: DataFrame, series: DataFrame) -> DataFrame:
    """Add the label of each event's series, NULL when it is not in the window."""
    types = series.select("feed_id", "sensor", "reading", F.col("type").alias("series_type"))
    return events.join(types, ["feed_id", "sensor", "reading"], "left")


def violation_filter(needles: list[str] | None = None, type_label: str | None = None) -> Column:
    """Needs ``series_type`` (see ``with_series_type``) for a label filter."""
    keep = R.matches_names(needles or [])
    if type_label:
        keep = keep & F.coalesce(F.col("series_type") == type_label, F.lit(False))
    return keep


def ranked(series: DataFrame, top: int = DEFAULT_TOP, keep_all: bool = False, limit: int | None = None) -> DataFrame:
    """Violated series first, then by relative movement, then by name; ``rank``
    is 1-based. Kept are all violated series, and others up to ``top`` in all;
    ``keep_all`` keeps everything and ``limit`` cuts the ranks of both tiers.

    A feed may have any number of series: where a limit applies it is taken in
    salted parts, otherwise the numbering runs over range slices.
    """
    scored = series.withColumn("score", S.mover_score(F.col("first"), F.col("last")))
    order = [F.desc("score"), F.col("sensor"), F.col("reading")]
    w = Window.partitionBy("feed_id").orderBy(*order)

    def numbered(df: DataFrame, n: int | None) -> DataFrame:
        if n is None:
            return blocked.range_row_numbers(df, ["feed_id"], order, "rank")
        return blocked.top_per_key(df, ["feed_id"], order, n).withColumn("rank", F.row_number().over(w).cast("long"))

    n_forced = scored.where("in_violation").groupBy("feed_id").agg(F.count(F.lit(1)).alias("__n"))
    forced = numbered(scored.where("in_violation"), limit)
    most = None if keep_all else top
    if limit is not None:
        most = limit if most is None else min(most, limit)
    rest = numbered(scored.where("NOT in_violation"), most).join(n_forced, "feed_id", "left")
    rest = rest.withColumn("rank", F.col("rank") + F.coalesce("__n", F.lit(0))).drop("__n")
    if most is not None:
        rest = rest.where(F.col("rank") <= most)
    return forced.unionByName(rest)


def last_transitions(events: DataFrame, keep: int = MAX_VIOLATIONS_SHOWN) -> DataFrame:
    """The latest ``keep`` transitions of each feed, renumbered from 1."""
    kept = blocked.top_per_key(events, ["feed_id"], [F.desc("seq")], keep)
    up = Window.partitionBy("feed_id").orderBy("seq")
    return kept.withColumn("seq", F.row_number().over(up).cast("long")).withColumn("id", S.event_id(F.col("rule"), F.col("seq")))


def feed_totals(name: str, df: DataFrame) -> DataFrame:
    return df.groupBy("feed_id").agg(F.count(F.lit(1)).alias(name))


def _digits(c: Column) -> Column:
    return F.length(c.cast("string"))


def assemble(
    meta: DataFrame, violations: DataFrame, gaps: DataFrame, rows: DataFrame, max_bytes: int = DEFAULT_MAX_BYTES,
) -> DataFrame:
    """Fit the digest of each feed into ``max_bytes`` and render it.

    ``meta`` has one row per feed with ``meta_fields`` and the three exact totals.
    Detail goes in a fixed order: reading rows from the tail, then the smallest
    gaps (oldest first), then the oldest violations. Turned around this is a
    keeping order, and what fits is a running sum of rendered lengths along it.
    An item takes at least two bytes, so ranks past ``max_bytes`` are cut early.
    """
    v = violations.select(
        "feed_id", F.lit(0).alias("tier"), F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc("seq"))).alias("r"),
        F.col("seq").alias("at"), S.event_object().alias("json"))
    g = gaps.select(
        "feed_id", F.lit(1).alias("tier"),
        F.row_number().over(Window.partitionBy("feed_id").orderBy(F.desc("seconds"), F.desc("blk"), F.desc("ord"))).alias("r"),
        "blk", "ord", S.json_object({k: F.col(k) for k in GAP_KEYS}, {"from": "text", "to": "text"}).alias("json"))
    chron = Window.partitionBy("feed_id").orderBy("blk", "ord")
    g = g.withColumn("at", F.row_number().over(chron).cast("long")).drop("blk", "ord")
    r = rows.where(F.col("rank") <= max_bytes).select(
        "feed_id", F.lit(2).alias("tier"), F.col("rank").alias("r"), F.col("rank").cast("long").alias("at"),
        S.json_object({k: F.col(k) for k in ROW_KEYS}, _ROW_TYPES).alias("json"))
    items = v.unionByName(g).unionByName(r).withColumn("size", F.octet_length("json"))

    keep = Window.partitionBy("feed_id").orderBy("tier", "r").rowsBetween(Window.unboundedPreceding, 0)
    n = [F.count_if(F.col("tier") == t).over(keep) for t in range(3)]
    extra = F.sum("size").over(keep)
    for c in n:
        extra = extra + F.greatest(c - 1, F.lit(0)) + _digits(c) - 1
    sized = items.withColumn("cost", extra)

    head = meta.withColumn("__m0", _meta_json(F.lit(0), F.lit(0), F.lit(0)))
    frame = len(f'{{"schema_version":{DIGEST_SCHEMA_VERSION},"meta":,"violations":[],"gaps":[],"readings":[]}}')
    head = head.withColumn("base_bytes", F.octet_length("__m0") + frame)
    fitting = sized.join(head.select("feed_id", "base_bytes"), "feed_id").where(
        F.col("cost") + F.col("base_bytes") <= max_bytes)

    def lines(t):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct("at", "json")))), lambda x: x["json"])

    packed = fitting.groupBy("feed_id").agg(*[lines(t).alias(f"__l{t}") for t in range(3)])
    out = head.join(packed, "feed_id", "left")
    for t in range(3):
        out = out.withColumn(f"__l{t}", F.coalesce(f"__l{t}", F.array().cast("array<string>")))
    shown = [F.size(f"__l{t}") for t in range(3)]
    body = F.concat(
        F.lit(f'{{"schema_version":{DIGEST_SCHEMA_VERSION},"meta":'), _meta_json(shown[2], shown[0], shown[1]),
        F.lit(',"violations":['), F.array_join("__l0", ","), F.lit('],"gaps":['), F.array_join("__l1", ","),
        F.lit('],"readings":['), F.array_join("__l2", ","), F.lit("]}"),
    )
    fits = F.col("base_bytes") <= max_bytes
    return out.select(
        "feed_id", F.when(fits, body).alias("digest"), fits.alias("fits"),
        shown[2].cast("long").alias("readings_shown"), "readings_total",
        shown[0].cast("long").alias("violations_shown"), "violations_total",
        shown[1].cast("long").alias("gaps_shown"), "gaps_total",
        F.octet_length(F.when(fits, body)).cast("long").alias("bytes"),
    )


def _meta_json(readings_shown: Column, violations_shown: Column, gaps_shown: Column) -> Column:
    shown = {"readings": readings_shown, "violations": violations_shown, "gaps": gaps_shown}
    counts = {f"{k}_{which}": shown[k] if which == "shown" else F.col(f"{k}_total") for k in shown for which in ("shown", "total")}
    texts = dict.fromkeys(("since", "until", "log_dir", "first_sample", "last_sample"), "text")
    plain = ["log_dir", "files_scanned", "interval_seconds", "samples", "skipped_lines", "first_sample", "last_sample", "series_total", "rules_evaluated"]
    return S.json_object({
        "window": S.json_object({k: F.col(k) for k in ("since", "until")}, texts),
        **{k: F.col(k) for k in plain}, "truncated": S.json_object(counts)}, texts)
