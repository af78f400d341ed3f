"""Report, watch and export: the whole jobs, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetpulse.operators import digest as D, engine, readings as R, series as A
from fleetpulse.operators.rules import Rule
from fleetpulse.schema import DEFAULT_MAX_BYTES, DEFAULT_TOP, MIN_MAX_BYTES
from fleetpulse.session import written
from fleetpulse.sources import sample_log


@dataclass
class ReportOptions:
    interval_seconds: int = 10
    top: int = DEFAULT_TOP
    max_bytes: int = DEFAULT_MAX_BYTES
    match: list[str] = field(default_factory=list)
    type_label: str | None = None
    log_dir: str = ""
    chunk: int = engine.DEFAULT_CHUNK


def report_parts(
    stream: DataFrame, folded: DataFrame, rules: list[Rule], opt: ReportOptions, feeds: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The frames a digest is made of, before anything is cut to size.

    Events, series and gaps are read several times below and are small next to
    the readings, so each is computed once and written.
    """
    ticks = R.markers(stream)
    series = A.series_aggregates(folded)
    # Rules see every sample of the window; filters below only choose what is shown.
    events = written(engine.to_events(engine.transitions(stream, rules, opt.chunk)), "events")
    return {
        "ticks": ticks, "events": events, "series": written(D.flag_violated(series, events), "series"),
        "gaps": written(A.gaps(ticks, opt.interval_seconds), "gaps"), "meta": A.feed_meta(ticks, feeds),
    }


def digest_inputs(
    stream: DataFrame, folded: DataFrame, rules: list[Rule], since: Column, until: Column,
    opt: ReportOptions, parsed: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(meta with exact totals, violations, gaps, ranked rows): the lists are at
    their caps but not yet cut to a byte budget."""
    # A feed whose lines are all broken, or all outside the window, still has a digest.
    feeds = None if parsed is None else parsed.select("feed_id").union(stream.select("feed_id"))
    p = report_parts(stream, folded, rules, opt, feeds)
    shown_rows = p["series"].where(R.display_filter(opt.match, opt.type_label))
    typed = D.with_series_type(p["events"], p["series"])
    keep = D.violation_filter(opt.match, opt.type_label)

    counts = [
        p["series"].groupBy("feed_id").agg(F.count(F.lit(1)).alias("series_total")),
        D.feed_totals("readings_total", shown_rows),
        D.feed_totals("violations_total", typed.where(keep)),
        A.gap_totals(p["gaps"]),
    ]
    if parsed is not None:
        counts.append(parsed.groupBy("feed_id").agg(
            F.countDistinct("file").alias("files_scanned"), F.count_if(F.col("problem").isNotNull()).alias("skipped_lines")))
    meta = p["meta"].drop("last_ts")
    for c in counts:
        meta = meta.join(c, "feed_id", "left")
    if parsed is None:
        meta = meta.withColumn("files_scanned", F.lit(0)).withColumn("skipped_lines", F.lit(0))
    names = ["series_total", "readings_total", "violations_total", "gaps_total", "files_scanned", "skipped_lines", "samples"]
    meta = meta.select(
        "feed_id", "first_sample", "last_sample", *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in names],
        F.date_format(since, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("since"), F.date_format(until, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("until"),
        F.lit(opt.log_dir).alias("log_dir"), F.lit(opt.interval_seconds).alias("interval_seconds"),
        F.lit(len(rules)).alias("rules_evaluated"),
    )
    return (meta, D.last_transitions(typed).where(keep), A.largest_gaps(p["gaps"]),
            D.ranked(shown_rows, opt.top, limit=opt.max_bytes))


def digest(
    stream: DataFrame, folded: DataFrame, rules: list[Rule], since: Column, until: Column,
    opt: ReportOptions | None = None, parsed: DataFrame | None = None,
) -> DataFrame:
    """One size-bounded JSON digest per feed for an already windowed stream."""
    opt = opt or ReportOptions()
    if opt.max_bytes < MIN_MAX_BYTES:
        raise ValueError(f"max_bytes must be at least {MIN_MAX_BYTES}")
    return D.assemble(*digest_inputs(stream, folded, rules, since, until, opt, parsed), opt.max_bytes)


def report(
    spark: SparkSession, root: str, rules: list[Rule], since: datetime, until: datetime, opt: ReportOptions | None = None,
) -> DataFrame:
    """Digest of a window straight from the log files. The engine starts fresh at
    the window edge."""
    if since > until:
        raise ValueError("since is after until")
    samples, parsed = sample_log.scan(spark, root, since, until)
    a, b = F.lit(since.astimezone(timezone.utc)), F.lit(until.astimezone(timezone.utc))
    # The text is parsed once; aggregates, gaps and rules read the columns they need.
    samples = written(samples, "samples")
    folded = R.flatten(R.fold_samples(samples))
    return digest(R.to_stream(samples), folded, rules, a, b, opt, parsed)


def watch_replay(spark: SparkSession, root: str, rules: list[Rule]) -> DataFrame:
    """Every event of a full replay of the logs."""
    samples, _ = sample_log.scan(spark, root)
    return engine.to_events(engine.transitions(R.to_stream(samples), rules))
