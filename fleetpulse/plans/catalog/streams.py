"""Replays of the events through Structured Streaming."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from fleetpulse.operators import readings as R
from fleetpulse.plans.catalog.digests import GAP_CTE, INTERVAL
from fleetpulse.plans.catalog.registry import POLL, finite, query
from fleetpulse.plans.catalog.rules import ALL_RULES, ALL_SQL, SHOWN
from fleetpulse.session import shared_folder
from fleetpulse.sources import testdata as T
from fleetpulse.streaming import engine as E, panels


def event_stream(spark, sf_dir) -> DataFrame:
    """The events file as a stream of nested samples; an error is a failed poll."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    cols = {c: x for c, x in zip(("sensor", "reading", "type", "value", "min", "max", "avg", "unit"), T._reading_columns(T.probed_value()))}
    live = F.col("event_type") != "error"
    return e.select(
        F.col("user_id").cast("string").alias("feed_id"), F.lit("events").alias("file"),
        F.floor(F.col("event_id") / T.BLOCK).cast("long").alias("blk"), F.col("event_id").alias("ord"),
        F.col("ts").cast("timestamp").alias("ts"), T.raw_text(F.col("ts")).alias("raw_timestamp"),
        live.alias("available"), F.array(F.struct(*cols.values())).alias("sensors"), "event_type",
    )


def drain(df: DataFrame, name: str, mode: str = "append", base: str | None = None) -> DataFrame:
    """Run a streaming frame over everything available into a table, and read it; with the same ``base`` it goes on."""
    spark = df.sparkSession
    base = base or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    q = df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


@query("stream_rule_events", ALL_SQL)
def stream_rule_events(spark, sf_dir):
    edges = E.stream_transitions(event_stream(spark, sf_dir), ALL_RULES)
    return drain(E.stream_events(edges), "events").select(*SHOWN).withColumn("value", F.round("value", 6))


@query("stream_rule_events_spread", ALL_SQL)
def stream_rule_events_spread(spark, sf_dir):
    """The same with every feed split over four keys."""
    edges = E.stream_transitions(event_stream(spark, sf_dir), ALL_RULES, spread=4)
    return drain(E.stream_events(edges), "events").select(*SHOWN).withColumn("value", F.round("value", 6))


@query("stream_event_log", f"SELECT rule, state, count(*) AS n FROM ({ALL_SQL}) GROUP BY rule, state")
def stream_event_log(spark, sf_dir):
    """Follow a stream into the daily event log, and count the log."""
    base = f"{shared_folder(spark)}/follow-{uuid.uuid4().hex}"
    q = E.follow(E.stream_events(E.stream_transitions(event_stream(spark, sf_dir), ALL_RULES)), f"{base}/log", f"{base}/state", availableNow=True)
    q.awaitTermination()
    log = spark.read.schema("rule string, state string, query string, batch int, written date").parquet(f"{base}/log")
    return log.groupBy("rule", "state").agg(F.count(F.lit(1)).alias("n"))


@query("stream_window_panel", f"""
WITH {POLL}, w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts) AS s FROM poll),
closed AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM poll)
SELECT feed_id, reading, strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS samples, min({finite('value')}) AS min, max({finite('value')}) AS max
FROM w, closed WHERE s + INTERVAL 6 HOUR <= mark GROUP BY feed_id, reading, s""")
def stream_window_panel(spark, sf_dir):
    """Tumbling windows per series; a window is written once the watermark passes its end."""
    s = event_stream(spark, sf_dir).withColumn("available", F.lit(True))
    out = drain(panels.windowed_series(R.flatten(s), "6 hours"), "panel")
    return out.select("feed_id", "reading", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "samples", "min", "max")


@query("stream_window_panel_closed", f"""
WITH {POLL}, w AS (SELECT *, {finite('value')} AS v, time_bucket(INTERVAL 6 HOUR, ts) AS s FROM poll)
SELECT feed_id, reading, strftime(s, '%Y-%m-%d %H:%M') AS start, count(*) AS samples, count(*) - count(v) AS non_finite,
  arg_min(v, ord) FILTER (v IS NOT NULL) AS first, arg_max(v, ord) FILTER (v IS NOT NULL) AS last, min(v) AS min, max(v) AS max, round(avg(v), 6) AS avg,
  round(arg_max(v, ord) FILTER (v IS NOT NULL) - arg_min(v, ord) FILTER (v IS NOT NULL), 6) AS delta
FROM w GROUP BY feed_id, reading, s""")
def stream_window_panel_closed(spark, sf_dir):
    """Every window with all aggregates: the stream stops, is told that it has ended, and goes on from its checkpoint."""
    base = f"{shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    spark.createDataFrame([], "ts timestamp").write.parquet(f"{base}/closing")

    def run():
        s = event_stream(spark, sf_dir).withColumn("available", F.lit(True))
        return drain(panels.windowed_series(R.flatten(s), "6 hours", closing=panels.closing_ticks(spark, f"{base}/closing")), "panel", base=base)

    run()
    end = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("ts")).first()[0]
    panels.close_windows(spark, f"{base}/closing", end + timedelta(hours=7))
    return run().select(
        "feed_id", "reading", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "samples", "non_finite", "first", "last", "min", "max",
        F.round("avg", 6).alias("avg"), F.round("delta", 6).alias("delta"))


@query("stream_sampling_gaps", f"""WITH {GAP_CTE} SELECT feed_id, "from", "to", seconds FROM gaps""")
def stream_sampling_gaps(spark, sf_dir):
    s = event_stream(spark, sf_dir).withColumn("available", F.lit(True))
    late = F.when(F.col("ord") % 13 == 0, F.col("ts") - F.expr("INTERVAL 90 MINUTES")).otherwise(F.col("ts"))
    return drain(panels.stream_gaps(s.withColumn("ts", late), INTERVAL), "gaps")


@query("stream_ticks", """
SELECT user_id::VARCHAR AS feed_id, count(*) AS ticks, count_if(event_type <> 'error') AS samples FROM events GROUP BY ALL""")
def stream_ticks(spark, sf_dir):
    """Every tick of the stream, available or not, exactly once."""
    out = drain(event_stream(spark, sf_dir).select("feed_id", "ord", "available"), "ticks")
    return out.groupBy("feed_id").agg(F.count(F.lit(1)).alias("ticks"), F.count_if("available").alias("samples"))
