"""The `events` table read as machine telemetry.

dense: every (user, event type) pair is a feed and every event a poll with one
reading, so a series is present in each poll of its feed.
daily: every user is a feed and every day with events a poll whose readings are
that day's events, so series come and go and repeat inside a poll.
polls: every user is a feed and every event a poll with one reading.

Every 17th value is NULL and every 19th is NaN, in place of the value, so that
the handling of values that are not numbers is exercised. No row is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fleetpulse.functions import scalars as S

BLOCK = 4_096  # events per block: feeds share the event counter, so a block of a feed is at most this long
DAYS_PER_BLOCK = 7

# fixed values: the labels the event types stand for
TYPE_OF = {"view": "usage", "click": "Clock", "purchase": "POWER", "signup": "Other", "error": "unknown(7)"}
UNIT_OF = {"view": "%", "click": "MHz", "purchase": "W", "signup": "", "error": ""}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(c: Column, names: dict[str, str]) -> Column:
    out = F.lit("").cast("string")
    for k, v in names.items():
        out = F.when(c == k, F.lit(v)).otherwise(out)
    return out


def probed_value() -> Column:
    return F.when(F.col("event_id") % 17 == 0, None).when(F.col("event_id") % 19 == 0, F.lit(float("nan"))).otherwise(F.col("value"))


def coarse_value() -> Column:
    """The probed value in 64ths, so that sums are exact in any order."""
    v = probed_value()
    return F.when(F.isnan(v), v).otherwise(F.floor(v * 64) / 64)


def raw_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _reading_columns(value: Column) -> list[Column]:
    v = S.nan_if_not_finite(value)
    return [
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("sensor"),
        F.col("event_type").alias("reading"),
        S.normalize_type(_mapped(F.col("event_type"), TYPE_OF)).alias("type"),
        v.alias("value"), v.alias("min"), v.alias("max"), v.alias("avg"),
        _mapped(F.col("event_type"), UNIT_OF).alias("unit"),
    ]


def _with_markers(rows: DataFrame, available: Column | None = None) -> DataFrame:
    """One reading per poll: the marker is an extra copy of the row's header."""
    ok = F.lit(True) if available is None else available
    blank = [F.lit(None).cast(rows.schema[c].dataType) for c in ("sensor", "reading", "type", "value", "min", "max", "avg", "unit")]
    names = ["pos", "sensor", "reading", "type", "value", "min", "max", "avg", "unit"]
    marker = F.struct(*[c.alias(n) for c, n in zip([F.lit(-1).cast("long"), *blank], names)])
    here = F.struct(*[F.col(n) for n in names])
    return rows.select(
        "feed_id", "blk", "ord", "ts", "raw_timestamp", ok.alias("available"),
        F.inline_outer(F.when(ok, F.array(marker, here)).otherwise(F.array(marker))),
    )


def dense_readings(spark: SparkSession, sf_dir: str, value: Column | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.col("user_id").cast("string"), F.lit("/"), F.col("event_type")).alias("feed_id"),
        F.floor(F.col("event_id") / BLOCK).cast("long").alias("blk"), F.col("event_id").alias("ord"),
        F.col("ts").cast("timestamp").alias("ts"), raw_text(F.col("ts")).alias("raw_timestamp"),
        F.lit(0).cast("long").alias("pos"), *_reading_columns(probed_value() if value is None else value),
    )


def dense_stream(spark: SparkSession, sf_dir: str, value: Column | None = None) -> DataFrame:
    return _with_markers(dense_readings(spark, sf_dir, value))


def poll_readings(spark: SparkSession, sf_dir: str, value: Column | None = None) -> DataFrame:
    return dense_readings(spark, sf_dir, value).withColumn("feed_id", F.substring_index("feed_id", "/", 1))


def poll_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_markers(poll_readings(spark, sf_dir))


def polls_with_outages(spark: SparkSession, sf_dir: str, value: Column | None = None) -> DataFrame:
    """polls, where an event of type error is a poll that found no source: its
    marker stays, as unavailable, and its reading goes."""
    return _with_markers(poll_readings(spark, sf_dir, value), F.col("reading") != "error")


def daily_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return e.select(
        F.col("user_id").cast("string").alias("feed_id"),
        F.floor(F.unix_date(day) / DAYS_PER_BLOCK).cast("long").alias("blk"),
        F.unix_date(day).cast("long").alias("ord"),
        day.cast("timestamp").alias("ts"), raw_text(day.cast("timestamp")).alias("raw_timestamp"),
        F.col("event_id").alias("pos"), *_reading_columns(probed_value()),
    )


def daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings plus one marker per (user, day); the markers are a partial aggregate."""
    rows = daily_readings(spark, sf_dir).withColumn("available", F.lit(True))
    ticks = rows.select("feed_id", "blk", "ord", "ts", "raw_timestamp", "available").distinct()
    return rows.unionByName(ticks.withColumn("pos", F.lit(-1).cast("long")), allowMissingColumns=True).select(
        "feed_id", "blk", "ord", "ts", "raw_timestamp", "available",
        "pos", "sensor", "reading", "type", "value", "min", "max", "avg", "unit")
