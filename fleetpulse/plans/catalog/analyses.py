"""Worked analyses over line items, orders and events read as telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetpulse.operators import analyses as X, readings as R
from fleetpulse.plans.catalog.registry import DAILY, POLL, finite, query
from fleetpulse.sources import testdata as T


@query("load_bands", """
SELECT (floor(l_extendedprice / 1000) * 1000)::BIGINT AS band, round(avg(l_discount), 6) AS avg_eff, min(l_discount) AS min_eff, max(l_discount) AS max_eff, count(*) AS n
FROM lineitem GROUP BY 1""")
def load_bands(spark, sf_dir):
    return X.load_bands(T.table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_discount", 1000)


@query("rail_regulation", """
SELECT l_returnflag, nominal, low, high, round((low / nominal - 1) * 100, 6) AS dev_low_pct, round((high / nominal - 1) * 100, 6) AS dev_high_pct, round(high - low, 6) AS ripple
FROM (SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high FROM lineitem GROUP BY 1)
JOIN (VALUES ('A', 12.0::DOUBLE), ('N', 5.0), ('R', 3.3)) v(f, nominal) ON f = l_returnflag""")
def rail_regulation(spark, sf_dir):
    return X.rail_regulation(T.table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", {"A": 12.0, "N": 5.0, "R": 3.3})


@query("load_profile", """
WITH k AS (SELECT l_orderkey * 8 + l_linenumber AS key, * FROM lineitem),
p AS (SELECT * FROM k ORDER BY l_extendedprice DESC, key LIMIT 1)
SELECT (SELECT count(*) FROM k) AS n, (SELECT count_if(l_discount < 0.02) FROM k) AS below_floor, p.l_extendedprice AS peak_load, p.key AS peak_key,
       p.l_discount AS peak_eff, p.l_tax AS peak_other, (SELECT round(avg(l_tax), 6) FROM k WHERE l_extendedprice < 5000) AS idle_avg,
       (SELECT round(avg(l_tax), 6) FROM k WHERE l_extendedprice > 50000) AS stress_avg FROM p""")
def load_profile(spark, sf_dir):
    l = T.table(spark, sf_dir, "lineitem").withColumn("key", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return X.load_profile(l, "l_extendedprice", "l_discount", "l_tax", 0.02, 5000, 50000, "key")


@query("minute_peaks", """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS bucket, max(value) AS peak, count(*) AS n FROM events GROUP BY date_trunc('minute', ts)""")
def minute_peaks(spark, sf_dir):
    out = X.bucket_peaks(T.table(spark, sf_dir, "events"), "ts", "value", top=None)
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


@query("top_minute_peaks", """
SELECT strftime(b, '%Y-%m-%d %H:%M') AS bucket, peak, n FROM (
  SELECT date_trunc('minute', ts) AS b, max(value) AS peak, count(*) AS n FROM events GROUP BY 1 ORDER BY peak DESC, b LIMIT 5)""")
def top_minute_peaks(spark, sf_dir):
    out = X.bucket_peaks(T.table(spark, sf_dir, "events"), "ts", "value", top=5)
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


@query("order_day_peaks", """
SELECT strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS bucket, max(o_totalprice) AS peak, count(*) AS n FROM orders GROUP BY 1""")
def order_day_peaks(spark, sf_dir):
    out = X.bucket_peaks(T.table(spark, sf_dir, "orders"), "o_orderdate", "o_totalprice", "day", None)
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


_WIDE = {"view": "usage", "click": "clock", "purchase": "power"}
WIDE_SQL = f"""
WITH {DAILY} SELECT feed_id, epoch(day)::BIGINT // 86400 AS ord,
  arg_min(value, pos) FILTER (reading = 'view') AS usage, arg_min(value, pos) FILTER (reading = 'click') AS clock,
  arg_min(value, pos) FILTER (reading = 'purchase') AS power FROM daily WHERE reading IN ('view', 'click', 'purchase') GROUP BY feed_id, day"""


def wide(spark, sf_dir):
    return X.pivot_readings(T.daily_readings(spark, sf_dir), _WIDE, ["feed_id", "ord"])


@query("pivot_readings", WIDE_SQL)
def pivot_readings(spark, sf_dir):
    return wide(spark, sf_dir)


@query("reading_correlation", f"""
SELECT feed_id, CASE WHEN count(*) > 2 THEN round(corr(usage, clock), 6) END AS corr, count(*) AS n FROM ({WIDE_SQL})
WHERE usage IS NOT NULL AND clock IS NOT NULL AND NOT isnan(usage) AND NOT isnan(clock) GROUP BY feed_id""")
def reading_correlation(spark, sf_dir):
    out = X.correlation(wide(spark, sf_dir), "usage", "clock", ["feed_id"])
    return out.withColumn("corr", F.when(F.col("n") > 2, F.col("corr")))  # two points are always on a line


@query("peak_per_reading", f"WITH {POLL} SELECT reading, max({finite('value')}) AS max_value FROM poll WHERE type = 'Power' GROUP BY reading")
def peak_per_reading(spark, sf_dir):
    return X.peak_per_reading(R.export_rows(T.poll_readings(spark, sf_dir)), "Power")


@query("top_export_rows", f"""
WITH {POLL} SELECT feed_id, raw_timestamp AS timestamp, reading, {finite('value')} AS value FROM poll
ORDER BY value DESC NULLS LAST, feed_id, timestamp, reading LIMIT 10""")
def top_export_rows(spark, sf_dir):
    out = X.top_rows(R.export_rows(T.poll_readings(spark, sf_dir)))
    return out.select("feed_id", T.raw_text(F.col("timestamp")).alias("timestamp"), "reading", "value")
