"""Worked analyses over the flat export: bands, rails, peaks, pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def load_bands(df: DataFrame, load: str, efficiency: str, width: int = 100) -> DataFrame:
    """Average/min/max efficiency per load band."""
    band = (F.floor(F.col(load) / width) * width).cast("long")
    return df.groupBy(band.alias("band")).agg(
        F.round(F.avg(efficiency), 6).alias("avg_eff"), F.min(efficiency).alias("min_eff"),
        F.max(efficiency).alias("max_eff"), F.count(F.lit(1)).alias("n"))


def rail_regulation(df: DataFrame, rail: str, value: str, nominals: dict[str, float]) -> DataFrame:
    """Range, deviation from nominal in percent and ripple per rail. The nominal
    values are a literal map, so nothing is joined."""
    nominal = F.create_map(*[F.lit(x) for kv in nominals.items() for x in kv])
    out = df.groupBy(rail).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    out = out.withColumn("nominal", F.try_element_at(nominal, F.col(rail)))

    def pct(c):
        return F.round((F.col(c) / F.col("nominal") - 1) * 100, 6)

    return out.where(F.col("nominal").isNotNull()).select(
        rail, "nominal", "low", "high", pct("low").alias("dev_low_pct"), pct("high").alias("dev_high_pct"),
        F.round(F.col("high") - F.col("low"), 6).alias("ripple"))


def load_profile(df: DataFrame, load: str, efficiency: str, other: str, floor: float, idle: float, stress: float, tie: str) -> DataFrame:
    """Samples under an efficiency floor, the row at peak load (lowest ``tie`` on
    equal load), and the average of ``other`` at idle and under stress."""
    peak = F.max_by(F.struct(tie, efficiency, other), F.struct(F.col(load), -F.col(tie)))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(efficiency) < floor).alias("below_floor"),
        F.max(load).alias("peak_load"), peak.alias("p"),
        F.round(F.avg(F.when(F.col(load) < idle, F.col(other))), 6).alias("idle_avg"),
        F.round(F.avg(F.when(F.col(load) > stress, F.col(other))), 6).alias("stress_avg"),
    ).select(
        "n", "below_floor", "peak_load", F.col(f"p.{tie}").alias("peak_key"),
        F.col(f"p.{efficiency}").alias("peak_eff"), F.col(f"p.{other}").alias("peak_other"), "idle_avg", "stress_avg")


def bucket_peaks(df: DataFrame, ts: str, value: str, unit: str = "minute", top: int | None = 5) -> DataFrame:
    """Highest value per time bucket; ``top`` keeps the largest few."""
    out = df.groupBy(F.date_trunc(unit, ts).alias("bucket")).agg(F.max(value).alias("peak"), F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("peak"), "bucket").limit(top) if top else out


def pivot_readings(readings: DataFrame, names: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Long to wide: one column per chosen reading (``names``: reading -> column).

    The chosen names are known, so it is one hash aggregate of conditional
    maxima; the first position wins where a poll repeats a reading.
    """
    keys = keys or ["feed_id", "blk", "ord"]
    chosen = readings.where(F.col("reading").isin(list(names)))
    aggs: list[Column] = [
        F.min_by("value", F.when(F.col("reading") == name, F.col("pos"))).alias(col) for name, col in names.items()
    ]
    return chosen.groupBy(*keys).agg(*aggs)


def correlation(wide: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Pearson's correlation and the number of pairs; NaN where a column does not vary, NULL for a single pair.

    ``corr`` itself divides by zero there, which is an error in ANSI mode.
    """
    both = wide.where(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b))
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    found = F.when(spread == 0, F.lit(float("nan"))).otherwise(F.covar_pop(a, b) / spread)
    return both.groupBy(*(keys or [])).agg(
        F.round(F.when(F.count(F.lit(1)) > 1, found), 6).alias("corr"), F.count(F.lit(1)).alias("n"))


def peak_per_reading(export: DataFrame, type_label: str) -> DataFrame:
    return export.where(F.col("type") == type_label).groupBy("reading").agg(F.max("value").alias("max_value"))


def top_rows(export: DataFrame, n: int = 10) -> DataFrame:
    """The n largest values of the export; a take-ordered, not a full sort."""
    return export.orderBy(F.desc_nulls_last("value"), "feed_id", "timestamp", "reading").limit(n)
