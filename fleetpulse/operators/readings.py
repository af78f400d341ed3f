"""Samples, readings and the combined stream, with the row filters over them.

Three frames are used throughout:

* samples  - one row per poll, readings nested (``SAMPLE_SCHEMA``);
* readings - one row per reading: ``pos`` is its place in the sample;
* stream   - readings plus one marker row (``pos`` = -1) per poll, so that a poll
  without readings, or without the readings of interest, still counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.schema import EXPORT_COLUMNS, READING_STRUCT

TICK_COLUMNS = ["feed_id", "blk", "ord", "ts", "raw_timestamp"]
READING_COLUMNS = ["pos", "sensor", "reading", "type", "value", "min", "max", "avg", "unit"]
MARKER_POS = -1


def _reading_fields(r: str) -> list[Column]:
    return [
        F.col(f"{r}.sensor").alias("sensor"),
        F.col(f"{r}.reading").alias("reading"),
        S.normalize_type(F.col(f"{r}.type")).alias("type"),
        *[S.nan_if_not_finite(F.col(f"{r}.{c}")).alias(c) for c in ("value", "min", "max", "avg")],
        F.col(f"{r}.unit").alias("unit"),
    ]


def flatten(samples: DataFrame) -> DataFrame:
    """One row per reading, array order kept in ``pos``; a narrow operation.

    The outer form is used because the plain one also tests the array's size in a
    filter below, which would compute a derived array twice.
    """
    each = samples.select(*TICK_COLUMNS, F.posexplode_outer("sensors").alias("__p", "__r"))
    return each.where(F.col("__p").isNotNull()).select(
        *TICK_COLUMNS, F.col("__p").cast("long").alias("pos"), *_reading_fields("__r")
    )


def to_stream(samples: DataFrame) -> DataFrame:
    """Markers and readings from one pass over the samples; a narrow operation."""
    marker = F.array(F.lit(None).cast(READING_STRUCT))
    body = F.coalesce(F.col("sensors"), F.array().cast(samples.schema["sensors"].dataType))
    return samples.select(
        *TICK_COLUMNS, "available", F.posexplode_outer(F.concat(marker, body)).alias("__p", "__r")
    ).select(
        *TICK_COLUMNS, "available", (F.col("__p") - 1).cast("long").alias("pos"), *_reading_fields("__r")
    )


def markers(stream: DataFrame) -> DataFrame:
    return stream.where(F.col("pos") == MARKER_POS).select(*TICK_COLUMNS, "available")


def readings_of(stream: DataFrame) -> DataFrame:
    return stream.where(F.col("pos") > MARKER_POS).select(*TICK_COLUMNS, *READING_COLUMNS)


def fold_samples(samples: DataFrame) -> DataFrame:
    """Keep only the first (sensor, reading) of every sample, inside the array.

    Nothing is shuffled. Samples without duplicates, which is nearly all, keep
    their array as it is; the others are sorted so that duplicates are neighbours.
    """
    key = F.transform(
        "sensors",
        lambda s: F.concat(F.length(s["sensor"]).cast("string"), F.lit(":"), s["sensor"], F.lit("/"), s["reading"]),
    )
    tagged = samples.withColumn("__dup", F.size(F.array_distinct(key)) < F.size("sensors"))
    keyed = F.sort_array(F.transform("sensors", lambda s, i: F.struct(
        s["sensor"].alias("sensor"), s["reading"].alias("reading"), i.alias("i"), s.alias("r"))))
    tagged = tagged.withColumn("__e", F.when(F.col("__dup"), keyed))
    previous = F.concat(
        F.array(F.lit(None).cast(tagged.schema["__e"].dataType.elementType)),
        F.slice("__e", 1, F.greatest(F.size("__e") - 1, F.lit(0))),
    )
    firsts = F.filter(
        F.zip_with("__e", previous, lambda x, p: F.struct(
            x["i"].alias("i"), x["r"].alias("r"),
            F.coalesce((x["sensor"] == p["sensor"]) & (x["reading"] == p["reading"]), F.lit(False)).alias("again"),
        )),
        lambda z: ~z["again"],
    )
    in_order = F.transform(
        F.sort_array(F.transform(firsts, lambda z: F.struct(z["i"].alias("i"), z["r"].alias("r")))),
        lambda z: z["r"],
    )
    return tagged.withColumn("sensors", F.when(F.col("__dup"), in_order).otherwise(F.col("sensors"))).drop("__dup", "__e")


def fold_rows(readings: DataFrame) -> DataFrame:
    """The same fold for readings that are already flat: the group is one sample."""
    w = Window.partitionBy("feed_id", "blk", "ord", "sensor", "reading").orderBy("pos")
    return readings.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def in_window(df: DataFrame, since: Column, until: Column) -> DataFrame:
    """Inclusive on both ends."""
    return df.where(F.col("ts").between(since, until))


def sensor_scope(include: list[str] | None = None, exclude: list[str] | None = None, name: str = "sensor") -> Column:
    """Include/exclude by case-insensitive substring of the sensor name; no
    include pattern keeps everything, exclude always wins."""
    def patterns(ps):
        return [p.strip().lower() for p in ps or [] if p.strip()]

    def hit(ps):
        return S.any_of([F.lower(F.col(name)).contains(p) for p in ps])

    inc, exc = patterns(include), patterns(exclude)
    keep = hit(inc) if inc else F.lit(True)
    return keep & ~hit(exc) if exc else keep


def scope_samples(samples: DataFrame, include=None, exclude=None) -> DataFrame:
    """Apply the sensor scope inside the arrays; samples left empty are dropped,
    as nothing is logged for them."""
    inc = [p.strip().lower() for p in include or [] if p.strip()]
    exc = [p.strip().lower() for p in exclude or [] if p.strip()]

    def keep(s):
        low = F.lower(s["sensor"])
        ok = S.any_of([low.contains(p) for p in inc]) if inc else F.lit(True)
        return ok & ~S.any_of([low.contains(p) for p in exc])

    return samples.withColumn("sensors", F.filter("sensors", keep)).where(F.size("sensors") > 0)


def matches_names(needles: list[str], sensor: str = "sensor", reading: str = "reading") -> Column:
    """Any needle inside the sensor or the reading name; no needle keeps all."""
    if not needles:
        return F.lit(True)
    s, r = F.lower(F.col(sensor)), F.lower(F.col(reading))
    return F.coalesce(
        S.any_of([F.coalesce(s.contains(n.lower()), F.lit(False)) | F.coalesce(r.contains(n.lower()), F.lit(False))
                  for n in needles]), F.lit(False))


def display_filter(needles: list[str] | None = None, type_label: str | None = None) -> Column:
    keep = matches_names(needles or [])
    return keep & (F.col("type") == type_label) if type_label else keep


def _newest(df: DataFrame) -> DataFrame:
    """The newest (blk, ord) of every feed: numeric hash aggregates, first per
    block, so nothing is sorted and no feed is gathered."""
    per_block = df.groupBy("feed_id", "blk").agg(F.max("ord").alias("ord"))
    last = per_block.groupBy("feed_id").agg(F.max("blk").alias("blk"), F.max_by("ord", "blk").alias("ord"))
    return last.select("feed_id", "blk", "ord")



def latest_readings(readings: DataFrame) -> DataFrame:
    return readings.join(_newest(readings), ["feed_id", "blk", "ord"], "left_semi")


def snapshot(readings: DataFrame, type_label: str | None = None, needle: str | None = None) -> DataFrame:
    """Latest readings, filtered by label and by name."""
    return latest_readings(readings).where(display_filter([needle] if needle else [], type_label))


def export_rows(readings: DataFrame, with_feed: bool = True) -> DataFrame:
    """The flat export: fixed columns, duplicates kept, non-finite values NULL."""
    out = readings.select(
        "feed_id", F.col("ts").alias("timestamp"), "sensor", "reading", "type",
        S.finite_or_null(F.col("value")).alias("value"), "unit",
    )
    return out if with_feed else out.select(*EXPORT_COLUMNS)
