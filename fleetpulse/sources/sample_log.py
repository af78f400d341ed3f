"""Sample logs: JSON lines in daily files, read as an ordered stream.

Layout: ``<root>/<feed_id>/<prefix>YYYY-MM-DD.jsonl``. The block of a line is the
file's date and the start of the file split it was read from, so blocks are as
small as a split, and lines inside a block keep the reader's order.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from fleetpulse.functions import scalars as S
from fleetpulse.schema import MAX_LINE_BYTES, RECORD_SCHEMA

PREFIX = "sensors_"
#: The window's length where only its end is given.
DEFAULT_LAST = timedelta(hours=24)
LINE_SCHEMA = "feed_id string, file string, blk bigint, ord bigint, value string"
_SPLIT_BITS = 44  # a block start fits below this, a day number above it
_PART_BITS = 30  # of a written log: starts below (parts of under 1 GiB), part numbers above

_NUMBERS = "value|min|max|avg"
_TEXTS = "timestamp|sensor|reading|type|unit"


def candidate_dates(since: datetime, until: datetime, zone: str = "UTC") -> list[str]:
    """Local dates of the window, padded by one day on both sides."""
    tz = ZoneInfo(zone)
    day = since.astimezone(tz).date() - timedelta(days=1)
    last = until.astimezone(tz).date() + timedelta(days=1)
    out = []
    while day <= last:
        out.append(day.isoformat())
        day += timedelta(days=1)
    return out


def window(
    since: datetime | None, until: datetime | None, last: timedelta = DEFAULT_LAST, now: datetime | None = None,
) -> tuple[datetime, datetime]:
    """Both ends of a window: ``until`` defaults to now, ``since`` to ``last`` before ``until``."""
    until = until or now or datetime.now(timezone.utc)
    return since or until - last, until


def read_lines(
    spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None,
    prefix: str = PREFIX, zone: str = "UTC",
) -> DataFrame:
    """Raw lines of all feeds under ``root``; files outside the padded window are
    not opened, and a missing folder is an empty result."""
    days = candidate_dates(*window(since, until), zone) if since or until else None
    glob = f"{prefix}{{{','.join(days)}}}.jsonl" if days else f"{prefix}????-??-??.jsonl"
    try:
        text = (
            spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob).text(root)
        )
    except AnalysisException:
        return spark.createDataFrame([], LINE_SCHEMA)
    return _place(text, prefix)


def read_written(
    spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None, zone: str = "UTC",
) -> DataFrame:
    """Lines of a log that ``tables.write_log`` wrote: folders ``feed_id=`` and ``dt=``, numbered parts.

    Folders outside the padded window are pruned before any file is opened. A part's number
    goes into its block, so that the parts of a day keep their order.
    """
    return _parts(spark.read.schema("value string, feed_id string, dt date").option("lineSep", "\n").text(root), since, until, zone)


def read_day_log(
    spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None, zone: str = "UTC",
) -> DataFrame:
    """Lines of a log that ``tables.write_day_log`` wrote, as ``read_written`` gives them."""
    return _parts(spark.read.schema("value string, feed_id string, dt date").parquet(root), since, until, zone)


def _parts(text: DataFrame, since: datetime | None, until: datetime | None, zone: str) -> DataFrame:
    if since or until:
        days = candidate_dates(*window(since, until), zone)
        text = text.where(F.col("dt").between(days[0], days[-1]))
    part = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("long")
    return text.select(
        "feed_id", F.concat_ws("/", F.col("dt").cast("string"), F.col("_metadata.file_name")).alias("file"),
        (F.shiftleft(F.unix_date("dt").cast("long"), _SPLIT_BITS) + F.shiftleft(part, _PART_BITS)
         + F.col("_metadata.file_block_start")).alias("blk"),
        F.monotonically_increasing_id().alias("ord"), "value")


def _place(text: DataFrame, prefix: str) -> DataFrame:
    path = F.col("_metadata.file_path")
    date = F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})\.jsonl$", 1)
    return text.select(
        F.url_decode(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).alias("feed_id"),
        F.col("_metadata.file_name").alias("file"),
        (F.shiftleft(F.unix_date(F.try_to_date(date)).cast("long"), _SPLIT_BITS)
         + F.col("_metadata.file_block_start")).alias("blk"),
        F.monotonically_increasing_id().alias("ord"),
        F.col("value"),
    )


def drop_outside(lines: DataFrame, since: Column, until: Column) -> DataFrame:
    """Drop lines outside the window by their leading timestamp, before the
    readings are parsed. Lines that are not JSON or too long stay, to be counted."""
    lead = S.leading_timestamp(F.col("value"))
    at = F.when(S.has_offset(lead), F.try_to_timestamp(F.when(lead != "", lead)))
    probe = F.from_json("value", "timestamp string, _bad string", _OPTIONS)
    outside = (F.octet_length("value") <= MAX_LINE_BYTES) & F.coalesce(~at.between(since, until), F.lit(False))
    whole = F.when(outside, probe["_bad"].isNull() & F.rtrim(_clean()).endswith("}")).otherwise(False)
    return lines.where(~F.coalesce(whole, F.lit(False)))


_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false"}


def _clean() -> Column:
    return F.rtrim("value", F.lit(" \t\r"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Add ``rec`` and ``problem`` (NULL for a good record); blank lines vanish.

    A record is good when it is one JSON object with an offset timestamp and a
    sensors array whose entries have their text fields as text and their numeric
    fields, where given, as numbers or the bare tokens NaN and Infinity.
    """
    schema = T.StructType([*RECORD_SCHEMA.fields, T.StructField("_bad", T.StringType())])
    long_line = F.octet_length("value") > MAX_LINE_BYTES
    text = F.when(~long_line, _clean())
    rec = F.from_json(text, schema, _OPTIONS)
    loose = text.rlike(rf'(?<!\\)"(?:(?:{_NUMBERS})"\s*:\s*"|(?:{_TEXTS})"\s*:\s*[^"\s])')
    entry_ok = lambda s: s.isNotNull() & s["sensor"].isNotNull() & s["reading"].isNotNull() & s["type"].isNotNull() & s["unit"].isNotNull()
    parsed = lines.where(_clean() != "").withColumn("rec", rec)
    stamp = F.col("rec.timestamp")
    problem = (
        F.when(long_line, "line too long")
        .when(~F.is_valid_utf8(F.col("value")), "not UTF-8")
        .when(loose, "field type")
        .when(F.col("rec").isNull() | F.col("rec._bad").isNotNull() | ~text.endswith("}"), "not JSON")
        .when(F.col("rec.sensors").isNull() | stamp.isNull(), "field missing")
        .when(~F.forall("rec.sensors", entry_ok), "field missing")
        .when(~S.has_offset(stamp) | F.try_to_timestamp(stamp).isNull(), "timestamp")
    )
    return parsed.withColumn("problem", problem)


def good_samples(parsed: DataFrame) -> DataFrame:
    # A filter would be moved below the parsing and repeat it for every test in
    # ``problem``; unnesting zero or one record per line keeps a single parse.
    kept = F.explode_outer(F.when(F.col("problem").isNull(), F.array("rec")).otherwise(F.array()))
    return parsed.select("feed_id", "file", "blk", "ord", kept.alias("rec")).where(F.col("rec").isNotNull()).select(
        "feed_id", "file", "blk", "ord", F.to_timestamp("rec.timestamp").alias("ts"),
        F.col("rec.timestamp").alias("raw_timestamp"), F.lit(True).alias("available"),
        F.col("rec.sensors").alias("sensors"),
    )


def skipped_lines(parsed: DataFrame, by: list[str] | None = None) -> DataFrame:
    return parsed.groupBy(*(by or ["feed_id"])).agg(F.count_if(F.col("problem").isNotNull()).alias("skipped_lines"))


def scan(
    spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None,
    prefix: str = PREFIX, zone: str = "UTC",
) -> tuple[DataFrame, DataFrame]:
    """(samples in the window, parsed lines for the counts).

    Without both ends everything is read; with one, ``window`` gives the other.
    """
    if since or until:
        since, until = window(since, until)
    lines = read_lines(spark, root, since, until, prefix, zone)
    if since and until:
        a, b = F.lit(since.astimezone(timezone.utc)), F.lit(until.astimezone(timezone.utc))
        lines = drop_outside(lines, a, b)
        parsed = parse_lines(lines)
        return good_samples(parsed).where(F.col("ts").between(a, b)), parsed
    parsed = parse_lines(lines)
    return good_samples(parsed), parsed


def stream_lines(spark: SparkSession, root: str, prefix: str = PREFIX, files_per_batch: int = 100) -> DataFrame:
    """The same lines as a stream of arriving files."""
    text = (
        spark.readStream.option("lineSep", "\n").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"{prefix}????-??-??.jsonl").option("maxFilesPerTrigger", files_per_batch).text(root)
    )
    return _place(text, prefix)
