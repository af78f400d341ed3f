"""Reading and writing the derived tables: export, logs, events, retention."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.operators import readings as R
from fleetpulse.schema import EXPORT_COLUMNS
from fleetpulse.sources.sample_log import PREFIX

_EXPORT_DDL = "timestamp timestamp, sensor string, reading string, type string, value double, unit string"


def write_export(readings: DataFrame, target: str, by_feed: bool = False) -> dict[str, int]:
    """Overwrite ``target`` with the flat export and report what was written.

    The job is scan, flatten, write: no shuffle. The counts are observed while
    writing. An empty window still leaves a file with the schema.
    """
    seen = Observation()
    rows = R.export_rows(readings).select("feed_id", F.to_date("timestamp").alias("dt"), *EXPORT_COLUMNS)
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
    if by_feed:
        rows.write.mode("overwrite").option("compression", "snappy").partitionBy("feed_id", "dt").parquet(target)
    else:
        rows.select(*EXPORT_COLUMNS).write.mode("overwrite").option("compression", "snappy").parquet(target)
    return {"rows": seen.get["rows"]}


def export_summary(readings: DataFrame, ticks: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """rows, samples, files and skipped lines of one export, per feed."""
    rows = readings.groupBy("feed_id").agg(F.count(F.lit(1)).alias("rows"))
    n = ticks.groupBy("feed_id").agg(F.count(F.lit(1)).alias("samples"))
    out = n.join(rows, "feed_id", "left")
    if parsed is not None:
        p = parsed.groupBy("feed_id").agg(
            F.countDistinct("file").alias("files"), F.count_if(F.col("problem").isNotNull()).alias("skipped_lines"))
        out = out.join(p, "feed_id", "full")
    return out.na.fill(0)


def read_export(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    df = spark.read.schema(_EXPORT_DDL).parquet(path)
    if view:
        df.createOrReplaceTempView(view)
    return df


def record_json(samples: DataFrame) -> DataFrame:
    """One log line per sample; a sample without readings is not logged. Values
    that are not numbers are written as null."""
    clean = F.transform("sensors", lambda s: F.struct(
        s["sensor"].alias("sensor"), s["reading"].alias("reading"), s["type"].alias("type"),
        *[S.finite_or_null(s[c]).alias(c) for c in ("value", "min", "max", "avg")], s["unit"].alias("unit")))
    return samples.where(F.size("sensors") > 0).select(
        "feed_id", "blk", "ord", F.to_date("ts").alias("dt"),
        F.to_json(F.struct(F.col("raw_timestamp").alias("timestamp"), clean.alias("sensors")),
                  {"ignoreNullFields": "false"}).alias("value"))


def write_log(samples: DataFrame, root: str) -> None:
    """Append samples as text, partitioned by feed and day, in stream order
    inside each day. Days of a feed are independent, and a big day may span
    several files because rows are range-partitioned, not gathered.
    ``sample_log.read_written`` reads it."""
    lines = record_json(samples)
    (lines.repartitionByRange("feed_id", "dt", "blk", "ord")
     .sortWithinPartitions("feed_id", "dt", "blk", "ord")
     .select("feed_id", "dt", "value").write.mode("append").partitionBy("feed_id", "dt").text(root))


def write_day_log(samples: DataFrame, root: str) -> None:
    """Write the log of a whole fleet, in stream order inside each feed's day, as Parquet by day only.

    ``write_log`` makes a folder for each feed and day, which suits a few feeds; here there are as many
    files as range partitions and days, however many feeds there are. ``sample_log.read_day_log`` reads it.
    """
    lines = record_json(samples)
    (lines.repartitionByRange("dt", "feed_id", "blk", "ord")
     .sortWithinPartitions("dt", "feed_id", "blk", "ord")
     .select("dt", "feed_id", "value").write.partitionBy("dt").parquet(root))


def write_daily_files(lines: DataFrame, root: str, prefix: str = PREFIX) -> int:
    """Lines (feed_id, dt, blk, ord, value) as ``<root>/<feed_id>/<prefix>YYYY-MM-DD.jsonl``, one file for each
    feed and day, as ``sample_log.read_lines`` reads them; returns how many. A day of a feed is one
    task. Files are written next to ``root`` and then moved, a rename each. Feed ids must be folder names.
    """
    spark = lines.sparkSession
    (lines.repartition("feed_id", "dt").sortWithinPartitions("feed_id", "dt", "blk", "ord").select("feed_id", "dt", "value")
     .write.partitionBy("feed_id", "dt").text(f"{root}.parts"))
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    unescape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    moved = 0
    for st in fs.globStatus(path(f"{root}.parts/feed_id=*/dt=*/part-*")) or []:
        day = st.getPath().getParent()
        folder = path(path(root), unescape(day.getParent().getName().split("=", 1)[1]))
        fs.mkdirs(folder)
        moved += fs.rename(st.getPath(), path(folder, f"{prefix}{day.getName().split('=', 1)[1]}.jsonl"))
    return moved


def append_journal(journal: DataFrame, path: str) -> None:
    journal.write.mode("append").partitionBy("month").parquet(path)


def file_date(name: Column, prefix: str = PREFIX) -> Column:
    """The date in ``<prefix>YYYY-MM-DD.<ext>``, NULL for any other name."""
    day = F.regexp_extract(name, rf"^{prefix}(\d{{4}}-\d{{2}}-\d{{2}})\.[a-z]+$", 1)
    return F.try_to_date(F.when(day != "", day))


def expired(files: DataFrame, days: int, today: Column, prefix: str = PREFIX, name: str = "file") -> DataFrame:
    """Files strictly older than ``days`` before ``today``. The cut-off day stays,
    names without a date stay, and ``days`` <= 0 keeps everything."""
    if days <= 0:
        return files.where(F.lit(False))
    return files.where(F.coalesce(file_date(F.col(name), prefix) < F.date_sub(today, days), F.lit(False)))


def prune_days(spark: SparkSession, root: str, keep_days: int, today: date, column: str = "dt") -> list[str]:
    """Drop expired ``column=`` partition folders of a table through the table's
    file system; returns the dropped folder names. Only folder names are listed."""
    if keep_days <= 0:
        return []
    jvm = spark._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base, f"{column}=*")) or []:
        name = st.getPath().getName()
        try:
            day = date.fromisoformat(name.split("=", 1)[1])
        except ValueError:
            continue
        if (today - day).days > keep_days:
            fs.delete(st.getPath(), True)
            dropped.append(name)
    return sorted(dropped)
