"""A sample log of many appends: data files, and a manifest that says which of them count and in which order.

Layout: ``<root>/data/append=N/feed_id=F/dt=D/part-*`` and ``<root>/manifest/version=N``. A
version of the manifest is a Parquet table of all files in force, one row each; it counts once its write is
committed, so an append, a compaction or a dropped day becomes visible at once or not at all.
Readers take the newest. There is one writer at a time.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fleetpulse.sources import sample_log
from fleetpulse.sources.tables import record_json

FILE_KEY = ["append", "feed_id", "dt", "file"]
MANIFEST_DDL = "append bigint, feed_id string, dt date, file string, seq bigint"


def _folders(spark: SparkSession, pattern: str):
    """Existing folders of a glob pattern, on the table's own file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, [st.getPath() for st in fs.globStatus(path) or []]


def version(spark: SparkSession, root: str) -> int:
    """The newest committed version; 0 for a table that has none. Only folder names are listed."""
    _, done = _folders(spark, f"{root}/manifest/version=*/_SUCCESS")
    return max((int(p.getParent().getName().split("=")[1]) for p in done), default=0)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """The files in force: append, feed_id, dt, file, and the file's place in its feed's day."""
    n = version(spark, root)
    return spark.read.schema(MANIFEST_DDL).parquet(f"{root}/manifest/version={n}") if n else spark.createDataFrame([], MANIFEST_DDL)


def _commit(files: DataFrame, root: str, n: int) -> None:
    """Write version ``n``. Files of a feed's day are numbered by append and part; no window is wider than a day of a feed."""
    part = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")
    order = Window.partitionBy("feed_id", "dt").orderBy("append", part, "file")
    numbered = files.withColumn("seq", F.row_number().over(order).cast("long") - 1)
    numbered.select("append", "feed_id", "dt", "file", "seq").write.parquet(f"{root}/manifest/version={n}")


def _write(lines: DataFrame, root: str, n: int) -> DataFrame:
    """Write lines (feed_id, dt, blk, ord, value) as append ``n``, in order, and list the files that came of it."""
    spark, folder = lines.sparkSession, f"{root}/data/append={n}"
    (lines.repartitionByRange("feed_id", "dt", "blk", "ord").sortWithinPartitions("feed_id", "dt", "blk", "ord")
     .select("feed_id", "dt", "value").write.mode("overwrite").partitionBy("feed_id", "dt").text(folder))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder)
    feed = F.url_decode(F.replace(F.regexp_extract("path", r"/feed_id=([^/]*)/", 1), F.lit("+"), F.lit("%2B")))
    return found.select(
        F.lit(n).cast("long").alias("append"), feed.alias("feed_id"), F.to_date(F.regexp_extract("path", r"/dt=([^/]*)/", 1)).alias("dt"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("file"))


def append_log(samples: DataFrame, root: str) -> int:
    """Append samples, whose order among earlier ones is that of the appends; returns the new version."""
    spark = samples.sparkSession
    n = version(spark, root) + 1
    _commit(manifest(spark, root).select(*FILE_KEY).unionByName(_write(record_json(samples), root, n)), root, n)
    return n


def read_log(spark: SparkSession, root: str, since: datetime | None = None, until: datetime | None = None, zone: str = "UTC") -> DataFrame:
    """Lines in order, as ``sample_log.read_lines`` gives them; days outside the padded window are pruned by folder.

    A line's block is its day, its file's place in the day, and the split it was read from. Files that
    the manifest does not have are passed over.
    """
    files = manifest(spark, root)
    if not version(spark, root):
        return spark.createDataFrame([], sample_log.LINE_SCHEMA)
    text = spark.read.schema("value string, append bigint, feed_id string, dt date").option("lineSep", "\n").text(f"{root}/data")
    if since or until:
        days = sample_log.candidate_dates(*sample_log.window(since, until), zone)
        text, files = (x.where(F.col("dt").between(days[0], days[-1])) for x in (text, files))
    lines = text.select("append", "feed_id", "dt", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("ord"), "value")
    return lines.join(files, FILE_KEY).select(
        "feed_id", F.concat_ws("/", F.col("dt").cast("string"), "file").alias("file"),
        (F.shiftleft(F.unix_date("dt").cast("long"), sample_log._SPLIT_BITS) + F.shiftleft("seq", sample_log._PART_BITS) + F.col("start")).alias("blk"),
        "ord", "value")


def compact_day(spark: SparkSession, root: str, day: date) -> int:
    """Rewrite one day's files of all feeds as few as they fill; returns the new version."""
    n = version(spark, root) + 1
    start = datetime(day.year, day.month, day.day)
    lines = read_log(spark, root, start, start).withColumn("dt", F.to_date(F.substring("file", 1, 10))).where(F.col("dt") == day)
    others = manifest(spark, root).where(F.col("dt") != day).select(*FILE_KEY)
    _commit(others.unionByName(_write(lines, root, n)), root, n)
    return n


def drop_days(spark: SparkSession, root: str, keep_days: int, today: date) -> int:
    """Take days older than ``keep_days`` before ``today`` out of the manifest; 0 or less keeps all. Returns the version in force."""
    if keep_days <= 0:
        return version(spark, root)
    n = version(spark, root) + 1
    _commit(manifest(spark, root).where(F.col("dt") >= today - timedelta(days=keep_days)).select(*FILE_KEY), root, n)
    return n


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the day folders of appends that the manifest no longer has any file of; returns ``append=N/dt=D`` of each."""
    kept = {f"append={r.append}/dt={r.dt}" for r in manifest(spark, root).select("append", "dt").distinct().collect()}  # a row per append and day
    fs, days = _folders(spark, f"{root}/data/append=*/feed_id=*/dt=*")
    gone = set()
    for p in days:
        name = f"{p.getParent().getParent().getName()}/{p.getName()}"
        if name not in kept:
            fs.delete(p, True)
            gone.add(name)
    return sorted(gone)
