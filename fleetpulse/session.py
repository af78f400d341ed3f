"""Session settings the jobs are designed for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What a Python worker is handed at once while a step is written; 10,000 long texts would be held several times over.
BATCH_BYTES = 4 << 20
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shuffle_partitions(input_bytes: int, partition_bytes: int = 128 << 20, least: int = 200) -> int:
    """The initial number of shuffle partitions for an input; AQE joins the small ones at run time."""
    return max(least, -(-input_bytes // partition_bytes))


def build_session(app: str = "fleetpulse", master: str | None = None, input_bytes: int = 0, **conf: str) -> SparkSession:
    """A session with AQE (coalescing, skew join, size-checked broadcasts) and UTC.

    With ``input_bytes``, shuffles start with a partition for every 128 MiB of it: at
    100 TB that is 800,000 small ones instead of 200 of half a terabyte. What is less is
    coalesced at run time. ``conf`` may set everything, ``spark.checkpoint.dir`` above all.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        **conf,
    }
    if input_bytes:
        settings.setdefault("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(shuffle_partitions(input_bytes)))
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for streaming checkpoints and written intermediates.

    The cluster names it in ``spark.checkpoint.dir``. Unset, it is an error, as folders of
    one machine are not seen by the others; only ``local[...]`` sessions, which
    have no others, get a new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    Several branches then share one computation, lost executors cost a re-read
    and not a re-run, and the table's known size guides the joins. Shuffle files of
    the write are not needed after it and are dropped with it. Python workers get
    their rows in batches of about ``BATCH_BYTES``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    settings = {DROP_SHUFFLES: "true", ARROW_BYTES: f"{BATCH_BYTES}b"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)
