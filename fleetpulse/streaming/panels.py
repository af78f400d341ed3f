"""Liveness panels on a stream: windowed aggregates and sampling gaps."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fleetpulse.functions import scalars as S
from fleetpulse.schema import GAP_INTERVAL_MULTIPLE
from fleetpulse.session import ROCKSDB


def closing_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """The stream of times up to which windows are to be closed, see ``close_windows``."""
    return spark.readStream.schema("ts timestamp").parquet(folder)


def close_windows(spark: SparkSession, folder: str, until: datetime) -> None:
    """Say that nothing dated before ``until`` will come: a stream that has ended writes its last windows.

    ``until`` has to lie at least the allowed lateness behind the last window's end.
    """
    spark.createDataFrame([(until,)], "ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def windowed_series(readings: DataFrame, width: str = "1 minute", late: str = "10 minutes", closing: DataFrame | None = None) -> DataFrame:
    """Per-series aggregates of tumbling windows; only built-in operators.

    First and last are the finite values that come first and last in stream order. A window
    is written once the watermark passes its end; ``closing`` ticks move the watermark only.
    """
    if closing is not None:
        readings = readings.unionByName(closing.select("ts"), allowMissingColumns=True)
    v = S.finite_or_null(F.col("value"))
    at = F.when(v.isNotNull(), F.struct("blk", "ord", "pos"))
    out = readings.withWatermark("ts", late).groupBy(F.window("ts", width), "feed_id", "sensor", "reading").agg(
        F.count("feed_id").alias("samples"), (F.count("feed_id") - F.count(v)).alias("non_finite"), F.min_by(v, at).alias("first"), F.max_by(v, at).alias("last"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("avg"))
    # A filter on a count stays above the watermark; one on the feed would be pushed below it, and take the ticks away.
    return out.where("samples > 0").select(
        "feed_id", "sensor", "reading", F.col("window.start").alias("start"), "samples", "non_finite", "first", "last", "min", "max", "avg",
        (F.col("last") - F.col("first")).alias("delta"))


_GAP = "feed_id string, from string, to string, seconds long"


class _GapProcessor(StatefulProcessor):
    def __init__(self, interval_seconds: int):
        self.limit = GAP_INTERVAL_MULTIPLE * interval_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long, raw string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        t = frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)
        order = np.lexsort((t["ord"].to_numpy(), t["blk"].to_numpy()))
        at, names = t["us"].to_numpy()[order], t["raw_timestamp"].to_numpy()[order]
        us, raw = self.newest.get() or (int(at[0]), names[0])
        # Whole columns at a time: the baseline is the running maximum.
        top = np.maximum.accumulate(np.append(us, at))
        moved = np.flatnonzero(top[1:] > top[:-1])
        gap = np.flatnonzero((top[1:] - top[:-1])[moved] > self.limit)
        seen = np.append(np.array([raw], dtype=object), names[moved])
        self.newest.update((int(top[-1]), seen[-1]))
        if len(gap):
            here = moved[gap]
            yield pd.DataFrame({"feed_id": np.full(len(gap), key[0], dtype=object), "from": seen[gap], "to": names[here],
                                "seconds": (top[here + 1] - top[here]) // 1_000_000})


def stream_gaps(ticks: DataFrame, interval_seconds: int) -> DataFrame:
    """Sampling gaps as they appear; the state per feed is one time."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    t = ticks.where(F.col("available") & F.col("ts").isNotNull()).select("feed_id", "blk", "ord", F.unix_micros("ts").alias("us"), "raw_timestamp")
    return t.groupBy("feed_id").transformWithStateInPandas(_GapProcessor(interval_seconds), _GAP, "Append", "None")
