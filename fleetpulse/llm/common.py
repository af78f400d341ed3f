"""Small helpers that several operators share."""

from __future__ import annotations

import sys
from types import ModuleType

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the query contracts, as a regular expression that Spark and DuckDB read alike.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def worker_cache() -> dict:
    """A dictionary of the Python process that outlives its tasks, whose code is sent anew each time."""
    return sys.modules.setdefault("_fleetpulse_worker", ModuleType("_fleetpulse_worker")).__dict__.setdefault("kept", {})


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: One random 64-bit number for each byte value.
BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Odd, so that it can be inverted modulo 2**64.
BASE = 0x2545F4914F6CDD1D
UNBASE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


class Grid:
    """Powers that are computed once and grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(BASE, n), powers(UNBASE, n)
        return self.up, self.down


GRID = Grid()


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] = sum over i <= t < j of key(data[t]) * BASE**t; one longer than data."""
    up, _ = GRID.upto(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_KEYS[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal spans have equal hashes."""
    _, down = GRID.upto(len(sums))
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def doc_slices(offsets: np.ndarray, most: int = 1 << 21):
    """Ranges (i, j) of neighbouring texts of at most ``most`` bytes together, or of one longer text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def string_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def runs(batches, keys: list[str]):
    """The rows of each key of a sorted stream of Arrow batches, as columns; a key may span batches."""
    held: dict | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {
            name: (c.to_pylist() if str(c.type) in ("binary", "string", "large_binary", "large_string") else c.to_numpy(zero_copy_only=False))
            for name, c in zip(batch.schema.names, batch.columns)
        }
        if held is not None:
            cols = {k: held[k] + v if isinstance(v, list) else np.concatenate([held[k], v]) for k, v in cols.items()}
        n = len(cols[keys[0]])
        new = np.zeros(n, bool)
        for k in keys:
            v = np.asarray(cols[k])
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        for s, e in zip(cuts[:-2], cuts[1:-1]):
            yield {k: v[s:e] for k, v in cols.items()}
        held = {k: v[cuts[-2] :] for k, v in cols.items()}
    if held is not None:
        yield held
