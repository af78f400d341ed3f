"""Removal of repeated byte strings with a sparse suffix array that is range-partitioned by leading bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetpulse.llm.common import BASE, BYTE_KEYS, mix64, runs, string_bytes

LEAD = 32
SLICE = 1 << 20


def gram_hashes(data: np.ndarray, k: int = LEAD) -> np.ndarray:
    """Hashes of all strings of k bytes (a power of two), by doubling."""
    h, size, base = BYTE_KEYS[data], 1, BASE
    while size < k:
        h = h[:-size] * np.uint64(base) + h[size:]
        size, base = 2 * size, base * base % (1 << 64)
    return mix64(h)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    size, m = 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == w else np.minimum(m[: len(x) - w + 1], m[w - size :][: len(x) - w + 1])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first, last): the suffixes that stand for all windows of ``length`` bytes.

    A window's anchor is the place in it of the LEAD bytes with the least hash, the rightmost
    of equals, so equal windows have their anchors at the same place. ``first`` to ``last`` are
    the starts of an anchor's windows.
    """
    w = length - LEAD + 1
    out = []
    for begin in range(0, max(len(data) - length + 1, 0), SLICE):
        part = data[begin : begin + SLICE + length - 1]
        h = gram_hashes(part)
        order = (h >> np.uint64(21) << np.uint64(21)) | (np.uint64((1 << 21) - 1) - np.arange(len(h), dtype=np.uint64))
        at = ((1 << 21) - 1) - (sliding_min(order, w) & np.uint64((1 << 21) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        last = np.append(cut[1:], len(at)) - 1
        out.append((at[cut] + begin, h[at[cut]], cut + begin, last + begin))
    if not out:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.uint64), none, none
    return tuple(np.concatenate(x) for x in zip(*out))


def repeated_leads(docs: DataFrame, length: int) -> DataFrame:
    """``doc_id, leads``: hashes of the anchors of each document that occur more than once in all documents.

    Each task sends a row for each of its hashes, with the documents that hold it.
    """
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("docs", pa.list_(pa.int64()))])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ids, held = [], [], 0

        def rows() -> pa.RecordBatch:
            h, d = np.concatenate(hs), np.concatenate(ids)
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            n = np.diff(np.append(start, len(h)))
            rest = [None] * len(start)
            for k in np.flatnonzero(n > 1):
                rest[k] = np.unique(d[start[k] : start[k] + n[k]])[1:] if d[start[k]] != d[start[k] + n[k] - 1] else None
            return pa.record_batch([pa.array(h[start].view(np.int64)), pa.array(n), pa.array(d[start]), pa.array(rest, pa.list_(pa.int64()))], schema=schema)

        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for doc, s, e in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:]):
                _, h, _, _ = anchors(data[s:e], length)
                if len(h):
                    hs.append(h)
                    ids.append(np.full(len(h), doc, np.int64))
                    held += len(h)
                    if held > 1_500_000:
                        yield rows()
                        hs, ids, held = [], [], 0
        if held:
            yield rows()

    seen = docs.mapInArrow(emitted, "h bigint, n bigint, first bigint, docs array<bigint>")
    again = seen.select("h", "first", "docs", F.sum("n").over(W.partitionBy("h")).alias("total")).filter("total >= 2")
    each = again.select("h", F.explode(F.concat(F.array("first"), F.coalesce("docs", F.array().cast("array<bigint>")))).alias("doc_id"))
    return each.groupBy("doc_id").agg(F.collect_list("h").alias("leads"))  # as long as the document at most


def suffix_rows(docs: DataFrame, leads: DataFrame, length: int) -> DataFrame:
    """``doc_id, first, at, span``: the bytes of all windows of each anchor that may repeat.

    ``at`` is the anchor's place in the span. Of equal spans in one task, only the first goes on
    with its bytes; the others repeat it as a whole and carry none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("windows", pa.int64()), ("at", pa.int64()), ("span", pa.binary())])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[int, bytes], tuple[int, int]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            rows = [(d, f, len(span) - length + 1, at, span) for (at, span), (d, f) in kept.items()]
            kept.clear()
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            copies = []
            for doc, s, e, own in zip(batch.column(0).to_pylist(), offsets[:-1], offsets[1:], batch.column(2)):
                if not own.is_valid:
                    continue
                text = data[s:e]
                at, h, first, last = anchors(text, length)
                mine = np.isin(h, own.values.to_numpy(zero_copy_only=False).view(np.uint64))
                raw = text.tobytes()
                for p, f, z in zip(at[mine].tolist(), first[mine].tolist(), last[mine].tolist()):
                    key = (p - f, raw[f : z + length])
                    other = kept.get(key)
                    if other is None:
                        kept[key] = (doc, f)
                        size += len(key[1]) + 200
                    elif other <= (doc, f):
                        copies.append((doc, f, z - f + 1))
                    else:
                        copies.append((*other, z - f + 1))
                        kept[key] = (doc, f)
            if copies:
                none = pa.nulls(len(copies))
                yield pa.record_batch([*(pa.array(c, pa.int64()) for c in zip(*copies)), none.cast(pa.int64()), none.cast(pa.binary())], schema=schema)
            if size > 96 << 20:
                yield flush()
                size = 0
        if kept:
            yield flush()

    return docs.join(leads, "doc_id").select("doc_id", "text", "leads").mapInArrow(
        emitted, "doc_id bigint, first bigint, windows bigint, at bigint, span binary")


def repeats_of_run(docs: np.ndarray, first: np.ndarray, at: np.ndarray, spans: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(document, start, end) of the bytes of one lead's windows that start earlier elsewhere."""
    order = np.lexsort((first + at, docs))
    out, seen = [], {}
    fresh = []
    for i in order.tolist():
        key = (int(at[i]), spans[i])
        if key in seen:
            out.append((int(docs[i]), int(first[i]), int(first[i]) + len(spans[i])))
        else:
            seen[key] = i
            fresh.append(i)
    if len(fresh) < 2:
        return out
    places = {i: int(at[i]) for i in fresh}
    hits: dict[int, list[int]] = {}
    for shift in range(-max(places.values()), max(len(spans[i]) - length - places[i] for i in fresh) + 1):
        known = set()
        for i in fresh:  # by document and position: the first of equal windows stays
            k = shift + places[i]
            if 0 <= k <= len(spans[i]) - length:
                window = spans[i][k : k + length]
                if window in known:
                    hits.setdefault(i, []).append(k)
                else:
                    known.add(window)
    for i, ks in hits.items():
        begin = 0
        for j in range(1, len(ks) + 1):
            if j == len(ks) or ks[j] != ks[j - 1] + 1:
                out.append((int(docs[i]), int(first[i]) + ks[begin], int(first[i]) + ks[j - 1] + length))
                begin = j
    return out


def repeated_spans(suffixes: DataFrame, length: int, buckets: int) -> DataFrame:
    """``doc_id, start, end``: bytes that lie in windows that also start earlier."""
    keyed = suffixes.withColumn("lead", F.expr(f"coalesce(substring(span, cast(at as int) + 1, {LEAD}), cast(cast(xxhash64(doc_id, first) as string) as binary))"))
    sorted_ = keyed.repartitionByRange(buckets, "lead").sortWithinPartitions("lead")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for run in runs(batches, ["lead"]):
            spans = run["span"]
            if spans[0] is None:
                out.extend((int(d), int(f), int(f) + int(w) - 1 + length) for d, f, w in zip(run["doc_id"], run["first"], run["windows"]))
            elif len(spans) > 1:
                out.extend(repeats_of_run(run["doc_id"], run["first"], np.asarray(run["at"]).astype(np.int64), spans, length))
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out)], schema=schema)

    return sorted_.mapInArrow(compared, "doc_id bigint, start bigint, end bigint")


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` of each document."""
    lists = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # a document's own

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            rows = []
            for s, e, own in zip(offsets[:-1], offsets[1:], batch.column(2)):
                text = data[s:e]
                edge = np.zeros(len(text) + 1, np.int32)
                if own.is_valid:
                    starts, ends = own.values.flatten()
                    np.add.at(edge, starts.to_numpy(), 1)
                    np.add.at(edge, ends.to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = text[~gone].tobytes()
                begins = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                rows.append((len(text), int(gone.sum()), begins, hashlib.sha256(kept).hexdigest(), kept))
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string(), pa.binary()]))],
                                  names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(lists, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(
        cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte that lies in a string of ``length`` bytes which also starts earlier.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the bytes left).
    Earlier means a smaller id, or an earlier start in the same document; all is judged
    on the input. Texts are UTF-8 bytes, and no string crosses documents.

    Of all suffixes, those at anchors are enough: every window of ``length`` bytes has one, chosen by
    content alone, so equal windows have it at the same place (about one byte in 35 is one). Anchors that
    occur once are dropped by a count of hashes. The rest are range-partitioned by their leading bytes with
    splitters that Spark samples, and sorted there; equal leads never straddle two buckets, as splitters
    are whole leads. In a run of equal leads the windows are compared as bytes, so hashes decide nothing.

    Documents are shuffled once, by id, and that exchange serves all three passes. Spans equal to an earlier one of the
    same task are settled there, so that a passage in a third of all rows costs a row per task and neighbourhood.

    Nulls: a null text is empty; rows without an id take no part and keep all bytes. Of rows
    that repeat an id the smallest text counts, once. Other columns are ignored.
    """
    if length < 2 * LEAD:
        raise ValueError(f"length is {2 * LEAD} or more")
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    one = named.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    suffixes = suffix_rows(one, repeated_leads(one, length), length)
    done = without_spans(one, repeated_spans(suffixes, length, buckets))
    unnamed = named.filter("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_removed"),
        F.lit(0).cast("bigint").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return done.union(unnamed)
