"""Hierarchical packing of documents into sequences of several lengths."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetpulse.llm.word_tokens import WordTokenizer

TIERS = (256, 512, 1024, 2048, 4096)

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, tier int, step_group bigint"
)
SHARD = 1 << 40


class TierPool:
    """Documents of one tier that wait to be packed: (length, index), shortest first."""

    def __init__(self) -> None:
        self.waiting: list[tuple[int, int]] = []

    def add(self, length: int, index: int) -> None:
        insort(self.waiting, (length, index))

    def take_fitting(self, room: int) -> tuple[int, int] | None:
        """The longest document of at most ``room`` tokens."""
        at = bisect_left(self.waiting, (room + 1, -1))
        return self.waiting.pop(at - 1) if at else None

    def take_longest(self) -> tuple[int, int] | None:
        return self.waiting.pop() if self.waiting else None


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token once.

    A document longer than the largest tier first fills whole windows of it. Each rest goes
    to the smallest tier that holds it. From the largest tier down, a window starts with the
    longest waiting document of its tier and takes best-fitting ones, of its own tier and
    then of shorter ones; what is then still empty is filled with the head of a shorter
    document, whose tail waits in its own tier. Only the last window can stay open; it
    is cut into powers of two, so that nothing is padded.
    """
    top = tiers[-1]
    pools = {t: TierPool() for t in tiers}
    starts = [0] * len(lengths)
    out: list[list[tuple[int, int, int]]] = []

    def wait(doc: int, left: int) -> None:
        if left:
            pools[next(t for t in tiers if left <= t)].add(left, doc)

    for doc, n in enumerate(lengths):
        while n - starts[doc] >= top:
            out.append([(doc, starts[doc], top)])
            starts[doc] += top
        wait(doc, n - starts[doc])

    def put(seq: list, doc: int, n: int) -> None:
        seq.append((doc, starts[doc], n))
        starts[doc] += n

    last: list[tuple[int, int, int]] = []
    for level in range(len(tiers) - 1, -1, -1):
        window = tiers[level]
        while first := pools[window].take_longest():
            seq: list[tuple[int, int, int]] = []
            put(seq, first[1], first[0])
            room = window - first[0]
            for below in range(level, -1, -1):
                while room and (got := pools[tiers[below]].take_fitting(room)):
                    put(seq, got[1], got[0])
                    room -= got[0]
            if room:  # every waiting document is longer than the room: cut one
                longer = next((x for t in tiers[: level + 1] if (x := pools[t].take_longest())), None)
                if longer:
                    put(seq, longer[1], room)
                    wait(longer[1], longer[0] - room)
                    room = 0
            if room:
                last = seq  # nothing of this tier or a shorter one is left
            else:
                out.append(seq)
    while last:
        used = sum(n for _, _, n in last)
        size = 1 << (used.bit_length() - 1)
        seq, rest, room = [], [], size
        for doc, at, n in last:
            here = min(n, room)
            if here:
                seq.append((doc, at, here))
                room -= here
            if n > here:
                rest.append((doc, at + here, n - here))
        out.append(seq)
        last = rest
    return out


def step_groups(sizes: list[int], group_tokens: int) -> list[int]:
    """A step for each sequence: sequences of one length together, of equal token sums."""
    steps, at, names = [], {}, {}
    for size in sizes:
        filled, step = at.get(size, (group_tokens, -1))
        if filled + size > group_tokens:
            filled, step = 0, len(names)
            names[step] = size
        at[size] = (filled + size, step)
        steps.append(step)
    return steps


def pack_documents(
    docs: DataFrame, tokenizer_file: str = "word_bpe_49k.json", end_id: int = 2, tiers: tuple[int, ...] = TIERS,
    buffer_tokens: int = 1 << 21, group_tokens: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pack all tokens of all documents; one row per piece.

    Each Spark partition is read once and packed in buffers of about ``buffer_tokens`` tokens
    (a single longer document is a buffer of its own), so memory is bounded, nothing is
    shuffled, and a hot source is spread as its files are. A re-run of a lost partition packs it as
    a whole again. Sequence ids are partition number times 2**40 plus a counter.
    ``tier`` is the sequence's size and ``step_group`` a batch of sequences of one size with at
    most ``group_tokens`` tokens.

    ``tokenizer_file`` is a path, or a name that the package ``public_tokenizers`` resolves on
    the worker. Nulls: a null text is empty and has just the end id; a null id is kept as null.
    Repeated rows are packed as often as they occur. Other columns are ignored.
    """
    top = tiers[-1]
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers are rising powers of two")
    schema = pa.schema([
        (name, {"bigint": pa.int64(), "int": pa.int32()}[kind]) for name, kind in (x.split() for x in PIECES.split(", "))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer.shared(tokenizer_file)
        base = TaskContext.get().partitionId() * SHARD
        state = {"sequences": 0, "steps": 0}

        def flush(ids: list, docs: list[np.ndarray]) -> pa.RecordBatch:
            sequences = pack([len(d) for d in docs], tiers)
            sizes = [sum(n for _, _, n in seq) for seq in sequences]
            steps = step_groups(sizes, max(group_tokens, top))
            rows = []
            for k, (seq, size, step) in enumerate(zip(sequences, sizes, steps)):
                offset = 0
                for doc, at, n in seq:
                    crc = zlib.crc32(docs[doc][at : at + n].astype("<u4").tobytes())
                    rows.append((ids[doc], at, n, crc, len(docs[doc]), base + state["sequences"] + k, offset, size,
                                 base + state["steps"] + step))
                    offset += n
            state["sequences"] += len(sequences)
            state["steps"] += max(steps, default=-1) + 1
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        ids, docs, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.append(tokens.encode(text.as_py() or ""), np.uint32(end_id))
                if docs and held + len(got) > buffer_tokens:
                    yield flush(ids, docs)
                    ids, docs, held = [], [], 0
                ids.append(doc_id)
                docs.append(got.astype(np.uint32 if len(got) and got.max() > 65535 else np.uint16))
                held += len(got)
        if docs:
            yield flush(ids, docs)

    return docs.select(id_col, text_col).mapInArrow(packed, PIECES)
