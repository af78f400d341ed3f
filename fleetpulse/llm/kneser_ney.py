"""Quality by the perplexity of an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import text_or_empty
from fleetpulse.session import written

ORDER = 4
#: They open and close every text; the texts' own copies of them are read as spaces.
OPEN, CLOSE = "\x02", "\x03"
BLOCK_CHARS = 56 << 20
SLICE_CHARS = 1 << 20


def ranked(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, index of each key among them)."""
    if size > 1 << 22:
        return np.unique(keys, return_inverse=True)
    present = np.zeros(size, bool)
    present[keys] = True
    place = np.cumsum(present, dtype=np.int32)
    return np.flatnonzero(present), place[keys].astype(np.int64) - 1


def text_slices(docs: pa.Table) -> Iterator[tuple[str, np.ndarray, list[str]]]:
    """(language, row numbers, texts) of a few texts of one language at a time."""
    lengths = pc.utf8_length(docs.column("text")).to_pylist()
    by_lang: dict[str, list[int]] = {}
    for row, lang in enumerate(docs.column("lang").to_pylist()):
        by_lang.setdefault(lang, []).append(row)
    for lang, rows in by_lang.items():
        i = 0
        while i < len(rows):
            j, held = i, 0
            while j < len(rows) and (j == i or held + lengths[rows[j]] <= SLICE_CHARS):
                held += lengths[rows[j]]
                j += 1
            yield lang, np.array(rows[i:j]), docs.column("text").take(pa.array(rows[i:j])).to_pylist()
            i = j


def block_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.Table]]:
    """(are they texts, rows) of a sorted block: first what the block was sent, then its texts, a few batches at a time."""
    for batch in batches:
        kinds = batch.column("is_text").to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(kinds, True))
        for part, texts in ((batch.slice(0, cut), False), (batch.slice(cut), True)):
            if part.num_rows:
                yield texts, pa.Table.from_batches([part])


def grams_of(texts: list[str], order: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct grams, gram of each symbol, first symbol of each text) of opened and closed texts."""
    plain = [OPEN * (order - 1) + t.replace(OPEN, " ").replace(CLOSE, " ") + CLOSE for t in texts]
    symbols = np.frombuffer("".join(plain).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes, char = ranked(symbols, int(symbols.max()) + 1)
    letters = [chr(c) for c in codes]
    names, at = letters, char
    for _ in range(order - 1):
        values, nxt = ranked(at[:-1] * len(letters) + char[-len(at) + 1 :], len(names) * len(letters))
        names = [names[v // len(letters)] + letters[v % len(letters)] for v in values.tolist()]
        at = nxt
    lengths = np.array([len(p) for p in plain])
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    own = np.ones(len(at), bool)  # of a text and not of two neighbours
    for k in range(1, order):
        own[(begin[1:] - k)] = False
    first = np.concatenate([[0], np.cumsum(lengths - (order - 1))[:-1]])
    return names, at[own], first


def count_block(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """``block, lang, gram, n`` of all grams of a block, once each; n counts those of trusted texts only."""
    ids: set[int] = set()
    totals: dict[str, dict[str, int]] = {}
    block = None
    for is_text, rows in block_parts(batches):
        block = rows.column("block")[0].as_py()
        if not is_text:
            ids.update(rows.column("doc_id").to_pylist())
            continue
        trusted = np.array([d in ids for d in rows.column("doc_id").to_pylist()], np.float64)
        for lang, at_rows, texts in text_slices(rows):
            names, at, first = grams_of(texts, order)
            weight = np.repeat(trusted[at_rows], np.diff(np.append(first, len(at))))
            held = totals.setdefault(lang, {})
            for name, n in zip(names, np.bincount(at, weight, len(names)).astype(np.int64).tolist()):
                held[name] = held.get(name, 0) + n
    for lang, held in totals.items():
        names, counts = list(held), list(held.values())
        for i in range(0, len(names), 1 << 16):
            some = names[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(some), pa.int32()), pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string()),
                pa.array(counts[i : i + (1 << 16)], pa.int64())], ["block", "lang", "gram", "n"])


def score_block(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """``doc_id, digest, lang, symbols, log_sum`` of a block's texts; log_sum is null without a model of the language."""
    logs: dict[str, dict[str, float]] = {}
    for is_text, rows in block_parts(batches):
        if not is_text:
            for lang, gram, value in zip(*(rows.column(c).to_pylist() for c in ("lang", "gram", "log_p"))):
                logs.setdefault(lang, {})[gram] = value
            continue
        symbols, sums = np.zeros(rows.num_rows, np.int64), np.full(rows.num_rows, np.nan)
        for lang, at_rows, texts in text_slices(rows):
            known = logs.get(lang, {})
            names, at, first = grams_of(texts, order)
            value = np.array([known.get(name, np.nan) for name in names])
            sums[at_rows] = np.add.reduceat(value[at], first)
            symbols[at_rows] = np.diff(np.append(first, len(at)))
        out = rows.select(["doc_id", "digest", "lang"]).combine_chunks().append_column("symbols", pa.array(symbols))
        yield from out.append_column("log_sum", pa.array(sums, mask=np.isnan(sums))).to_batches()


def discounts(level: DataFrame) -> DataFrame:
    """``lang, d1, d2, d3``: the discounts of grams seen once, twice and oftener, from the counts of counts."""
    seen = level.groupBy("lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
    n1, n2, n3, n4 = (F.col(f"n{i}") for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    usual = (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)
    bounded = lambda x, i: F.when(usual, F.least(F.greatest(x, F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(0.5 * i))
    return seen.select("lang", bounded(1 - 2 * y * n2 / n1, 1).alias("d1"), bounded(2 - 3 * y * n3 / n2, 2).alias("d2"), bounded(3 - 4 * y * n4 / n3, 3).alias("d3"))


def discount_of(n: Column) -> Column:
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).when(n >= 3, F.col("d3")).otherwise(F.lit(0.0))


def probabilities(wanted: DataFrame, level: DataFrame, order: int) -> DataFrame:
    """``lang, gram, p`` for all ``wanted`` grams, which have ``order`` symbols; ``level`` has lang, gram and count n.

    The counts of the order below are those of distinct left neighbours. Each order joins counts,
    context sums and the order below on (language, gram), shards of the count tables.
    """
    rates = discounts(level)
    context = F.substring("gram", 1, order - 1)
    n = F.col("n")
    sums = level.groupBy("lang", context.alias("context")).agg(
        F.sum("n").cast("double").alias("total"), F.sum((n == 1).cast("double")).alias("c1"), F.sum((n == 2).cast("double")).alias("c2"),
        F.sum((n >= 3).cast("double")).alias("c3"))
    own = wanted.join(level, ["lang", "gram"], "left").na.fill(0, ["n"])
    if order > 1:
        below_level = level.groupBy("lang", F.substring("gram", 2, order - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        below_wanted = wanted.select("lang", F.substring("gram", 2, order - 1).alias("gram")).distinct()
        below = probabilities(below_wanted, below_level, order - 1).select("lang", F.col("gram").alias("tail"), F.col("p").alias("p_below"))
        joined = own.withColumn("tail", F.substring("gram", 2, order - 1)).join(below, ["lang", "tail"])
    else:
        sizes = level.groupBy("lang").agg((1.0 / (F.count(F.lit(1)) + 1)).alias("p_below"))
        joined = own.join(sizes, "lang")
    joined = joined.withColumn("context", context).join(sums, ["lang", "context"], "left").join(rates, "lang")
    kept = F.greatest(n - discount_of(n), F.lit(0.0)) / F.col("total")
    freed = (F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")) / F.col("total")
    return joined.select("lang", "gram", F.when(F.col("total") > 0, kept + freed * F.col("p_below")).otherwise(F.col("p_below")).alias("p"))


def fold(col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def dealt(docs: DataFrame, sent: DataFrame, blocks: int) -> DataFrame:
    """A partition for each block, by its own number: first the rows sent to it, then its texts."""
    both = sent.withColumn("is_text", F.lit(False)).unionByName(docs.withColumn("is_text", F.lit(True)), allowMissingColumns=True)
    return both.repartitionById(blocks, F.col("block")).sortWithinPartitions("is_text")


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER, block_chars: int = BLOCK_CHARS, digests: bool = False) -> DataFrame:
    """``doc_id, digest, lang, symbols, log_sum`` of all ``docs`` (doc_id, lang, text) by a model of the ``trusted`` ids' texts.

    Texts are dealt into blocks of about ``block_chars`` characters, by a hash of id and text, a
    block to a partition. Counting writes every distinct gram of a block with its count; scoring deals the texts again
    and sends each block those grams with their probabilities before its texts, which stream past them. In
    between are joins of count tables only. A task holds the grams of a block, and a slice of its texts.
    ``digest`` is the text's SHA-256, or null without ``digests``.
    """
    size = docs.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    digest = F.unhex(F.sha2("text", 256)) if digests else F.lit(None).cast("binary")
    rows = docs.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    marks = rows.select("doc_id", "block").join(trusted.select("doc_id").distinct(), "doc_id")
    counted = dealt(rows, marks, blocks).mapInArrow(lambda it: count_block(it, order), "block int, lang string, gram string, n bigint")
    grams = written(counted, "grams")
    all_grams = written(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "counts")
    p = written(probabilities(all_grams.select("lang", "gram"), all_grams.filter("n > 0"), order), "model")
    model = grams.select("block", "lang", "gram").join(p, ["lang", "gram"]).select("block", "lang", "gram", F.log("p").alias("log_p"))
    return dealt(rows.withColumn("digest", digest), model, blocks).mapInArrow(
        lambda it: score_block(it, order), "doc_id bigint, digest binary, lang string, symbols bigint, log_sum double")


def judged(
    docs: DataFrame, labels: DataFrame, high: float = 0.995, low: float | None = None, order: int = ORDER, block_chars: int = BLOCK_CHARS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", digests: bool = False,
) -> DataFrame:
    """``doc_id, digest, lang, symbols, perplexity, least, most, kept`` for every document.

    ``labels`` has doc_id and quality (0 or 1). Texts with quality 1 are trusted; the model of each
    language is trained on four fifths of them, all of these and whole, and the limits ``least`` and ``most``
    are quantiles of the perplexities of the other fifth, by language (no lower limit with ``low`` None). A
    document is kept within them.

    Nulls: a null text is empty (one closing symbol), a null language is a language of its
    own. Documents of a language without trusted text have no perplexity and are kept, as is anything
    in a language without held-out trusted text. Rows without an id are scored and never trusted; rows that
    repeat an id are each scored. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_or_empty(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    good = labels.filter("quality = 1").select("doc_id").distinct()
    scores = written(perplexities(rows, good.filter(fold(F.col("doc_id")) != 0), order, block_chars, digests), "scores")
    scored = scores.withColumn("perplexity", F.exp(-F.col("log_sum") / F.col("symbols")))
    limits = (
        scored.join(good.filter(fold(F.col("doc_id")) == 0), "doc_id").filter("perplexity is not null").groupBy("lang")
        .agg((F.lit(None).cast("double") if low is None else F.percentile("perplexity", F.lit(low))).alias("least"),
             F.percentile("perplexity", F.lit(high)).alias("most"))
    )
    p = F.col("perplexity")
    inside = F.coalesce(p <= F.col("most"), F.lit(True)) & F.coalesce(p >= F.col("least"), F.lit(True))
    return scored.join(limits, "lang", "left").select("doc_id", "digest", "lang", "symbols", "perplexity", "least", "most", inside.alias("kept"))


def quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``judged`` without digests."""
    return judged(docs, labels, **options).drop("digest")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns.

    A row goes by its own id, text and language, so that rows that share an id, or have none, do
    not decide for each other.
    """
    names = ["__bad_id", "__bad_digest", "__bad_lang"]
    bad = judged(docs, labels, id_col=id_col, text_col=text_col, lang_col=lang_col, digests=True, **options).filter("not kept")
    bad = bad.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "digest", "lang"), names))).distinct()
    own = [F.col(id_col).cast("bigint"), F.unhex(F.sha2(text_or_empty(text_col), 256)), text_or_empty(lang_col)]
    same = [o.eqNullSafe(F.col(n)) for o, n in zip(own, names)]
    return docs.join(bad, same[0] & same[1] & same[2], "left_anti")
