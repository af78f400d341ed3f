"""Hard negatives by a secondary sort: each anchor's scores stream in falling order past its positives' windows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.whitening import common_length, integer_entries, matrix
from fleetpulse.session import written

#: Rows and anchors of one cell of the score matrix; a task holds the anchors and one Arrow batch of rows.
CELL_ROWS, CELL_ANCHORS = 1 << 16, 1 << 13
#: Anchors scored at once against a batch.
SLICE = 256
#: Scores beyond this are taken as this, so that a hundred times a score is still a long.
MOST_SCORE = ((1 << 63) - 1) // 100
NONE = -(1 << 62)
#: (anchor, its tag, falling score, 0 for a positive and 1 for a negative, id), all sorted as bytes.
KEY = ">QQQBQ"
SIGN = 1 << 63


def pack(anchor: int, tag: int, score: int, negative: int, vec_id: int) -> bytes:
    return struct.pack(KEY, anchor + SIGN, tag + SIGN, SIGN - score, negative, vec_id + SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    """(anchor, score, negative, id)."""
    anchor, _, score, negative, vec_id = struct.unpack(KEY, key)
    return anchor - SIGN, SIGN - score, negative, vec_id - SIGN


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of a and b, held to +-MOST_SCORE."""
    most = a.shape[1] * max((abs(int(v)) for v in (a.min(initial=0), a.max(initial=0))), default=0) * max(abs(int(v)) for v in (b.min(initial=0), b.max(initial=0)))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most <= MOST_SCORE:
        return a @ b.T
    return np.clip(a.astype(object) @ b.T.astype(object), -MOST_SCORE, MOST_SCORE).astype(np.int64)


def largest(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k largest that fit in each row, of equal ones the first; NONE where there are fewer."""
    held = np.where(fits, scores, NONE)
    top, who = np.full((len(held), k), NONE), np.zeros((len(held), k), np.int64)
    each = np.arange(len(held))
    for r in range(min(k, held.shape[1])):
        at = held.argmax(1)
        top[:, r], who[:, r] = held[each, at], ids[at]
        held[each, at] = NONE
    return top, who


def merged(top: np.ndarray, who: np.ndarray, more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The first k of two such lists; ids of the second are not smaller than those of the first."""
    k = top.shape[1]
    top, who = np.hstack([top, more[0]]), np.hstack([who, more[1]])
    order = np.argsort(-top, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(top, order, 1), np.take_along_axis(who, order, 1)


class Anchors:
    """The anchors of one cell, and the best they have met in it so far."""

    def __init__(self, parts: list[pa.RecordBatch], d: int, positives: int, negatives: int, low: int, high: int) -> None:
        t = pa.Table.from_batches(parts)
        self.ids, self.labels, self.tags = (t.column(c).to_numpy() for c in ("vec_id", "label", "tag"))
        self.x = matrix(t.column("x").combine_chunks(), d)
        self.windows = None
        k = positives
        if t.column("scores").null_count < len(t):
            scores = np.array([[*s, *[NONE] * (positives - len(s))] for s in t.column("scores").to_pylist()])
            # windows of positives with a score below 0, and of none, are empty
            self.windows = np.where(scores >= 0, -(-low * scores // 100), 1), np.where(scores >= 0, high * scores // 100, 0)
            k = negatives
        sets = positives if self.windows else 1
        self.best = [(np.full((len(self.ids), k), NONE), np.zeros((len(self.ids), k), np.int64)) for _ in range(sets)]

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """Score rows, whose ids rise, and keep what is best for each list."""
        if self.windows is None:
            for label in np.intersect1d(self.labels, labels):
                mine, theirs = np.flatnonzero(self.labels == label), np.flatnonzero(labels == label)
                for i in range(0, len(mine), SLICE):
                    self.score(mine[i : i + SLICE], ids[theirs], None, x[theirs])
        else:
            for i in range(0, len(self.ids), SLICE):
                self.score(np.arange(i, min(i + SLICE, len(self.ids))), ids, labels, x)

    def score(self, which: np.ndarray, ids: np.ndarray, labels: np.ndarray | None, x: np.ndarray) -> None:
        scores = inner_products(self.x[which], x)
        other = np.ones(scores.shape, bool) if labels is None else self.labels[which, None] != labels
        own = np.searchsorted(ids, self.ids[which]), np.searchsorted(ids, self.ids[which], side="right")
        for row in np.flatnonzero(own[0] < own[1]):
            other[row, own[0][row] : own[1][row]] = False
        for j, (top, who) in enumerate(self.best):
            fits = other
            if self.windows is not None:
                fits = other & (scores >= self.windows[0][which, j, None]) & (scores <= self.windows[1][which, j, None])
            if fits.any():
                top[which], who[which] = merged(top[which], who[which], largest(scores, fits, ids, top.shape[1]))

    def rows(self) -> pa.RecordBatch:
        """(anchor, tag, score, id) of all that is kept, once each."""
        n = len(self.ids)
        at = np.concatenate([np.repeat(np.arange(n), t.shape[1]) for t, _ in self.best])
        score, who = (np.concatenate([b[i].ravel() for b in self.best]) for i in (0, 1))
        kept = np.unique(np.stack([at, score, who], 1)[score > NONE], axis=0) if (score > NONE).any() else np.zeros((0, 3), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.ids[kept[:, 0]], pa.int64()), pa.array(self.tags[kept[:, 0]], pa.int64()), pa.array(kept[:, 1], pa.int64()), pa.array(kept[:, 2], pa.int64())],
            ["anchor_id", "tag", "score", "id"])


def score_cells(rows: DataFrame, anchors: DataFrame, grid: tuple[int, int], d: int, *limits: int) -> DataFrame:
    """(anchor_id, tag, score, id): of each cell of the score matrix, what may be among an anchor's first.

    Rows go to the cells of their row block, anchors to those of their anchor block; no pair is a
    row before it is chosen. A cell is one partition: its anchors come first, its rows stream
    past them by id.
    """
    across, down = grid
    place = F.xxhash64("vec_id", "tag")
    rows = rows.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("b"), F.pmod(place, F.lit(across)).cast("int").alias("a"), "vec_id", "label", "tag", "x")
    anchors = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("a"), F.pmod(place, F.lit(down)).cast("int").alias("b"), "vec_id", "label", "tag", "x", "scores")
    both = anchors.withColumn("row", F.lit(0)).unionByName(rows.withColumn("row", F.lit(1)), allowMissingColumns=True)
    both = both.select((F.col("b") * across + F.col("a")).alias("cell"), "row", "vec_id", "label", "tag", "x", "scores")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, held = None, [], None
        for batch in batches:
            cells, kinds = batch.column("cell").to_numpy(), batch.column("row").to_numpy()
            cuts = [0, *(np.flatnonzero((cells[1:] != cells[:-1]) | (kinds[1:] != kinds[:-1])) + 1), batch.num_rows]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                part = batch.slice(s, e - s)
                if cells[s] != cell:
                    if held:
                        yield held.rows()
                    cell, parts, held = cells[s], [], None
                if not kinds[s]:
                    parts.append(part)
                elif parts or held:
                    held = held or Anchors(parts, d, *limits)
                    parts = []
                    held.meet(part.column("vec_id").to_numpy(), part.column("label").to_numpy(), matrix(part.column("x"), d))
        if held:
            yield held.rows()

    dealt = both.repartitionById(across * down, F.col("cell")).sortWithinPartitions("cell", "row", "vec_id")
    return dealt.mapInArrow(meet, "anchor_id bigint, tag bigint, score bigint, id bigint")


def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("anchor_id", "tag", "score", "negative", "id")]
        yield pa.RecordBatch.from_arrays([pa.array([pack(*r) for r in zip(*cols)], pa.binary())], ["key"])


def windows(keys: Iterator[tuple[bytes, None]], negatives: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Rows of the sorted keys of whole anchors: a positive opens a window, a negative goes to each open window that it lies in."""
    anchor, opened = None, []
    for key, _ in keys:
        if key[:16] != anchor:
            anchor, opened = key[:16], []
        anchor_id, score, negative, vec_id = unpack(key)
        if not negative:
            opened.append([vec_id, score, 0])
            continue
        opened = [w for w in opened if w[2] < negatives and low * w[1] <= 100 * score]
        for w in opened:
            if 100 * score <= high * w[1]:
                w[2] += 1
                yield anchor_id, w[0], w[2], vec_id, w[1], score


def hard_negatives(
    table: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """For each anchor and each of its first positives, the first rows of other labels in the positive's window.

    Returns ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``. Scores are integer
    inner products of floor(256 c). Positives are an anchor's ``positives`` first rows of its label; a
    negative's score lies between ``low`` and ``high`` hundredths of the positive's. Higher
    scores come first, of equal ones the smaller id. ``is_anchor`` is a condition on ``vec_id``.

    All anchors meet all rows in cells of bounded size; a cell sends on what is among its first, as a combiner does, so that
    nothing is lost. Positives come from a first pass; in a second one cells look for negatives in their windows
    only. Both meet in one secondary sort: keys (anchor, falling score, id) go through
    repartitionAndSortWithinPartitions, and an iterator opens and closes windows. It holds no more of an anchor than its open windows.

    Rows take no part with a null id, label or vector, with null or non-finite entries, or with another length
    than the commonest (of two as common, the larger). Rows that repeat id, label and integer vector count once; other rows of one id
    all take part, but never for each other. Labels are integers. Scores beyond +-2**63 / 100 are taken as that. A positive below 0 has
    an empty window. Tables without anchors or rows give no rows. Other columns are ignored, whatever their names.
    """
    spark = table.sparkSession
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("bigint").alias("label"), integer_entries(F.col(vec_col)).alias("x"))
    rows = rows.filter("vec_id is not null and label is not null and x is not null")
    d = common_length(rows)
    if not d:
        return spark.createDataFrame([], schema)
    rows = written(rows.filter(F.size("x") == d).distinct().withColumn("tag", F.xxhash64("label", "x")), "labelled-vectors")
    anchors = rows.filter(is_anchor)
    n_rows, n_anchors = rows.count(), anchors.count()
    if not n_anchors:
        return spark.createDataFrame([], schema)
    down = -(-n_anchors // CELL_ANCHORS)
    across = max(-(-n_rows // CELL_ROWS), -(-2 * spark.sparkContext.defaultParallelism // down))
    limits = (positives, negatives, low, high)

    met = score_cells(rows, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), (across, down), d, *limits)
    best = first_positives(met, positives)
    of_anchor = best.groupBy("anchor_id", "tag").agg(F.collect_list("score").alias("scores"))
    ready = anchors.join(of_anchor.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "tag"])
    found = score_cells(rows, ready, (across, down), d, *limits)

    pairs = best.withColumn("negative", F.lit(0)).unionByName(found.withColumn("negative", F.lit(1)))
    keys = pairs.mapInArrow(keys_of, "key binary").rdd.map(lambda r: (bytes(r[0]), None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:16]))
    return spark.createDataFrame(dealt.mapPartitions(lambda it: windows(it, negatives, low, high)), schema, verifySchema=False)


def first_positives(met: DataFrame, positives: int) -> DataFrame:
    """Each anchor's first rows of those that its cells sent, written, as both what follows and the second pass need it."""
    from pyspark.sql import Window

    order = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "id")
    return written(met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= positives).drop("place"), "positives")


def moved_labels(embeddings: DataFrame) -> DataFrame:
    """The query's rows: where vec_id is divisible by 7, the label is the next of ten."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: The same for DuckDB, pair by pair.
NEGATIVES_SQL = """
WITH r AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (
  SELECT anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank,
    s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
