"""Approximate nearest neighbours: a graph built by NN-descent in Spark joins, searched greedily."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetpulse.session import written

EDGES = "u bigint, v bigint, s float"


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` (doubles) of the rows that take part: finite, not zero, of the commonest length."""
    rows = table.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).filter("vec_id is not null")
    real = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.filter(F.coalesce(real, F.lit(False)))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (lengths["n"] if lengths else 0)).groupBy("vec_id").agg(F.min("vector").alias("vector"))


def small_units(vectors: np.ndarray) -> np.ndarray:
    """Directions in signed bytes, each row scaled to use their range."""
    return np.rint(vectors * (127 / np.abs(vectors).max(axis=1, keepdims=True))).astype(np.int8)


def units(small: list[bytes]) -> np.ndarray:
    q = np.frombuffer(b"".join(small), np.int8).reshape(len(small), -1).astype(np.float32)
    return q / np.sqrt((q * q).sum(axis=1, keepdims=True))


def quantised(reps: DataFrame, plane_sets: int, seed: int) -> DataFrame:
    """``id, q, codes``: the direction in bytes and, for each set of random planes, the sides it lies on (as one number)."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).values.to_numpy(zero_copy_only=False)[batch.column(1).offsets[0].as_py() : batch.column(1).offsets[-1].as_py()]
            x = x.reshape(batch.num_rows, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            planes = np.random.default_rng(seed).standard_normal((x.shape[1], plane_sets * 48))
            sides = (x @ planes > 0).reshape(len(x), plane_sets, 48)
            codes = (sides * (1 << np.arange(47, -1, -1, dtype=np.int64))).sum(axis=2)
            yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in small_units(x)], pa.binary()),
                                   pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["id", "q", "codes"])

    return reps.select("vec_id", "vector").mapInArrow(coded, "id bigint, q binary, codes array<bigint>")


def first_edges(points: DataFrame, plane_sets: int, k: int, leaf: int) -> DataFrame:
    """``u, v, s``: near neighbours inside runs of ``leaf`` points in the order of each code; ``block`` of u is its first run."""

    def near(tree: int):
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: list[int] = []
            small: list[bytes] = []

            def edges() -> pa.RecordBatch:
                x, own = units(small), np.array(ids, np.int64)
                sims = x @ x.T
                np.fill_diagonal(sims, -2)
                m = min(k, len(own) - 1)
                top = np.argpartition(-sims, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(own), 0), np.int64)
                u = np.repeat(own, m)
                return pa.record_batch([pa.array(u), pa.array(own[top].ravel()), pa.array(np.take_along_axis(sims, top, 1).ravel().astype(np.float32)),
                                        pa.array(np.full(len(u), own[0] if tree == 0 else -1))], names=["u", "v", "s", "block"])

            for batch in batches:
                for i, q in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    ids.append(i)
                    small.append(q)
                    if len(ids) == leaf:
                        yield edges()
                        ids.clear()
                        small.clear()
            if ids:
                yield edges()

        return found

    out = None
    for tree in range(plane_sets):
        coded = points.select("id", "q", F.col("codes")[tree].alias("code"))
        part = coded.repartitionByRange("code", "id").sortWithinPartitions("code", "id").select("id", "q").mapInArrow(near(tree), EDGES + ", block bigint")
        out = part if out is None else out.union(part)
    return out


def best_edges(edges: DataFrame, k: int, *more: str) -> DataFrame:
    """The k nearest of each node; ``edges`` has u, v, s and the columns ``more``."""
    one = edges.groupBy("u", "v").agg(F.max("s").alias("s"), *(F.min(c).alias(c) for c in more))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def both_ways(graph: DataFrame, k: int) -> DataFrame:
    """``c, x, new``: each node with its neighbours and with the k nearest of those whose neighbour it is."""
    back = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "old")
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))
    back = back.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")
    return graph.select("u", "v", "old").union(back.select("u", "v", "old")).groupBy(F.col("u").alias("c"), F.col("v").alias("x")).agg(F.min("old").alias("old"))


def descend(graph: DataFrame, points: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """One step: neighbours of a node are proposed to each other; ``graph`` with what is nearer.

    Nodes are dealt in blocks of near ones, so a vector is sent once to each block that meets it
    and not to each node. Pairs of which both edges were there a step ago are not tried again.
    Each block proposes at most the k best to a node, and only what beats the node's k-th.
    """
    met = both_ways(graph, k).join(blocks.select(F.col("id").alias("c"), "block"), "c")
    limit = graph.groupBy("u").agg(F.min("s").alias("limit"), F.count(F.lit(1)).alias("held"))
    limit = limit.select(F.col("u").alias("x"), F.when(F.col("held") >= k, F.col("limit")).otherwise(F.lit(-2.0)).cast("float").alias("limit"))
    bodies = met.select(F.col("block").alias("block"), F.col("x").alias("x")).distinct().join(points.select(F.col("id").alias("x"), "q"), "x").join(limit, "x")

    def proposed(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = right.column("x").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], units([right.column("q")[int(i)].as_py() for i in order]) if len(order) else None
        lim = right.column("limit").to_numpy()[order]
        c, at = left.column("c").to_numpy(), np.searchsorted(ids, left.column("x").to_numpy())
        old = left.column("old").to_numpy(zero_copy_only=False).astype(bool)
        by = np.argsort(c, kind="stable")
        c, at, old = c[by], at[by], old[by]
        cuts = [0, *np.flatnonzero(c[1:] != c[:-1]) + 1, len(c)]
        a, b, s = [], [], []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            m, was = at[lo:hi], old[lo:hi]
            if was.all():
                continue
            sims = x[m] @ x[m].T
            good = (sims > lim[m][:, None]) & ~(was[:, None] & was[None, :])
            np.fill_diagonal(good, False)
            i, j = np.nonzero(good)
            a.append(m[i])
            b.append(m[j])
            s.append(sims[i, j])
        if not a:
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64()), "s": pa.array([], pa.float32())})
        a, b, s = np.concatenate(a), np.concatenate(b), np.concatenate(s)
        keys, first = np.unique(a.astype(np.int64) * len(ids) + b, return_index=True)
        a, b, s = a[first], b[first], s[first]
        by = np.lexsort((-s, a))
        a, b, s = a[by], b[by], s[by]
        starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        rank = np.arange(len(a)) - np.repeat(starts, np.diff(np.append(starts, len(a))))
        keep = rank < k
        return pa.table({"u": pa.array(ids[a[keep]]), "v": pa.array(ids[b[keep]]), "s": pa.array(s[keep].astype(np.float32))})

    fresh = met.groupBy("block").cogroup(bodies.groupBy("block")).applyInArrow(proposed, EDGES)
    now = graph.select("u", "v", "s", F.lit(True).alias("old")).union(fresh.select("u", "v", "s", F.lit(False).alias("old")))
    one = now.groupBy("u", "v").agg(F.max("s").alias("s"), F.max("old").alias("old"))
    rank = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def similar(rows: DataFrame) -> DataFrame:
    """``q, w, s, opened`` of rows with ``q, w`` and both directions."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                s = (units(batch.column(2).to_pylist()) * units(batch.column(3).to_pylist())).sum(axis=1).astype(np.float32)
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(s), pa.array(np.zeros(len(s), bool))], names=["q", "w", "s", "opened"])

    return rows.mapInArrow(scored, "q bigint, w bigint, s float, opened boolean")


def greedy_search(graph: DataFrame, points: DataFrame, queries: DataFrame, k: int, beam: int, width: int) -> DataFrame:
    """``q, w``: what each query (a node) finds: from its own neighbours on, always opening the ``width`` nearest unopened nodes.

    A round joins opened nodes with the graph and new candidates with their directions; it is written. The
    search ends when no query has an unopened node among its ``beam`` best. It does end: a beam only gets
    nearer, so a node that has left it doesn't come back, and each round opens one more in every beam not done.
    """
    ways = written(both_ways(graph.withColumn("old", F.lit(True)), k).select("c", "x"), "ways")
    asked = written(queries.join(points.select(F.col("id").alias("q"), F.col("q").alias("q_small")), "q"), "asked")
    bodies = points.select(F.col("id").alias("w"), F.col("q").alias("w_small"))
    state = asked.select("q", F.col("q").alias("w"), F.lit(2.0).cast("float").alias("s"), F.lit(False).alias("opened"))
    by_query = W.partitionBy("q").orderBy(F.desc("s"), "w")
    while True:
        ranked = state.withColumn("turn", F.sum((~F.col("opened")).cast("int")).over(by_query))
        opening = ranked.filter(~F.col("opened") & (F.col("turn") <= width)).select("q", "w")
        marked = ranked.withColumn("opened", F.col("opened") | (F.col("turn") <= width)).drop("turn")
        seen = opening.join(ways.withColumnRenamed("c", "w"), "w").select("q", F.col("x").alias("w")).distinct().join(state.select("q", "w"), ["q", "w"], "left_anti")
        found = similar(seen.join(asked, "q").join(bodies, "w").select("q", "w", "q_small", "w_small"))
        both = marked.union(found).withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= beam).drop("rank")
        state = written(both, "search")
        if state.filter("not opened").isEmpty():
            return state.select("q", "w")


def evened(v: Column) -> Column:
    """The vector times the power of two that brings its largest component near 1: its direction, exactly, without overflow."""
    largest = F.array_max(F.transform(v, F.abs))
    factor = F.pow(F.lit(2.0), F.greatest(F.lit(-1000), F.least(F.lit(1000), -F.floor(F.log2(largest)))))
    return F.zip_with(v, F.array_repeat(factor, F.size(v)), lambda x, f: x * f)


def cosine(a: Column, b: Column) -> Column:
    a, b = evened(a), evened(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, r: p * r), F.lit(0.0), lambda t, p: t + p)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_neighbours(
    table: DataFrame, is_query: Column, top: int = 5, k: int = 40, plane_sets: int = 6, leaf: int = 1024, fresh: float = 0.01, beam: int = 192,
    width: int = 64, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` nearest found for each row for which ``is_query`` (over vec_id) holds.

    1. Equal vectors are one point; its copies come back at the end (the smallest ids that can count).
    2. The graph starts from runs of points in the order of random-plane codes, which have a fixed number, so
       crowded regions are cut as finely as others; then NN-descent until a step leaves less than the share
       ``fresh`` of the edges new.
    3. Queries search the graph greedily until nothing nearer is left to open; the graph is built and searched on directions in bytes.
    4. What was found is scored by the exact cosine of the original vectors in double precision.

    All rows are indexed; the graph keeps k neighbours a node, which makes the search approximate.
    Nothing is collected: nodes, proposals and search states stay tables that are shuffled by node, block or query.

    Nulls: rows without an id, and vectors that are null, zero, or hold null or non-finite numbers,
    take no part; nor do vectors of another length than the commonest. Of rows that repeat an id the smallest vector
    counts. Other columns are ignored. With fewer candidates than ``top`` all are returned.
    """
    vectors = written(valid_vectors(table, id_col, vector_col), "vectors")
    classes = written(vectors.join(vectors.groupBy("vector").agg(F.min("vec_id").alias("rep")), "vector").select("vec_id", "rep"), "copies")
    reps = vectors.join(classes.filter("vec_id = rep").select("vec_id"), "vec_id", "left_semi")
    points = written(quantised(reps, plane_sets, seed), "points")
    start = written(best_edges(first_edges(points, plane_sets, k, leaf), k, "block").withColumn("old", F.lit(False)), "graph")
    blocks = points.select("id").join(start.groupBy(F.col("u").alias("id")).agg(F.max("block").alias("block")), "id", "left")
    blocks = written(blocks.withColumn("block", F.coalesce(F.when(F.col("block") >= 0, F.col("block")), F.pmod(F.xxhash64("id"), F.lit(997)))), "blocks")
    graph = start.drop("block")
    while True:
        graph = written(descend(graph, points, blocks, k), "graph")
        edges, new = graph.agg(F.count(F.lit(1)), F.count_if(~F.col("old"))).first()
        if new <= fresh * edges:
            break
    asking = classes.filter(is_query)
    found = greedy_search(graph, points, asking.select(F.col("rep").alias("q")).distinct(), k, beam, width)
    part = F.row_number().over(W.partitionBy("rep", "salt").orderBy("vec_id"))
    copies = classes.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("n", part).filter(F.col("n") <= top + 1)
    copies = copies.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy("vec_id"))).filter(F.col("n") <= top + 1)
    pairs = (
        asking.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("q")).join(found, "q")
        .join(copies.select(F.col("rep").alias("w"), "vec_id"), "w").filter("query_id <> vec_id").select("query_id", "vec_id")
    )
    scored = (
        pairs.join(vectors.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("a")), "query_id").join(vectors, "vec_id")
        .select("query_id", "vec_id", cosine(F.col("a"), F.col("vector")).alias("score"))
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
