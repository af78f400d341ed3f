"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import doc_slices, string_bytes, worker_cache
from fleetpulse.llm.shingles import word_hashes
from fleetpulse.session import written

BLOCK = 64


def held_out(col: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def term_counts(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, end, text, term, count) for slices of texts, in order, texts counted from the first; terms are hashes, or places in the vocabulary."""
    for i, j in doc_slices(offsets):
        words, owner = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], letters_only=True)
        if vocabulary is not None:
            at = np.searchsorted(vocabulary, words)
            at[at == len(vocabulary)] = 0
            known = vocabulary[at] == words if len(vocabulary) else np.zeros(len(words), bool)
            words, owner = at[known], owner[known]
        order = np.lexsort((words, owner))
        words, owner = words[order], owner[order]
        new = np.flatnonzero(np.append(True, (words[1:] != words[:-1]) | (owner[1:] != owner[:-1]))) if len(words) else np.zeros(0, np.int64)
        yield i, j, owner[new], words[new], np.diff(np.append(new, len(words)))


class Index:
    """Weighted terms of the examples in blocks of BLOCK, with each block's largest weight per term."""

    def __init__(self, vocabulary: np.ndarray, idf: np.ndarray, example: np.ndarray, term: np.ndarray, count: np.ndarray, toxic: np.ndarray) -> None:
        weight = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(example, weight**2, len(toxic)))
        weight = weight / np.where(norm > 0, norm, 1)[example]
        strongest = np.zeros(len(toxic), np.int64)
        by = np.lexsort((weight, example))
        last = np.flatnonzero(np.append(example[by][1:] != example[by][:-1], True)) if len(by) else np.zeros(0, np.int64)
        strongest[example[by][last]] = term[by][last]
        place = np.empty(len(toxic), np.int64)
        self.order = np.argsort(strongest, kind="stable")  # neighbours by content share blocks
        place[self.order] = np.arange(len(toxic))
        self.vocabulary, self.idf, self.toxic = vocabulary, idf, np.append(toxic[self.order], 0)
        self.blocks = max(1, -(-len(toxic) // BLOCK))
        at = place[example]
        self.rows, self.parts, most = [], [], np.zeros((len(vocabulary), self.blocks), np.float32)
        for b in range(self.blocks):
            mine = at // BLOCK == b
            terms = np.unique(term[mine])
            row = np.full(len(vocabulary), -1, np.int32)
            row[terms] = np.arange(len(terms))
            part = np.zeros((len(terms), BLOCK), np.float32)
            part[row[term[mine]], at[mine] % BLOCK] = weight[mine]
            most[terms, b] = part.max(axis=1) if len(terms) else 0
            self.rows.append(row)
            self.parts.append(part)
        self.most = most

    def block_scores(self, b: int, docs: np.ndarray, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Cosines of the chosen texts with a block's examples."""
        chosen = np.full(n, -1)
        chosen[docs] = np.arange(len(docs))
        row = self.rows[b][term]
        use = (row >= 0) & (chosen[owner] >= 0)
        out = np.zeros((len(docs), BLOCK), np.float32)
        if use.any():
            who = chosen[owner[use]]
            starts = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
            out[who[starts]] = np.add.reduceat(self.parts[b][row[use]] * weight[use][:, None], starts)
        return out

    def nearest(self, n: int, owner: np.ndarray, term: np.ndarray, count: np.ndarray, k: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of example, cosine) of the k nearest examples of n texts, exact, nearest first; -1 where there are none.

        Blocks whose bound (the sum of the largest weights of the text's terms) is not above
        the k-th cosine found so far can't hold a nearer one and are passed over. ``own`` are the texts'
        own places, which don't count.
        """
        weight = ((1 + np.log(count)) * self.idf[term]).astype(np.float32)
        norm = np.sqrt(np.bincount(owner, weight.astype(np.float64) ** 2, n))
        weight = weight / np.where(norm > 0, norm, 1)[owner].astype(np.float32)
        bound = np.zeros((n, self.blocks), np.float32)
        if len(owner):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            bound[owner[starts]] = np.add.reduceat(self.most[term] * weight[:, None], starts)
        best, place = np.zeros((n, k), np.float32), np.full((n, k), -1)
        todo = np.argsort(-bound, axis=1, kind="stable")
        done = np.zeros((n, self.blocks), bool)
        for turn in (4, self.blocks):
            open_ = np.zeros((n, self.blocks), bool)
            np.put_along_axis(open_, todo[:, :turn], True, axis=1)
            open_ &= ~done & (bound > best[:, -1:])
            for b in np.flatnonzero(open_.any(axis=0)):
                docs = np.flatnonzero(open_[:, b] & (bound[:, b] * np.float32(1.00001) > best[:, -1]))
                if not len(docs):
                    continue
                got = self.block_scores(b, docs, owner, term, weight, n)
                here = np.broadcast_to(np.arange(b * BLOCK, b * BLOCK + BLOCK), got.shape)
                if own is not None:
                    got = np.where(here == own[docs][:, None], 0, got)
                both, where = np.hstack([best[docs], got]), np.hstack([place[docs], np.where(got > 0, here, -1)])
                top = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best[docs], place[docs] = np.take_along_axis(both, top, 1), np.take_along_axis(where, top, 1)
            done |= open_
        return place, best

    def votes(self, place: np.ndarray, cosine: np.ndarray, power: float, prior: float) -> np.ndarray:
        """Share of toxic neighbours, weighted by a power of their cosine, drawn to the prior where they are far."""
        w = np.where(place >= 0, cosine.astype(np.float64), 0) ** power
        return ((w * self.toxic[np.maximum(place, 0)]).sum(1) + 0.05 * prior) / (w.sum(1) + 0.05)


def logistic_fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """(a, b) of the logistic curve through weighted points, by Newton steps with a small ridge."""
    beta, features = np.zeros(2), np.stack([np.ones_like(x), x], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        grad = features.T @ (weight * (y - p)) - 1e-3 * beta
        hess = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-3 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(hess, grad), -5, 5)
    return float(beta[0]), float(beta[1])


def toxicity(
    docs: DataFrame, labels: DataFrame, most_toxic: int = 1024, most_clean: int = 3072, most_terms: int = 8_000,
    least_chi: float = 6.6, k: int = 15, power: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, held_out, score, predicted, neighbours, cosines`` for every document.

    Examples are labelled rows outside the held-out fifth, at most ``most_toxic`` and ``most_clean`` of
    them: those whose ids have the smallest hashes; of equal texts one. Terms are at most ``most_terms`` words, those
    whose presence speaks most for the label (chi-squared of ``least_chi`` or more over the examples), weighted
    by inverse document frequencies counted over all documents. That bounds the index, which is why it may be sent to every task. Each whole text then finds its k nearest
    examples exactly; their votes, weighted by distance, are calibrated by a logistic curve fitted
    to the examples' votes on each other, weighted back to the labels' true shares. ``neighbours`` are
    the ids of the nearest three: the evidence.

    Nulls: a null or empty text has no terms and gets the score of no evidence; so does any text if no row is
    labelled. A null id is in the held-out fifth or not by the checksum of the empty text. Labels that repeat an
    id count once, toxic if any is. Repeated rows are each scored. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    train = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    train = train.filter(~held_out(F.col("doc_id")))
    shares = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    pick = lambda toxic, most: train.filter(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = pick(1, most_toxic).union(pick(0, most_clean))
    texts = rows.join(F.broadcast(picked), "doc_id").groupBy(F.coalesce("text", F.lit("")).alias("text"))
    examples = written(texts.agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "examples")
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(0))
            toxic = batch.column(1).to_numpy()
            for i, _, owner, term, _ in term_counts(data, offsets, None):
                yield pa.record_batch([pa.array(term.view(np.int64)), pa.array(toxic[i + owner])], names=["term", "toxic"])

    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    seen = examples.select("text", "toxic").mapInArrow(hashed, "term bigint, toxic int").groupBy("term").agg(
        F.sum("toxic").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("n"))
    off = F.col("t") * n0 - (F.col("n") - F.col("t")) * n1
    spread = F.col("n") * (n0 + n1 - F.col("n")) * (n0 * n1)
    telling = seen.withColumn("chi", F.when(spread > 0, off * off * (n0 + n1) / spread).otherwise(0.0)).filter((F.col("chi") >= least_chi) & (off > 0))
    chosen = telling.orderBy(F.desc("chi"), "term").limit(most_terms).toPandas()["term"].to_numpy(np.int64)
    vocabulary = np.sort(chosen.view(np.uint64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(vocabulary) + 1, np.int64), 0
        for batch in batches:
            data, offsets = string_bytes(batch.column(0))
            n += batch.num_rows
            for _, _, _, term, _ in term_counts(data, offsets, vocabulary):
                df += np.bincount(term, minlength=len(df))
        df[-1] = n
        yield pa.record_batch([pa.array(np.flatnonzero(df)), pa.array(df[df > 0])], names=["term", "n"])

    frequency = rows.select("text").mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(vocabulary) + 1)
    df[frequency["term"].to_numpy(np.int64)] = frequency["n"].to_numpy(np.float64)
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 1e-6

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, _, owner, term, count in term_counts(data, offsets, vocabulary):
                yield pa.record_batch([pa.array(ids[i + owner]), pa.array(term.astype(np.int64)), pa.array(count)], names=["doc_id", "term", "count"])

    postings = examples.select("doc_id", "text").mapInArrow(described, "doc_id bigint, term bigint, count bigint").toPandas()
    known = examples.select("doc_id", "toxic").toPandas().sort_values("doc_id")
    ids, toxic = known["doc_id"].to_numpy(np.int64), known["toxic"].to_numpy(np.int64)
    raw = (vocabulary, idf, np.searchsorted(ids, postings["doc_id"].to_numpy(np.int64)), postings["term"].to_numpy(np.int64), postings["count"].to_numpy(np.int64), toxic)
    total = max(sum(shares.values()), 1)
    prior = shares.get(1, 0) / total
    index = Index(*raw)
    a, b = -6.0, 0.0
    if len(ids) and 0 < toxic.sum() < len(toxic):
        order = np.lexsort((raw[3], raw[2]))
        place = np.empty(len(ids), np.int64)
        place[index.order] = np.arange(len(ids))
        near, cosine = index.nearest(len(ids), raw[2][order], raw[3][order], raw[4][order], k, own=place)
        vote = index.votes(near, cosine, power, prior)
        drawn = np.array([shares.get(0, 0) / max((toxic == 0).sum(), 1), shares.get(1, 0) / max(toxic.sum(), 1)])
        a, b = logistic_fit(vote, toxic.astype(np.float64), drawn[toxic] * len(toxic) / total)
    sent, name = spark.sparkContext.broadcast((*raw, ids)), uuid.uuid4().hex

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_cache()
        if kept.get("index_name") != name:
            kept["index"], kept["index_name"] = Index(*sent.value[:-1]), name
        index: Index = kept["index"]
        example_ids = sent.value[-1]
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            out_score, out_ids, out_cos = [], [], []
            for i, j, owner, term, count in term_counts(data, offsets, index.vocabulary):
                near, cosine = index.nearest(j - i, owner, term, count, k)
                vote = index.votes(near, cosine, power, prior)
                out_score.append(1 / (1 + np.exp(-np.clip(a + b * vote, -30, 30))))
                for p, c in zip(near[:, :3], cosine[:, :3]):
                    out_ids.append([int(example_ids[index.order[x]]) for x in p if x >= 0])
                    out_cos.append([float(y) for x, y in zip(p, c) if x >= 0])
            score = np.concatenate(out_score) if out_score else np.zeros(0)
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_cos, pa.list_(pa.float64()))],
                                  names=["doc_id", "score", "neighbours", "cosines"])

    scores = rows.mapInArrow(scored, "doc_id bigint, score double, neighbours array<bigint>, cosines array<double>")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbours", "cosines")
