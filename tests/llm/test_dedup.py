"""Exact dedup, Jaccard join and suffix dedup against brute force on small texts."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.components import connected_components
from fleetpulse.llm.exact_dedup import exact_dedup, keep_first_copies
from fleetpulse.llm.jaccard_join import jaccard_components, keep_one_of_each
from fleetpulse.llm.suffix_dedup import suffix_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.LongType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], DOCS).repartition(3)


def texts(seed, n):
    r = random.Random(seed)
    words = [f"w{k}é"[: r.randint(2, 5)] + str(k) for k in range(400)]
    out = []
    for i in range(n):
        if i % 3 or not out:
            t = " ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 30, 200])))
        else:
            w = r.choice(out).split()
            for _ in range(r.choice([0, 1, 1, 2, 8])):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        if i % 7 == 0:
            t = " ".join(words[:60]) + "\n" + t
        out.append(t)
    return list(enumerate(out))


@pytest.mark.parametrize("hash_bytes", [16, 1])
def test_exact_dedup_compares_bytes(spark, hash_bytes):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a b "), (7, None), (2, ""), (2, ""), (11, "x" * 100_000), (12, "x" * 100_000), (None, "a b"), (None, "only")]
    rows += [(100 + i, f"t{i % 40}") for i in range(200)]
    got = {(r.doc_id, r.text_sha256): (r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, rows), hash_bytes=hash_bytes).collect()}
    norm = {(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows}
    want = {}
    for i, t in norm:
        same = [j for j, u in norm if u == t]
        keep = min((j for j in same if j is not None), default=None)
        want[i, hashlib.sha256(t.encode()).hexdigest()] = (keep, len(same), i == keep)
    assert got == want


def test_exact_dedup_keeps_rows_and_columns(spark):
    docs = frame(spark, [(1, "a"), (2, "a"), (1, "a"), (None, "b"), (None, "b"), (3, None)])
    assert sorted((r.doc_id or 0, r.text) for r in keep_first_copies(docs).collect()) == [(0, "b"), (1, "a"), (3, None)]
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_keeps_every_different_text(spark):
    rows = [(None, f"no id {i % 20}") for i in range(40)] + [(1, "a"), (1, "b"), (1, "b "), (2, "b"), (2, "c"), (2, "c"), (None, "a"), (None, None), (0, "c")]
    got = sorted((r.doc_id, r.text) for r in keep_first_copies(frame(spark, rows)).filter("doc_id is not null").collect())
    assert got == [(0, "c"), (1, "a"), (1, "b"), (1, "b ")]
    lone = sorted(r.text or "" for r in keep_first_copies(frame(spark, rows)).filter("doc_id is null").collect())
    assert lone == sorted(["", *(f"no id {i}" for i in range(20))])


def shingle_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def brute_components(rows, percent=75):
    sets = {i: shingle_set(t) for i, t in rows}
    best = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * len(sets[a] | sets[b]) and best[a] != best[b]:
                    best[a] = best[b] = min(best[a], best[b])
                    changed = True
    return {(i, len(sets[i]), best[i]) for i in sets}


@pytest.mark.parametrize("common,tile", [(128, 512), (3, 2)])
def test_jaccard_components_equal_brute_force(spark, common, tile):
    rows = texts(3, 90) + [(200, None), (201, "  \n"), (202, "One two"), (203, "one TWO"), (204, "one two three")]
    got = jaccard_components(frame(spark, rows), common=common, tile=tile)
    assert {tuple(r) for r in got.collect()} == brute_components(rows)


def test_jaccard_odd_rows(spark):
    long = " ".join(f"q{i}" for i in range(20_000))
    docs = frame(spark, [(4, long), (2, long + " end"), (4, long), (None, long), (8, "short")])
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(docs).collect())
    assert got == [("2", 19997, 2), ("4", 19996, 2), ("8", 1, 8), ("None", 19996, None)]
    # The row without an id is a near copy of 2 and 4 like any other, and has the smallest number of them.
    assert sorted(str(r.doc_id) for r in keep_one_of_each(docs).collect()) == ["8", "None"]
    assert jaccard_components(frame(spark, [])).count() == 0


def test_words_of_regular_patterns_do_not_clash(spark):
    """Words that hash alike as any polynomial modulo a power of two."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    other = word.translate(str.maketrans("ab", "ba"))
    docs = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_components_of_a_chain(spark):
    links = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(100, 77)], "a bigint, b bigint"))
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 77, 77: 77}


def brute_removal(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_dedup_equals_brute_force(spark):
    r = random.Random(5)
    passage = "".join(r.choice("abcdé ") for _ in range(260))
    rows = [(i, "".join(r.choice("abcdefgh ") for _ in range(r.choice([0, 50, 99, 100, 400])))) for i in range(40)]
    rows += [(50 + i, rows[i % 7][1][:i] + passage[i : i + 150 + i] + rows[i % 11][1]) for i in range(40)]
    rows += [(100, "a" * 3000), (101, "ab" * 700), (102, None), (103, passage), (104, passage), (99, "a" * 150)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in suffix_dedup(frame(spark, rows)).collect()}
    assert got == brute_removal(rows)


def test_suffix_dedup_odd_rows(spark):
    t = "".join(chr(97 + i * i % 23) + str(i) for i in range(200))
    got = sorted((str(x.doc_id), x.n_removed) for x in suffix_dedup(frame(spark, [(2, t), (2, t), (1, t), (None, t)])).collect())
    assert got == [("1", 0), ("2", len(t)), ("None", 0)]
    assert suffix_dedup(frame(spark, [])).count() == 0


def test_near_stage_tells_rows_of_one_id_or_none_apart(spark):
    from fleetpulse.llm.jaccard_join import keep_one_of_each

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long + " more"), (3, "a quite different text of some eight words"), (3, "and yet another text of one more kind here"),
            (None, "no id but a text that nobody else has got"), (None, long + " less"), (4, None), (5, ""), (None, None), (6, "few words"), (6, "few words")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, n int, digest string")
    got = [(r.doc_id, r.text) for r in keep_one_of_each(docs).collect()]
    assert sum((t or "").startswith("w0 ") for _, t in got) == 1
    assert sorted(map(str, [g for g in got if not (g[1] or "").startswith("w0 ")])) == sorted(map(str, [r for r in dict.fromkeys(rows) if not (r[1] or "").startswith("w0 ")]))
    assert keep_one_of_each(docs.limit(0)).count() == 0
