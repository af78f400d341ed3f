"""Jaccard self-join on word shingles: tiles of one shingle and size band, bitmaps, exact intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fleetpulse.llm.common import runs, string_bytes
from fleetpulse.llm.components import connected_components
from fleetpulse.llm.shingles import bitmap, folded, shingle_sets
from fleetpulse.session import written

#: A shingle of more documents than this comes last in the order of shingles.
COMMON = 128
#: Documents of a tile that one task compares.
TILE = 512


def prefix_length(n, percent: int):
    """Two sets that reach the similarity share one of each one's first ``prefix_length`` shingles, in any common order."""
    return n - (n * percent + 99) // 100 + 1


def emitted_length(n, percent: int):
    """How many of a set's shingles are looked at: its prefix and a reserve for common ones."""
    return np.minimum(n, prefix_length(n, percent) * 13 // 10 + 32)


def shingle_table(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n, key, bits``: size, 128-bit hash and bitmap of each document's shingle set."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            n, keys, bits = [], [], []
            for s in shingle_sets(data, offsets, k):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bits.append(bitmap(s))
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())],
                                  names=["doc_id", "n", "key", "bits"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).mapInArrow(described, "doc_id bigint, n bigint, key binary, bits binary")


def prefix_rows(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, flush: int = 1_500_000) -> DataFrame:
    """``h, doc, at, more``: for each of the first shingles of some documents, which documents they are and where it stands.

    Rows of one map task that share a shingle are one row, so a common shingle costs a row per task.
    """
    others = pa.list_(pa.struct([("doc", pa.int64()), ("at", pa.int32())]))
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("at", pa.int32()), ("more", others)])

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, ids, pos, held = [], [], [], 0

        def rows() -> pa.RecordBatch:
            a, d, p = np.concatenate(h), np.concatenate(ids), np.concatenate(pos)
            order = np.argsort(a, kind="stable")
            a, d, p = a[order], d[order], p[order]
            starts = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
            ends = np.append(starts[1:], len(a))
            rest = np.ones(len(a), bool)
            rest[starts] = False
            cuts = np.concatenate([[0], np.cumsum(ends - starts - 1)])
            offsets = pa.array(cuts.astype(np.int32), mask=np.append(ends - starts == 1, False))  # null: no others
            more = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(d[rest]), pa.array(p[rest])], names=["doc", "at"]))
            return pa.record_batch([pa.array(a[starts].view(np.int64)), pa.array(d[starts]), pa.array(p[starts]), more], schema=schema)

        for batch in batches:
            data, offsets = string_bytes(batch.column(1))
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(data, offsets, k)):
                m = int(emitted_length(len(s), percent)) if len(s) else 0
                h.append(s[:m])
                ids.append(np.full(m, doc, np.int64))
                pos.append(np.arange(m, dtype=np.int32))
                held += m
                if held >= flush:
                    yield rows()
                    h, ids, pos, held = [], [], [], 0
        if held:
            yield rows()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_col).filter("doc_id is not null")
    return rows.mapInArrow(emitted, "h bigint, doc bigint, at int, more array<struct<doc: bigint, at: int>>")


def shared_rows(rows: DataFrame) -> DataFrame:
    """``h, df, doc_id, at``: the rows of shingles that several documents emitted."""
    total = F.sum(1 + F.coalesce(F.size("more"), F.lit(0))).over(W.partitionBy("h")).alias("df")
    here = F.array(F.struct("doc", "at"))
    met = rows.select("h", "doc", "at", "more", total).filter("df >= 2")
    each = met.select("h", "df", F.explode(F.when(F.col("more").isNull(), here).otherwise(F.concat(here, "more"))).alias("x"))
    return each.select("h", "df", F.col("x.doc").alias("doc_id"), "x.at")


def tile_rows(shared: DataFrame, classes: DataFrame, percent: int, common: int) -> DataFrame:
    """``h, band, rep, n, home, strong``: the sets that meet in each tile.

    Common shingles come last in the order, so most sets skip them: a *strong* row is in its
    set's prefix under that order. A set with so many common shingles that its reserve does not suffice keeps
    its prefix in plain hash order as strong rows; to meet it, all others keep their common
    shingles of that prefix as *weak* rows, which are compared with strong ones only.
    """
    own = shared.join(classes.select("doc_id", "rep", "n"), "doc_id").groupBy("rep", "h").agg(
        F.min("at").alias("at"), F.min("df").alias("df"), F.min("n").alias("n"))
    by_set = W.partitionBy("rep")
    n = F.col("n")
    p = n - F.expr(f"(n * {percent} + 99) div 100") + 1
    seen = F.least(n, F.expr(f"(n - (n * {percent} + 99) div 100 + 1) * 13 div 10 + 32"))
    hot = (F.col("df") > common).cast("int")
    ranked = own.withColumn("hot", hot).select(
        "*", F.sum("hot").over(by_set).alias("hots"), F.sum("hot").over(by_set.orderBy("at")).alias("upto"), p.alias("p"), seen.alias("seen"))
    complete = F.col("seen") == n
    enough = complete | (F.col("seen") - F.col("hots") >= F.col("p"))
    rank = F.when(F.col("hot") == 0, F.col("at") - F.col("upto")).when(complete, n - F.col("hots") + F.col("upto") - 1).otherwise(n)
    strong = F.when(enough, rank < F.col("p")).otherwise(F.col("at") < F.col("p"))
    band = F.floor(F.log(n.cast("double")) / math.log(1.005 * 100 / percent)).cast("int")
    kept = ranked.select("h", "rep", "n", strong.alias("strong"), band.alias("own"), "at", "p").filter("strong or at < p")
    return kept.select("h", "rep", "n", "strong", F.explode(F.array(F.struct(F.col("own").alias("band"), F.lit(True).alias("home")),
                                                                   F.struct((F.col("own") + 1).alias("band"), F.lit(False).alias("home")))).alias("x")
                       ).select("h", "x.band", "rep", "n", "x.home", "strong")


def different_tiles(rows: DataFrame) -> DataFrame:
    """The rows of one tile of each list of sets: tiles with the same list say nothing new."""
    mark = F.xxhash64("rep", "home", "strong")
    lists = rows.groupBy("h", "band").agg(
        F.count(F.lit(1)).alias("size"), F.sum(F.shiftright(mark, 16)).alias("s"), F.bit_xor(F.xxhash64(mark)).alias("x"),
        F.max("home").alias("home"), F.max("strong").alias("strong"))
    one = lists.filter("size >= 2 and home and strong").groupBy("band", "size", "s", "x").agg(F.min("h").alias("h"))
    return rows.join(one.select("h", "band", "size"), ["h", "band"])


def possible_overlap(maps: np.ndarray, one: int, others: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The most shingles that one set can share with each of the others: a set bit that the other map lacks is a shingle it lacks."""
    mine = n[one] - np.bitwise_count(maps[one] & ~maps[others]).sum(axis=1, dtype=np.int64)
    theirs = n[others] - np.bitwise_count(maps[others] & ~maps[one]).sum(axis=1, dtype=np.int64)
    return np.minimum(mine, theirs)


def dealt_blocks(named: DataFrame, tile: int, few: bool) -> DataFrame:
    """The rows of tiles of several components with ``i, j, block, partial``: for each pair of blocks that they meet in.

    Pairs inside a component are not wanted, so the rows of a large tile's main component get blocks of their own, which meet
    the others' blocks only: with few others a tile costs a row or two a set, whatever its size. With ``few`` each block of the
    main component meets one block of others, and those meet the next one; ``partial`` marks tiles where others are left.
    """
    held = named.groupBy("h", "band", "component").agg(F.count(F.lit(1)).alias("c"))
    top = held.groupBy("h", "band").agg(F.max(F.struct("c", "component")).alias("top"), F.count(F.lit(1)).alias("components"))
    rows = named.join(top.filter("components > 1").select("h", "band", "top"), ["h", "band"])
    ways = rows.withColumn("large", F.col("size") > tile).withColumn("main", F.col("large") & (F.col("component") == F.col("top.component")))
    most = F.greatest(F.lit(float(tile)), F.sqrt(F.col("size") * tile / 2))  # of a block: larger ones in larger tiles, where they are many
    mains = F.when(F.col("large"), F.ceil(F.col("top.c") / most)).otherwise(0).cast("int")
    others = F.when(F.col("large"), F.ceil((F.col("size") - F.col("top.c")) / most)).otherwise(1).cast("int")
    ways = ways.withColumn("mains", mains).withColumn("others", others)
    mark = F.xxhash64("rep")
    block = F.when(F.col("main"), F.pmod(mark, F.col("mains"))).otherwise(F.pmod(mark, F.col("others")) + F.col("mains")).cast("int")
    ways = ways.withColumn("block", block).withColumn("partial", F.lit(few) & (F.col("others") > 1))
    own = F.col("block") - F.col("mains")  # of the others
    if few:
        step = lambda d: F.col("mains") + F.pmod(own + d, F.col("others"))
        met = F.when(F.col("main"), F.array(F.col("mains") + F.pmod("block", "others"))).otherwise(F.array_distinct(F.concat(
            F.array(F.col("block"), step(1), step(-1)),
            F.when(own < F.col("mains"), F.sequence(own, F.col("mains") - 1, F.col("others"))).otherwise(F.array().cast("array<int>")))))
    else:
        every = F.col("mains") + F.col("others") - 1
        met = F.when(F.col("main"), F.sequence(F.col("mains"), every)).otherwise(F.sequence(F.lit(0), every))
    met = ways.withColumn("other", F.explode(met))
    return met.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("top", "large", "main", "mains", "others", "other")


def tile_pairs(tiles: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int, tile: int, few: bool) -> DataFrame:
    """``a, b, h, band``: pairs of a tile whose bitmaps leave enough overlap possible.

    A tile of more than ``tile`` sets is dealt to blocks, and pairs of blocks that may matter to a task each. Without
    ``labels`` each set looks for partners in one tile only, the first of its own, and there in its own block: at
    most two pairs a set, with the partner whose bitmap leaves the highest similarity possible, and with the possible
    partner of the smallest id. With ``labels`` pairs are made across components, in tiles that
    hold several. With ``few`` each component of a task gives its likeliest pair and its first, as in Boruvka's
    rounds; tiles where more were possible, or were not looked for, are given as rows (h, band). Without, all possible pairs are given.
    """
    first = labels is None
    if first:
        own = tiles.filter("home and strong").groupBy("rep").agg(F.min(F.struct("h", "band")).alias("own")).select("rep", "own.h", "own.band", F.lit(True).alias("looks"))
        open_rows = tiles.join(own.select("h", "band").distinct(), ["h", "band"], "left_semi").join(own, ["rep", "h", "band"], "left")
        block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / tile).cast("bigint")).cast("int")
        open_rows = open_rows.withColumn("looks", F.coalesce("looks", F.lit(False))).withColumn("component", F.col("rep"))
        open_rows = open_rows.withColumns({"block": block, "i": block, "j": block, "partial": F.lit(False)})
    else:
        named = tiles.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_rows = dealt_blocks(named, tile, few).withColumn("looks", F.col("strong"))
    dealt = open_rows.join(sets.select(F.col("doc_id").alias("rep"), "bits"), "rep").select(
        "h", "band", "i", "j", "block", "partial", "rep", "n", "home", "strong", "looks", "component", "bits")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("h", pa.int64()), ("band", pa.int32())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, tiles_left, given, held = [], [], [], set(), 0

        def rows() -> pa.RecordBatch:
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (firsts, seconds))
            more = len(tiles_left)
            return pa.record_batch([
                pa.concat_arrays([pa.array(a), pa.nulls(more, pa.int64())]), pa.concat_arrays([pa.array(b), pa.nulls(more, pa.int64())]),
                pa.array([None] * len(a) + [h for h, _ in tiles_left], pa.int64()), pa.array([None] * len(a) + [t for _, t in tiles_left], pa.int32())], schema=schema)

        for run in runs(batches, ["h", "band", "i", "j"]):
            rep, n, home, strong, label = (run[c] for c in ("rep", "n", "home", "strong", "component"))
            block, apart = run["block"], run["i"][0] != run["j"][0]
            if run["partial"][0]:
                tiles_left.append((int(run["h"][0]), int(run["band"][0])))
            if len(rep) < 2 or not run["looks"].any():
                continue
            maps, order, best, possible = folded(run["bits"]), np.arange(len(rep)), {}, 0
            for x in np.flatnonzero(run["looks"]):
                fit = (label != label[x]) & (np.minimum(n, n[x]) * 100 >= np.maximum(n, n[x]) * percent) & (home | home[x])
                if apart:
                    fit &= block != block[x]
                if not few:
                    fit &= ~strong | (order > x)
                others = np.flatnonzero(fit)
                if not len(others):
                    continue
                most = possible_overlap(maps, x, others, n)
                likely = 100 * most >= percent * (n[x] + n[others] - most)
                others, most = others[likely], most[likely]
                if not len(others):
                    continue
                if few:
                    possible += int(((others > x) | ~strong[others]).sum())
                    alike = most / (n[x] + n[others] - most)
                    likeliest = int(np.argmax(alike))
                    for way, score, y in ((0, -alike[likeliest], rep[others[likeliest]]), (1, int(rep[others].min()), rep[others].min())):
                        offer = (score, min(int(rep[x]), int(y)), max(int(rep[x]), int(y)))
                        key = (label[x], way)
                        if key not in best or offer < best[key]:
                            best[key] = offer
                else:
                    firsts.append(np.minimum(rep[x], rep[others]))
                    seconds.append(np.maximum(rep[x], rep[others]))
                    held += len(others)
            chosen = {offer[1:] for offer in best.values()}
            if not first and possible > len(chosen) and not run["partial"][0]:
                tiles_left.append((int(run["h"][0]), int(run["band"][0])))
            if fresh := chosen - given:
                firsts.append(np.array([a for a, _ in fresh], np.int64))
                seconds.append(np.array([b for _, b in fresh], np.int64))
                given |= fresh
                held += len(fresh)
            if held + len(tiles_left) > 50_000:
                yield rows()
                firsts, seconds, tiles_left, held = [], [], [], 0
                if len(given) > 200_000:
                    given = set()
        if held or tiles_left:
            yield rows()

    grouped = dealt.repartition("h", "band", "i", "j").sortWithinPartitions("h", "band", "i", "j")
    return grouped.mapInArrow(compared, "a bigint, b bigint, h bigint, band int")


def exact_links(pairs: DataFrame, docs: DataFrame, k: int, percent: int, part: int = 512) -> DataFrame:
    """The pairs that reach the similarity, by intersection of their sorted sets.

    Texts are sent to their pairs' first sets, in parts of ``part`` pairs; a task holds one
    first set and one other at a time. ``docs`` has doc_id and text.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part).cast("bigint").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    wanted = dealt.select("a", "part", F.lit(1).alias("turn"), F.col("b").alias("doc_id")).union(
        dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("turn"), F.col("a").alias("doc_id")))
    sent = docs.join(wanted.hint("merge"), "doc_id").repartition("a", "part").sortWithinPartitions("a", "part", "turn")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, first = None, None
        for batch in batches:
            data, offsets = string_bytes(batch.column("text"))
            a, part_, turn, ids = (batch.column(c).to_numpy() for c in ("a", "part", "turn", "doc_id"))
            out = []
            for r, s in enumerate(shingle_sets(data, offsets, k)):
                if turn[r] == 0:
                    head, first = (a[r], part_[r]), s
                elif head == (a[r], part_[r]):
                    both = np.intersect1d(first, s, assume_unique=True).size
                    if 100 * both >= percent * (len(first) + len(s) - both):
                        out.append((a[r], ids[r]))
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return sent.select("a", "part", "turn", "doc_id", "text").mapInArrow(verified, "a bigint, b bigint")


def jaccard_components(
    docs: DataFrame, k: int = 5, percent: int = 75, common: int = COMMON, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: what each document is linked with, directly or over others.

    Documents link when 100 * |A and B| >= percent * |A or B| for their sets of distinct
    k-word shingles (of lower-cased words). The way to that:

    1. Documents with equal sets are one class, so copies cost nothing further.
    2. Any two sets that link share a shingle of their prefixes; only shingles of two or more
       documents go on. Sets that share one and have sizes of one band or the next are a tile;
       tiles with the same list of sets are taken once.
    3. In every tile the bit counts of two bitmaps bound the overlap of their sets from above. First
       each set is paired, in one tile, with the one that may be most similar and with the first that may be similar at
       all; exact intersection of the sorted sets decides. Then, in at most two rounds, each component of
       a tile is paired in the same way across the components so far.
    4. In every tile that had more possible pairs and still holds several components, all pairs across
       components that the bitmaps do not exclude are intersected too. No link that could join two
       components is left out, so the components are those of all links.

    Nothing is capped, and no pair is made inside a component that is known. A shingle of
    more than ``common`` documents comes last in the order; large tiles are split in blocks.

    Nulls: a null text has no shingles and is linked with nothing, as are texts without words;
    rows without an id are given back unlinked, each by itself. Rows that repeat an id count once;
    with different texts they fail the job. Other columns are ignored.
    """
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    table = written(shingle_table(named, k, "doc_id", "text"), "sets")
    clash = F.raise_error(F.lit("an id has two different texts"))
    one = table.groupBy("doc_id").agg(
        F.when(F.col("doc_id").isNotNull() & (F.min("key") != F.max("key")), clash.cast("bigint")).otherwise(F.min("n")).alias("n"), F.min("key").alias("key"))
    unnamed = table.filter("doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id"))
    named_sets = one.filter("doc_id is not null")
    reps = named_sets.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = written(named_sets.join(reps, "key", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("doc_id")).alias("rep")), "classes")
    sets = written(table.filter("doc_id is not null and n > 0").select("doc_id", "n", "bits").join(
        classes.filter("doc_id = rep").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "maps")
    shared = written(shared_rows(prefix_rows(named, k, percent, "doc_id", "text")), "shared")
    tiles = written(different_tiles(written(tile_rows(shared, classes, percent, common), "meets")), "tiles")
    labels, links, tried, left, few, rounds = None, None, None, tiles, True, 0
    while True:
        near = written(tile_pairs(left, labels, sets, percent, tile, few), "near")
        pairs = near.filter("a is not null").select("a", "b").distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        found = written(exact_links(pairs, named, k, percent), "found").select("a", "b")
        tried = pairs if tried is None else tried.union(pairs)
        more, open_tiles = not found.isEmpty(), near.filter("h is not null").select("h", "band").distinct()
        done = labels is not None and (not few or open_tiles.isEmpty())
        left = left if labels is None else left.join(open_tiles, ["h", "band"], "left_semi")
        if links is None or more:
            links = found if links is None else links.union(found)
            labels = connected_components(links)
        if done:
            break
        # after the first round, at most two more with few pairs while they find links; then all that are left
        rounds += 1
        few = rounds == 1 or (more and rounds < 3)
    return classes.join(labels.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")).union(unnamed)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each component, with all its columns.

    Rows are told apart by id and text: those that share an id but not their text, and those without an
    id, are documents of their own, under numbers below all ids. Rows that repeat both count once. Texts
    without words are linked with nothing and stay.
    """
    key, digest = "__near_key", "__near_digest"
    rows = docs.withColumn(digest, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    several = rows.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__near_id")).agg(
        F.min(digest).alias("lo"), F.max(digest).alias("hi")).filter("lo <> hi").select("__near_id")
    several = written(several, "ids-of-several-texts")
    same = F.col(id_col) == F.col("__near_id")
    odd = rows.join(several, same, "left_semi").union(rows.filter(F.col(id_col).isNull())).dropDuplicates([id_col, digest])
    least = docs.agg(F.least(F.min(F.col(id_col).cast("bigint")), F.lit(0)).alias("m")).first().m or 0
    numbered = written(odd.withColumn(key, F.lit(least) - 1 - F.monotonically_increasing_id()), "odd-rows")
    plain = rows.filter(F.col(id_col).isNotNull()).join(several, same, "left_anti").withColumn(key, F.col(id_col).cast("bigint"))
    all_rows = plain.unionByName(numbered)
    first = jaccard_components(all_rows.select(key, text_col), id_col=key, text_col=text_col, **options).filter("doc_id = component_id")
    held = all_rows.join(first.select(F.col("doc_id").alias("__near_first")), F.col(key) == F.col("__near_first"), "left_semi")
    return held.dropDuplicates([key]).drop(key, digest)
