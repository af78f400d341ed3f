"""Tables of threshold rules that one sample fires: what they find, without a row for each reading and rule.

A feed's readings and every rule go to the feed's part once. A Python worker there holds the rules and
takes one feed after the other: a series' values meet the levels of its rules in blocks of bounded size,
whose edges are handed back as lists, one row for each reading that has any. Watched readings and edges, which
grow with rules times readings, are neither shuffled nor sorted nor written.
"""

from __future__ import annotations

from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.operators import blocked, readings as R, rule_index
from fleetpulse.operators.rules import RuleTable
from fleetpulse.schema import METRICS, OPS, SEVERITIES

RULES_A_ROW = 64  # rules come to the workers in rows of so many
PARTS_A_CORE = 4
CELLS = 1 << 20  # values times levels that are compared at once
RULE_SETS = 512  # rules of so many kinds of series are kept sorted
COMPARE = {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}

RULES, ROWS = 0, 1
HELD = "array<struct<rule_idx: bigint, name: string, severity: int, threshold: double, clear: double>>"
FOUND = ("tick bigint, raw_timestamp string, sensor string, reading string, value double, unit string, "
         "seqs array<bigint>, rules array<bigint>, names array<string>, severities array<tinyint>, thresholds array<double>, cleared array<int>")


def applies(rules: RuleTable) -> bool:
    """Whether every rule is of that kind, and has a number of its own."""
    whole = dict(rules.frame.dtypes)["rule_idx"] in ("int", "bigint")
    if not whole or rules.kinds != {"threshold"} or rules.same.get("for_samples") != 1:
        return False
    numbers = rules.frame.groupBy("rule_idx").agg(F.count(F.lit(1)).alias("n"))
    return numbers.where("n > 1 OR rule_idx IS NULL").isEmpty()


def edges(stream: DataFrame, rules: RuleTable) -> DataFrame:
    """Numbered edges of ``stream``, all of whose feeds are small enough for a worker, with what events say of their rule."""
    parts = blocked.partitions_for(stream, PARTS_A_CORE * stream.sparkSession.sparkContext.defaultParallelism)
    dealt = _dealt(stream, rules, parts).repartitionById(parts, F.col("part"))
    found = dealt.sortWithinPartitions("tag", "feed_id", "blk", "ord", "pos", "sensor", "reading").mapInArrow(
        found_in, f"feed_id {stream.schema['feed_id'].dataType.simpleString()}, {FOUND}")
    each = found.select("*", F.posexplode("seqs").alias("__i", "seq"))
    at = lambda name: F.get(F.col(name), F.col("__i"))
    cleared = at("cleared")
    return each.select(
        "feed_id", "seq", at("rules").cast(rules.frame.schema["rule_idx"].dataType).alias("rule_idx"),
        at("names").alias("rule_name"), F.lit("threshold").alias("rule_kind"),
        _word(SEVERITIES, at("severities")).alias("rule_severity"), at("thresholds").alias("rule_threshold"),
        F.when(cleared == 0, "fired").otherwise("cleared").alias("state"), "raw_timestamp", "tick", "sensor", "reading", "value", "unit",
        F.greatest(cleared, F.lit(1)).cast("long").alias("samples_in_violation"))


def _word(words: list[str], place: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), place.cast("int"))


def _place(words: list[str], word: Column) -> Column:
    return (F.array_position(F.array(*[F.lit(w) for w in words]), word) - 1).cast("int")


def _dealt(stream: DataFrame, rules: RuleTable, parts: int) -> DataFrame:
    """Rules, for every part, and the stream's markers and watched readings, for the part of their feed.

    A reading has the numbers of the wishes that its series grants; a wish has the least number of the rules that ask for it.
    """
    marker = F.col("pos") == R.MARKER_POS
    asked = rule_index.by_wish(rules.frame)
    wishes = asked.groupBy("wish").agg(F.min("rule_idx").cast("long").alias("asked"), F.count(F.lit(1)).alias("n"))
    readings = stream.where(~marker)
    granted = rule_index.granted_wishes(readings.select(*rule_index.NAMES).distinct(), asked).join(wishes, "wish")
    of_series = granted.groupBy(*rule_index.NAMES).agg(F.sort_array(F.collect_list("asked")).alias("wishes"))
    rows = readings.join(of_series, rule_index.NAMES).unionByName(stream.where(marker), allowMissingColumns=True).select(
        F.pmod(F.xxhash64("feed_id"), F.lit(parts)).cast("int").alias("part"), F.lit(ROWS).alias("tag"),
        "feed_id", "blk", "ord", "pos", "sensor", "reading", "raw_timestamp", "unit", F.coalesce("available", F.lit(False)).alias("available"),
        F.array(*[S.select_metric(F.lit(m), *[F.col(c) for c in ("value", "min", "max", "avg")]) for m in METRICS]).alias("xs"), "wishes")
    held = F.struct(
        F.col("rule_idx").cast("long").alias("rule_idx"), "name", _place(SEVERITIES, F.col("severity")).alias("severity"),
        rules.get("threshold").alias("threshold"), rules.get("clear_level").alias("clear"))
    packs = (
        rule_index.by_wish(rules.frame.select("rule_idx", *rule_index.NAMES, held.alias("held"), _place(METRICS, rules.get("metric")).alias("metric"), _place(OPS, rules.get("op")).alias("op")),
                           ["held", "metric", "op"])
        .join(wishes, "wish").groupBy("asked", "metric", "op", F.pmod(F.xxhash64("rule_idx"), F.ceil(F.col("n") / RULES_A_ROW)).alias("pack"))
        .agg(F.collect_list("held").cast(HELD).alias("held")).drop("pack"))
    to_all = packs.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(RULES).alias("tag"), "asked", "metric", "op", "held")
    return rows.unionByName(to_all, allowMissingColumns=True)


# --- in the worker -----------------------------------------------------------------------------------


class Held:
    """All rules, in the order of their numbers; ``rank`` is the place there."""

    def __init__(self, packs: list[pa.RecordBatch]):
        whole = pa.Table.from_batches(packs).combine_chunks() if packs else None
        held = whole["held"].combine_chunks() if packs else None
        self.sets: OrderedDict[bytes, list] = OrderedDict()
        self.of_wish: dict[int, list] = defaultdict(list)
        if not packs:
            return
        each = held.flatten()
        numbers = each.field("rule_idx").to_numpy()
        order = np.argsort(numbers, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        column = lambda name: each.field(name).to_numpy()[order]
        self.numbers, self.severity, self.threshold, self.clear = numbers[order], column("severity").astype(np.int8), column("threshold"), column("clear")
        self.names = each.field("name").take(pa.array(order))
        ends = np.cumsum(held.value_lengths().to_numpy())
        begins = ends - held.value_lengths().to_numpy()
        for wish, metric, op, a, b in zip(*[whole[c].to_pylist() for c in ("asked", "metric", "op")], begins.tolist(), ends.tolist(), strict=True):
            self.of_wish[wish].append((metric, op, rank[a:b]))

    def of(self, wishes: bytes) -> list[tuple[int, int, np.ndarray]]:
        """(metric, op, ranks in order) of the rules that ask for ``wishes``."""
        if wishes in self.sets:
            self.sets.move_to_end(wishes)
            return self.sets[wishes]
        by_kind = defaultdict(list)
        for w in np.frombuffer(wishes, np.int64).tolist():
            for metric, op, ranks in self.of_wish[w]:
                by_kind[metric, op].append(ranks)
        self.sets[wishes] = [(m, o, np.sort(np.concatenate(x))) for (m, o), x in by_kind.items()]
        if len(self.sets) > RULE_SETS:
            self.sets.popitem(last=False)
        return self.sets[wishes]


class Block:
    """Values of one series and levels of rules that watch it, with the state that each rule has reached."""

    def __init__(self, held: Held, rows: np.ndarray, x: np.ndarray, metric: int, op: int, ranks: np.ndarray):
        known = ~np.isnan(x)
        self.rows, self.x, self.metric, self.ranks, self.compare = rows[known], x[known], metric, ranks, COMPARE[OPS[op]]
        self.threshold, self.clear = held.threshold[ranks], held.clear[ranks]
        self.plain = bool((self.threshold == self.clear).all())
        self.fired, self.violations = np.zeros(len(ranks), bool), np.zeros(len(ranks), np.int64)

    def edges(self, until: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(row, rank, violations that a clear ends, or 0 for a fire) of the rows before ``until``, by row and rank."""
        n = int(np.searchsorted(self.rows, until))
        if not n:
            return None
        rows, x = self.rows[:n], self.x[:n, None]
        self.rows, self.x = self.rows[n:], self.x[n:]
        over = state = self.compare(x, self.threshold)
        k = np.arange(n, dtype=np.int32)[:, None]
        if not self.plain:
            judged = over | ~self.compare(x, self.clear)
            last = np.maximum.accumulate(np.where(judged, k, -1), axis=0)
            state = np.where(last < 0, self.fired, np.take_along_axis(over, np.maximum(last, 0), axis=0))
        turned = state.copy()
        turned[0] ^= self.fired
        turned[1:] ^= state[:-1]
        fire = np.maximum.accumulate(np.where(turned & state, k, -1), axis=0)  # row of the last fire here
        count = np.cumsum(over, axis=0, dtype=np.int32)
        row, rule = np.nonzero(turned)

        def since(at, which):
            f = fire[at, which]
            return count[at, which] + np.where(f < 0, self.violations[which], 1 - count[np.maximum(f, 0), which])

        cleared = np.zeros(len(row), np.int32)
        down = ~state[row, rule]
        cleared[down] = since(row[down], rule[down])
        self.violations = np.where(state[-1], since(n - 1, np.arange(len(self.ranks))), 0)
        self.fired = state[-1].copy()
        return rows[row], self.ranks[rule], cleared


def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's edges: rules come first, then markers and readings by feed and time."""
    packs, held, rest = [], None, None
    for batch in batches:
        n_rules = batch.num_rows - int(np.count_nonzero(batch["tag"].to_numpy()))
        if n_rules:
            packs.append(batch.slice(0, n_rules).select(["asked", "metric", "op", "held"]))
        if n_rules == batch.num_rows:
            continue
        held, packs = held or Held(packs), []
        new = pa.Table.from_batches([batch.slice(n_rules)])
        rest = pa.concat_tables([rest, new]).combine_chunks() if rest is not None else new
        feeds = _codes(rest["feed_id"])
        ends = np.flatnonzero(feeds[1:] != feeds[:-1]) + 1
        if len(ends):
            yield from _feeds(rest.slice(0, ends[-1]), ends, held)
            rest = rest.slice(ends[-1])
    if rest is not None:
        yield from _feeds(rest, np.array([rest.num_rows]), held)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def _feeds(table: pa.Table, ends: np.ndarray, held: Held) -> Iterator[pa.RecordBatch]:
    """Edges of the whole feeds that end before the rows ``ends``."""
    if not held.of_wish:
        return
    table = table.combine_chunks()
    pos, available = table["pos"].to_numpy(), table["available"].to_numpy()
    marker = pos == R.MARKER_POS
    sensors, names = _codes(table["sensor"]), _codes(table["reading"])
    series = sensors.astype(np.int64) * (int(names.max()) + 1) + names
    lists = table["wishes"].combine_chunks()
    wishes, lengths = lists.flatten().to_numpy(), lists.value_lengths().fill_null(0).to_numpy()
    wish_end = np.cumsum(lengths)
    xs = np.where((flat := table["xs"].combine_chunks().flatten()).is_null().to_numpy(zero_copy_only=False), np.nan, flat.to_numpy(zero_copy_only=False)).reshape(-1, len(METRICS))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        ticks, samples = np.cumsum(marker[a:b]), np.cumsum(marker[a:b] & available[a:b])
        by_series = defaultdict(lambda: defaultdict(list))
        for i in (np.flatnonzero(lengths[a:b])).tolist():
            by_series[series[a + i]][wishes[wish_end[a + i] - lengths[a + i]:wish_end[a + i]].tobytes()].append(i)
        blocks = [
            Block(held, rows, xs[a + rows, metric], metric, op, ranks)
            for lists in by_series.values() for rows, asked in _watched(lists)
            for rows in [_first(rows, samples[rows], pos[a + rows])] for metric, op, ranks in held.of(asked)]
        yield from _numbered(table.slice(a, b - a), blocks, ticks, held)


def _watched(lists: dict[bytes, list[int]]) -> list[tuple[np.ndarray, bytes]]:
    """(rows, wishes): rows of a series by the wishes that they all grant. Rows of different labels may grant different ones."""
    if len(lists) == 1:
        return [(np.array(rows), asked) for asked, rows in lists.items()]
    grants = defaultdict(list)
    for asked in lists:
        for w in np.frombuffer(asked, np.int64).tolist():
            grants[w].append(asked)
    alike = defaultdict(list)
    for w, by in grants.items():
        alike[tuple(by)].append(w)
    return [(np.sort(np.concatenate([lists[x] for x in by])), np.array(sorted(ws), np.int64).tobytes()) for by, ws in alike.items()]


def _first(rows: np.ndarray, samples: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Of a sample's readings of one series the first."""
    if (samples[1:] > samples[:-1]).all():
        return rows
    order = np.lexsort((pos, samples))
    again = samples[order]
    return np.sort(rows[order[np.r_[True, again[1:] != again[:-1]]]])


def _numbered(feed: pa.Table, blocks: list[Block], ticks: np.ndarray, held: Held) -> Iterator[pa.RecordBatch]:
    """Edges of one feed in their order, tick, rule, reading, from stretches of ``CELLS`` comparisons."""
    cells, seen = np.zeros(feed.num_rows, np.int64), np.zeros(feed.num_rows, np.int64)
    for x in blocks:
        cells[x.rows] += len(x.ranks)
        seen[x.rows] += 1
    watched = ticks[seen > 0]
    apart = seen.max(initial=0) <= 1 and bool((watched[1:] != watched[:-1]).all())  # a tick has one block's edges
    upto, done, seq = np.cumsum(cells), 0, 0
    while done < feed.num_rows:
        last = int(np.searchsorted(upto, (upto[done - 1] if done else 0) + CELLS, side="right"))
        until = int(np.searchsorted(ticks, ticks[max(last - 1, done)], side="right"))
        found = [(x, e) for x in blocks if (e := x.edges(until)) is not None]
        done = until
        if not found:
            continue
        row, rank, cleared = (np.concatenate([e[i] for _, e in found]) for i in range(3))
        if not len(row):
            continue
        metric = np.repeat([x.metric for x, _ in found], [len(e[0]) for _, e in found])
        seqs = np.arange(seq + 1, seq + 1 + len(row))
        seq += len(row)
        if apart:
            near = row - row.min()
            order = np.argsort(near.astype(np.uint16) if near.max() < 1 << 16 else near, kind="stable")
        else:
            by_tick = np.lexsort((row, rank, ticks[row]))
            own = np.empty_like(seqs)
            own[by_tick] = seqs
            order = np.lexsort((own, metric, row))
            seqs = own[order]
        row, rank, cleared, metric = row[order], rank[order], cleared[order], metric[order]
        starts = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (metric[1:] != metric[:-1])])
        at, by = row[starts], metric[starts]
        offsets = pa.array(np.r_[starts, len(row)].astype(np.int32))
        of_row = feed.take(pa.array(at)).combine_chunks()
        values = of_row["xs"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(METRICS))[np.arange(len(at)), by]
        lists = [pa.array(seqs), pa.array(held.numbers[rank]), held.names.take(pa.array(rank)), pa.array(held.severity[rank]), pa.array(held.threshold[rank]), pa.array(cleared)]
        yield pa.RecordBatch.from_arrays(
            [of_row["feed_id"].combine_chunks(), pa.array(ticks[at]), *[of_row[c].combine_chunks() for c in ("raw_timestamp", "sensor", "reading")], pa.array(values),
             of_row["unit"].combine_chunks(), *[pa.ListArray.from_arrays(offsets, x) for x in lists]],
            names=["feed_id", "tick", "raw_timestamp", "sensor", "reading", "value", "unit", "seqs", "rules", "names", "severities", "thresholds", "cleared"])
