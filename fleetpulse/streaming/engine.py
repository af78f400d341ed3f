"""The rule engine on a live stream of samples.

Absence and source rules need whole samples, so state is kept per feed. A feed
may be split into ``spread`` parts by a hash of the series: every part sees every
tick, but only its own series, and one hot feed then runs in several tasks. The
few edges of all parts then meet in a second stateful step by feed, which numbers
them densely in stream order and owns the quiet timer, so that ``spread`` changes no row.
Rules are matched before the shuffle, so only watched readings reach Python.

Ticks are taken in arrival order: there is no watermark and nothing is reordered
beyond the stream order inside one micro-batch. State lives in the checkpoint, so
a restart goes on where it stopped and sequence numbers are never used twice.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from fleetpulse.functions import scalars as S
from fleetpulse.operators.rules import Rule
from fleetpulse.schema import EVENT_KEYS
from fleetpulse.session import ROCKSDB

_EDGE = {
    "part": "int", "seq": "long", "tick": "long", "rule_idx": "int", "late": "int", "pos": "long", "state": "string", "timestamp": "string",
    "sensor": "string", "reading": "string", "value": "double", "unit": "string", "samples_in_violation": "long"}
_OF_RULE = {"rule": ("name", "string"), "type": ("kind", "string"), "severity": ("severity", "string"), "threshold": ("threshold", "double")}
_NAMES = [
    "feed_id", "part", "seq", "tick", "rule_idx", "late", "pos", "rule", "type", "severity", "state", "timestamp", "sensor", "reading", "value", "unit",
    "threshold", "samples_in_violation"]
PACKED = "feed_id string, edges string"  # a key has few edges: many narrow frames cost far less than many wide ones
PACK = 1_000  # edges to a text
PAGE = 32  # gates to a page of the state, about
_HIT = "array<struct<rule_idx:int,pos:int,sensor:string,reading:string,x:double,sig:string,unit:string>>"
QUIET, ALIVE = "quiet", "alive"


def watched(samples: DataFrame, rules: list[Rule], spread: int = 1) -> DataFrame:
    """One row per (sample, part) with the readings its rules watch."""
    def hits(i: int, r: Rule):
        def entry(s, pos):
            metric = S.nan_if_not_finite(s[r.metric])
            four = [S.nan_if_not_finite(s[c]) for c in ("value", "min", "max", "avg")]
            sig = F.concat_ws("|", *[v.cast("string") for v in four]) if r.kind == "stale" else F.lit(None).cast("string")
            return F.struct(F.lit(i).alias("rule_idx"), pos.alias("pos"), s["sensor"].alias("sensor"), s["reading"].alias("reading"),
                            metric.alias("x"), sig.alias("sig"), s["unit"].alias("unit"))

        def keep(s):
            ok = F.lit(True)
            if r.sensor is not None:
                ok = ok & F.lower(s["sensor"]).contains(r.sensor)
            if r.reading is not None:
                ok = ok & F.lower(s["reading"]).contains(r.reading)
            if r.type is not None:
                ok = ok & (S.normalize_type(s["type"]) == r.type)
            return ok

        kept = F.filter(F.transform("sensors", lambda s, p: F.struct(s.alias("s"), p.alias("p"))), lambda z: keep(z["s"]))
        return F.transform(kept, lambda z: entry(z["s"], z["p"]))

    per_rule = [hits(i, r) for i, r in enumerate(rules) if r.kind != "source-unavailable"]
    found = F.coalesce(F.concat(*per_rule), F.array().cast(_HIT)) if per_rule else F.array().cast(_HIT)
    rows = samples.select("feed_id", "blk", "ord", "raw_timestamp", "available", found.alias("hits"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))))
    if spread > 1:
        mine = F.filter("hits", lambda h: F.pmod(F.xxhash64(h["sensor"], h["reading"]), F.lit(spread)) == F.col("part"))
        rows = rows.withColumn("hits", mine)
    # Each column of each key is converted on its own on the way to Python, so the readings cross as one text, if there are any.
    return rows.select("feed_id", "part", "blk", "ord", "raw_timestamp", "available", F.when(F.size("hits") > 0, F.to_json("hits")).alias("hits"))


class Gate:
    """Debounce and hysteresis of one rule on one series."""

    __slots__ = ("fired", "run", "total", "last", "unit", "sig", "window")

    def __init__(self, fired=False, run=0, total=0, last=-1, unit=None, sig=None, window=()):
        self.fired, self.run, self.total, self.last = fired, run, total, last
        self.unit, self.sig, self.window = unit, sig, list(window)

    def dump(self) -> str:
        return json.dumps([getattr(self, n) for n in self.__slots__])

    @classmethod
    def load(cls, text: str) -> Gate:
        return cls(*json.loads(text))

    def step(self, violates: bool, clears: bool, need: int):
        """('fired', n), ('cleared', n) or None."""
        if self.fired:
            if clears:
                n, self.fired, self.run, self.total = self.total, False, 0, 0
                return "cleared", n
            self.total += violates
        else:
            self.run = self.run + 1 if violates else 0
            if violates and self.run == need:
                self.fired, self.total = True, need
                return "fired", need
        return None


def _beyond(op: str, x: float, bound: float) -> bool:
    if op == ">":
        return x > bound
    if op == ">=":
        return x >= bound
    return x < bound if op == "<" else x <= bound


def _judge(rule: Rule, gate: Gate, sample: int, x: float, sig: str | None):
    """(shown value, violates, clears) of one present reading."""
    if gate.last != sample - 1:  # absent in between, or never seen
        gate.run, gate.sig, gate.window = 0, None, []
    if rule.kind == "stale":
        known, same = gate.sig is not None, gate.sig == sig
        gate.sig = sig
        return x, known and same, known and not same
    shown = x
    if rule.kind == "rate":
        full = len(gate.window) == rule.lookback
        shown = x - gate.window[0] if full else math.nan
        gate.window = (gate.window + [x])[-rule.lookback:]
    if math.isnan(shown):
        return shown, False, False
    return shown, _beyond(rule.op, shown, rule.threshold), not _beyond(rule.op, shown, rule.clear_level)


def _rearm(handle: StatefulProcessorHandle, timerValues, seconds: float, again: bool) -> None:
    """One timer a key: set where there is none, or set anew."""
    timers = list(handle.listTimers())
    if timers and not again:
        return
    for t in timers:
        handle.deleteTimer(t)
    handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(seconds * 1000))


def _frames(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    frames = list(rows)
    return frames[0] if len(frames) == 1 else pd.concat(frames, ignore_index=True)


def _packed(feed: str, edges: list[dict]) -> pd.DataFrame:
    texts = [json.dumps(edges[at:at + PACK]) for at in range(0, len(edges), PACK)]
    return pd.DataFrame({"feed_id": pd.Series([feed] * len(texts), dtype=object), "edges": pd.Series(texts, dtype=object)})


def _signal(feed: str, part: int, seq: int, tick: int, state: str) -> pd.DataFrame:
    return _packed(feed, [{"part": part, "seq": seq, "tick": tick, "rule_idx": -1, "late": 0, "pos": 0, "state": state, "samples_in_violation": 0}])


def _dumped(gates: dict[tuple, Gate]) -> str:
    return json.dumps([[name, g.dump()] for name, g in gates.items()])


def _loaded(text: str | None) -> dict[tuple, Gate]:
    return {tuple(name): Gate.load(g) for name, g in json.loads(text)} if text else {}


class _Gates:
    """The gates of one key. Few stand in the key's head; more are dealt over pages, of which only those in use are read and written."""

    def __init__(self, store, inline: str | None, pages: int, kept: int):
        self.store, self.pages, self.kept = store, pages, kept
        self.read = {} if pages else {0: _loaded(inline)}
        self.found: dict[tuple, Gate] = {}

    def _page(self, name: tuple) -> int:
        return zlib.crc32(json.dumps(name).encode()) % self.pages if self.pages else 0

    def _open(self, at: int) -> dict[tuple, Gate]:
        if at not in self.read:
            self.read[at] = _loaded(self.store.getValue((at,))[0]) if self.store.containsKey((at,)) else {}
        return self.read[at]

    def get(self, name: tuple) -> Gate:
        g = self.found.get(name)
        if g is None:
            page = self._open(self._page(name))
            g = page.get(name)
            if g is None:
                g = page[name] = Gate()
                self.kept += 1
            self.found[name] = g
        return g

    def save(self) -> str | None:
        """Write the pages read; the text for the head, while there are none."""
        if self.kept > 2 * PAGE * max(self.pages, 1):
            every = [gate for at in range(max(self.pages, 1)) for gate in self._open(at).items()]
            self.pages = 1 << math.ceil(math.log2(self.kept / PAGE))
            self.read = {at: {} for at in range(self.pages)}
            for name, g in every:
                self.read[self._page(name)][name] = g
        if not self.pages:
            return _dumped(self.read[0])
        for at, gates in self.read.items():
            self.store.updateValue((at,), (_dumped(gates),))
        return None


class RuleProcessor(StatefulProcessor):
    def __init__(self, rules: list[Rule], quiet_seconds: float | None = None, alive: bool = False):
        self.rules, self.quiet_seconds, self.alive = rules, quiet_seconds, alive
        self.sources = [i for i, r in enumerate(rules) if r.kind == "source-unavailable"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # Absences need every gate of missing rules in each batch, so those stand in the head; each call of the state costs.
        self.head = handle.getValueState("head", "tick long, sample long, seq long, sources string, seen string, gates string, pages int, kept int")
        self.store = handle.getMapState("pages", "k int", "v string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        feed, part = key[0], int(key[1])
        frame = _frames(rows)
        order = np.lexsort((frame["ord"].to_numpy(), frame["blk"].to_numpy()))
        tick, sample, seq, sources, seen, inline, pages, kept = self.head.get() or (0, 0, 0, None, None, None, 0, 0)
        sources = {name[0]: g for name, g in _loaded(sources).items()}
        missing = _loaded(seen)
        gates = _Gates(self.store, inline, pages, kept)
        due: dict[int, set] = {}
        for name, g in missing.items():
            self._expect(due, name, g)
        out: list[dict] = []

        for raw, available, hits in zip(*[frame[c].to_numpy()[order] for c in ("raw_timestamp", "available", "hits")]):
            tick += 1
            edges = []
            for i in self.sources if part == 0 else []:
                g = sources.setdefault(i, Gate())
                e = g.step(not available, bool(available), self.rules[i].for_samples)
                if e:
                    edges.append((i, 0, 0, "", "", e, None, None))
            if available:
                sample += 1
                for h in json.loads(hits) if hits else ():
                    name = (h["rule_idx"], h.get("sensor"), h.get("reading"))
                    rule = self.rules[name[0]]
                    absent = rule.kind == "missing"
                    g = (missing.get(name) or missing.setdefault(name, Gate())) if absent else gates.get(name)
                    if g.last == sample:
                        continue  # repeated in this sample: the first one counts
                    g.unit = h.get("unit")
                    if absent:
                        e, shown = (("cleared", sample - g.last - 1) if g.fired else None), None
                        g.fired = False
                    else:
                        shown, violates, clears = _judge(rule, g, sample, float(h.get("x", math.nan)), h.get("sig"))
                        e = g.step(violates, clears, rule.for_samples)
                    g.last = sample
                    if absent:
                        self._expect(due, name, g)
                    if e:
                        edges.append((name[0], 0, h["pos"], *name[1:], e, shown, g.unit))
                for name in due.pop(sample, ()):
                    g, need = missing[name], self.rules[name[0]].for_samples
                    if g.last == sample - need and not g.fired:
                        g.fired = True
                        edges.append((name[0], 1, 0, name[1], name[2], ("fired", need), None, g.unit))
            for i, late, pos, s, n, (state, count), shown, unit in sorted(edges, key=lambda e: e[:5]):
                seq += 1
                out.append({"part": part, "seq": seq, "tick": tick, "rule_idx": i, "late": late, "pos": pos, "state": state, "timestamp": raw,
                            "sensor": s or None, "reading": n or None, "value": shown if shown is not None and math.isfinite(shown) else None,
                            "unit": unit, "samples_in_violation": count})

        inline = gates.save()
        self.head.update((tick, sample, seq, _dumped({(i,): g for i, g in sources.items()}), _dumped(missing), inline, gates.pages, gates.kept))
        fired = any(e["state"] == "fired" for e in out)
        if self.quiet_seconds is not None:
            _rearm(self.handle, timerValues, self.quiet_seconds, fired)
        if self.alive and part == 0:
            yield _signal(feed, part, seq, tick, ALIVE)
        if out:
            yield _packed(feed, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        tick, _, seq, *_ = self.head.get()
        _rearm(self.handle, timerValues, self.quiet_seconds, True)
        yield _signal(key[0], int(key[1]), seq, tick, QUIET)

    def _expect(self, due: dict, name: tuple, g: Gate) -> None:
        """A series last seen at sample n is missing at sample n + for_samples."""
        if not g.fired:
            due.setdefault(g.last + self.rules[name[0]].for_samples, set()).add(name)


class Numbering(StatefulProcessor):
    """Dense numbers for the edges of a feed's parts.

    Both stateful steps run in the same micro-batch, and every part sees every tick, so all
    edges of a batch's ticks are here at once and none of an earlier tick can follow.
    """

    def __init__(self, quiet_seconds: float | None = None):
        self.quiet_seconds = quiet_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "seq long, tick long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        both = [e for text in _frames(rows)["edges"] for e in json.loads(text)]
        seq, _ = self.head.get() or (0, 0)
        edges = sorted((e for e in both if e["state"] != ALIVE),
                       key=lambda e: (e["tick"], e["rule_idx"], e["late"], e["pos"], e["sensor"] or "", e["reading"] or ""))
        for e in edges:
            seq += 1
            e["seq"] = seq
        self.head.update((seq, max(e["tick"] for e in both)))
        if self.quiet_seconds is not None:
            _rearm(self.handle, timerValues, self.quiet_seconds, any(e["state"] == "fired" for e in edges))
        if edges:
            yield _packed(key[0], edges)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seq, tick = self.head.get()
        _rearm(self.handle, timerValues, self.quiet_seconds, True)
        yield _signal(key[0], 0, seq, tick, QUIET)


def stream_transitions(samples: DataFrame, rules: list[Rule], spread: int = 1, quiet_seconds: float | None = None) -> DataFrame:
    """Streaming samples -> fired and cleared edges (and quiet signals). ``spread`` changes the tasks, not the rows."""
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    mode = "None" if quiet_seconds is None else "ProcessingTime"
    split = spread > 1
    edges = watched(samples, rules, spread).groupBy("feed_id", "part").transformWithStateInPandas(
        RuleProcessor(rules, None if split else quiet_seconds, split and quiet_seconds is not None), PACKED, "Append", "None" if split else mode)
    if split:
        edges = edges.groupBy("feed_id").transformWithStateInPandas(Numbering(quiet_seconds), PACKED, "Append", mode)
    each = F.from_json("edges", "array<struct<" + ",".join(f"{n}:{t}" for n, t in _EDGE.items()) + ">>")
    edges = edges.select("feed_id", F.inline(each))
    of_rule = {c: F.get(F.from_json(F.lit(json.dumps([getattr(r, n) for r in rules])), f"array<{t}>"), F.col("rule_idx")) for c, (n, t) in _OF_RULE.items()}
    edges = edges.withColumns(of_rule).select(*_NAMES)
    return edges.withColumn("value", S.finite_or_null(F.col("value"))).withColumn("threshold", S.finite_or_null(F.col("threshold")))


def stream_events(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("state") != QUIET).select(
        "feed_id", "tick", F.lit(1).alias("schema_version"), "seq", S.event_id(F.col("rule"), F.col("seq")).alias("id"),
        *[k for k in EVENT_KEYS if k not in ("schema_version", "seq", "id")])


def follow(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every event to the daily event log, dated by the time of writing.

    Each micro-batch of a query owns one folder and overwrites it when it is run
    again, so a retry leaves no event twice. The query's id lives as long as its
    checkpoint; a new checkpoint, which counts from 0 again, writes beside what is there.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.withColumn("written", F.current_date()).write.mode("overwrite").partitionBy("written").parquet(f"{path}/query={query}/batch={batch_id}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"processingTime": "10 seconds"})).start()
