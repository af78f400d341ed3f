"""The rule engine as set-based window expressions.

A feed is one *chunk* when it is no larger than ``chunk`` rows, as nearly all feeds are.
One shuffle by feed then serves everything: numbering, windows over each
(rule, series), and the order of the events. A larger feed is cut into chunks at
boundaries that a table of its blocks' counts gives; what a chunk passes on to the
next ones (run lengths, fired state, violation counts) goes through a summary of one row
per series and chunk, so even a feed that holds most of the data is spread over many tasks.

Fire and clear are found without stepping through the samples: a run reaching
``for_samples`` is a fire mark, a sample past the clear level a clear mark, and a
mark equal to the mark before it changes nothing. That holds because a valid
rule's clear region lies inside its non-violating region.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.operators import blocked, level_rules, readings as R, rule_index
from fleetpulse.operators.rules import Rule, RuleList, RuleTable
from fleetpulse.schema import RULE_SCHEMA

DEFAULT_CHUNK = 65_536
MOST_LARGE = 1_000_000  # so many feeds at most are cut, which bounds what is broadcast
NUMBERING_BLOCK = 4_096
INDEX_FROM = 64  # so many rules are no longer tried on every reading one by one
PARTITION_ROWS = 250_000  # rows that a table of rules makes of readings, to a task
SERIES = ["feed_id", "rule_idx", "sensor", "reading"]
NO_SERIES = ""  # sensor/reading of rules that watch the source itself

TRANSITION_COLUMNS = [
    "feed_id", "seq", "rule_idx", "rule", "type", "severity", "state", "timestamp", "tick",
    "sensor", "reading", "value", "unit", "threshold", "samples_in_violation",
]


def _rule_set(rules: list[Rule] | RuleTable | RuleList) -> RuleTable | RuleList:
    return RuleList(rules) if isinstance(rules, list) else rules


def match_rules(stream: DataFrame, rules: list[Rule] | RuleTable | RuleList) -> DataFrame:
    """Pair readings with the rules watching them, and pass every marker once.

    Map-side only, up to ``INDEX_FROM`` rules; more are looked up by series (``rule_index``), whose
    names are far fewer than readings. Marker rows keep a NULL rule; source rules attach to markers.
    """
    held = _rule_set(rules)
    if isinstance(held, RuleTable):
        return _matched(_match_table(stream, held), held)
    rules = held.rules
    if len(rules) > INDEX_FROM:
        on_series = rules_frame(stream.sparkSession, rules).where("kind <> 'source-unavailable'")
        readings = rule_index.watched_readings(stream.where(F.col("pos") != R.MARKER_POS), on_series)
        sources = F.array(F.lit(None).cast("int"), *[F.lit(i) for i, r in enumerate(rules) if r.kind == "source-unavailable"])
        markers = stream.where(F.col("pos") == R.MARKER_POS).withColumn("rule_idx", F.explode(sources))
        return _matched(readings.unionByName(markers), held)
    tagged = stream.withColumn("sensor_lc", F.lower("sensor")).withColumn("reading_lc", F.lower("reading"))
    marker = F.col("pos") == R.MARKER_POS
    series_hits = [
        F.when(r.matches(), F.lit(i)) for i, r in enumerate(rules) if r.kind != "source-unavailable"
    ]
    source_ids = [F.lit(i) for i, r in enumerate(rules) if r.kind == "source-unavailable"]
    none = F.array().cast("array<int>")
    on_reading = F.filter(F.array(*series_hits), lambda h: h.isNotNull()) if series_hits else none
    on_marker = F.array(F.lit(None).cast("int"), *source_ids)
    paired = tagged.withColumn(
        "rule_idx", F.explode_outer(F.when(marker, on_marker).otherwise(on_reading).cast("array<int>"))
    ).where(marker | F.col("rule_idx").isNotNull())
    return _matched(paired, held)


def _match_table(stream: DataFrame, rules: RuleTable) -> DataFrame:
    """The same for a table of rules, whose parameters come along."""
    marker = F.col("pos") == R.MARKER_POS
    readings = rule_index.watched_readings(stream.where(~marker), rules.of_kind("source-unavailable", False), rules.carried)
    markers = stream.where(marker)
    if "source-unavailable" in rules.kinds:
        sources = rules.of_kind("source-unavailable").select("rule_idx", *rules.carried)
        readings = readings.unionByName(markers.crossJoin(sources))
    return readings.unionByName(markers, allowMissingColumns=True)


def _matched(paired: DataFrame, rules: RuleTable | RuleList) -> DataFrame:
    """The columns that the rules of readings and markers need."""
    marker = F.col("pos") == R.MARKER_POS
    metric = S.select_metric(rules.get("metric"), *[F.col(c) for c in ("value", "min", "max", "avg")])
    # Text keeps NaN equal to itself and -0.0 apart from 0.0, like a bit compare.
    frozen = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in ("value", "min", "max", "avg")])
    return paired.select(
        "feed_id", "blk", "ord", "raw_timestamp", "available", "pos",
        F.when(marker & F.col("rule_idx").isNotNull(), F.lit(NO_SERIES)).otherwise(F.col("sensor")).alias("sensor"),
        F.when(marker & F.col("rule_idx").isNotNull(), F.lit(NO_SERIES)).otherwise(F.col("reading")).alias("reading"),
        "unit", "rule_idx",
        F.when(marker, F.when(F.col("available"), 0.0).otherwise(1.0)).otherwise(metric).alias("x"),
        (F.when(rules.get("kind") == "stale", frozen) if "stale" in rules.kinds else F.lit(None).cast("string")).alias("sig"),
        *rules.carried,
    )


def tick_numbers(ticks: DataFrame) -> DataFrame:
    """(feed_id, blk, ord) -> dense ``tick`` and ``sample`` numbers, block by block."""
    flags = ticks.select(
        "feed_id", "blk", "ord", "raw_timestamp", "available",
        F.lit(1).cast("long").alias("__one"), F.col("available").cast("long").alias("__av"),
    )
    return blocked.running(
        flags, ["feed_id"], "blk", ["ord"],
        [blocked.Running("tick", "sum", F.col("__one")), blocked.Running("sample", "sum", F.col("__av"))],
        inclusive=True,
    ).drop("__one", "__av")


def number_matches(matched: DataFrame, stream: DataFrame) -> DataFrame:
    """Give every matched row its dense tick and sample number.

    Matched rows and markers are grouped by (feed, blk), which is bounded; the
    offsets of earlier blocks come from one count per block.
    """
    w = Window.partitionBy("feed_id", "blk").orderBy("ord").rangeBetween(Window.unboundedPreceding, 0)
    is_marker = F.col("rule_idx").isNull()
    local = matched.select(
        "*",
        F.count(F.when(is_marker, True)).over(w).alias("__t"),
        F.count(F.when(is_marker & F.col("available"), True)).over(w).alias("__s"),
    ).where(F.col("rule_idx").isNotNull())
    before = Window.partitionBy("feed_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        R.markers(stream).groupBy("feed_id", "blk")
        .agg(F.count(F.lit(1)).alias("__bt"), F.count_if("available").alias("__bs"))
        .select("feed_id", "blk",
                F.coalesce(F.sum("__bt").over(before), F.lit(0)).alias("__ot"),
                F.coalesce(F.sum("__bs").over(before), F.lit(0)).alias("__os"))
    )
    return local.join(offsets, ["feed_id", "blk"]).select(
        "feed_id", "rule_idx", "sensor", "reading", "pos", "x", "sig",
        (F.col("__t") + F.col("__ot")).alias("tick"),
        (F.col("__s") + F.col("__os")).alias("sample"),
        "unit", "raw_timestamp",
    )


def large_feeds(stream: DataFrame, chunk: int, back: int) -> DataFrame:
    """(feed_id, per): feeds of more than ``chunk`` rows, and how many of their samples make a chunk.

    A feed with less than a millionth of all rows is never cut, so there are at most ``MOST_LARGE``.
    """
    marker = F.col("pos") == R.MARKER_POS
    sizes = stream.groupBy("feed_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(marker & F.col("available")).alias("samples"))
    per = F.greatest(F.lit(back), F.floor(F.lit(chunk) * F.col("samples") / F.col("rows"))).cast("long")
    every = sizes.agg(F.sum("rows").alias("every"))
    return sizes.withColumn("per", per).crossJoin(every).where(
        (F.col("samples") > F.col("per")) & (F.col("rows") * MOST_LARGE > F.col("every"))).select("feed_id", "per")


def feed_cuts(stream: DataFrame, large: DataFrame, back: int) -> DataFrame:
    """(feed_id, blk, home, chunks, ticks_before, samples_before, samples) of the large feeds' blocks.

    ``home`` is the block's chunk; ``chunks`` are that one and those that need the block's rows to
    look back ``back`` samples. Chunks begin at block borders; a stretch without samples is not cut.
    """
    counts = (
        R.markers(stream).join(F.broadcast(large), "feed_id").groupBy("feed_id", "blk", "per")
        .agg(F.count(F.lit(1)).alias("ticks"), F.count_if("available").alias("samples")))
    before = Window.partitionBy("feed_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("ticks", "samples")})
    end = F.col("samples_before") + F.col("samples")
    number = [F.floor(x / F.col("per")).cast("long") for x in (F.col("samples_before"), end, end + back - 1)]
    return placed.select(
        "feed_id", "blk", number[0].alias("home"), F.array_distinct(F.array(*number)).alias("chunks"), "ticks_before", "samples_before", "samples")


def _numbered(placed: DataFrame, keys: list[str], rules: RuleTable | RuleList, ahead: bool) -> DataFrame:
    """Tick, sample and ``idx``, the number that a rule goes by, of the rows that rules watch.

    ``placed`` has the markers too, and the counts before each key's first block. With ``ahead``, rows of missing
    rules also get tick and time of the sample that is ``for_samples`` later, and the number of
    samples; that takes whole feeds.
    """
    w = Window.partitionBy(*keys).orderBy("blk", "ord")
    is_marker = F.col("rule_idx").isNull()
    sampled = is_marker & F.col("available")
    out = placed.withColumns({
        "tick": F.count(F.when(is_marker, True)).over(w) + F.first("ticks_before").over(w),
        "sample": F.count(F.when(sampled, True)).over(w) + F.first("samples_before").over(w)})
    if ahead:
        kind, need = rules.get("kind"), rules.get("for_samples")
        later = F.lit(None).cast("struct<tick: bigint, raw_timestamp: string>")
        for n in rules.waits:
            there = Window.partitionBy(*keys).orderBy("sample").rangeBetween(n, n)
            then = F.min(F.when(sampled, F.struct("tick", "raw_timestamp"))).over(there)
            later = F.when((kind == "missing") & (need == n), then).otherwise(later)
        out = out.withColumn("later", later).withColumn("n_samples", F.max("sample").over(Window.partitionBy(*keys)))
    kind = rules.get("kind")
    idx = F.when(kind == "source-unavailable", F.col("tick")).otherwise(F.col("sample"))
    return out.where(~is_marker).withColumn("idx", idx).drop("blk", "ord", "available", "ticks_before", "samples_before", "sample")


def _judged(chunked: DataFrame, rules: RuleTable | RuleList) -> DataFrame:
    """Fold duplicates and give each row its verdict ``v``: 1 violates, -1 clears,
    0 neither; plus run lengths inside the chunk."""
    w = Window.partitionBy(*SERIES, "chunk").orderBy("idx", "pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first = chunked.withColumn("__d", F.lag("idx").over(w)).where(F.col("__d").isNull() | (F.col("__d") != F.col("idx"))).drop("__d")

    kind = rules.get("kind")
    widths = rules.widths
    looked = first.withColumn("prev_idx", F.lag("idx").over(w)).withColumn("prev_unit", F.lag("unit").over(w))
    whole = [c for c in ("later", "n_samples") if c in chunked.columns]
    if whole:
        looked = looked.withColumn("prev_later", F.lag("later").over(w))
        whole += ["prev_later"]
    if "stale" in rules.kinds:
        looked = looked.withColumn("__sig", F.lag("sig").over(w))
    for n in widths:
        looked = looked.withColumn(f"__i{n}", F.lag("idx", n).over(w)).withColumn(f"__x{n}", F.lag("x", n).over(w))

    start = F.col("prev_idx").isNull() | (F.col("idx") - F.col("prev_idx") != 1)
    delta = F.lit(None).cast("double")
    back = rules.get("lookback")
    for n in widths:
        full = F.col("idx") - F.col(f"__i{n}") == n
        delta = F.when((back == n) & full, F.col("x") - F.col(f"__x{n}")).otherwise(delta)
    compared = F.when(kind == "rate", delta).otherwise(F.col("x"))

    looked = looked.withColumn("start", start).withColumn("cmp", compared)
    op = rules.get("op")
    valued = (
        F.when(F.col("cmp").isNull() | F.isnan("cmp"), 0)
        .when(S.compare(op, F.col("cmp"), rules.get("threshold")), 1)
        .when(~S.compare(op, F.col("cmp"), rules.get("clear_level")), -1)
        .otherwise(0)
    )
    verdict = F.when(kind.isin("threshold", "rate"), valued)
    if "__sig" in looked.columns:
        verdict = verdict.when(
            kind == "stale", F.when(F.col("start"), 0).when(F.col("__sig") == F.col("sig"), 1).otherwise(-1))
    verdict = verdict.when(kind == "source-unavailable", F.when(F.col("x") == 1.0, 1).otherwise(-1)).otherwise(0)

    judged = looked.withColumn("v", verdict).where(~F.col("halo"))
    counted = judged.withColumn("cum", F.count(F.when(F.col("v") == 1, True)).over(upto)).withColumn(
        "last_clear", F.max(F.when(F.col("v") == -1, F.col("idx"))).over(upto))
    broken = counted.withColumn(
        "base", F.max(F.when(F.col("v") != 1, F.col("cum")).when(F.col("start"), F.col("cum") - 1)).over(upto))
    return broken.select(
        *SERIES, "chunk", "idx", "pos", "tick", "prev_idx", "prev_unit",
        "unit", "raw_timestamp", "cmp", "v", "cum", "last_clear", *whole, *rules.carried,
        F.col("base").isNull().alias("leading"),
        (F.col("cum") - F.coalesce("base", F.lit(0))).alias("run"),
    )


def _summaries(judged: DataFrame, rules: RuleTable | RuleList) -> DataFrame:
    """One row per (series, chunk)."""
    need = rules.get("for_samples")
    fires = (F.col("v") == 1) & ~F.col("leading") & (F.col("run") == need)
    return blocked.shuffled_once(judged, [*SERIES, "chunk"], [
        F.count_if(F.col("v") == 1).alias("n_v"),
        F.count_if("leading").alias("lead"),
        F.bool_and("leading").alias("whole"),
        F.max_by("run", "idx").alias("trail"),
        F.max(F.when(F.col("v") == -1, F.col("idx"))).alias("clear_idx"),
        F.max(F.when(fires, F.col("idx"))).alias("fire_idx"),
        # violations counted at the first fire after the chunk's last clear
        F.min(F.when(fires, F.struct(-F.coalesce("last_clear", F.lit(-1)), F.col("cum").alias("cum")))).alias("fire_at"),
        F.max("idx").alias("last_idx"),
        F.max_by("unit", "idx").alias("last_unit"),
        *[F.first(c).alias(c) for c in rules.carried],
    ])


def _carried(summaries: DataFrame, rules: RuleTable | RuleList) -> DataFrame:
    """What each chunk inherits from the chunks before it."""
    upto = Window.partitionBy(*SERIES).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*SERIES).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    prior = Window.partitionBy(*SERIES).orderBy("chunk")
    need = rules.get("for_samples")

    led = summaries.withColumn("__s", F.sum(F.when(F.col("whole"), F.col("lead")).otherwise(0)).over(upto))
    led = led.withColumn("__r", F.last(F.when(~F.col("whole"), F.col("trail") - F.col("__s")), ignorenulls=True).over(upto))
    led = led.withColumn("__out", F.col("__s") + F.coalesce("__r", F.lit(0)))
    led = led.withColumn("run_in", F.coalesce(F.lag("__out").over(prior), F.lit(0)))
    lead_fires = (F.col("lead") > 0) & (F.col("run_in") < need) & (need <= F.col("run_in") + F.col("lead"))
    mark = (
        F.when(F.col("fire_idx").isNotNull() & (F.col("clear_idx").isNull() | (F.col("fire_idx") > F.col("clear_idx"))), 1)
        .when(F.col("clear_idx").isNotNull(), -1)
        .when(lead_fires, 1)
    )
    marked = led.withColumn("__m", mark)
    marked = marked.withColumn("fired_in", F.coalesce(F.last("__m", ignorenulls=True).over(before), F.lit(-1)) == 1)
    marked = marked.withColumn("cum_in", F.coalesce(F.sum("n_v").over(before), F.lit(0)))
    fire_cum = F.when(
        F.col("__m") == 1,
        F.when(F.col("clear_idx").isNotNull(), F.col("cum_in") + F.col("fire_at.cum"))
        .when(F.col("fired_in"), None)
        .when(lead_fires, F.col("cum_in") + need - F.col("run_in"))
        .otherwise(F.col("cum_in") + F.col("fire_at.cum")),
    )
    marked = marked.withColumn("__f", fire_cum)
    return marked.select(
        *SERIES, "chunk", "run_in", "fired_in", "cum_in",
        F.last("__f", ignorenulls=True).over(before).alias("fire_cum_in"),
        F.lag("last_idx").over(prior).alias("last_idx_in"),
        F.lag("last_unit").over(prior).alias("last_unit_in"),
        "last_idx", "last_unit", *rules.carried,
        F.lead("chunk").over(prior).isNull().alias("is_last"),
    )


def _edge(state: str | Column, place: int, pos: Column, tick: Column, at: Column, value: Column, unit: Column, n: Column, raw: Column) -> Column:
    return F.struct(
        (F.lit(state) if isinstance(state, str) else state).alias("state"), F.lit(place).alias("pass"), pos.cast("long").alias("pos"),
        tick.cast("long").alias("tick"), at.cast("long").alias("at_sample"), value.cast("double").alias("value"), unit.alias("unit"),
        raw.cast("string").alias("raw_timestamp"),
        n.cast("long").alias("samples_in_violation"),
    )


def _edges(rows: DataFrame, rules: RuleTable | RuleList) -> DataFrame:
    """Every edge that shows at a matched row, from one pass over the rows.

    A gated row gives at most one edge. A row of a missing rule that ends an
    absence gives two: the fire back when the absence had lasted long enough, at
    a sample the series is not in, and the clear here. No absent sample is
    enumerated: an absence is a jump in the sample numbers.
    """
    w = Window.partitionBy(*SERIES, "chunk").orderBy("idx")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    need = rules.get("for_samples")
    kind = rules.get("kind")
    run = F.when(F.col("leading"), F.col("run") + F.col("run_in")).otherwise(F.col("run"))
    mark = F.when((F.col("v") == 1) & (run == need), 1).when(F.col("v") == -1, -1)
    m = rows.withColumn("__m", mark).withColumn("__total", F.col("cum") + F.col("cum_in"))
    m = m.withColumn("__p", F.coalesce(
        F.last("__m", ignorenulls=True).over(before), F.when(F.col("fired_in"), 1).otherwise(-1)))
    m = m.withColumn("__edge", F.coalesce(F.col("__m") != F.col("__p"), F.lit(False)))
    m = m.withColumn("__fc", F.coalesce(
        F.last(F.when(F.col("__edge") & (F.col("__m") == 1), F.col("__total")), ignorenulls=True).over(before),
        F.col("fire_cum_in")))
    fired = F.col("__m") == 1
    own = F.when(kind == "source-unavailable", -F.col("tick")).otherwise(F.col("idx"))  # ticks have no sample to look up
    gated = F.when(F.col("__edge"), _edge(
        F.when(fired, "fired").otherwise("cleared"), 0, F.col("pos"), F.col("tick"), own,
        F.when(kind != "source-unavailable", F.col("cmp")), F.col("unit"),
        F.when(fired, need).otherwise(F.col("__total") - F.col("__fc") + need), F.col("raw_timestamp")))
    found = [gated]
    if "missing" in rules.kinds:
        seen = F.coalesce("prev_idx", "last_idx_in")
        unit = F.when(F.col("prev_idx").isNotNull(), F.col("prev_unit")).otherwise(F.col("last_unit_in"))
        gap = F.col("idx") - seen - 1
        ended = (kind == "missing") & (gap >= need)
        none, pos = F.lit(None), F.lit(0)
        whole = "later" in rows.columns
        at_fire = [F.col(f"prev_later.{c}") if whole else none for c in ("tick", "raw_timestamp")]
        found += [
            F.when(ended, _edge("cleared", 0, F.col("pos"), F.col("tick"), own, none, F.col("unit"), gap, F.col("raw_timestamp"))),
            F.when(ended, _edge("fired", 1, pos, at_fire[0], seen + need, none, unit, need, at_fire[1])),
        ]
        if whole:
            last = F.lead("idx").over(w).isNull()
            m = m.withColumn("__last", last)
            never = (kind == "missing") & F.col("__last") & (F.col("n_samples") - F.col("idx") >= need)
            found += [F.when(never, _edge("fired", 1, pos, F.col("later.tick"), F.col("idx") + need, none, F.col("unit"), need, F.col("later.raw_timestamp")))]
    each = m.select(*SERIES, F.explode_outer(F.filter(F.array(*found), lambda e: e.isNotNull())).alias("e"))
    return each.where(F.col("e").isNotNull()).select(*SERIES, "e.*")


def _still_missing(carried: DataFrame, sizes: DataFrame, rules: RuleTable | RuleList) -> DataFrame:
    """Fires of series that never came back: from the last row to the feed's end."""
    need = rules.get("for_samples")
    kind = rules.get("kind")
    none = F.lit(None)
    out = (
        carried.where((kind == "missing") & F.col("is_last")).join(sizes, "feed_id")
        .where(F.col("n_samples") - F.col("last_idx") >= need)
    )
    edge = _edge("fired", 1, F.lit(0), none, F.col("last_idx") + need, none, F.col("last_unit"), need, none)
    return out.select(*SERIES, edge.alias("e")).select(*SERIES, "e.*")


EDGE_COLUMNS = [
    "feed_id", "tick", "rule_idx", "pass", "pos", "sensor", "reading", "state", "value", "unit", "raw_timestamp", "samples_in_violation"]
EDGE_ORDER = ["tick", "rule_idx", "pass", "pos", "sensor", "reading"]


def _whole_feeds(matched: DataFrame, rules: RuleTable | RuleList) -> DataFrame:
    """Numbered edges of feeds that are one chunk: windows by feed or finer, so one shuffle does."""
    zero = F.lit(0).cast("long")
    placed = matched.withColumns({"ticks_before": zero, "samples_before": zero})
    numbered = _numbered(placed, ["feed_id"], rules, "missing" in rules.kinds).withColumns({"chunk": zero, "halo": F.lit(False)})
    nothing = F.lit(None)
    carried = {"run_in": zero, "fired_in": F.lit(False), "cum_in": zero, "fire_cum_in": nothing.cast("long"),
               "last_idx_in": nothing.cast("long"), "last_unit_in": nothing.cast("string")}
    edges = _edges(_judged(numbered, rules).withColumns(carried), rules).select(*EDGE_COLUMNS)
    return edges.withColumn("seq", F.row_number().over(Window.partitionBy("feed_id").orderBy(*EDGE_ORDER)).cast("long"))


def _cut_feeds(matched: DataFrame, stream: DataFrame, large: DataFrame, back: int, rules: RuleTable | RuleList) -> DataFrame:
    """Numbered edges of feeds of several chunks."""
    cuts = feed_cuts(stream, large, back)
    placed = matched.join(F.broadcast(large.select("feed_id")), "feed_id", "left_semi").join(cuts.drop("samples"), ["feed_id", "blk"])
    placed = placed.withColumn("chunk", F.explode("chunks")).withColumn("halo", F.col("chunk") != F.col("home")).drop("chunks", "home")
    numbered = _numbered(placed, ["feed_id", "chunk"], rules, ahead=False)
    judged = _judged(blocked.not_null(numbered, [*SERIES, "chunk"]), rules)
    carried = _carried(_summaries(judged, rules), rules)
    rows = judged.join(
        carried.select(*SERIES, "chunk", "run_in", "fired_in", "cum_in", "fire_cum_in", "last_idx_in", "last_unit_in"),
        [*SERIES, "chunk"],
    )
    edges = _edges(rows, rules)
    if "missing" in rules.kinds:
        sizes = cuts.groupBy("feed_id").agg(F.sum("samples").alias("n_samples"))
        edges = edges.unionByName(_still_missing(carried, sizes, rules))
        # A fire at a sample the series is not in takes its time from that sample.
        ticks = R.markers(stream).join(F.broadcast(large.select("feed_id")), "feed_id", "left_semi")
        at = tick_numbers(ticks).where("available").select(
            "feed_id", F.col("sample").alias("at_sample"), F.col("tick").alias("at_tick"), F.col("raw_timestamp").alias("at_raw"))
        back_dated = edges.where("tick IS NULL").drop("tick", "raw_timestamp").join(at, ["feed_id", "at_sample"])
        back_dated = back_dated.withColumnsRenamed({"at_tick": "tick", "at_raw": "raw_timestamp"})
        edges = edges.where("tick IS NOT NULL").unionByName(back_dated)
    edges = edges.select(*EDGE_COLUMNS, F.floor(F.col("tick") / NUMBERING_BLOCK).cast("long").alias("__blk"))
    return blocked.row_numbers(edges, ["feed_id"], "__blk", EDGE_ORDER, "seq", derived=True).drop("__blk")


def transitions(stream: DataFrame, rules: list[Rule] | RuleTable, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """Every fired and cleared edge of every rule, numbered per feed in the order
    tick, rule, present readings by position, absent series by name.

    State starts fresh at the first row of ``stream``: filter the stream to a
    window first and this answers "what fired in the window?". ``chunk`` is the size, in
    rows, from which a feed is cut.
    """
    rules = _rule_set(rules)
    back = rules.back
    large = large_feeds(stream, chunk, back)
    few = F.broadcast(large.select("feed_id"))
    if isinstance(rules, RuleTable) and level_rules.applies(rules):
        if large.isEmpty():  # nearly always; the rest of the plan would take the driver longer than many a job
            named = level_rules.edges(stream, rules)
        else:
            cut = _cut_feeds(match_rules(stream.join(few, "feed_id", "left_semi"), rules), stream, large, back, rules)
            named = level_rules.edges(stream.join(few, "feed_id", "left_anti"), rules).unionByName(rules.named(cut), allowMissingColumns=True)
    else:
        matched = match_rules(stream, rules)
        whole = _whole_feeds(matched.join(few, "feed_id", "left_anti").repartition(_partitions(stream, rules), "feed_id"), rules)
        # What follows from the rule alone is added last, outside the shuffles.
        named = rules.named(whole.unionByName(_cut_feeds(matched, stream, large, back, rules)))
    no_series = F.col("rule_kind") == "source-unavailable"
    return named.select(
        "feed_id", "seq", "rule_idx", F.col("rule_name").alias("rule"), F.col("rule_kind").alias("type"), F.col("rule_severity").alias("severity"),
        "state", F.col("raw_timestamp").alias("timestamp"), "tick",
        *[F.when(~no_series, F.col(c)).alias(c) for c in ("sensor", "reading")], "value",
        F.when(~no_series, F.col("unit")).alias("unit"), F.col("rule_threshold").alias("threshold"),
        "samples_in_violation",
    ).select(*TRANSITION_COLUMNS)


def _partitions(stream: DataFrame, rules: RuleTable | RuleList) -> int:
    """Partitions for whole feeds: by the input's size, and for a table of rules by the rows that they make of it."""
    by_size = blocked.partitions_for(stream)
    if isinstance(rules, RuleList):
        return by_size
    readings = stream.where(F.col("pos") != R.MARKER_POS)
    return max(by_size, -(-rule_index.watched_total(readings, rules.of_kind("source-unavailable", False)) // PARTITION_ROWS))


def to_events(transitions_: DataFrame) -> DataFrame:
    """Transitions -> event records: fixed keys in fixed order, NaN as NULL."""
    return transitions_.select(
        "feed_id",
        F.lit(1).alias("schema_version"), "seq",
        S.event_id(F.col("rule"), F.col("seq")).alias("id"),
        "rule", "type", "severity", "state", "timestamp", "sensor", "reading",
        S.finite_or_null(F.col("value")).alias("value"), "unit", "threshold",
        F.col("samples_in_violation").cast("long").alias("samples_in_violation"),
    )


def event_json(events: DataFrame, name: str = "event") -> DataFrame:
    """One JSON line per event, NULL fields written as null."""
    return events.select("feed_id", "seq", S.event_object().alias(name))


def first_fires(events: DataFrame) -> DataFrame:
    """The earliest fired event of each feed."""
    fired = events.where("state = 'fired'")
    first = fired.groupBy("feed_id").agg(F.min("seq").alias("seq"))
    return fired.join(first, ["feed_id", "seq"], "left_semi")


def rules_frame(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    rows = [{"rule_idx": i, **asdict(r)} for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULE_SCHEMA)
