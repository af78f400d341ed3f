"""Alert lifecycle over the event table: contract check, acknowledgement,
incidents, escalation, reconciliation, routing and status.

Events carry ``seq`` (delivery order within a feed) and ``processed_at``; running
state is computed in blocks of the sequence, so a feed or a rule with very many
events is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.operators import blocked
from fleetpulse.schema import (
    ACKED_IDS_KEPT, DEFAULT_BLIND_AFTER, DEFAULT_COOLDOWN_SECONDS, DEFAULT_DAILY_CAP,
    DEFAULT_SNOOZE_SECONDS, EVENT_KINDS, EVENT_SCHEMA_VERSION, SEVERITIES, STATES,
)
from fleetpulse.session import written

SEQ_BLOCK = 4_096


def _blocked(events: DataFrame) -> DataFrame:
    return events.withColumn("__sb", F.floor(F.col("seq") / SEQ_BLOCK).cast("long"))


# --- event contract ---------------------------------------------------------------

def check_events(lines: DataFrame, column: str = "line") -> DataFrame:
    """Add ``reasons`` (array of text, empty when valid) to JSON event lines.

    Every line is made and parsed once, and every field is read once: as plain columns they would be
    put into each of the checks that use them, and be worked out again there.
    """
    once = lambda df, name, **cols: df.withColumn(name, F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))))
    base = once(lines, "__at", line=F.col(column))
    base = once(base, "__in", doc=F.try_parse_json("__at.line"), keys=F.map_keys(F.from_json("__at.line", "map<string,string>")))
    fields = {}
    for key in EVENT_KINDS:
        fields[f"{key}_type"] = F.schema_of_variant(F.try_variant_get("__in.doc", f"$.{key}", "variant"))
        fields[f"{key}_text"] = F.try_variant_get("__in.doc", f"$.{key}", "string")
        fields[f"{key}_there"] = F.coalesce(F.array_contains("__in.keys", key), F.lit(False))
    base = once(base, "__got", kind=F.schema_of_variant("__in.doc"), **fields)
    is_object = F.coalesce(F.col("__got.kind").startswith("OBJECT"), F.lit(False))
    checks = [F.when(~is_object, F.lit("not an object"))]
    for key in EVENT_KINDS:
        ty, text = F.col(f"__got.{key}_type"), F.col(f"__got.{key}_text")
        absent = ~F.col(f"__got.{key}_there")
        is_null = F.coalesce(ty == "VOID", F.lit(True))
        is_text = F.coalesce(ty == "STRING", F.lit(False))
        is_int = F.coalesce(ty == "BIGINT", F.lit(False))
        is_num = is_int | F.coalesce(ty.startswith("DECIMAL") | ty.isin("DOUBLE", "FLOAT"), F.lit(False))
        want = EVENT_KINDS[key]
        ok = {
            "int": is_int,
            "text": is_text, "text!": is_text & (text != ""), "text?": is_null | is_text, "number?": is_null | is_num,
            "severity": is_text & text.isin(SEVERITIES), "state": is_text & text.isin(STATES),
            "instant": is_text & ~text.rlike(r"\s") & F.try_to_timestamp(text).isNotNull() & (text != ""),
        }[want]
        if key == "schema_version":
            ok = is_int & (text == str(EVENT_SCHEMA_VERSION))
        checks.append(F.when(is_object & absent, F.lit(f"{key} missing")))
        checks.append(F.when(is_object & ~absent & ~F.coalesce(ok, F.lit(False)), F.lit(f"{key} invalid")))
    reasons = F.filter(F.array(*checks), lambda r: r.isNotNull())
    return base.withColumn("reasons", reasons).drop("__at", "__in", "__got")


# --- acknowledgement ---------------------------------------------------------------

def distinct_deliveries(events: DataFrame) -> DataFrame:
    """One row per (feed, id): redeliveries carry the same content."""
    return events.dropDuplicates(["feed_id", "id"])


def unacked(events: DataFrame, acks: DataFrame) -> DataFrame:
    return distinct_deliveries(events.join(acks.select("feed_id", "id"), ["feed_id", "id"], "left_anti"))


def ack_cursor(acks: DataFrame, keep: int = ACKED_IDS_KEPT) -> DataFrame:
    """High-water mark and the newest acknowledged ids, newest last.

    An id counts at its first acknowledgement. The ids are cut to ``keep`` by a
    rank limit before they are collected.
    """
    first = acks.groupBy("feed_id", "id").agg(F.min("ack_ord").alias("ack_ord"), F.min("seq").alias("seq"))
    high = first.groupBy("feed_id").agg(F.max("seq").alias("last_acked_seq"), F.count(F.lit(1)).alias("acked_total"))
    ring = (
        blocked.top_per_key(first, ["feed_id"], [F.desc("ack_ord"), F.desc("id")], keep)
        .groupBy("feed_id").agg(F.array_sort(F.collect_list(F.struct("ack_ord", "id"))).alias("__ids"))
        .select("feed_id", F.transform("__ids", lambda x: x["id"]).alias("recent_ids"))
    )
    return high.join(ring, "feed_id")


# --- incidents ---------------------------------------------------------------------

def tag_incidents(events: DataFrame, snooze_seconds: int = DEFAULT_SNOOZE_SECONDS) -> DataFrame:
    """Give every event its incident: the number of clears of its rule before it.

    Adds ``repeat`` (a redelivered id), ``opens`` (a fired, non-benign, first
    delivery), ``incident_no`` and ``continuation`` (inside the snooze of an
    earlier event of the same incident).
    """
    first = events.groupBy("feed_id", "id").agg(F.min("seq").alias("__first"))
    e = events.join(first, ["feed_id", "id"]).withColumn("repeat", F.col("seq") > F.col("__first")).drop("__first")
    e = e.withColumn("opens", (F.col("state") == "fired") & (F.col("classification") != "benign") & ~F.col("repeat"))
    clear = ((F.col("state") == "cleared") & ~F.col("repeat")).cast("long")
    wakes = (F.col("state") == "fired") & (F.col("classification") != "benign")
    e = blocked.running(
        _blocked(e), ["feed_id", "rule"], "__sb", ["seq"],
        [blocked.Running("incident_no", "sum", clear),
         blocked.Running("__woke", "last", F.when(wakes, F.struct("seq", "processed_at"))),
         blocked.Running("__shut", "max", F.when(clear == 1, F.col("seq")))],
        derived=True,
    )
    inside = (F.col("__woke.seq") > F.coalesce("__shut", F.lit(-1))) & (
        F.col("processed_at") < F.col("__woke.processed_at") + F.make_interval(secs=F.lit(snooze_seconds)))
    return e.withColumn("continuation", F.coalesce(inside & (F.col("state") == "fired"), F.lit(False))).drop("__woke", "__shut", "__sb")


def incidents(tagged: DataFrame, snooze_seconds: int = DEFAULT_SNOOZE_SECONDS) -> DataFrame:
    """One row per incident. A group without an opening event is none: its clear
    found nothing open, its benign events were only noted."""
    opens, closes = F.col("opens"), (F.col("state") == "cleared") & ~F.col("repeat")
    wakes = (F.col("state") == "fired") & (F.col("classification") != "benign")
    rows = tagged.groupBy("feed_id", "rule", "incident_no").agg(
        F.count_if(opens).alias("__o"), F.count_if(closes).alias("__c"),
        F.max(F.when(opens, S.severity_rank(F.col("severity")))).alias("__sev"),
        F.max_by("classification", F.when(opens, F.col("seq"))).alias("classification"),
        F.min(F.when(opens, F.col("seq"))).alias("opened_seq"),
        F.min_by("processed_at", F.when(opens, F.col("seq"))).alias("opened"),
        F.max_by("processed_at", F.when(wakes, F.col("seq"))).alias("__woke"),
        F.max(F.when(opens | closes, F.col("processed_at"))).alias("last_event"),
        F.max(F.when(closes, F.col("seq"))).alias("closed_seq"),
        F.max(F.when(closes, F.col("processed_at"))).alias("closed"),
    ).where(F.col("__o") > 0)
    # Redeliveries before the opening event cannot re-snooze anything: they repeat it.
    return rows.select(
        "feed_id", "rule", "incident_no", S.severity_name(F.col("__sev")).alias("severity"), "classification",
        (F.col("__o") + F.col("__c")).alias("events"), "opened_seq", "opened",
        (F.col("__woke") + F.make_interval(secs=F.lit(snooze_seconds))).alias("snooze_until"),
        "last_event", "closed_seq", "closed",
        F.when(F.col("__c") > 0, "closed").otherwise("open").alias("status"),
    )


def continuations(pending: DataFrame, incidents_: DataFrame, now: Column) -> DataFrame:
    """Pending events whose rule has an open incident still inside its snooze.
    There is at most one open incident per (feed, rule), so nothing multiplies."""
    live = incidents_.where((F.col("status") == "open") & (F.col("opened") <= now) & (now < F.col("snooze_until")))
    return pending.join(live.select("feed_id", "rule", "incident_no", "snooze_until"), ["feed_id", "rule"])


# --- escalation --------------------------------------------------------------------

def escalation_tiers(tagged: DataFrame) -> DataFrame:
    """Tier 0..4 of every first-delivered event.

    cleared and info 0; warning 1, or 2 from the third event of its incident on;
    critical 2, or 3 from the third on, and 4 while two or more rules have a
    critical incident open.
    """
    e = _blocked(tagged.where(~F.col("repeat")))
    inc = ["feed_id", "rule", "incident_no"]
    rank = F.when(F.col("opens"), S.severity_rank(F.col("severity")))
    e = blocked.running(
        e, inc, "__sb", ["seq"],
        [blocked.Running("persistence", "sum", F.col("opens").cast("long")), blocked.Running("__worst", "max", rank)],
        derived=True,
    )
    critical = SEVERITIES.index("critical")
    was = F.coalesce(F.col("__worst") == critical, F.lit(False))
    turns = F.coalesce(rank == critical, F.lit(False)) & ~was
    shuts = (F.col("state") == "cleared") & was
    e = e.withColumn("persistence", F.col("persistence") + F.col("opens").cast("long"))
    e = e.withColumn("__step", turns.cast("long") - shuts.cast("long"))
    e = e.withColumn("__own", was | turns)
    e = blocked.running(
        e, ["feed_id"], "__sb", ["seq"], [blocked.Running("__before", "sum", F.col("__step"))], derived=True)
    open_rules = F.col("__before") + F.col("__step") + F.when(F.col("__own"), 0).otherwise(1)
    tier = (
        F.when((F.col("state") == "cleared") | (F.col("severity") == "info"), 0)
        .when(F.col("severity") == "warning", F.when(F.col("persistence") >= 3, 2).otherwise(1))
        .when(open_rules >= 2, 4)
        .when(F.col("persistence") >= 3, 3).otherwise(2)
    )
    return e.withColumn("tier", tier).drop("__worst", "__step", "__own", "__before", "__sb")


DAY_US = 86_400_000_000
_DAY = ["feed_id", "day"]


def _day_deliveries(cooldown_us: int, cap: int):
    """Deliveries of every day: the next one is the earliest later point whose rule is free.

    Rows are sorted by day; those that are no points come first and say until when
    a rule is still cooling down. A day may span batches: kept are its count and
    the times at which its delivered rules are free again.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, sent, free = None, 0, {}
        for b in batches:
            feed, day, us, point = (b[c].to_numpy() for c in ("feed_id", "day", "us", "point"))
            code, names = pd.factorize(b["rule"])
            code_of = {r: c for c, r in enumerate(names)}
            edges = np.flatnonzero((feed[1:] != feed[:-1]) | (day[1:] != day[:-1])) + 1
            found = []
            for k, end in pairwise([0, *edges.tolist(), len(b)] if len(b) else []):
                if (feed[k], day[k]) != here:
                    here, sent, free = (feed[k], day[k]), 0, {}
                while k < end and not point[k]:
                    free[names[code[k]]] = us[k]
                    k += 1
                while sent < cap and k < end:
                    open_ = np.ones(end - k, bool)
                    for rule, until in free.items():
                        if rule in code_of:
                            open_ &= (code[k:end] != code_of[rule]) | (us[k:end] >= until)
                    at = int(open_.argmax())
                    if not open_[at]:
                        break
                    k += at
                    found.append(k)
                    free[names[code[k]]], sent, k = us[k] + cooldown_us, sent + 1, k + 1
            yield b.iloc[found][[*_DAY, "rule", "us"]]

    return run


def _deliveries(points: DataFrame, cooldown_us: int, cap: int) -> DataFrame:
    """``feed_id, day, rule, us`` of all deliveries.

    All days are solved side by side, first as if no cooldown ran into them. What
    the days so solved leave to later days is then looked up, and the days for which
    that has changed are solved again, until none has. A day is final once all
    days before it are, so this ends, and with what one day after the other gives.
    Each pass takes up only the days that cooldowns reach differently than before.
    """
    def solve(p: DataFrame, carry: DataFrame | None) -> DataFrame:
        rows = p.select(*_DAY, F.lit(True).alias("point"), "us", "seq", "rule")
        if carry is not None:
            rows = rows.unionByName(carry.select(*_DAY, F.lit(False).alias("point"), F.col("free_at").alias("us"), F.lit(0).cast("long").alias("seq"), "rule"))
        return rows.repartition(*_DAY).sortWithinPartitions(*_DAY, "point", "us", "seq").mapInPandas(
            _day_deliveries(cooldown_us, cap), "feed_id string, day long, rule string, us long")

    first = points.groupBy(*_DAY, "rule").agg(F.min("us").alias("first"))
    later = F.explode(F.sequence(F.col("day") + 1, F.floor((F.col("us") + cooldown_us - 1) / DAY_US).cast("long")))
    sent = written(solve(points, None), "deliveries")
    carry = None
    while True:
        spills = sent.where(F.col("us") + cooldown_us - 1 >= (F.col("day") + 1) * DAY_US)
        reach = spills.select("feed_id", later.alias("day"), "rule", (F.col("us") + cooldown_us).alias("free_at"))
        reach = reach.groupBy(*_DAY, "rule").agg(F.max("free_at").alias("free_at"))
        reach = written(reach.join(first, [*_DAY, "rule"]).where("first < free_at").drop("first"), "carry")
        moved = reach if carry is None else reach.exceptAll(carry).unionByName(carry.exceptAll(reach))
        moved = written(moved.select(*_DAY).distinct(), "moved")
        if moved.isEmpty():
            return sent
        again = solve(points.join(moved, _DAY, "left_semi"), reach.join(moved, _DAY, "left_semi"))
        sent, carry = written(sent.join(moved, _DAY, "left_anti").unionByName(again), "deliveries"), reach


def suppression(
    tiered: DataFrame, cooldown_seconds: int = DEFAULT_COOLDOWN_SECONDS, daily_cap: int = DEFAULT_DAILY_CAP,
) -> DataFrame:
    """allow / suppress / batch per event.

    Up to tier 1 everything is allowed and nothing is counted. Above, a decision
    depends on earlier deliveries of the feed. Only what such a decision needs is
    looked at: one row per (rule, instant), of which at most ``daily_cap`` a feed
    and day are deliveries. Those are found first (``_deliveries``); all else follows by
    joins: what a delivery's cooldown covers is suppressed, the rest is batched.
    """
    loud = tiered.where(F.col("tier") >= 2).withColumn("us", F.unix_micros("processed_at"))
    cooldown_us = cooldown_seconds * 1_000_000
    points = loud.groupBy("feed_id", "rule", "us").agg(F.min("seq").alias("seq"))
    points = written(points.withColumn("day", F.floor(F.col("us") / DAY_US).cast("long")), "points")
    sent = _deliveries(points, cooldown_us, daily_cap)
    last_day = F.greatest(F.col("day"), F.floor((F.col("us") + cooldown_us - 1) / DAY_US).cast("long"))
    cover = sent.select("feed_id", "rule", F.explode(F.sequence(F.col("day"), last_day)).alias("day"), F.col("us").alias("at"))
    # Deliveries of a rule lie a cooldown apart, so at most one covers a point.
    j = points.alias("p").join(
        cover.alias("c"),
        (F.col("p.feed_id") == F.col("c.feed_id")) & (F.col("p.rule") == F.col("c.rule")) & (F.col("p.day") == F.col("c.day"))
        & (F.col("c.at") <= F.col("p.us")) & ((F.col("p.us") == F.col("c.at")) | (F.col("p.us") < F.col("c.at") + cooldown_us)), "left")
    decision = F.when(F.col("c.at") == F.col("p.us"), "allow").when(F.col("c.at").isNotNull(), "suppress").otherwise("batch")
    lead = j.select("p.feed_id", "p.rule", "p.us", F.col("p.seq").alias("__first"), decision.alias("decision"))
    out = loud.join(lead, ["feed_id", "rule", "us"]).withColumn(
        "decision", F.when((F.col("seq") > F.col("__first")) & (F.col("decision") == "allow"), "suppress").otherwise(F.col("decision")))
    quiet = tiered.where(F.col("tier") <= 1).withColumn("decision", F.lit("allow"))
    return out.select(*tiered.columns, "decision").unionByName(quiet)


def notifications(decided: DataFrame) -> DataFrame:
    """Deliveries: what arms cooldowns and counts towards the day's cap."""
    return decided.where((F.col("tier") >= 2) & (F.col("decision") == "allow"))


def ledger(decided: DataFrame, today: Column) -> DataFrame:
    """Per-rule ledger rolled up from the history."""
    sent = (F.col("tier") >= 2) & (F.col("decision") == "allow")
    return decided.groupBy("feed_id", "rule").agg(
        F.max_by("severity", "seq").alias("severity"), F.max_by("tier", "seq").alias("tier"),
        F.max("processed_at").alias("last_gate"), F.max(F.when(sent, F.col("processed_at"))).alias("last_notified"),
        F.count_if(sent & (F.to_date("processed_at") == today)).alias("notified_today"))


def route(decided: DataFrame, routes: dict[str, list[str]], default: list[str] | None = None) -> DataFrame:
    """Deliveries -> one row per channel. A severity entry wins over the default,
    an empty list mutes, and a severity without any route is an error row."""
    table = F.create_map(*[
        x for sev, channels in routes.items()
        for x in (F.lit(sev), F.array(*[F.lit(c) for c in channels]).cast("array<string>"))
    ]) if routes else F.create_map().cast("map<string,array<string>>")
    fallback = F.lit(None).cast("array<string>") if default is None else F.array(*[F.lit(c) for c in default]).cast("array<string>")
    chosen = F.coalesce(F.try_element_at(table, F.col("severity")), fallback)
    sent = notifications(decided).withColumn("__c", chosen)
    return sent.select(
        *decided.columns,
        F.explode(F.when(F.col("__c").isNull(), F.array(F.lit(None).cast("string"))).otherwise(F.col("__c"))).alias("channel"),
    ).withColumn("route_error", F.when(F.col("channel").isNull(), F.lit("nothing routed")))


# --- reconciliation ----------------------------------------------------------------

def latest_transitions(events: DataFrame) -> DataFrame:
    """The last transition of every rule."""
    last = events.groupBy("feed_id", "rule").agg(F.max("seq").alias("seq"))
    return events.join(last, ["feed_id", "rule", "seq"], "left_semi")


def reconcile(incidents_: DataFrame, latest: DataFrame, fresh: DataFrame) -> DataFrame:
    """Verdict per open incident: recovered, still-firing or indeterminate.

    Recovered needs a fresh feed and a latest transition that is a clear strictly
    newer than the incident's last event.
    """
    t = latest.select(
        "feed_id", "rule", F.col("state").alias("last_state"), F.try_to_timestamp("timestamp").alias("last_at"))
    j = (
        incidents_.where("status = 'open'")
        .join(t, ["feed_id", "rule"], "left").join(fresh.select("feed_id", "fresh", "fresh_reason"), "feed_id", "left")
    )
    is_fresh = F.coalesce("fresh", F.lit(False))
    verdict = (
        F.when(~is_fresh, "indeterminate")
        .when(F.col("last_state") == "fired", "still-firing")
        .when((F.col("last_state") == "cleared") & (F.col("last_at") > F.col("last_event")), "recovered")
        .otherwise("indeterminate")
    )
    why = (
        F.when(~is_fresh, F.coalesce("fresh_reason", F.lit("no digest")))
        .when(F.col("last_state").isNull(), "no transition")
        .when(verdict == "indeterminate", "clear not newer")
        .otherwise(F.col("last_state"))
    )
    return j.select("feed_id", "rule", "incident_no", "severity", verdict.alias("verdict"), why.alias("why"))


# --- health of the watcher, journal, status ------------------------------------------

def failure_runs(runs: DataFrame, blind_after: int = DEFAULT_BLIND_AFTER) -> DataFrame:
    """Consecutive failures at every watcher run (``ok`` BOOLEAN, ``seq`` order)."""
    r = _blocked(runs).withColumn("__f", (~F.col("ok")).cast("long"))
    r = blocked.running(r, ["feed_id"], "__sb", ["seq"], [blocked.Running("__cum", "sum", F.col("__f"))], inclusive=True)
    r = blocked.running(
        r, ["feed_id"], "__sb", ["seq"], [blocked.Running("__at", "max", F.when(F.col("ok"), F.col("__cum")))],
        inclusive=True, derived=True)
    n = F.col("__cum") - F.coalesce("__at", F.lit(0))
    return r.withColumn("failures", n).withColumn("blind", n >= blind_after).drop("__f", "__cum", "__at", "__sb")


def journal(tagged: DataFrame) -> DataFrame:
    """One action row per handled event, with its month for partitioning."""
    action = F.when(F.col("state") == "cleared", "close").otherwise("open")
    return tagged.select(
        "feed_id", F.col("processed_at").alias("ts"), F.date_format("processed_at", "yyyy-MM").alias("month"),
        action.alias("action"), "rule", F.col("id").alias("event_id"),
        F.to_json(F.struct("classification", "seq")).alias("detail"))


def status(events: DataFrame, acks: DataFrame, incidents_: DataFrame, decided: DataFrame, today: Column) -> DataFrame:
    """One status row per feed."""
    feeds = events.select("feed_id").distinct()
    cursor = ack_cursor(acks).select("feed_id", "last_acked_seq", F.size("recent_ids").cast("long").alias("recent_ids"))
    pending = unacked(events, acks).groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("pending"), F.min("seq").alias("lowest_pending_seq"))
    open_ = incidents_.where("status = 'open'").groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("open_incidents"), F.count_if(F.col("severity") == "critical").alias("open_criticals"))
    sent = notifications(decided).where(F.to_date("processed_at") == today).groupBy("feed_id").agg(
        F.count(F.lit(1)).alias("notifications_today"))
    out = feeds
    for part in (cursor, pending, open_, sent):
        out = out.join(part, "feed_id", "left")
    counts = ["last_acked_seq", "recent_ids", "pending", "open_incidents", "open_criticals", "notifications_today"]
    return out.select("feed_id", "lowest_pending_seq", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
