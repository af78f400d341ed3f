"""Alert lifecycle over an event table made from `events`.

Rule = event type, feed = user, delivery order = event_id. Large values fire,
small ones clear, the rest alternate by severity. Some deliveries repeat an
earlier id, and some fires are classified benign.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, functions as F

from fleetpulse.operators import lifecycle as L
from fleetpulse.plans.catalog.registry import query
from fleetpulse.session import shared_folder, written
from fleetpulse.sources import tables, testdata as T

# Three users of four share one feed, so that one feed holds most events.
EV = """
ev AS (
  SELECT CASE WHEN user_id % 4 < 3 THEN 'big' ELSE user_id::VARCHAR END AS feed_id, event_id AS seq, event_type || '-' || (event_id - event_id % 10 % 3 % 2) AS id,
         event_type AS rule, CASE WHEN value > 45 THEN 'critical' WHEN value > 20 THEN 'warning' ELSE 'info' END AS severity,
         CASE WHEN value < 25 THEN 'cleared' ELSE 'fired' END AS state,
         CASE WHEN event_id % 6 = 0 THEN 'benign' WHEN event_id % 6 = 1 THEN 'anomaly' ELSE 'incident' END AS classification, ts AS processed_at
  FROM events)"""


def events_frame(spark, sf_dir) -> DataFrame:
    e = T.table(spark, sf_dir, "events")
    v, k = F.col("value"), F.col("event_id")
    return e.select(
        F.when(F.col("user_id") % 4 < 3, "big").otherwise(F.col("user_id").cast("string")).alias("feed_id"), k.alias("seq"),
        F.concat(F.col("event_type"), F.lit("-"), (k - k % 10 % 3 % 2).cast("string")).alias("id"), F.col("event_type").alias("rule"),
        F.when(v > 45, "critical").when(v > 20, "warning").otherwise("info").alias("severity"),
        F.when(v < 25, "cleared").otherwise("fired").alias("state"),
        F.when(k % 6 == 0, "benign").when(k % 6 == 1, "anomaly").otherwise("incident").alias("classification"),
        F.col("ts").cast("timestamp").alias("processed_at"),
    )


def iso(c):
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def text(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


TAG = f"""
{EV},
rep AS (SELECT *, seq > min(seq) OVER (PARTITION BY feed_id, id) AS repeat FROM ev),
tag AS (
  SELECT *, state = 'fired' AND classification <> 'benign' AND NOT repeat AS opens, state = 'cleared' AND NOT repeat AS closes,
         state = 'fired' AND classification <> 'benign' AS wakes,
         coalesce(count_if(state = 'cleared' AND NOT repeat) OVER (PARTITION BY feed_id, rule ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS incident_no
  FROM rep),
inc AS (
  SELECT feed_id, rule, incident_no, max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) FILTER (opens) AS sev,
         arg_max(classification, seq) FILTER (opens) AS classification, count_if(opens) + count_if(closes) AS events,
         arg_min(processed_at, seq) FILTER (opens) AS opened, max(processed_at) FILTER (wakes) + INTERVAL 6 HOUR AS snooze_until,
         max(processed_at) FILTER (opens OR closes) AS last_event, CASE WHEN count_if(closes) > 0 THEN 'closed' ELSE 'open' END AS status
  FROM tag GROUP BY ALL HAVING count_if(opens) > 0)"""


def tagged(spark, sf_dir) -> DataFrame:
    return L.tag_incidents(events_frame(spark, sf_dir))


@query("incidents", f"""WITH {TAG}
SELECT feed_id, rule, incident_no, CASE sev WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, classification, events,
       {iso('opened')} AS opened, {iso('snooze_until')} AS snooze_until, {iso('last_event')} AS last_event, status FROM inc""")
def incidents(spark, sf_dir):
    return L.incidents(tagged(spark, sf_dir)).select(
        "feed_id", "rule", "incident_no", "severity", "classification", "events", text("opened").alias("opened"),
        text("snooze_until").alias("snooze_until"), text("last_event").alias("last_event"), "status")


@query("incident_continuations", f"""WITH {TAG},
w AS (SELECT *, max(CASE WHEN wakes THEN processed_at END) OVER (PARTITION BY feed_id, rule, incident_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS woke FROM tag)
SELECT feed_id, seq, repeat, coalesce(state = 'fired' AND processed_at < woke + INTERVAL 6 HOUR, false) AS continuation FROM w""")
def incident_continuations(spark, sf_dir):
    return tagged(spark, sf_dir).select("feed_id", "seq", "repeat", "continuation")


NOW = "2024-01-30 12:00:00"


@query("snoozed_pending", f"""WITH {TAG}
SELECT t.feed_id, t.seq, i.incident_no FROM rep t JOIN inc i USING (feed_id, rule)
WHERE i.status = 'open' AND i.opened <= TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' < i.snooze_until AND t.state = 'fired'""")
def snoozed_pending(spark, sf_dir):
    """Fired events whose rule has an open incident inside its snooze."""
    e = events_frame(spark, sf_dir)
    out = L.continuations(e.where("state = 'fired'"), L.incidents(L.tag_incidents(e)), F.lit(NOW).cast("timestamp"))
    return out.select("feed_id", "seq", "incident_no")


TIER = f"""
{TAG},
one AS (SELECT * FROM tag WHERE NOT repeat),
run AS (
  SELECT *, count_if(opens) OVER (PARTITION BY feed_id, rule, incident_no ORDER BY seq) AS persistence,
         coalesce(bool_or(opens AND severity = 'critical') OVER (PARTITION BY feed_id, rule, incident_no ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS was
  FROM one),
step AS (SELECT *, (CASE WHEN opens AND severity = 'critical' AND NOT was THEN 1 ELSE 0 END) - (CASE WHEN closes AND was THEN 1 ELSE 0 END) AS d FROM run),
crit AS (SELECT *, sum(d) OVER (PARTITION BY feed_id ORDER BY seq) + CASE WHEN was OR (opens AND severity = 'critical') THEN 0 ELSE 1 END AS others FROM step),
tier AS (
  SELECT *, CASE WHEN state = 'cleared' OR severity = 'info' THEN 0 WHEN severity = 'warning' THEN CASE WHEN persistence >= 3 THEN 2 ELSE 1 END
       WHEN others >= 2 THEN 4 WHEN persistence >= 3 THEN 3 ELSE 2 END AS tier FROM crit)"""


@query("escalation_tiers", f"WITH {TIER} SELECT feed_id, seq, persistence, tier FROM tier")
def escalation_tiers(spark, sf_dir):
    return L.escalation_tiers(tagged(spark, sf_dir)).select("feed_id", "seq", "persistence", "tier")


# Steps through every feed's loud events in order of time; the state is the day's
# count and a map of each rule's last delivery.
DECIDE = f"""
{TIER},
loud AS (SELECT *, row_number() OVER (PARTITION BY feed_id ORDER BY processed_at, seq) AS k FROM tier WHERE tier >= 2),
st AS (
  SELECT DISTINCT feed_id, 0::BIGINT AS k, 0::BIGINT AS seq, NULL::VARCHAR AS decision, 0 AS sent, NULL::DATE AS day,
         NULL::TIMESTAMP AS l_view, NULL::TIMESTAMP AS l_click, NULL::TIMESTAMP AS l_purchase, NULL::TIMESTAMP AS l_signup, NULL::TIMESTAMP AS l_error FROM loud
  UNION ALL
  SELECT feed_id, k, seq, decision, sent + (decision = 'allow')::INT, day,
         CASE WHEN decision = 'allow' AND rule = 'view' THEN tm ELSE l_view END, CASE WHEN decision = 'allow' AND rule = 'click' THEN tm ELSE l_click END,
         CASE WHEN decision = 'allow' AND rule = 'purchase' THEN tm ELSE l_purchase END, CASE WHEN decision = 'allow' AND rule = 'signup' THEN tm ELSE l_signup END,
         CASE WHEN decision = 'allow' AND rule = 'error' THEN tm ELSE l_error END
  FROM (
    SELECT l.feed_id, l.k, l.seq, l.rule, l.processed_at AS tm, l.processed_at::DATE AS day, CASE WHEN s.day = l.processed_at::DATE THEN s.sent ELSE 0 END AS sent,
           s.l_view, s.l_click, s.l_purchase, s.l_signup, s.l_error,
           CASE WHEN coalesce(l.processed_at < CASE l.rule WHEN 'view' THEN s.l_view WHEN 'click' THEN s.l_click WHEN 'purchase' THEN s.l_purchase
                       WHEN 'signup' THEN s.l_signup ELSE s.l_error END + INTERVAL 6 HOUR, false) THEN 'suppress'
                WHEN CASE WHEN s.day = l.processed_at::DATE THEN s.sent ELSE 0 END >= 5 THEN 'batch' ELSE 'allow' END AS decision
    FROM st s JOIN loud l ON l.feed_id = s.feed_id AND l.k = s.k + 1)),
dec AS (SELECT t.*, coalesce(s.decision, 'allow') AS decision FROM tier t LEFT JOIN st s ON s.feed_id = t.feed_id AND s.seq = t.seq AND s.k > 0)"""


def decided(spark, sf_dir) -> DataFrame:
    return L.suppression(written(L.escalation_tiers(tagged(spark, sf_dir)), "tiers"))


LONG_HOURS, LONG_CAP = 30, 2
LONG_DECIDE = DECIDE.replace("INTERVAL 6 HOUR", f"INTERVAL {LONG_HOURS} HOUR").replace(">= 5 THEN 'batch'", f">= {LONG_CAP} THEN 'batch'")


@query("notification_decisions_over_days", f"WITH RECURSIVE {LONG_DECIDE} SELECT feed_id, seq, tier, decision FROM dec")
def notification_decisions_over_days(spark, sf_dir):
    """Cooldowns that run into the next days, so that every day depends on those before it."""
    tiers = written(L.escalation_tiers(tagged(spark, sf_dir)), "tiers")
    return L.suppression(tiers, LONG_HOURS * 3600, LONG_CAP).select("feed_id", "seq", "tier", "decision")


@query("notification_decisions", f"WITH RECURSIVE {DECIDE} SELECT feed_id, seq, tier, decision FROM dec")
def notification_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("feed_id", "seq", "tier", "decision")


@query("escalation_ledger", f"""WITH RECURSIVE {DECIDE}
SELECT feed_id, rule, arg_max(severity, seq) AS severity, arg_max(tier, seq) AS tier, {iso('max(processed_at)')} AS last_gate,
  {iso("max(processed_at) FILTER (tier >= 2 AND decision = 'allow')")} AS last_notified,
  count_if(tier >= 2 AND decision = 'allow' AND processed_at::DATE = DATE '2024-01-20') AS notified_today FROM dec GROUP BY feed_id, rule""")
def escalation_ledger(spark, sf_dir):
    out = L.ledger(decided(spark, sf_dir), F.lit(date(2024, 1, 20)))
    return out.withColumn("last_gate", text("last_gate")).withColumn("last_notified", text("last_notified"))


@query("notification_routes", f"""WITH RECURSIVE {DECIDE}
SELECT feed_id, seq, channel, NULL::VARCHAR AS route_error FROM dec JOIN (VALUES ('critical', 'phone'), ('critical', 'mail'), ('warning', 'mail')) v(severity, channel) USING (severity)
WHERE tier >= 2 AND decision = 'allow'""")
def notification_routes(spark, sf_dir):
    out = L.route(decided(spark, sf_dir), {"critical": ["phone", "mail"], "info": []}, ["mail"])
    return out.select("feed_id", "seq", "channel", "route_error")


# --- acknowledgement ------------------------------------------------------------------------

ACK = f"""
{EV},
ack AS (SELECT feed_id, id, seq, seq * 7919 % 100003 AS ack_ord FROM ev WHERE seq % 5 <> 0)"""


def acks_frame(events: DataFrame) -> DataFrame:
    return events.where(F.col("seq") % 5 != 0).select("feed_id", "id", "seq", (F.col("seq") * 7919 % 100003).alias("ack_ord"))


@query("unacked_events", f"WITH {ACK} SELECT DISTINCT feed_id, id FROM ev ANTI JOIN ack USING (feed_id, id)")
def unacked_events(spark, sf_dir):
    e = events_frame(spark, sf_dir)
    return L.unacked(e, acks_frame(e)).select("feed_id", "id")


CURSOR = """
firsts AS (SELECT feed_id, id, min(ack_ord) AS ack_ord, min(seq) AS seq FROM ack GROUP BY ALL),
cursor AS (SELECT feed_id, max(seq) AS last_acked_seq, count(*) AS acked_total FROM firsts GROUP BY feed_id),
ring AS (SELECT feed_id, string_agg(id, ',' ORDER BY ack_ord, id) AS ids, count(*) AS n FROM (
   SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY feed_id ORDER BY ack_ord DESC, id DESC) <= 64) GROUP BY feed_id)"""


@query("ack_cursor", f"WITH {ACK}, {CURSOR} SELECT feed_id, last_acked_seq, acked_total, ids AS recent_ids FROM cursor JOIN ring USING (feed_id)")
def ack_cursor(spark, sf_dir):
    return L.ack_cursor(acks_frame(events_frame(spark, sf_dir))).withColumn("recent_ids", F.array_join("recent_ids", ","))


@query("monitor_status", f"""WITH RECURSIVE {DECIDE}, {ACK.split('ack AS', 1)[1].join(['ack AS', ''])}, {CURSOR},
pend AS (SELECT feed_id, count(DISTINCT id) AS pending, min(seq) AS lowest_pending_seq FROM ev ANTI JOIN ack USING (feed_id, id) GROUP BY feed_id),
op AS (SELECT feed_id, count(*) AS open_incidents, count_if(sev = 2) AS open_criticals FROM inc WHERE status = 'open' GROUP BY feed_id),
nt AS (SELECT feed_id, count(*) AS notifications_today FROM dec WHERE tier >= 2 AND decision = 'allow' AND processed_at::DATE = DATE '2024-01-30' GROUP BY feed_id)
SELECT feed_id, lowest_pending_seq, coalesce(last_acked_seq, 0) AS last_acked_seq, coalesce(ring.n, 0) AS recent_ids, coalesce(pending, 0) AS pending,
  coalesce(open_incidents, 0) AS open_incidents, coalesce(open_criticals, 0) AS open_criticals, coalesce(notifications_today, 0) AS notifications_today
FROM (SELECT DISTINCT feed_id FROM ev) f LEFT JOIN cursor USING (feed_id) LEFT JOIN ring USING (feed_id) LEFT JOIN pend USING (feed_id)
LEFT JOIN op USING (feed_id) LEFT JOIN nt USING (feed_id)""")
def monitor_status(spark, sf_dir):
    e = events_frame(spark, sf_dir)
    tags = written(L.tag_incidents(e), "tagged")
    dec = L.suppression(written(L.escalation_tiers(tags), "tiers"))
    return L.status(e, acks_frame(e), L.incidents(tags), dec, F.lit(date(2024, 1, 30)))


# --- reconciliation and health -----------------------------------------------------------------

LATEST = "latest AS (SELECT * FROM ev QUALIFY seq = max(seq) OVER (PARTITION BY feed_id, rule))"


@query("latest_transitions", f"WITH {EV}, {LATEST} SELECT feed_id, rule, seq, state FROM latest")
def latest_transitions(spark, sf_dir):
    return L.latest_transitions(events_frame(spark, sf_dir)).select("feed_id", "rule", "seq", "state")


@query("reconcile_incidents", f"""WITH {TAG}, {LATEST},
half AS (SELECT *, processed_at - CASE WHEN try_cast(feed_id AS INT) % 5 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS seen_at FROM ev
         WHERE coalesce(try_cast(feed_id AS INT) % 7, 0) <> 3 QUALIFY seq = max(seq) OVER (PARTITION BY feed_id, rule)),
j AS (SELECT i.*, h.state AS last_state, h.seen_at AS last_at, coalesce(i.feed_id = 'big' OR try_cast(i.feed_id AS INT) % 8 < 6, false) AS fresh
      FROM inc i LEFT JOIN (SELECT feed_id, rule, state, seen_at FROM half) h USING (feed_id, rule) WHERE i.status = 'open')
SELECT feed_id, rule, incident_no, CASE sev WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN NOT fresh THEN 'indeterminate' WHEN last_state = 'fired' THEN 'still-firing' WHEN last_state = 'cleared' AND last_at > last_event THEN 'recovered' ELSE 'indeterminate' END AS verdict,
  CASE WHEN NOT fresh THEN 'old' WHEN last_state IS NULL THEN 'no transition' WHEN last_state = 'cleared' AND NOT last_at > last_event THEN 'clear not newer' ELSE last_state END AS why
FROM j""")
def reconcile_incidents(spark, sf_dir):
    """Open incidents against the latest transitions of another log: some feeds' clocks are a day behind, and some feeds are not in it."""
    e = events_frame(spark, sf_dir)
    inc = L.incidents(L.tag_incidents(e))
    number = F.expr("try_cast(feed_id AS int)")
    late = F.when(number % 5 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    there = F.coalesce(number % 7, F.lit(0)) != 3
    seen = L.latest_transitions(e).where(there).withColumn("timestamp", T.raw_text(F.col("processed_at") - late))
    feeds = e.select("feed_id").distinct()
    ok = (F.col("feed_id") == "big") | (F.try_to_number("feed_id", F.lit("999999")) % 8 < 6)
    fresh = feeds.select("feed_id", F.coalesce(ok, F.lit(False)).alias("fresh"), F.when(~F.coalesce(ok, F.lit(False)), "old").alias("fresh_reason"))
    return L.reconcile(inc, seen, fresh)


@query("watcher_failures", """
WITH x AS (SELECT user_id::VARCHAR AS feed_id, event_id AS seq, value >= 40 AS ok FROM events),
y AS (SELECT *, count_if(ok) OVER (PARTITION BY feed_id ORDER BY seq) AS g FROM x)
SELECT feed_id, seq, failures, failures >= 3 AS blind FROM (SELECT feed_id, seq, count_if(NOT ok) OVER (PARTITION BY feed_id, g ORDER BY seq) AS failures FROM y)""")
def watcher_failures(spark, sf_dir):
    runs = T.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("feed_id"), F.col("event_id").alias("seq"), (F.col("value") >= 40).alias("ok"))
    return L.failure_runs(runs).select("feed_id", "seq", "failures", "blind")


@query("action_journal", f"""WITH {EV}
SELECT strftime(processed_at, '%Y-%m') AS month, CASE state WHEN 'cleared' THEN 'close' ELSE 'open' END AS action, rule, count(*) AS n FROM ev GROUP BY ALL""")
def action_journal(spark, sf_dir):
    """Append the journal by month and count what was written."""
    path = f"{shared_folder(spark)}/journal-{uuid.uuid4().hex}"
    tables.append_journal(L.journal(events_frame(spark, sf_dir)), path)
    return spark.read.schema("action string, rule string, month string").parquet(path).groupBy("month", "action", "rule").agg(F.count(F.lit(1)).alias("n"))


# --- event contract ---------------------------------------------------------------------------

_DAMAGE = """CASE event_id % 16 WHEN 0 THEN 'not an object' WHEN 1 THEN 'seq missing' WHEN 2 THEN 'seq invalid' WHEN 3 THEN 'severity invalid'
  WHEN 4 THEN 'timestamp invalid' WHEN 5 THEN 'schema_version invalid' WHEN 6 THEN 'value invalid' WHEN 7 THEN 'id invalid' WHEN 8 THEN 'state missing|unit missing' ELSE '' END"""


@query("event_contract", f"SELECT event_id, {_DAMAGE} AS reasons FROM events")
def event_contract(spark, sf_dir):
    e = T.table(spark, sf_dir, "events")
    k = F.col("event_id") % 16
    doc = F.to_json(F.struct(
        F.when(k == 5, 2).otherwise(1).alias("schema_version"), F.when(k == 1, None).otherwise(F.col("event_id")).alias("seq"),
        F.when(k == 7, "").otherwise("r-1").alias("id"), F.lit("r").alias("rule"), F.lit("threshold").alias("type"),
        F.when(k == 3, "fatal").otherwise("warning").alias("severity"), F.when(k == 8, None).otherwise("fired").alias("state"),
        F.when(k == 4, F.date_format("ts", "yyyy-MM-dd HH:mm:ss'Z'")).otherwise(T.raw_text(F.col("ts"))).alias("timestamp"),
        F.lit("s").alias("sensor"), F.col("event_type").alias("reading"), F.col("value").alias("value"),
        F.when(k == 8, None).otherwise("V").alias("unit"), F.lit(1.5).alias("threshold"), F.lit(2).alias("samples_in_violation"), F.lit(1).alias("extra"),
    ))
    doc = F.regexp_replace(doc, '"sensor":"s"', '"sensor":null')
    line = (
        F.when(k == 0, "[1,2]").when(k == 2, F.regexp_replace(doc, r'"seq":\d+', '"seq":1.5'))
        .when(k == 6, F.regexp_replace(doc, r'"value":[0-9.]+', '"value":"high"')).otherwise(doc)
    )
    return L.check_events(e.select("event_id", line.alias("line"))).select("event_id", F.array_join("reasons", "|").alias("reasons"))
