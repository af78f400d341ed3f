"""Registry of runnable queries: name -> (Spark job, equivalent SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


# --- SQL pieces shared by the checks -------------------------------------------------

TYPE_CASE = (
    "CASE event_type WHEN 'view' THEN 'Usage' WHEN 'click' THEN 'Clock' WHEN 'purchase' THEN 'Power' "
    "WHEN 'signup' THEN 'Other' ELSE 'unknown' END"
)
UNIT_CASE = "CASE event_type WHEN 'view' THEN '%' WHEN 'click' THEN 'MHz' WHEN 'purchase' THEN 'W' ELSE '' END"
VALUE = "CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN 'NaN'::DOUBLE ELSE value END"
RAW = "strftime({}, '%Y-%m-%dT%H:%M:%S.%fZ')"

DENSE = f"""
dense AS (
  SELECT user_id::VARCHAR || '/' || event_type AS feed_id, event_id // 4096 AS blk, event_id AS ord, ts, {RAW.format('ts')} AS raw_timestamp,
         'user_' || user_id::VARCHAR AS sensor, event_type AS reading, {TYPE_CASE} AS type, {UNIT_CASE} AS unit,
         {VALUE} AS value
  FROM events)"""
POLL = f"""
poll AS (
  SELECT user_id::VARCHAR AS feed_id, event_id // 4096 AS blk, event_id AS ord, ts, {RAW.format('ts')} AS raw_timestamp,
         'user_' || user_id::VARCHAR AS sensor, event_type AS reading, {TYPE_CASE} AS type, {UNIT_CASE} AS unit,
         {VALUE} AS value
  FROM events)"""
DAILY = f"""
daily AS (
  SELECT user_id::VARCHAR AS feed_id, date_trunc('day', ts) AS day, {RAW.format("date_trunc('day', ts)::TIMESTAMP")} AS raw_timestamp,
         event_id AS pos, 'user_' || user_id::VARCHAR AS sensor, event_type AS reading, {TYPE_CASE} AS type, {UNIT_CASE} AS unit,
         {VALUE} AS value
  FROM events)"""
FOLDED = """
folded AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY feed_id, day, sensor, reading ORDER BY pos) AS dup FROM daily) WHERE dup = 1)"""

# Steps through every series one sample at a time. Needs obs(feed_id, series, k, sym, need)
# with k = 1, 2, ... per series; gives edges(feed_id, series, k, state, n).
GATE = """
gate AS (
  SELECT DISTINCT feed_id, series, 0::BIGINT AS k, false AS fired, 0::BIGINT AS streak, 0::BIGINT AS total,
         NULL::VARCHAR AS state, 0::BIGINT AS n FROM obs
  UNION ALL
  SELECT o.feed_id, o.series, o.k,
         CASE WHEN g.fired THEN o.sym <> 'C' ELSE o.sym = 'V' AND g.streak + 1 = o.need END,
         CASE WHEN NOT g.fired AND o.sym = 'V' AND g.streak + 1 < o.need THEN g.streak + 1 ELSE 0 END,
         CASE WHEN g.fired AND o.sym = 'V' THEN g.total + 1 WHEN g.fired AND o.sym <> 'C' THEN g.total
              WHEN NOT g.fired AND o.sym = 'V' AND g.streak + 1 = o.need THEN o.need ELSE 0 END,
         CASE WHEN g.fired AND o.sym = 'C' THEN 'cleared'
              WHEN NOT g.fired AND o.sym = 'V' AND g.streak + 1 = o.need THEN 'fired' END,
         CASE WHEN g.fired AND o.sym = 'C' THEN g.total ELSE o.need END
  FROM gate g JOIN obs o ON o.feed_id = g.feed_id AND o.series = g.series AND o.k = g.k + 1),
edges AS (SELECT feed_id, series, k, state, n FROM gate WHERE state IS NOT NULL)"""


def threshold_sym(x: str, op: str, bound: float, clear: float) -> str:
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) THEN 'H' WHEN {x} {op} {bound} THEN 'V' "
            f"WHEN NOT ({x} {op} {clear}) THEN 'C' ELSE 'H' END")


def finite(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN {x} END"


def json_number_sql(x: str) -> str:
    """``x`` as a JSON number: the shortest digits of DuckDB's own text, laid out anew."""
    text = f"abs({x})::VARCHAR"
    parts = f"""[{{'whole': regexp_replace(regexp_replace(t, '[eE].*$', ''), '\\.|^0+\\.?0*', '', 'g'),
      'power': coalesce(nullif(regexp_extract(t, '[eE][+]?(-?[0-9]+)$', 1), '')::INT, 0) - length(regexp_extract(regexp_replace(t, '[eE].*$', ''), '\\.(.*)$', 1))}} FOR t IN [{text}]][1]"""
    digits = f"[{{'d': rtrim(w.whole, '0'), 'point': length(w.whole) + w.power}} FOR w IN [{parts}]][1]"
    laid = f"""[CASE WHEN v.point BETWEEN length(v.d) AND 16 THEN v.d || repeat('0', v.point - length(v.d)) || '.0'
      WHEN v.point BETWEEN 1 AND 16 THEN left(v.d, v.point) || '.' || substr(v.d, v.point + 1)
      WHEN v.point BETWEEN -4 AND 0 THEN '0.' || repeat('0', -v.point) || v.d
      WHEN length(v.d) = 1 THEN v.d || 'e' || (v.point - 1)
      ELSE left(v.d, 1) || '.' || substr(v.d, 2) || 'e' || (v.point - 1) END FOR v IN [{digits}]][1]"""
    sign = f"CASE WHEN signbit({x}) THEN '-' ELSE '' END"
    return f"CASE WHEN {x} IS NULL OR NOT isfinite({x}) THEN 'null' WHEN {x} = 0 THEN {sign} || '0.0' ELSE {sign} || {laid} END"


def json_object_sql(fields: dict[str, str]) -> str:
    """An object of SQL expressions that are already JSON."""
    return "'{' || " + " || ',' || ".join(f"""'"{k}":' || {v}""" for k, v in fields.items()) + " || '}'"


def json_text_sql(x: str) -> str:
    """A string that needs no escapes."""
    return f"""coalesce('"' || {x} || '"', 'null')"""
