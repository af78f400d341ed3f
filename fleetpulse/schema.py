"""Schemas, vocabularies and fixed limits shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: the closed vocabularies of the data contract ---------------
TYPE_LABELS = ["None", "Temperature", "Voltage", "Fan", "Current", "Power", "Clock", "Usage", "Other"]
UNKNOWN_LABEL = "unknown"
RULE_KINDS = ["threshold", "rate", "stale", "missing", "source-unavailable"]
METRICS = ["value", "min", "max", "avg"]
OPS = [">", ">=", "<", "<="]
SEVERITIES = ["info", "warning", "critical"]
STATES = ["fired", "cleared"]
# The keys of an event in contract order, each with what its value may be.
EVENT_KINDS = {
    "schema_version": "int", "seq": "int", "id": "text!", "rule": "text!", "type": "text", "severity": "severity", "state": "state",
    "timestamp": "instant", "sensor": "text?", "reading": "text?", "value": "number?", "unit": "text?", "threshold": "number?",
    "samples_in_violation": "int",
}
EVENT_KEYS = list(EVENT_KINDS)
EVENT_SCHEMA_VERSION = 1
DIGEST_SCHEMA_VERSION = 1

# --- fixed values: limits and defaults of the data contract -------------------
MAX_LINE_BYTES = 4 * 1024 * 1024
MAX_SAMPLES = 1_000_000
GAP_INTERVAL_MULTIPLE = 3
MAX_GAPS_SHOWN = 1024
MAX_VIOLATIONS_SHOWN = 512
DEFAULT_TOP = 20
DEFAULT_MAX_BYTES = 8192
MIN_MAX_BYTES = 512
DIGEST_MAX_AGE_SECONDS = 600
SINGLE_GAP_MAX_SECONDS = 900
GAP_DENSITY_THRESHOLD = 0.10
ACKED_IDS_KEPT = 64
DEFAULT_SNOOZE_SECONDS = 6 * 3600
DEFAULT_COOLDOWN_SECONDS = 6 * 3600
DEFAULT_DAILY_CAP = 5
DEFAULT_BLIND_AFTER = 3

READING_STRUCT = T.StructType([
    T.StructField("sensor", T.StringType()),
    T.StructField("reading", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("avg", T.DoubleType()),
    T.StructField("unit", T.StringType()),
])

RECORD_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("sensors", T.ArrayType(READING_STRUCT)),
])

# One row per poll. Stream order inside a feed is (blk, ord); every
# (feed_id, blk) group has a bounded number of rows, which is what lets the
# ordered operators run block by block instead of one feed per task.
SAMPLE_SCHEMA = T.StructType([
    T.StructField("feed_id", T.StringType()),
    T.StructField("file", T.StringType()),
    T.StructField("blk", T.LongType()),
    T.StructField("ord", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("raw_timestamp", T.StringType()),
    T.StructField("available", T.BooleanType()),
    T.StructField("sensors", T.ArrayType(READING_STRUCT)),
])

RULE_SCHEMA = T.StructType([
    T.StructField("rule_idx", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("reading", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("metric", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("clear", T.DoubleType()),
    T.StructField("for_samples", T.LongType()),
    T.StructField("window_samples", T.LongType()),
    T.StructField("severity", T.StringType()),
])

EVENT_SCHEMA = T.StructType([
    T.StructField("schema_version", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("rule", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("sensor", T.StringType()),
    T.StructField("reading", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("unit", T.StringType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("samples_in_violation", T.LongType()),
])

EXPORT_COLUMNS = ["timestamp", "sensor", "reading", "type", "value", "unit"]
