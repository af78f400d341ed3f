"""Rule tables: validation as a DataFrame, and the two forms in which the engine takes rules:
a small driver-side set that becomes literals, and a table of any size that stays one."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.functions import scalars as S
from fleetpulse.schema import MAX_SAMPLES, METRICS, OPS, RULE_KINDS, SEVERITIES, TYPE_LABELS, UNKNOWN_LABEL


@dataclass(frozen=True)
class Rule:
    name: str
    kind: str
    sensor: str | None = None
    reading: str | None = None
    type: str | None = None
    metric: str = "value"
    op: str | None = None
    threshold: float | None = None
    clear: float | None = None
    for_samples: int = 1
    window_samples: int | None = None
    severity: str = "warning"

    @property
    def clear_level(self) -> float | None:
        return self.threshold if self.clear is None else self.clear

    @property
    def lookback(self) -> int:
        """How many samples back the rule looks when judging one sample."""
        return self.window_samples - 1 if self.kind == "rate" else 1

    def matches(self) -> Column:
        """Predicate over stream columns sensor, reading, type (already lower-cased
        as ``sensor_lc``/``reading_lc``)."""
        parts = []
        if self.sensor is not None:
            parts.append(F.col("sensor_lc").contains(self.sensor.strip().lower()))
        if self.reading is not None:
            parts.append(F.col("reading_lc").contains(self.reading.strip().lower()))
        if self.type is not None:
            parts.append(F.col("type") == canonical_label(self.type))
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def canonical_label(label: str) -> str:
    for known in [*TYPE_LABELS, UNKNOWN_LABEL]:
        if label.lower() == known.lower():
            return known
    raise ValueError(f"unknown type label {label!r}")


def _blank(c: Column) -> Column:
    return F.trim(c) == ""


def rule_errors(rules: DataFrame, set_cols: list[str] | None = None) -> DataFrame:
    """Every problem of every rule, one row each: (set_cols, rule_idx, name, error).

    Works on rule tables of any size: the checks are row-local expressions, and
    repeated names are found by one aggregate per name.
    """
    keys = set_cols or []
    c = F.col
    value_kind = F.coalesce(c("kind").isin("threshold", "rate"), F.lit(False))
    has_matcher = c("sensor").isNotNull() | c("reading").isNotNull() | c("type").isNotNull()
    known_label = F.coalesce(
        S.ascii_lower(c("type")).isin([x.lower() for x in [*TYPE_LABELS, UNKNOWN_LABEL]]), F.lit(False))
    wrong_side = (
        S.is_finite(c("threshold")) & S.is_finite(c("clear"))
        & F.when(c("op").isin(">", ">="), c("clear") > c("threshold"))
        .when(c("op").isin("<", "<="), c("clear") < c("threshold")).otherwise(False)
    )
    known_kind = F.coalesce(c("kind").isin(RULE_KINDS), F.lit(False))
    other_kind = known_kind & ~value_kind
    checks: list[tuple[str, Column]] = [
        ("name missing", c("name").isNull()),
        ("name blank", _blank(c("name"))),
        ("kind missing", c("kind").isNull()),
        ("kind not known", c("kind").isNotNull() & ~known_kind),
        ("sensor blank", _blank(c("sensor"))),
        ("reading blank", _blank(c("reading"))),
        ("type not known", c("type").isNotNull() & ~known_label),
        ("metric not known", ~c("metric").isin(METRICS)),
        ("op not known", ~c("op").isin(OPS)),
        ("severity not known", ~c("severity").isin(SEVERITIES)),
        ("threshold not finite", c("threshold").isNotNull() & ~S.is_finite(c("threshold"))),
        ("clear not finite", c("clear").isNotNull() & ~S.is_finite(c("clear"))),
        ("clear on the wrong side", wrong_side),
        ("for_samples out of range", ~F.coalesce(c("for_samples"), F.lit(1)).between(1, MAX_SAMPLES)),
        ("matcher required", value_kind & ~has_matcher),
        ("matcher not allowed", (c("kind") == "source-unavailable") & has_matcher),
        ("op required", value_kind & c("op").isNull()),
        ("threshold required", value_kind & c("threshold").isNull()),
        ("op not allowed", other_kind & c("op").isNotNull()),
        ("threshold not allowed", other_kind & c("threshold").isNotNull()),
        ("clear not allowed", other_kind & c("clear").isNotNull()),
        ("metric not allowed", other_kind & c("metric").isNotNull()),
        ("window_samples required", (c("kind") == "rate") & c("window_samples").isNull()),
        ("window_samples out of range",
         (c("kind") == "rate") & ~c("window_samples").between(2, MAX_SAMPLES)),
        ("window_samples not allowed", known_kind & (c("kind") != "rate") & c("window_samples").isNotNull()),
    ]
    found = F.filter(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks]), lambda e: e.isNotNull())
    local = rules.select(*keys, "rule_idx", "name", F.explode(found).alias("error"))

    # Names are compared among rules that are valid otherwise.
    sound = rules.join(local.select(*keys, "rule_idx").distinct(), [*keys, "rule_idx"], "left_anti")
    named = sound.withColumn("__n", F.trim("name"))
    first = named.groupBy(*keys, "__n").agg(F.min("rule_idx").alias("__first"), F.count(F.lit(1)).alias("__c"))
    repeated = (
        named.join(first.where("__c > 1"), [*keys, "__n"])
        .where(F.col("rule_idx") > F.col("__first"))
        .select(*keys, "rule_idx", "name", F.lit("name repeated").alias("error"))
    )
    return local.unionByName(repeated)


def with_defaults(rules: DataFrame) -> DataFrame:
    """Valid rules in their final form: trimmed lower-case matchers, canonical
    labels, defaults filled in."""
    return rules.select(
        *[x for x in rules.columns if x not in {
            "name", "sensor", "reading", "type", "metric", "for_samples", "severity", "clear"}],
        F.trim("name").alias("name"),
        F.lower(F.trim("sensor")).alias("sensor"),
        F.lower(F.trim("reading")).alias("reading"),
        F.when(F.col("type").isNotNull(), S.normalize_type(F.col("type"))).alias("type"),
        F.coalesce("metric", F.lit("value")).alias("metric"),
        F.coalesce("clear", "threshold").alias("clear"),
        F.coalesce("for_samples", F.lit(1)).alias("for_samples"),
        F.coalesce("severity", F.lit("warning")).alias("severity"),
    )


def prune_rules(rules: DataFrame, names: list[str] | None = None, min_severity: str | None = None) -> DataFrame:
    """Keep rules by exact name and by severity floor."""
    out = rules
    if names:
        out = out.where(F.col("name").isin(names))
    if min_severity:
        floor = SEVERITIES.index(min_severity)
        out = out.where(S.severity_rank(F.coalesce("severity", F.lit("warning"))) >= floor)
    return out


def prune(rules: list[Rule], names: list[str] | None = None, min_severity: str | None = None) -> list[Rule]:
    """The same on a loaded rule set; unknown names and an empty result are errors."""
    unknown = set(names or []) - {r.name for r in rules}
    if unknown:
        raise ValueError(f"no such rule: {', '.join(sorted(unknown))}")
    floor = SEVERITIES.index(min_severity) if min_severity else 0
    kept = [r for r in rules if (not names or r.name in names) and SEVERITIES.index(r.severity) >= floor]
    if not kept:
        raise ValueError("no rule left to evaluate")
    return kept


def load_rules(rules: DataFrame) -> list[Rule]:
    """Validate a rule table on Spark and bring it to the driver.

    Rules are configuration: their parameters are literals of the jobs, as arrays that are looked
    up by number. Matching many rules with series is Spark's work (``rule_index``).
    """
    rows = rules.orderBy("rule_idx").collect()
    errors = [f"rule {e.rule_idx} ({e.name}): {e.error}" for e in rule_errors(rules).orderBy("rule_idx", "error").collect()]
    if errors:
        raise ValueError("; ".join(errors))
    fields = Rule.__dataclass_fields__
    out = []
    for row in rows:
        given = {k: v for k, v in row.asDict().items() if k in fields and v is not None}
        out.append(make_rule(**given))
    return out


def make_rule(**given) -> Rule:
    """A Rule from keyword values, normalised like ``with_defaults``.

    What the engine relies on is checked here too: known words, ranges, and a clear level that
    is not inside the violating region.
    """
    rule = dict(given)
    rule["name"] = rule["name"].strip()
    for k in ("sensor", "reading"):
        if rule.get(k) is not None:
            rule[k] = rule[k].strip().lower()
    if rule.get("type") is not None:
        rule["type"] = canonical_label(rule["type"])
    for k in ("threshold", "clear"):
        if rule.get(k) is not None and not math.isfinite(rule[k]):
            raise ValueError(f"{rule['name']}: {k} must be finite")
    r = Rule(**rule)
    leveled = r.kind in ("threshold", "rate")
    problems = [text for text, bad in (
        ("kind not known", r.kind not in RULE_KINDS), ("metric not known", r.metric not in METRICS), ("severity not known", r.severity not in SEVERITIES),
        ("op required", leveled and r.op not in OPS), ("threshold required", leveled and r.threshold is None),
        ("for_samples out of range", not 1 <= r.for_samples <= MAX_SAMPLES),
        ("window_samples out of range", r.kind == "rate" and not 2 <= (r.window_samples or 0) <= MAX_SAMPLES),
        ("clear on the wrong side", leveled and r.op in OPS and r.threshold is not None and r.clear is not None
         and (r.clear > r.threshold if r.op[0] == ">" else r.clear < r.threshold)),
    ) if bad]
    if problems:
        raise ValueError(f"{r.name}: {', '.join(problems)}")
    return r


#: What the engine asks of a row's rule, and its type.
PARAMETERS = {"kind": "string", "metric": "string", "op": "string", "threshold": "double", "clear_level": "double", "for_samples": "long", "lookback": "long"}
SHOWN_ERRORS = 20


class RuleList:
    """Rules whose parameters are literals: one array for each, looked up by ``rule_idx``."""

    carried: list[str] = []

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.kinds = {r.kind for r in rules}
        self.widths = sorted({r.lookback for r in rules if r.kind == "rate"})
        self.waits = sorted({r.for_samples for r in rules if r.kind == "missing"})
        self.back = max([r.lookback for r in rules], default=1)

    def get(self, name: str, cast: str | None = None) -> Column:
        values = F.from_json(F.lit(json.dumps([getattr(r, name) for r in self.rules])), f"array<{cast or PARAMETERS[name]}>")
        return F.element_at(values, F.col("rule_idx") + 1)

    def named(self, edges: DataFrame) -> DataFrame:
        """``edges`` with what events say of their rule."""
        return edges.select("*", *[self.get(n, t).alias(f"rule_{n}") for n, t in SAID.items()])


SAID = {"name": "string", "kind": "string", "severity": "string", "threshold": "double"}


class RuleTable:
    """Valid rules that stay a table, however many there are.

    What the engine needs of a rule travels with the readings that it watches; a parameter that is
    the same for all rules is a literal instead. Rules keep the numbers that the table gives them. The driver sees
    which kinds and widths there are, and no rule.
    """

    def __init__(self, rules: DataFrame):
        wrong = rule_errors(rules).select("rule_idx", "name", "error")
        first = wrong.orderBy("rule_idx", "error").limit(SHOWN_ERRORS + 1).collect()
        if first:
            more = ["more errors"] if len(first) > SHOWN_ERRORS else []
            raise ValueError("; ".join([f"rule {e.rule_idx} ({e.name}): {e.error}" for e in first[:SHOWN_ERRORS]] + more))
        rate = F.col("kind") == "rate"
        self.frame = with_defaults(rules).withColumns({
            "clear_level": F.col("clear"), "lookback": F.when(rate, F.col("window_samples") - 1).otherwise(1)})
        self.frame = self.frame.withColumns({n: F.col(n).cast(t) for n, t in PARAMETERS.items()})
        missing = F.col("kind") == "missing"
        facts = self.frame.agg(
            F.collect_set("kind").alias("kinds"), F.collect_set(F.when(rate, F.col("lookback"))).alias("widths"),
            F.collect_set(F.when(missing, F.col("for_samples"))).alias("waits"), F.coalesce(F.max("lookback"), F.lit(1)).alias("back"),
            *[F.struct(F.min(n).alias("least"), F.max(n).alias("most"), (F.count(n) == F.count(F.lit(1))).alias("full")).alias(f"of_{n}") for n in PARAMETERS]).first()
        self.kinds, self.widths, self.waits, self.back = set(facts.kinds), sorted(facts.widths), sorted(facts.waits), facts.back
        spans = {n: facts[f"of_{n}"] for n in PARAMETERS}
        self.same = {n: s.least for n, s in spans.items() if s.least == s.most and (s.full or s.least is None)}
        self.carried = [f"rule_{n}" for n in PARAMETERS if n not in self.same]
        self.frame = self.frame.withColumnsRenamed({c[len("rule_"):]: c for c in self.carried})

    def get(self, name: str, cast: str | None = None) -> Column:
        return F.lit(self.same[name]).cast(PARAMETERS[name]) if name in self.same else F.col(f"rule_{name}")

    def of_kind(self, wanted: str, is_it: bool = True) -> DataFrame:
        return self.frame.where((self.get("kind") == wanted) == F.lit(is_it))

    def named(self, edges: DataFrame) -> DataFrame:
        """``edges`` with what events say of their rule: few are left, so that the join is by number."""
        said = self.frame.select("rule_idx", *[(self.get(n) if n in PARAMETERS else F.col(n)).alias(f"rule_{n}") for n in SAID])
        return edges.join(said, "rule_idx")
