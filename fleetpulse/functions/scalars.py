"""Scalar column functions. All of them are built-in expressions, so they stay
inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

from fleetpulse.schema import EVENT_KINDS, SEVERITIES, TYPE_LABELS, UNKNOWN_LABEL

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
NAN = float("nan")
INF = float("inf")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def normalize_type(c: Column) -> Column:
    """Fold any stream label onto the closed vocabulary (ASCII case-insensitive)."""
    low = ascii_lower(c)
    out = F.lit(UNKNOWN_LABEL)
    for label in reversed(TYPE_LABELS):
        out = F.when(low == label.lower(), F.lit(label)).otherwise(out)
    return out


def is_finite(c: Column) -> Column:
    """True for a real number; NULL, NaN and the infinities give false."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < INF), F.lit(False))


def finite_or_null(c: Column) -> Column:
    return F.when(is_finite(c), c)


def nan_if_not_finite(c: Column) -> Column:
    return F.when(is_finite(c), c).otherwise(F.lit(NAN))


def compare(op: Column, x: Column, bound: Column) -> Column:
    """``x op bound`` where any comparison with NaN or NULL is false."""
    hit = (
        F.when(op == ">", x > bound)
        .when(op == ">=", x >= bound)
        .when(op == "<", x < bound)
        .when(op == "<=", x <= bound)
    )
    return F.coalesce(F.when(F.isnan(x) | F.isnan(bound), False).otherwise(hit), F.lit(False))


def select_metric(metric: Column, value: Column, low: Column, high: Column, avg: Column) -> Column:
    return F.when(metric == "min", low).when(metric == "max", high).when(metric == "avg", avg).otherwise(value)



def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def clean_patterns(patterns: Column) -> Column:
    """Trim every pattern, drop the blank ones, lower-case the rest."""
    return F.filter(F.transform(patterns, lambda p: F.lower(F.trim(p))), lambda p: p != "")


def slug(c: Column) -> Column:
    """Name -> ``[a-z0-9._-]`` text of at most 50 characters, ``rule`` if empty."""
    s = F.substring(F.regexp_replace(ascii_lower(c), "[^a-z0-9._-]", "-"), 1, 50)
    return F.when(s == "", F.lit("rule")).otherwise(s)


def event_id(rule: Column, seq: Column) -> Column:
    return F.concat(rule, F.lit("-"), seq.cast("string"))


def event_key(rule: Column, seq: Column) -> Column:
    """``{seq:010}-{slug}``; longer numbers are not cut."""
    s = seq.cast("string")
    padded = F.when(F.length(s) < 10, F.lpad(s, 10, "0")).otherwise(s)
    return F.concat(padded, F.lit("-"), slug(rule))


def duration_seconds(c: Column) -> Column:
    """``1d12h`` / ``90m`` / bare seconds -> whole seconds; NULL when invalid.

    Invalid are: empty text, a zero total, signs, unknown units, trailing digits
    and anything that does not fit 64 bits.
    """
    low = ascii_lower(c)
    bare = low.rlike("^[0-9]+$")
    segmented = low.rlike("^([0-9]+[dhms])+$")
    parts = F.regexp_extract_all(low, F.lit("([0-9]+)([dhms])"), 1)
    units = F.regexp_extract_all(low, F.lit("([0-9]+)([dhms])"), 2)
    # 38-digit decimals hold any product of a 19-digit count and 86400 exactly.
    seconds = F.aggregate(
        F.zip_with(
            parts, units,
            lambda n, u: _wide(n) * F.when(u == "d", 86400).when(u == "h", 3600)
            .when(u == "m", 60).otherwise(1).cast("decimal(6,0)"),
        ),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, x: (acc + x).cast("decimal(38,0)"),
    )
    total = F.when(bare, _wide(low).cast("decimal(38,0)")).when(segmented, seconds)
    return F.when((total > 0) & (total <= F.lit(2**63 - 1).cast("decimal(38,0)")), total.cast("long"))


def _wide(digits: Column) -> Column:
    stripped = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    return F.when(F.length(stripped) <= 19, stripped.cast("decimal(19,0)"))


def window_bound(c: Column, zone: str = "UTC", end: bool = False) -> Column:
    """RFC 3339 instant, local date-time or bare date -> TIMESTAMP.

    A bare date means the start of that day in ``zone``, or its last microsecond
    when ``end`` is set. NULL when the text is none of the three.
    """
    bare = c.rlike(r"^\d{4}-\d{2}-\d{2}$")
    local = c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?$")
    instant = has_offset(c) & c.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}")
    midnight = F.try_to_timestamp(F.when(bare, F.concat(c, F.lit(" 00:00:00 UTC"))))
    if end:
        midnight = midnight + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 1 MICROSECOND")
    civil = F.try_to_timestamp(F.when(local, F.concat(c, F.when(F.length(c) == 16, ":00Z").otherwise("Z"))))
    return (
        F.when(bare, F.to_utc_timestamp(midnight, zone))
        .when(local, F.to_utc_timestamp(civil, zone))
        .when(instant, F.try_to_timestamp(c))
    )


def has_offset(c: Column) -> Column:
    return c.rlike(r"([Zz]|[+-]\d{2}:?\d{2})$")


def iso_micros(ts: Column) -> Column:
    """ISO-8601 with six fractional digits, in the session zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def severity_rank(c: Column) -> Column:
    out = F.lit(None).cast("int")
    for rank, name in enumerate(SEVERITIES):
        out = F.when(c == name, F.lit(rank)).otherwise(out)
    return out


def severity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), (rank + 1).cast("int"))


def mover_score(first: Column, last: Column) -> Column:
    """Relative movement in [0, 2]; the floor of 1 keeps small bases tame."""
    d = F.greatest(F.abs(first), F.abs(last), F.lit(1.0))
    return F.coalesce(F.abs(last / d - first / d), F.lit(0.0))


def leading_timestamp(line: Column) -> Column:
    """The timestamp text when it is the record's first key, else ''."""
    return F.regexp_extract(line, r'^\s*\{\s*"timestamp"\s*:\s*"([^"\\]*)"', 1)


# --- canonical JSON ---------------------------------------------------------------
# One text for each value, so that sizes in bytes are the same wherever it is rendered.


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# A number is written out while its decimal point is not more than so many places
# behind its first digit, or before it.
PLAIN_BEFORE, PLAIN_AFTER = 16, 5


def shortest_digits(c: Column) -> Column:
    """Text of a finite number with the fewest digits that read back as the same number.

    The JVM's own text may have more; fifteen digits decide whether fewer would do, but for the
    smallest numbers, which hold fewer.
    """
    own = c.cast("string")
    places = [F.format_string(f"%.{n}e", c) for n in range(17)]
    ways = [F.when(t.cast("double") == c, t) for t in places]
    short = F.coalesce(*ways[14:], own)
    return F.when(c < 2.0**-1022, F.coalesce(*ways, own)).when(F.length(F.regexp_replace(F.substring_index(own, "E", 1), r"[-.]|^-?0\.0*", "")) > 15, short).otherwise(own)


def json_number(c: Column) -> Column:
    """A double as JSON: shortest digits, ``1.0``, ``0.00001``, ``1e16``, ``1.5e-7``; null for what is no number."""

    def laid_out(x: Column) -> Column:
        digits, power = x["digits"], x["power"]
        n = F.length(digits)
        point = n + power
        tail = F.concat(F.lit("e"), (point - 1).cast("string"))
        return (
            F.when((power >= 0) & (point <= PLAIN_BEFORE), F.concat(digits, F.repeat(F.lit("0"), power), F.lit(".0")))
            .when((point > 0) & (point <= PLAIN_BEFORE), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, n)))
            .when((point > -PLAIN_AFTER) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
            .when(n == 1, F.concat(digits, tail))
            .otherwise(F.concat(F.substring(digits, 1, 1), F.lit("."), F.substring(digits, F.lit(2), n), tail)))

    def taken_apart(text: Column) -> Column:
        """(digits without zeros on either side, power of ten of the last one)."""
        mantissa = F.regexp_replace(text, "[eE].*$", "")
        places = F.length(F.regexp_extract(mantissa, r"\.(.*)$", 1))
        power = F.coalesce(F.nullif(F.regexp_extract(text, r"[eE]\+?(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
        whole = F.regexp_replace(mantissa, r"\.|^0+\.?0*", "")
        return let(F.struct(whole.alias("whole"), (power - places).alias("power")), lambda w: F.struct(
            F.rtrim(w.whole, F.lit("0")).alias("digits"), (w.power + F.length(w.whole) - F.length(F.rtrim(w.whole, F.lit("0")))).alias("power")))

    sign = F.when(c.cast("string").startswith("-"), "-").otherwise("")
    positive = let(shortest_digits(F.abs(c)), lambda t: let(taken_apart(t), laid_out))
    return F.when(finite_or_null(c).isNull(), "null").when(c == 0, F.concat(sign, F.lit("0.0"))).otherwise(F.concat(sign, positive))


def json_text(c: Column) -> Column:
    """A string as JSON; control characters that have no letter of their own as lower-case hex."""
    quoted = F.to_json(F.array(c))
    quoted = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    hexed = quoted
    for x in "ABCDEF":
        hexed = F.regexp_replace(hexed, r"((?<!\\)(?:\\\\)*\\u00[01])" + x, "$1" + x.lower())
    return F.when(c.isNull(), "null").when(quoted.rlike(r"\\u00[01][A-F]"), hexed).otherwise(quoted)


def json_object(fields: dict[str, Column], types: dict[str, str] | None = None) -> Column:
    """An object with its keys in order. ``types`` says which fields are a ``number`` or a ``text``; others are put in as they print."""
    render = {"number": json_number, "text": json_text}
    parts = []
    for i, (name, c) in enumerate(fields.items()):
        put = render.get((types or {}).get(name, ""), lambda x: F.coalesce(x.cast("string"), F.lit("null")))
        parts += [F.lit(("," if i else "{") + f'"{name}":'), put(c)]
    return F.concat(*parts, F.lit("}"))


def event_object() -> Column:
    """The event in the row's columns as JSON, with the contract's keys in its order."""
    types = {k: "number" if kind.startswith("number") else "" if kind == "int" else "text" for k, kind in EVENT_KINDS.items()}
    return json_object({k: F.col(k) for k in EVENT_KINDS}, types)
