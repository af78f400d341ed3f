"""Which series a table of rules watches, by an inverted index of the series' names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from fleetpulse.operators import blocked

NAMES = ["sensor", "reading", "type"]
GRAM = 3
PACK = 64  # rules that go to a series in one row
SALTS = 16  # parts of the series that grant one wish


def _tagged(tag: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.concat(F.lit(tag), g))


def _grams(text: Column, shorter: bool) -> Column:
    """The parts of ``GRAM`` characters of a text; with ``shorter`` all shorter ones too, else only the text itself if it is shorter."""
    n = F.length(text)
    none = F.array().cast("array<string>")
    at = lambda width: F.when(n >= width, F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.substring(text, i, F.lit(width)))).otherwise(none)
    if shorter:
        return F.array_distinct(F.concat(*[at(w) for w in range(1, GRAM + 1)]))
    return F.coalesce(F.when(n >= GRAM, F.array_distinct(at(GRAM))).when(n > 0, F.array(text)), none)


def postings(series: DataFrame, kept: list[str] = []) -> DataFrame:
    """(gram, sensor, reading, type, kept): every part of up to ``GRAM`` characters of a series' lower-cased names, its label, and the empty gram."""
    grams = F.concat(
        _tagged("s:", _grams(F.lower("sensor"), True)), _tagged("r:", _grams(F.lower("reading"), True)),
        F.array_compact(F.array(F.concat(F.lit("t:"), F.col("type")))), F.array(F.lit("")))
    return series.select(F.explode(grams).alias("gram"), *NAMES, *kept)


def by_wish(rules: DataFrame, carried: list[str] = []) -> DataFrame:
    """``rules`` with ``wish``, one text for all that ask for the same: they are looked up and verified once."""
    each = [F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in (F.lower("sensor"), F.lower("reading"), F.col("type"))]
    return rules.select("rule_idx", *carried, *NAMES, F.concat(*each).alias("wish"))


def watched_series(series: DataFrame, rules: DataFrame, carried: list[str] = []) -> DataFrame:
    """(sensor, reading, type, rule_idx, carried) of each of the distinct ``series`` and each rule that watches it.

    ``rules`` has rule_idx and the trimmed matchers sensor, reading (parts of the names, in any case) and
    type (a canonical label). A rule is looked up under the one of its grams that the fewest
    series have, and what is found there is verified. A rule without matchers stands under the empty gram: it watches
    all. Both sides are tables; a gram that many series share is used only by rules that have nothing rarer.
    """
    rules = by_wish(rules, carried)
    return granted_wishes(series, rules).join(rules.select("wish", "rule_idx", *carried), "wish").select(*NAMES, "rule_idx", *carried)


def granted_wishes(series: DataFrame, rules: DataFrame, kept: list[str] = []) -> DataFrame:
    """(sensor, reading, type, kept, wish): each series with each distinct wish that it grants."""
    listed = postings(series, kept)
    rule = rules.select("wish", *[F.lower(c).alias(f"want_{c}") for c in ("sensor", "reading")], F.col("type").alias("want_type")).distinct()
    asked = F.concat(
        _tagged("s:", _grams(F.coalesce("want_sensor", F.lit("")), False)), _tagged("r:", _grams(F.coalesce("want_reading", F.lit("")), False)),
        F.array_compact(F.array(F.concat(F.lit("t:"), F.col("want_type")))), F.array(F.lit("")))
    asks = rule.select("*", F.explode(asked).alias("gram"))
    sizes = blocked.shuffled_once(listed, ["gram"], [F.count(F.lit(1)).alias("n")], derived=bool(kept)).select("gram", F.col("n").alias("__n"))
    rarest = asks.join(sizes, "gram", "left").groupBy("wish", "want_sensor", "want_reading", "want_type").agg(
        F.min_by("gram", F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    holds = [
        F.col("want_sensor").isNull() | F.lower("sensor").contains(F.col("want_sensor")),
        F.col("want_reading").isNull() | F.lower("reading").contains(F.col("want_reading")),
        F.col("want_type").isNull() | (F.col("type") == F.col("want_type"))]
    found = rarest.join(listed, "gram")
    return found.where(holds[0] & holds[1] & holds[2]).select(*NAMES, *kept, "wish")


def watched_counts(readings: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_idx, sensor, reading, n): how many readings of each series each rule watches.

    Readings are counted by series, once, and series are matched with distinct wishes before
    rules come in, so that what grows with rules times series is the result alone. Its rows are made
    last, by unpacking up to ``PACK`` rules beside a series, in tasks that ``SALTS`` keeps even.
    """
    rules = by_wish(rules)
    parts = blocked.partitions_for(readings)
    counts = blocked.not_null(readings.groupBy(*NAMES).agg(F.count(F.lit(1)).alias("n")), NAMES)
    # Not nullable: a null test of the join would give this use of the counts a scan of its own.
    salt = F.coalesce(F.pmod(F.xxhash64("sensor", "reading"), F.lit(SALTS)).cast("int"), F.lit(0)).alias("salt")
    of_series = (
        granted_wishes(counts, rules, ["n"]).select("wish", salt, "sensor", "reading", "n").repartition(parts, "wish", "salt")
        .groupBy("wish", "salt", "sensor", "reading").agg(F.sum("n").alias("n")))
    asking = rules.groupBy("wish").agg(F.ceil(F.count(F.lit(1)) / PACK).alias("packs"))
    unnumbered = F.array_repeat(F.lit(None).cast(rules.schema["rule_idx"].dataType), F.count_if(F.col("rule_idx").isNull()).cast("int"))
    packs = (
        rules.select("wish", "rule_idx").join(asking, "wish").groupBy("wish", F.pmod(F.xxhash64("rule_idx"), F.col("packs")).alias("pack"))
        .agg(F.concat(F.collect_list("rule_idx"), unnumbered).alias("rules"))
        .select("wish", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "rules").repartition(parts, "wish", "salt"))
    return of_series.join(packs, ["wish", "salt"]).select(F.explode("rules").alias("rule_idx"), "sensor", "reading", "n")


def watched_total(readings: DataFrame, rules: DataFrame) -> int:
    """How many rows ``watched_readings`` has, from counts by series and by wish."""
    rules = by_wish(rules)
    counts = readings.groupBy(*NAMES).agg(F.count(F.lit(1)).alias("n"))
    granted = granted_wishes(counts.select(*NAMES), rules).join(counts, NAMES).groupBy("wish").agg(F.sum("n").alias("n"))
    asking = rules.groupBy("wish").agg(F.count(F.lit(1)).alias("rules"))
    return granted.join(asking, "wish").agg(F.sum(F.col("n") * F.col("rules"))).first()[0] or 0


def watched_readings(readings: DataFrame, rules: DataFrame, carried: list[str] = []) -> DataFrame:
    """Every reading with each rule that watches it, as ``rule_idx``: an equi-join on the names of its series.

    The rules' columns ``carried`` come along.
    """
    series = readings.select(*NAMES).distinct()
    of_series = watched_series(series, rules, carried).groupBy(*NAMES).agg(F.collect_list(F.struct("rule_idx", *carried)).alias("__rules"))
    return readings.join(of_series, NAMES).select(*readings.columns, F.inline("__rules"))
