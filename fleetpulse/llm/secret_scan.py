"""Secrets in texts, found through an inverted index of the trigrams that the rules' patterns cannot do without."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import text_or_empty
from fleetpulse.session import written

#: A clause is a set of alternatives, of which one must hold; an alternative is a set of trigrams that must all occur.
Clause = frozenset[frozenset[str]]


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``group`` has at least ``least`` characters; others are passed over."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


#: The three kinds of the query's contract come first and in this order (fixed values). An access or hex
#: match ends where its run of characters does, so that a minimal length in the pattern only drops matches.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Published token formats (fixed values).
TOKEN_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("npm", r"npm_[A-Za-z0-9]{36}"),
    Rule("private", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + TOKEN_RULES

#: More strings than this at one place of a pattern are not spelled out.
MOST_STRINGS = 64
#: Running sums are made in blocks of this many matches.
BLOCK = 256
#: Trigrams in one long of a document's bit set.
WORD = 62


def trigrams(s: str) -> frozenset[str]:
    return frozenset(s[i : i + 3] for i in range(len(s) - 2))


def clause_of(strings: set[str]) -> list[Clause]:
    """What holds for a text with one of the strings in it; nothing if one of them is too short."""
    sets = {trigrams(s) for s in strings}
    if not all(sets):
        return []
    return [frozenset(a for a in sets if not any(b < a for b in sets))]


def spelled(item: tuple) -> tuple[set[str] | None, list[Clause]]:
    """(all lower-cased strings that this part of a pattern can match, if they are few, clauses that hold anyway)."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}, []
    if op is sre.AT:
        return {""}, []
    if op is sre.IN and all(o in (sre.LITERAL, sre.RANGE) for o, _ in arg):
        spans = [(a, a) if o is sre.LITERAL else a for o, a in arg]
        if sum(e - s + 1 for s, e in spans) <= MOST_STRINGS:
            return {chr(c).lower() for s, e in spans for c in range(s, e + 1)}, []
    if op is sre.SUBPATTERN:
        return sequence_of(arg[3])
    if op is sre.BRANCH:
        ways = [sequence_of(x)[0] for x in arg[1]]
        return (None, []) if None in ways else (set().union(*ways), [])
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = arg
        strings, clauses = sequence_of(inner)
        if strings is not None and most <= 3 and len(strings) ** most <= MOST_STRINGS:
            out, power = set(), {""}
            for n in range(most + 1):
                out |= power if n >= least else set()
                power = {a + b for a in power for b in strings}
            return out, []
        return None, (clauses + clause_of(strings or {""}) if least else [])
    return None, []


def sequence_of(items: Iterable[tuple]) -> tuple[set[str] | None, list[Clause]]:
    """As ``spelled``, for parts that follow each other."""
    held, clauses, whole = {""}, [], True
    for item in items:
        strings, inner = spelled(item)
        clauses += inner
        if strings is None or len(held) * len(strings) > MOST_STRINGS:
            clauses += clause_of(held)
            held, whole = strings or {""}, False
        else:
            held = {a + b for a in held for b in strings}
    return (held, clauses) if whole else (None, clauses + clause_of(held))


def trigram_query(pattern: str) -> list[Clause]:
    """Clauses over lower-cased trigrams that every text with a match fulfils; none if the pattern has no mandatory trigram."""
    strings, clauses = sequence_of(sre_parser.parse(pattern))
    return list(dict.fromkeys(clauses + (clause_of(strings) if strings is not None else [])))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column) -> Column:
    """Running sums of an array, block by block, so that appending stays cheap in long arrays."""

    def sums(part: Column, first: Column) -> Column:
        start = F.struct(first.cast("bigint").alias("sum"), F.array().cast("array<bigint>").alias("all"))
        return F.aggregate(
            part, start, lambda s, x: F.struct((s.sum + x).alias("sum"), F.array_append(s["all"], s.sum + x).alias("all")), lambda s: s["all"])

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK)), lambda i: F.slice(numbers, (i * BLOCK + 1).cast("int"), BLOCK))
    return let(blocks, lambda b: let(
        F.concat(F.array(F.lit(0).cast("bigint")), sums(F.transform(b, total), F.lit(0))),
        lambda before: F.flatten(F.transform(b, lambda part, i: sums(part, F.get(before, i))))))


class Index:
    """The trigrams that the rules ask for, and the rules' queries over bit sets of them."""

    def __init__(self, rules: tuple[Rule, ...]) -> None:
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.terms = sorted({t for q in self.queries for c in q for a in c for t in a})
        self.bit = {t: divmod(i, WORD) for i, t in enumerate(self.terms)}
        self.words = -(-len(self.terms) // WORD)

    def postings(self, docs: DataFrame) -> DataFrame:
        """(trigram number, key): a posting for each trigram asked for and each document that has it, by trigram."""
        folded = docs.select("key", F.lower("text").alias("folded"))
        found = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(i)) for i, t in enumerate(self.terms)]))
        return folded.select(F.explode(found).alias("term"), "key").sortWithinPartitions("term")

    def candidates(self, postings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
        """(key, rules): the rules whose query the document's postings fulfil. Postings meet by key; a bit for each trigram."""
        masks = [
            F.bit_or(F.when(F.floor(F.col("term") / WORD) == w, F.expr(f"shiftleft(1L, term % {WORD})")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}")
            for w in range(self.words)
        ]

        def has(terms: frozenset[str]) -> Column:
            need = [sum(1 << b for w, b in map(self.bit.get, terms) if w == word) for word in range(self.words)]
            return all_of([F.col(f"w{w}").bitwiseAND(F.lit(n)) == n for w, n in enumerate(need) if n])

        def asks(query: list[Clause]) -> Column:
            return all_of([any_of([has(a) for a in sorted(c, key=sorted)]) for c in query])

        met = postings.groupBy("key").agg(*masks)
        hits = F.array_compact(F.array(*[F.when(asks(q), F.lit(k)) for k, q in enumerate(self.queries) if q]))
        return met.select("key", hits.alias("rules")).filter(F.size("rules") > 0)


def all_of(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def any_of(tests: list[Column]) -> Column:
    return ~all_of([~t for t in tests])


def matches(found: DataFrame, rules: tuple[Rule, ...], queries: list[list[Clause]]) -> DataFrame:
    """Add ``found``: what the rules match in ``text``, as (start, rule, end, kind) in order; rules with a query only where ``rules`` lists them."""
    none = F.array().cast("array<string>")

    def texts(k: int, group: int) -> Column:
        out = F.regexp_extract_all("text", F.lit(rules[k].pattern), F.lit(group))
        return F.when(F.array_contains("rules", k), out).otherwise(none) if queries[k] else out

    found = found.withColumns({f"m{k}": texts(k, 0) for k in range(len(rules))})
    found = found.withColumns({f"g{k}": F.when(F.size(f"m{k}") > 0, texts(k, r.group)).otherwise(none) for k, r in enumerate(rules) if r.group})

    def ends(k: int) -> Column:
        """A match ends where it, all matches before it and all text between them end."""
        return let(F.split("text", rules[k].pattern, -1), lambda between: let(
            F.transform(F.col(f"m{k}"), lambda m, i: F.length(m) + F.length(F.get(between, i))), running))

    found = found.withColumns({f"e{k}": F.when(F.size(f"m{k}") > 0, ends(k)) for k in range(len(rules))})

    def spans(k: int) -> Column:
        r = rules[k]
        size = F.transform(F.col(f"g{k}" if r.group else f"m{k}"), lambda m: F.length(m))
        all_spans = F.transform(F.col(f"m{k}"), lambda m, i: F.struct(
            (F.get(F.col(f"e{k}"), i) - F.length(m)).alias("start"), F.lit(k).alias("rule"), F.get(F.col(f"e{k}"), i).alias("end"),
            F.lit(r.kind).alias("kind"), F.get(size, i).alias("size")))
        good = F.filter(all_spans, lambda s: s["size"] >= r.least)
        return F.transform(good, lambda s: F.struct(s.start.alias("start"), s.rule.alias("rule"), s.end.alias("end"), s.kind.alias("kind")))

    return found.withColumn("found", F.array_sort(F.concat(*[spans(k) for k in range(len(rules))])))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where the rules match in each document: ``doc_id, found``, a row for each row of ``docs``.

    ``found`` is an array of (start, rule, end, kind), in code points, end exclusive, by
    start and then by the rule's place in ``rules``. Matches of one rule are the leftmost ones
    that do not overlap; those whose group is too short are dropped after that.

    A Boolean query over trigrams is derived from each pattern. The index holds a posting
    for each trigram that some query names and each document with it, and is written once;
    other trigrams are never looked up. Postings are intersected and united by the queries, and only the
    candidates' own rules are run over their texts. Rules without a mandatory trigram run over
    all texts. The index folds case, so that a candidate may fail, but none is missed.
    All is map-side but for two shuffles by a hash of id and text: the postings', combined
    before it, and the join that brings a text and its candidate rules together. Two
    documents with one hash only share candidates.

    Nulls: a null text is empty; a row without an id is scanned like any other. Repeated rows
    each give a row. An empty table gives no rows. Other columns are ignored, whatever
    their names. Patterns are of the syntax that Java, RE2 and Python read alike.
    """
    index = Index(rules)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    if index.terms:
        rows = rows.join(index.candidates(written(index.postings(rows), "trigrams"), rules), "key", "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<int>"))
    return matches(rows, rules, index.queries).select("doc_id", "found")


def secret_digest(found: DataFrame) -> DataFrame:
    """``doc_id``, the number of spans of each base kind, a digest of the base spans and all spans as text."""
    base = [r.kind for r in BASE_RULES]

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(joined(F.filter("found", lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"))


def secret_sql() -> str:
    """The query of ``secret_digest(scan_secrets(documents))`` for DuckDB, without an index."""
    parts = []
    for k, r in enumerate(RULES):
        pattern = r.pattern.replace("'", "''")
        parts.append(f"""
  SELECT row, {k} AS rule, '{r.kind}' AS kind, i, length(m) AS size, length(g) AS own, length(b) AS gap FROM (
    SELECT row, unnest(m) AS m, unnest(g) AS g, unnest(b[:len(m)]) AS b, unnest(range(len(m))) AS i FROM (
      SELECT row, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS g,
        regexp_split_to_array(text, '{pattern}') AS b FROM docs WHERE regexp_matches(text, '{pattern}')))""")
    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(RULES))
    base = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
matched AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT *, sum(size + gap) OVER (PARTITION BY row, rule ORDER BY i)::BIGINT AS stop FROM matched),
spans AS (
  SELECT row, rule, kind, stop - size AS start, kind || ':' || (stop - size) || ':' || stop AS said FROM placed
  WHERE own >= CASE rule {least} END)
SELECT doc_id, {counts}, sha256(coalesce(string_agg(said, ',' ORDER BY start, rule) FILTER (rule < {base}), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, rule), '') AS spans
FROM docs LEFT JOIN spans USING (row) GROUP BY row, doc_id"""
