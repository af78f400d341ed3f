"""URL verdicts from a tree of path templates per host, with given rules first."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host with path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
HEX_WORD = r"(?i)\b[0-9a-f]{12,}\b"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits ``host`` and ``path``, or null. Rules are literals: give thousands, not millions."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, slash, prefix = rule.partition("/")
        fits = (F.col("host") == domain) | F.col("host").endswith("." + domain)
        found = F.when(fits & F.col("path").startswith(slash + prefix), F.lit(rule)).otherwise(found)
    return found


def shape_of(path: Column) -> Column:
    """The path with each run of digits as {n}, hexadecimal words of twelve letters or more as {x}."""
    hexed = F.regexp_replace(path, HEX_WORD, "{x}")
    return F.regexp_replace(hexed, "[0-9]+", "{n}")


def named_shapes(shapes: DataFrame, min_count: int, min_share: float) -> DataFrame:
    """``shapes`` (host, shape, n, ...) with ``leaf``: the shape with its rare segments as wildcards.

    The tree is built from the top: a segment keeps its name where it is frequent among all pages whose
    segments above it have got the same names, wildcards included. So what stands below a variable
    segment is counted over all its values. A level is one written table; done with are shapes that
    have no further segment, whose node has only one way down (all literal), or whose node is
    too small to have a frequent branch (all wildcards), so deep paths do not mean many levels.
    """
    node, done = ["host", "prefix"], []
    todo = shapes.withColumn("segments", F.split(F.substring(F.col("shape"), 2, 1 << 30), "/", -1)).withColumn("prefix", F.lit(""))
    for level in count():
        rest = F.size("segments") - level
        rows = todo.withColumn("segment", F.col("segments")[level]).withColumn("below", F.array_join(F.slice("segments", level + 1, rest), "/"))
        trunk = rows.groupBy(*node).agg(F.sum("n").alias("all"), (F.min("below") == F.max("below")).alias("alike"))
        branch = rows.groupBy(*node, "segment").agg(F.sum("n").alias("here"))
        name = F.when((F.col("here") >= min_count) & (F.col("here") >= min_share * F.col("all")), F.col("segment")).otherwise(F.lit("*"))
        longer = F.concat_ws("/", "prefix", name)
        leaf = (
            F.when(F.col("all") < min_count, F.concat("prefix", F.repeat(F.lit("/*"), rest)))
            .when(F.col("alike"), F.concat_ws("/", "prefix", "below"))
            .when(rest == 1, longer)
        )
        step = written(
            rows.join(branch, [*node, "segment"]).join(trunk, node)
            .select(*shapes.columns, "segments", longer.alias("prefix"), leaf.alias("leaf")), "templates")
        done.append(step.filter("leaf is not null").select(*shapes.columns, "leaf"))
        todo = step.filter("leaf is null").drop("leaf")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, done)


def template_tree(
    urls: DataFrame, labelled: DataFrame, min_count: int = 5, min_share: float = 0.002, z: float = 1.96, weight: float = 8.0,
) -> DataFrame:
    """``host, shape, template, purity``: the templates of all shapes, and how clean their pages are.

    ``urls`` has host and shape; ``labelled`` host, shape and bad (0 or 1). A segment of a shape
    stays a literal where it is frequent below its node, and is a wildcard elsewhere (``named_shapes``). Among
    the leaves below one prefix, those whose share of bad pages does not differ significantly from
    that of all of them (``z``) are merged. Purity is the share of good labels, smoothed with
    ``weight`` labels at the host's rate, which is smoothed likewise with the rate of all labels.
    """
    counts = urls.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"))
    marks = labelled.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("labels"), F.sum("bad").alias("bad"))
    named = named_shapes(counts.join(marks, ["host", "shape"], "left").na.fill(0, ["labels", "bad"]), min_count, min_share)
    leaves = named.withColumn("stem", F.regexp_extract("leaf", r"^(.*/)[^/]*$", 1)).withColumn(
        "stem", F.when(F.col("leaf").endswith("/"), F.regexp_extract("leaf", r"^(.*/)[^/]*/$", 1)).otherwise(F.col("stem")))
    rates = leaves.groupBy("host", "stem", "leaf").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    stems = rates.groupBy("host", "stem").agg(F.sum("labels").alias("stem_labels"), F.sum("bad").alias("stem_bad"))
    p = F.col("stem_bad") / F.greatest(F.col("stem_labels"), F.lit(1))
    apart = (F.col("labels") > 0) & (
        F.abs(F.col("bad") / F.greatest(F.col("labels"), F.lit(1)) - p) > z * F.sqrt(p * (1 - p) / F.greatest(F.col("labels"), F.lit(1))))
    merged = rates.join(stems, ["host", "stem"]).withColumn(
        "template", F.when(apart, F.col("leaf")).otherwise(F.concat("stem", F.lit("**"))))
    totals = merged.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad"))
    hosts = totals.groupBy("host").agg(F.sum("labels").alias("host_labels"), F.sum("bad").alias("host_bad"))
    overall = hosts.agg((F.sum("host_bad") / F.greatest(F.sum("host_labels"), F.lit(1))).alias("rate"))
    smooth = lambda bad, n, rate: (bad + weight * rate) / (n + weight)
    rated = (
        totals.join(hosts, "host").withColumn("one", F.lit(1)).join(overall.withColumn("one", F.lit(1)), "one")
        .withColumn("host_rate", smooth(F.col("host_bad"), F.col("host_labels"), F.coalesce("rate", F.lit(0.0))))
        .select("host", "template", (1 - smooth(F.col("bad"), F.col("labels"), F.col("host_rate"))).alias("purity"))
    )
    of_leaf = merged.select("host", "leaf", "template").distinct()
    return named.join(of_leaf, ["host", "leaf"]).join(rated, ["host", "template"]).select("host", "shape", "template", "purity")


def judge_urls(
    pages: DataFrame, labelled: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, min_purity: float = 0.5, salts: int = 16,
    id_col: str = "page_id", url_col: str = "url", **tree: float,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` for every page.

    ``labelled`` has ``url`` and ``bad`` (0 or 1). The longest fitting rule decides; else a
    page is blocked if its template's smoothed purity is below ``min_purity``.

    Counts are combined before each shuffle. Pages meet their templates in a join on (host, shape),
    spread over ``salts`` parts, so that a host with a third of all pages does not land in one
    task; the template table is repeated ``salts`` times for it, and has one row per distinct shape.

    A null url, or one without ``://``, has an empty host and path, and goes to the template of
    all such urls. Ids may be null or repeat: each row is judged. Other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    shaped = rows.withColumn("shape", shape_of(F.col("path")))
    seen = labelled.select(host_of(F.col("url")).alias("host"), shape_of(path_of(F.col("url"))).alias("shape"), F.col("bad").cast("int").alias("bad"))
    known = template_tree(shaped.select("host", "shape"), seen.filter("bad is not null"), **tree)
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    verdicts = {rule: verdict for verdict, rule in rules}
    ruled = F.lit(None).cast("string")
    for rule, verdict in verdicts.items():
        ruled = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(ruled)
    return (
        shaped.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int")).join(known, ["host", "shape", "salt"], "left")
        .withColumn("rule", fitting_rule(rules))
        .withColumn("verdict", F.coalesce(ruled, F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow"))))
        .select("page_id", "host", "path", "rule", "verdict", "template", F.round("purity", 9).alias("purity"))
    )


def document_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad`` of the pages whose document has labels; the document's id is the first number of the path."""
    numbered = pages.select("url", F.expr("try_cast(regexp_extract(url, '://[^/?#]*/[^?#]*?([0-9]+)', 1) as bigint)").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    return numbered.filter("doc_id is not null").join(bad, "doc_id").select("url", "bad")


def urls_sql(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """``judge_urls`` over ``pages`` with ``document_labels``, for DuckDB."""
    fits, verdicts = [], []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, prefix = rule.partition("/")
        fits.append(f"WHEN (host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{slash}{prefix}') THEN '{rule}'")
        verdicts.append(f"WHEN '{rule}' THEN '{verdict}'")
    return rf"""
WITH RECURSIVE url AS (
  SELECT *, regexp_replace(regexp_replace(path, '{HEX_WORD}', '{{x}}', 'g'), '[0-9]+', '{{n}}', 'g') AS shape
  FROM (SELECT page_id, url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)),
bad_doc AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
mark AS (
  SELECT host, shape, count(*) AS labels, sum(bad) AS bad
  FROM (SELECT *, TRY_CAST(regexp_extract(url, '://[^/?#]*/[^?#]*?([0-9]+)', 1) AS BIGINT) AS doc_id FROM url) JOIN bad_doc USING (doc_id) GROUP BY ALL),
shapes AS (
  SELECT host, shape, n, coalesce(labels, 0) AS labels, coalesce(bad, 0) AS bad
  FROM (SELECT host, shape, count(*) AS n FROM url GROUP BY ALL) LEFT JOIN mark USING (host, shape)),
tree AS (
  SELECT host, shape, n, labels, bad, string_split(substr(shape, 2), '/') AS seg, 0 AS i, '' AS prefix FROM shapes
  UNION ALL
  SELECT host, shape, n, labels, bad, seg, i + 1, prefix || '/' || CASE WHEN here >= 5 AND here >= 0.002 * total THEN seg[i + 1] ELSE '*' END
  FROM (SELECT *, sum(n) OVER (PARTITION BY host, prefix, seg[i + 1]) AS here, sum(n) OVER (PARTITION BY host, prefix) AS total FROM tree WHERE i < len(seg))),
leaves AS (
  SELECT host, shape, labels, bad, prefix AS leaf,
         regexp_extract(prefix, CASE WHEN ends_with(prefix, '/') THEN '^(.*/)[^/]*/$' ELSE '^(.*/)[^/]*$' END, 1) AS stem
  FROM tree WHERE i = len(seg)),
rates AS (SELECT host, stem, leaf, sum(labels) AS labels, sum(bad) AS bad FROM leaves GROUP BY ALL),
stems AS (SELECT *, sum(bad) OVER (PARTITION BY host, stem) / greatest(sum(labels) OVER (PARTITION BY host, stem), 1) AS p FROM rates),
merged AS (
  SELECT host, leaf, labels, bad,
         CASE WHEN labels > 0 AND abs(bad / greatest(labels, 1) - p) > 1.96 * sqrt(p * (1 - p) / greatest(labels, 1)) THEN leaf ELSE stem || '**' END AS template
  FROM stems),
totals AS (SELECT host, template, sum(labels) AS labels, sum(bad) AS bad FROM merged GROUP BY ALL),
hosts AS (
  SELECT host, (sum(bad) + 8.0::DOUBLE * (SELECT sum(bad) / greatest(sum(labels), 1) FROM totals)) / (sum(labels) + 8.0::DOUBLE) AS rate
  FROM totals GROUP BY host),
rated AS (SELECT host, template, 1 - (bad + 8.0::DOUBLE * rate) / (labels + 8.0::DOUBLE) AS purity FROM totals JOIN hosts USING (host)),
ruled AS (SELECT *, CASE {" ".join(fits)} END AS rule FROM url)
SELECT page_id, host, path, rule,
  coalesce(CASE rule {" ".join(verdicts)} END, CASE WHEN purity < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 9) AS purity
FROM ruled JOIN leaves USING (host, shape) JOIN merged USING (host, leaf) JOIN rated USING (host, template)"""
