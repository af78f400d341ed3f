"""Mixing sources to target weights by iterative proportional fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import text_or_empty
from fleetpulse.session import written

DIMS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"
#: The table has no topic; the form of a document stands for it.
FORMS = ((60, "fragment"), (400, "short"), (1500, "article"))


def form_of(tokens: Column) -> Column:
    out = F.lit("long")
    for most, name in reversed(FORMS):
        out = F.when(tokens < most, F.lit(name)).otherwise(out)
    return out


def unit_hash(col: Column) -> Column:
    """A number from 0 to 1 that depends on the value alone: the first 52 bits of its MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of one column: its token shares to a power, scaled to sum to 1."""
    own = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t")).withColumn("t", F.pow("t", F.lit(power)))
    return own.withColumn("one", F.lit(1)).join(own.agg(F.sum("t").alias("all")).withColumn("one", F.lit(1)), "one").select(
        dim, (F.col("t") / F.greatest(F.col("all"), F.lit(1e-300))).alias(f"{dim}_target"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int) -> DataFrame:
    """``cells`` with ``weight``, so that the weighted tokens have the target shares of every column.

    Every round divides, column by column, by the weighted sums of that column: small
    aggregates that are combined before their shuffle and joined back. Each round is written
    to the shared folder.
    """
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    now = cells.withColumn("weight", F.lit(1.0))
    for dim, target in targets.items():
        now = now.join(target, dim)
    for _ in range(rounds):
        for dim in targets:
            sums = now.groupBy(dim).agg(F.sum(F.col("tokens") * F.col("weight")).alias("__sum"))
            now = now.join(sums, dim).withColumn(
                "weight", F.when(F.col("__sum") > 0, F.col("weight") * F.col(f"{dim}_target") * total / F.col("__sum")).otherwise(F.lit(1.0))
            ).drop("__sum")
        now = written(now, "mix-round")
    return now


def sampling_scale(cells: DataFrame, budget_share: float, steps: int) -> float:
    """c such that keeping each document with probability min(1, c * weight) keeps the budgeted tokens."""
    t, w = F.col("tokens").cast("double"), F.col("weight")
    total, weighted = cells.agg(F.sum(t), F.sum(t * w)).first()
    if not total:
        return 0.0
    c = budget_share * total / weighted
    for _ in range(steps):
        whole = c * w >= 1
        taken, left = cells.agg(F.sum(F.when(whole, t).otherwise(0.0)), F.sum(F.when(whole, 0.0).otherwise(t * w))).first()
        if not left:
            break
        c = (budget_share * total - taken) / left
    return c


def mix_sources(
    docs: DataFrame, power: float = 0.5, budget_share: float = 0.6, rounds: int = 8, steps: int = 8, topic: Column | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """Which documents a mix of target weights samples.

    Tokens are words. The targets of source, language and topic are their token shares to
    ``power`` (below 1: small ones gain). Cells (source, language, topic) are raked to all three
    at once; a cell's weight times a common scale is the probability of its documents, at most 1,
    and ``budget_share`` of all tokens are kept on average. The draw depends on the id alone.

    Returns ``doc_id, source, lang, topic, n_tokens, weight, probability, kept`` (weight and
    probability rounded to 6 places). Nulls: null source, language or topic is a value of its own
    (an empty string); a null text has 0 tokens, and is drawn like its cell; rows without an id share
    one draw; rows that repeat an id are drawn alike. Without any tokens every weight is 1.
    """
    words = F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("bigint")
    given = F.coalesce(topic.cast("string"), F.lit("")) if topic is not None else form_of(F.col("n_tokens"))
    rows = docs.withColumn("__tokens", words).select(
        F.col(id_col).alias("doc_id"), text_or_empty(source_col).alias("source"), text_or_empty(lang_col).alias("lang"),
        *([given.alias("topic")] if topic is not None else []), F.col("__tokens").alias("n_tokens"))
    rows = written(rows if topic is not None else rows.withColumn("topic", given), "mix-rows")
    cells = written(rows.groupBy(*DIMS).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    raked = rake(cells, {d: tempered(cells, d, power) for d in DIMS}, rounds)
    scale = sampling_scale(raked, budget_share, steps)
    chances = raked.select(*DIMS, F.round("weight", 6).alias("weight"), F.round(F.least(F.lit(1.0), F.col("weight") * scale), 6).alias("probability"))
    return rows.join(chances, list(DIMS)).select(
        "doc_id", *DIMS, "n_tokens", "weight", "probability", (unit_hash(F.col("doc_id")) < F.col("probability")).alias("kept"))


def keep_mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the mix samples, with all their columns."""
    drawn = mix_sources(docs, id_col=id_col, **options).filter("kept").select(F.col("doc_id").alias("__drawn")).distinct()
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("__drawn")), "left_semi")


def mix_sql(power: float = 0.5, budget_share: float = 0.6, rounds: int = 8, steps: int = 8) -> str:
    """The same in SQL, one common table expression per step."""
    form = "CASE " + " ".join(f"WHEN n_tokens < {n} THEN '{name}'" for n, name in FORMS) + " ELSE 'long' END"
    ctes = [
        r"""counted AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents)""",
        f"rows AS (SELECT *, {form} AS topic FROM counted)",
        "cells AS (SELECT source, lang, topic, sum(n_tokens)::BIGINT AS tokens FROM rows GROUP BY ALL)",
    ]
    for d in DIMS:
        ctes.append(f"target_{d} AS (SELECT {d}, t / sum(t) OVER () AS {d}_target FROM (SELECT {d}, pow(sum(tokens)::DOUBLE, {power}) AS t FROM cells GROUP BY {d}))")
    ctes.append("raked0 AS (SELECT *, 1::DOUBLE AS weight, sum(tokens) OVER ()::DOUBLE AS total FROM cells "
                + " ".join(f"JOIN target_{d} USING ({d})" for d in DIMS) + ")")
    k = 0
    for _ in range(rounds):
        for d in DIMS:
            ctes.append(f"raked{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN s > 0 THEN weight * {d}_target * total / s ELSE 1 END AS weight) "
                        f"FROM (SELECT *, sum(tokens * weight) OVER (PARTITION BY {d}) AS s FROM raked{k}))".replace("SELECT * REPLACE", "SELECT * EXCLUDE (s) REPLACE"))
            k += 1
    ctes.append(f"scale0 AS (SELECT {budget_share} * sum(tokens::DOUBLE) / sum(tokens * weight) AS c FROM raked{k})")
    for i in range(steps):
        ctes.append(f"scale{i + 1} AS MATERIALIZED (SELECT coalesce(({budget_share} * sum(tokens::DOUBLE) - sum(CASE WHEN c * weight >= 1 THEN tokens::DOUBLE ELSE 0 END)) / "
                    f"nullif(sum(CASE WHEN c * weight >= 1 THEN 0 ELSE tokens * weight END), 0), min(c)) AS c FROM raked{k}, scale{i})")
    ctes.append(f"chances AS (SELECT source, lang, topic, round(weight, 6) AS weight, round(least(1, weight * c), 6) AS probability FROM raked{k}, scale{steps})")
    return "WITH " + ",\n".join(ctes) + (
        "\nSELECT doc_id, source, lang, topic, n_tokens, weight, probability, "
        "('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496 < probability AS kept FROM rows JOIN chances USING (source, lang, topic)")
