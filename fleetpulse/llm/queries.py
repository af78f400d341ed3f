"""One query per operator over its whole table, and the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.llm.common import table
from fleetpulse.llm.exact_dedup import exact_dedup
from fleetpulse.llm.hard_negatives import NEGATIVES_SQL, hard_negatives, moved_labels
from fleetpulse.llm.html_text import extract_pages
from fleetpulse.llm.jaccard_join import jaccard_components
from fleetpulse.llm.kneser_ney import quality
from fleetpulse.llm.nn_descent import nearest_neighbours
from fleetpulse.llm.secret_scan import scan_secrets, secret_digest, secret_sql
from fleetpulse.llm.sequence_pack import pack_documents
from fleetpulse.llm.source_mix import mix_sources, mix_sql
from fleetpulse.llm.suffix_dedup import suffix_dedup
from fleetpulse.llm.toxicity_knn import toxicity
from fleetpulse.llm.url_templates import document_labels, judge_urls, urls_sql
from fleetpulse.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_exact_dedup", r"""
WITH rows AS (
  SELECT DISTINCT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM rows WINDOW w AS (PARTITION BY text_sha256)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id of the copy that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op2_html_text")
def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op7_sequence_pack")
def op7_sequence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op3_url_templates", urls_sql())
def op3_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, document_labels(pages, table(spark, sf_dir, "labels")))


@query("op6_source_mix", mix_sql())
def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight, its probability and whether it is drawn."""
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op8_jaccard_join")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id that it is linked with."""
    return jaccard_components(table(spark, sf_dir, "documents"))


@query("op4_kneser_ney")
def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, its language's limits, and whether it is kept."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's size, and what is left of it without repeated strings."""
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept")


@query("op10_toxicity_knn")
def op10_toxicity_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, with the nearest labelled examples."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_nn_descent")
def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest five of every fiftieth vector."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op11_secret_scan", secret_sql())
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets."""
    return secret_digest(scan_secrets(table(spark, sf_dir, "documents")))


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four largest components."""
    return whiten(table(spark, sf_dir, "embeddings"))


@query("op13_hard_negatives", NEGATIVES_SQL)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector's positives, each with the negatives of its window."""
    return hard_negatives(moved_labels(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)
