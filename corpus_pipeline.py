"""A training corpus from raw documents: quality, exact copies, near copies, mix, packing.

Each stage works on what the one before it kept; all but the last return the columns of
``documents``. Stages are (spark, docs, sf_dir) -> DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetpulse.llm.common import table
from fleetpulse.llm.exact_dedup import keep_first_copies
from fleetpulse.llm.jaccard_join import keep_one_of_each
from fleetpulse.llm.kneser_ney import keep_good
from fleetpulse.llm.sequence_pack import pack_documents
from fleetpulse.llm.source_mix import keep_mixed
from fleetpulse.session import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within their language's limits."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return keep_first_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one_of_each(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for the mix of sources, languages and forms."""
    return keep_mixed(docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("pack", pack_stage)]

#: SQL can express neither the language model's text pass nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
