"""Exact dedup by a 128-bit content hash, with the bytes compared inside each hash group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.common import SPACE, text_or_empty


def normalised(text_col: str = "text"):
    """The text with each run of white space as one space; null is the empty text."""
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16) -> DataFrame:
    """Which document of each set of equal texts stays.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row per distinct
    (id, text). The content hash is the first 128 bits (``hash_bytes``) of the SHA-256 of
    the normalised text. Texts are grouped by (hash, bytes): two texts that share a hash
    but not their bytes are two groups; ``hash_bytes`` can be made small to test just that.
    Equal texts are combined before the shuffle, so a text that a third of all rows holds
    costs one row per map task; the texts are shuffled once, all else is narrow. Documents
    meet their group in a shuffled join on the full digest, whose hot keys adaptive execution
    splits. Should two different texts ever have the same full digest, the job fails instead
    of merging them.

    Nulls: a null text is the empty text; a row without an id takes part in group sizes, but
    stays only where its whole group has no id. A row that repeats id and text counts once.
    Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("body"))
    rows = rows.select("doc_id", "body", F.unhex(F.sha2("body", 256)).alias("digest"))
    members = rows.select("doc_id", "digest").distinct()
    sizes = members.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    groups = (
        rows.groupBy(F.substring("digest", 1, hash_bytes).alias("hash"), "digest", "body")
        .agg(F.min("doc_id").alias("keep_id"))
    )
    clash = F.raise_error(F.lit("two different texts have one SHA-256")).cast("bigint")
    kept = groups.groupBy("digest").agg(F.when(F.count(F.lit(1)) > 1, clash).otherwise(F.min("keep_id")).alias("keep_id"))
    return (
        members.join(sizes.join(kept, "digest"), "digest")
        .select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one row for each different text.

    Of rows that repeat id and text, one stays. Different texts all stay, also where they
    share an id or have none.
    """
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("__exact_id"), F.unhex("text_sha256").alias("__exact_kept"))
    rows = docs.withColumn("__exact_digest", F.unhex(F.sha2(normalised(text_col), 256)))
    held = rows.join(kept, F.col(id_col).eqNullSafe(F.col("__exact_id")) & (F.col("__exact_digest") == F.col("__exact_kept")), "left_semi")
    return held.dropDuplicates(["__exact_digest"]).drop("__exact_digest")
