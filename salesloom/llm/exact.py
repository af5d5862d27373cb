"""Exact deduplication: 128-bit content hashes group the texts, bytes decide inside a group, the smallest id stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.llm.common import SPACE, id_and_text, one_per_key, row_key, staged, whole_text, wrapped


def normalised(text: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(text, SPACE, " ")


def texts_by_hash(keyed: DataFrame) -> DataFrame:
    """One row per distinct text: its hash, smallest doc_id (nulls last), and number of rows.

    Grouping by hash and text compares the bytes. Copies meet in the partial aggregation first, so that a group
    of any size sends one row per task through the shuffle.
    """
    return keyed.groupBy("content_hash", "text").agg(
        F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )


def exact_groups(docs: DataFrame, hash_of=F.md5) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts, and all empty texts are one group. A null doc_id is larger than any other and stays
    only if its group has no other id; rows without id that are alike are all kept, as are rows that repeat the id
    that stays. An empty table gives an empty one. ``hash_of`` gives the content hash as text.

    The texts shuffle once. A row finds its group by the content hash and the SHA-256 that it reports, which tells
    texts apart whose content hashes collide.
    """
    rows = id_and_text(docs).withColumn("text", normalised(F.col("text")))
    keyed = rows.withColumn("content_hash", hash_of(F.col("text")))
    digest = F.sha2("text", 256).alias("text_sha256")
    groups = texts_by_hash(keyed).select("content_hash", digest, "keep_id", "group_size")
    found = keyed.select("doc_id", "content_hash", digest).join(groups, ["content_hash", "text_sha256"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return found.select("doc_id", "keep_id", "group_size", kept, "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: one row for every text, normalised, of the smallest id.

    Rows that share an id go by their own texts. Of rows with one id and one text, and of rows with one text in a group
    without ids, the one stays whose columns hash lowest. The texts shuffle once here and once for their groups.
    """
    kept = exact_groups(docs).where("kept").select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"))
    digest = F.sha2(normalised(whole_text(docs)), 256)
    rows = wrapped(docs, key=row_key(docs["doc_id"].cast("long"), digest))
    return one_per_key(rows, docs).join(staged(kept.distinct(), "kept"), "key", "left_semi").select("row.*")
