"""Incremental builds: change classes, merged history and the application of a change set.

Only keys and fingerprints are shuffled to find changes; texts move only for what is rebuilt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

CLASSES = ("new", "unchanged", "metadata_only", "rebuild", "removed")


def change_set(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(doc_id, change): current and previous (doc_id, source_path, source_fingerprint, text_fingerprint), matched by path.

    A known path keeps its previous doc_id; a renamed file is a new document and a removed one.
    """
    old = previous.select("source_path", F.col("doc_id").alias("old_id"), F.col("source_fingerprint").alias("old_source"), F.col("text_fingerprint").alias("old_text"))
    both = current.join(old, "source_path", "full_outer")
    change = F.when(F.col("old_id").isNull(), "new").when(F.col("doc_id").isNull(), "removed").when(F.col("source_fingerprint") == F.col("old_source"), "unchanged").when(F.col("text_fingerprint").eqNullSafe(F.col("old_text")), "metadata_only").otherwise("rebuild")
    return both.select(F.coalesce("old_id", "doc_id").alias("doc_id"), change.alias("change"))


def removed_documents(current: DataFrame, previous: DataFrame) -> DataFrame:
    return previous.select("doc_id").join(current.select("doc_id"), "doc_id", "left_anti")


def merge_history(current: DataFrame, rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """Rebuilt rows, active, and the current rows that they do not replace, inactive."""
    stale = current.join(rebuilt.select(*keys), keys, "left_anti").withColumn("is_active", F.lit(False))
    return rebuilt.withColumn("is_active", F.lit(True)).unionByName(stale.select(rebuilt.columns))


def apply_changes(stored: DataFrame, changes: DataFrame, fresh: DataFrame) -> DataFrame:
    """``stored`` without what is removed or rebuilt, and with the rebuilt and new rows of ``fresh``.

    Unchanged and metadata-only documents keep their stored rows.
    """
    gone = changes.filter(F.col("change").isin("removed", "rebuild")).select("doc_id")
    come = changes.filter(F.col("change").isin("new", "rebuild")).select("doc_id")
    return stored.join(gone, "doc_id", "left_anti").unionByName(fresh.join(come, "doc_id", "left_semi").select(stored.columns))


def active_count(docs: DataFrame) -> DataFrame:
    return docs.filter("is_active").agg(F.count("*").alias("active"))


def document_ids(inputs: DataFrame) -> DataFrame:
    """(path, pos, base) to (path, doc_id): the first of equal bases keeps it, later ones get a digest of their path."""
    trimmed = F.coalesce(F.nullif(F.regexp_replace(F.substring("base", 1, 48), "^-+|-+$", ""), F.lit("")), F.lit("doc"))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("pos"))
    return inputs.withColumn("stem", trimmed).select("path", F.when(nth == 1, F.col("stem")).otherwise(F.concat(F.col("stem"), F.lit("-"), F.substring(F.sha2("path", 256), 1, 12))).alias("doc_id"))


def document_texts(docs: DataFrame, canonical: DataFrame) -> DataFrame:
    """(doc_id, version, title, text): what is indexed; a document without canonical text has an empty line."""
    joined = docs.select("doc_id", "version", "title").join(canonical.select("doc_id", "version", "canonical"), ["doc_id", "version"], "left")
    return joined.select("doc_id", "version", "title", tx.markdown_to_plain(F.coalesce("canonical", F.lit(""))).alias("text"))


def keep_ids(fresh: DataFrame, previous: DataFrame) -> DataFrame:
    """``fresh`` documents with the previous doc_id of a known path; a new one whose id another path holds gets a digest of its path."""
    known = previous.select("source_path", F.col("doc_id").alias("old_id"))
    taken = previous.select(F.col("doc_id").alias("taken")).distinct()
    joined = fresh.join(known, "source_path", "left").join(taken, F.col("doc_id") == F.col("taken"), "left")
    other = F.concat("doc_id", F.lit("-"), F.substring(F.sha2("source_path", 256), 1, 12))
    return joined.withColumn("doc_id", F.coalesce("old_id", F.when(F.col("taken").isNotNull(), other).otherwise(F.col("doc_id")))).select(fresh.columns)


def build_mode(changes: DataFrame, same_tools: bool) -> str:
    """``full`` if the tools changed or nothing is known, ``none`` if nothing changed, else ``incremental``."""
    if not same_tools or changes.isEmpty():
        return "full"
    return "none" if changes.filter("change <> 'unchanged'").isEmpty() else "incremental"
