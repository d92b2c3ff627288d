"""Documents in the form that the other operators take.

A corpus has one row for each document version: doc_key (long), doc_id, title,
source_file, version, is_active, text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx


def corpus(docs: DataFrame, *kept: str) -> DataFrame:
    """A corpus from (doc_id long, text, source): the file stem is source-doc_id. ``kept`` are further columns to carry."""
    stem = F.concat_ws("-", F.col("source"), F.col("doc_id").cast("string"))
    base = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").alias("doc_key"), stem.alias("doc_id"), F.concat(stem, F.lit(".txt")).alias("source_file"), F.col("text"), *kept)
    titled = base.withColumn("title", tx.document_title(F.col("text"), F.col("doc_id")))
    return titled.select("doc_key", "doc_id", "title", "source_file", tx.source_version(F.col("doc_id"), F.col("title")).alias("version"), F.lit(True).alias("is_active"), "text", *kept)
