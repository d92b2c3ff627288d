"""Tree records in JSON lines, stored state, and stored references."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import nodes
from .storage import Files

SCHEMA = (
    "type string, doc_id string, node_id string, kind string, title string, label string, parent_id string, prev_id string, next_id string, ref_path string, "
    "source_file string, source_path string, source_version string, active_parser string, doc_hash string, body_md string, body string, ordinal int, "
    "is_leaf variant, is_active variant, confidence double, aliases variant"
)


def _flag(name: str):
    """A flag of any JSON type as text: a number is true unless it is 0; what is no flag is null."""
    kind, value = F.schema_of_variant(F.col(name)), F.col(name)
    number = F.try_variant_get(value, "$", "double")
    return F.when(kind.isin("STRING", "BOOLEAN"), F.try_variant_get(value, "$", "string")).when(number.isNotNull(), F.when(number != 0, "true").otherwise("false"))


def _aliases():
    """A list of aliases, or a single text; anything else is none."""
    kind, value = F.schema_of_variant(F.col("aliases")), F.col("aliases")
    return F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))).when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<string>"))


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(documents, nodes) of a JSON-lines file.

    A line that is no JSON, an unknown type, and a missing id are errors. Documents without
    nodes are dropped, documents that only nodes name are made up, and of equal ids the last row counts.
    Siblings are linked, and documents without a hash get one from their nodes.
    """
    lines = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path).withColumns({"pos": F.monotonically_increasing_id(), "is_leaf": _flag("is_leaf"), "is_active": _flag("is_active"), "aliases": _aliases()})
    kind = F.lower(tx.strip(F.coalesce(F.nullif("type", F.lit("")), F.lit("node"))))
    known = F.when(kind.isin("doc", "node"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown record type "), kind)))
    has = lambda c: tx.strip(F.coalesce(c, F.lit(""))) != ""
    typed = lines.withColumn("type", known)
    whole = F.when(~has("doc_id"), F.raise_error(F.lit("a record has no doc_id"))).when((F.col("type") == "node") & ~has("node_id"), F.raise_error(F.lit("a node has no node_id"))).when((F.col("type") == "node") & ~has("kind"), F.raise_error(F.lit("a node has no kind"))).otherwise(F.col("doc_id"))
    checked = typed.withColumn("doc_id", tx.strip(whole))
    rows = checked.filter("type = 'node'")
    made = nodes.sibling_links(nodes.typed_nodes(rows))
    docs = nodes.implied_documents(checked.filter("type = 'doc'").select("doc_id", "title", "source_file", "pos"), rows)
    given = checked.filter("type = 'doc'").groupBy("doc_id").agg(F.max_by("doc_hash", "pos").alias("given"), F.max_by("source_version", "pos").alias("own_version"))
    hashed = docs.join(nodes.document_hashes(made), "doc_id").join(given, "doc_id", "left")
    full = hashed.select("doc_id", "title", "source_file", F.coalesce(F.nullif(tx.strip(F.col("own_version")), F.lit("")), F.col("source_version")).alias("source_version"), F.coalesce(F.nullif(tx.strip(F.col("given")), F.lit("")), F.col("doc_hash")).alias("doc_hash"))
    versions = full.select("doc_id", F.col("source_version").alias("doc_version"), F.col("title").alias("doc_title"))
    return full, made.join(versions, "doc_id").withColumn("source_version", F.coalesce("source_version", "doc_version")).drop("doc_version")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Stored documents of a knowledge base, in the order of their ids and versions."""
    return spark.read.parquet(f"{folder}/docs").orderBy("doc_id", "version")


def read_state(spark: SparkSession, path: str) -> dict:
    """Stored build state; an absent or broken file is an empty state."""
    try:
        found = json.loads(Files(spark).read_text(path))
    except Exception:  # noqa: BLE001 - whatever the file system raises, there is no usable state
        return {}
    return found if isinstance(found, dict) else {}


def reference_body(reference):
    """The text of a stored reference: without front matter and blank ends; null gives an empty text."""
    stripped = F.when(reference.startswith("---") & (F.locate("\n---", reference, 4) > 0), F.substring(reference, F.locate("\n---", reference, 4) + 4, F.length(reference))).otherwise(reference)
    return F.coalesce(tx.strip(stripped), F.lit(""))
