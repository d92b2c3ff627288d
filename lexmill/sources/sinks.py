"""Writing a knowledge base: tables, references, shards, manifests, and the swap of a finished build."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import udf
from ..operators import index, nodes, sharding, structure
from .storage import Files

PROTECTED = ("manifest", "build_state.json", "index.json", "docs", "names", "postings", "terms", "state", "export")


def guarded_path(root: str, name: str) -> str:
    """A path for output inside ``root`` that overwrites nothing of the knowledge base."""
    path = os.path.realpath(os.path.join(root, name))
    if os.path.commonpath([path, os.path.realpath(root)]) != os.path.realpath(root) or path == os.path.realpath(root):
        raise ValueError(f"output must be inside {root}")
    if os.path.relpath(path, os.path.realpath(root)).split(os.sep)[0] in PROTECTED:
        raise ValueError(f"{name} is part of the knowledge base")
    return path


def write_references(docs: DataFrame, folder: str) -> None:
    """One rendered text for each document, with its id."""
    structure.reference_text(docs).join(docs.select("doc_key", "doc_id"), "doc_key").select("doc_id", "reference").write.mode("overwrite").parquet(f"{folder}/references")


def write_shards(rows: DataFrame, folder: str, name: str, key: str) -> None:
    """Rows as tab-separated files, one folder for each shard of ``key``, and the map of shard keys to folders."""
    sharded = sharding.shard_keys(rows, key).withColumn("shard_file", udf.shard_name("shard"))
    clean = [F.regexp_replace(F.col(c).cast("string"), "[\\t\\r\\n]+", " ").alias(c) for c in rows.columns]
    out = sharded.select("shard_file", "shard", *clean)
    out.select("shard_file", *rows.columns).write.mode("overwrite").partitionBy("shard_file").csv(f"{folder}/{name}", sep="\t", header=True)
    out.select(F.col("shard").alias("key"), F.col("shard_file").alias("file")).distinct().orderBy("key").coalesce(1).write.mode("overwrite").csv(f"{folder}/{name}_shards", sep="\t", header=True)


def manifest_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, version, manifest): a JSON row for each document."""
    row = F.struct("doc_id", "title", "source_file", F.col("version").alias("source_version"), "is_active", F.concat(F.lit("canonical_text/"), F.col("doc_id"), F.lit("--"), tx.safe_version(F.col("version")), F.lit(".txt")).alias("canonical_text_path"), tx.content_hash(tx.canonical_line_ends(F.col("text"))).alias("canonical_text_sha256"))
    return docs.select("doc_id", "version", F.to_json(row).alias("manifest"))


def write_manifest(docs: DataFrame, folder: str) -> None:
    manifest_rows(docs).orderBy("doc_id", "version").select("manifest").write.mode("overwrite").text(f"{folder}/manifest")


def structure_reports(docs: DataFrame) -> DataFrame:
    """(doc_key, report): figures of a document as JSON."""
    return structure.text_statistics(docs).select("doc_key", F.to_json(F.struct(F.lit("whole_document").alias("mode"), F.struct("line_count", "char_count", "heading_count").alias("stats"))).alias("report"))


def document_metadata(docs: DataFrame) -> DataFrame:
    """(doc_key, metadata): a short Markdown card."""
    line = lambda k, c: F.concat(F.lit(f"- {k}: "), F.col(c), F.lit("\n"))
    return docs.select("doc_key", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), line("doc_id", "doc_id"), line("source_file", "source_file"), line("source_version", "version")).alias("metadata"))


def export_relations(docs: DataFrame, tree: DataFrame) -> dict[str, DataFrame]:
    """Documents, nodes and locators of an export; edges and aliases have rows only where nodes bring them."""
    documents = docs.select("doc_id", F.col("version").alias("source_version"), "title", "source_file", "is_active", F.concat(F.lit("canonical_text/"), F.col("doc_id"), F.lit("--"), tx.safe_version(F.col("version")), F.lit(".txt")).alias("canonical_text_path"), tx.content_hash(tx.canonical_line_ends(F.col("text"))).alias("canonical_text_sha256"))
    spans = tree.withColumns({"raw_span_start": F.lit(0).cast("long"), "raw_span_end": F.length("body_md").cast("long"), "node_hash": tx.content_hash(F.col("body_md"))})
    aliases = tree.select("doc_id", "source_version", F.explode("aliases").alias("alias"), F.col("node_id").alias("target_node_id"), "is_active").withColumn("normalized_alias", udf.alias_form(F.col("alias")))
    edges = tree.filter("parent_id is not null").select("doc_id", "source_version", F.lit("parent").alias("edge_type"), F.col("parent_id").alias("from_node_id"), F.col("node_id").alias("to_node_id"), "is_active")
    return {"documents": documents, "nodes": spans, "edges": edges, "aliases": aliases, "locators": nodes.locators(spans, documents)}


def write_export(docs: DataFrame, tree: DataFrame | None, folder: str) -> None:
    """The relations of an export, one folder each, and in ``export/digests`` a digest of each by document."""
    spark = docs.sparkSession
    if tree is None:
        tree = nodes.typed_nodes(spark.createDataFrame([], "doc_id string, node_id string"))
    for name, rows in export_relations(docs, tree).items():
        rows.write.mode("overwrite").parquet(f"{folder}/export/{name}")
        stored = spark.read.schema(rows.schema).parquet(f"{folder}/export/{name}")
        order = [c for c in ("doc_id", "node_id", "to_node_id", "alias", "target_node_id", "source_version") if c in rows.columns]
        nodes.relation_digest(stored, ["doc_id"], order).withColumn("relation", F.lit(name)).write.mode("append").parquet(f"{folder}/export/digests")


def state_table(docs: DataFrame) -> DataFrame:
    """What an incremental build compares: one row for each document, its text by digest alone."""
    return docs.select("doc_id", "version", "source_path", "source_fingerprint", "text_fingerprint", "title", "is_active")


def write_state(spark: SparkSession, path: str, state: dict) -> None:
    """Facts of a build as JSON, put in place whole; rows of documents are in the table beside it."""
    Files(spark).write_text(path, json.dumps(state, ensure_ascii=False, indent=2, sort_keys=True))


def swap(spark: SparkSession, finished: str, target: str) -> None:
    """Put a finished build in the place of ``target``; if that fails the old one comes back."""
    files, kept = Files(spark), f"{target}.{uuid.uuid4().hex}.old"
    there = files.exists(target)
    if there:
        files.rename(target, kept)
    try:
        files.rename(finished, target)
    except Exception:
        if there:
            files.rename(kept, target)
        raise
    if there:
        files.delete(kept)
