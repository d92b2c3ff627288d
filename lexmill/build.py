"""The life of a knowledge base: full, forced and incremental builds of documents, index, references and export.

A build is made in a folder beside the target and swapped in whole. An incremental build reads the fingerprints of all inputs,
extracts and tokenises only what is new or changed, takes everything else from the stored tables,
and keeps removed documents and versions as inactive ones.
"""

from __future__ import annotations

import datetime
import hashlib
import os
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx
from .functions import udf
from .operators import incremental, index, nodes, structure
from .sources import files, records, sinks
from .sources.storage import Files, cut

VERSION = "lexmill.base.v2"
#: Modules whose change makes stored documents or postings stale.
TOOLS = ("functions", "operators", "sources", "build.py")
DOCS = "doc_key long, doc_id string, title string, source_file string, source_path string, version string, is_active boolean, source_fingerprint string, text_fingerprint string, text string, indexed string"


class BuildError(ValueError):
    """A build that cannot be made as asked."""


def tool_checksum() -> str:
    """Digest of the code that makes what is stored."""
    root, digest = os.path.dirname(os.path.abspath(__file__)), hashlib.sha256(f"{VERSION} {pyspark.__version__}".encode())
    for tool in TOOLS:
        path = os.path.join(root, tool)
        names = sorted(n for n in os.listdir(path) if n.endswith(".py")) if os.path.isdir(path) else [""]
        for name in names:
            with open(os.path.join(path, name) if name else path, "rb") as file:
                digest.update(name.encode() + b"\0" + file.read() + b"\0")
    return digest.hexdigest()


def _prepared(docs: DataFrame) -> DataFrame:
    """Documents with what is stored of them: the rendered text, on which lines are counted, what is indexed, and the digest of the canonical text."""
    canonical = udf.canonical_text(F.col("text"))
    keyed = docs.withColumns({"doc_key": F.xxhash64("doc_id", "version"), "text": canonical})
    # the rendered text is made before it takes the place of the canonical one
    rendered = structure.reference_column(F.col("doc_id"), F.col("title"), F.col("version"), F.col("text"))
    made = keyed.withColumns({"text_fingerprint": tx.content_hash(F.col("text")), "indexed": tx.markdown_to_plain(F.col("text")), "rendered": records.reference_body(rendered)})
    return made.withColumn("text", F.col("rendered")).select([c.split()[0] for c in DOCS.split(", ")])


def _inactive(docs: DataFrame) -> DataFrame:
    """Documents that are no more: kept by name and digest, with no text."""
    return docs.withColumns({"is_active": F.lit(False), "text": F.lit(""), "indexed": F.lit("\n")})


def build(spark: SparkSession, inputs: list[str], folder: str, force: bool = False, update: bool = False, tree: str | None = None) -> dict:
    """Build from files (and tree records, if named) into ``folder``; (mode, documents and changes by class).

    An existing folder is replaced with ``force`` and updated with ``update``. An update falls back to a full build when the tools have
    changed or there is nothing to compare with, and does nothing when nothing changed.
    """
    store = Files(spark)
    name = folder.rstrip("/").rsplit("/", 1)[-1]
    if not spark.range(1).select(tx.valid_name(F.lit(name)).alias("ok")).first().ok:
        raise BuildError(f"{name} is no name for a knowledge base: lower-case letters and digits, single hyphens between them")
    there = store.exists(folder)
    if there and not (force or update):
        raise BuildError(f"{folder} exists already: force replaces it, an update changes it")
    if not inputs and not tree:
        raise BuildError("nothing to build from")
    facts = records.read_state(spark, f"{folder}/build_state.json") if there else {}
    usable = there and facts.get("version") == VERSION
    old = spark.read.schema(DOCS).parquet(f"{folder}/docs") if usable else None
    counts: dict = {}
    mode = "full"
    if update and old is not None and inputs:
        changes = cut(_changes(spark, inputs, old))
        mode = incremental.build_mode(changes, facts.get("tools") == tool_checksum())
        counts = {r.change: r.n for r in changes.groupBy("change").agg(F.count("*").alias("n")).collect()}
        if mode == "none":
            return {"mode": mode, "documents": facts.get("active", 0), "changes": counts}
    draft = f"{folder.rstrip('/')}.{uuid.uuid4().hex}"
    try:
        if mode == "incremental":
            _update(spark, inputs, old, changes, draft, index.read(spark, folder))
        else:
            fresh = cut(_prepared(files.read_documents(spark, inputs))) if inputs else spark.createDataFrame([], DOCS)
            gone = _inactive(old.join(fresh.select("doc_id", "version"), ["doc_id", "version"], "left_anti")) if old is not None else None
            (fresh if gone is None else fresh.unionByName(gone)).write.parquet(f"{draft}/docs")
            index.write_index(spark, draft)
        active = _finish(spark, draft, tree, mode, counts)
        sinks.swap(spark, draft, folder)
    except BaseException:
        store.delete(draft)
        raise
    return {"mode": mode, "documents": active, "changes": counts}


def _changes(spark: SparkSession, inputs: list[str], old: DataFrame) -> DataFrame:
    """(doc_id, change) with the path and, for a changed file, the digest of its new text."""
    seen = old.filter("is_active").select("doc_id", "source_path", "source_fingerprint", "text_fingerprint")
    prints = files.fingerprints(spark, inputs)
    touched = cut(prints.join(seen.select("source_path", "source_fingerprint"), ["source_path", "source_fingerprint"], "left_anti").select("source_path"))
    fresh = incremental.keep_ids(files.read_documents(spark, inputs, touched), seen)
    texts = fresh.select("doc_id", "source_path", tx.content_hash(udf.canonical_text(F.col("text"))).alias("text_fingerprint"))
    same = seen.join(prints, ["source_path", "source_fingerprint"], "left_semi").select("doc_id", "source_path", "source_fingerprint", "text_fingerprint")
    now = texts.join(prints, "source_path").select("doc_id", "source_path", "source_fingerprint", "text_fingerprint").unionByName(same)
    return incremental.change_set(now, seen)


def _update(spark: SparkSession, inputs: list[str], old: DataFrame, changes: DataFrame, draft: str, stored: index.Index) -> None:
    same = changes.filter("change = 'unchanged'").select("doc_id")
    kept = old.filter("is_active").join(same, "doc_id", "left_semi")
    paths = files.fingerprints(spark, inputs).join(kept.select("source_path"), "source_path", "left_anti")
    fresh = cut(_prepared(incremental.keep_ids(files.read_documents(spark, inputs, paths), old.filter("is_active"))))
    now = fresh.unionByName(kept)
    gone = _inactive(old.join(now.select("doc_id", "version"), ["doc_id", "version"], "left_anti"))
    now.unionByName(gone).write.parquet(f"{draft}/docs")
    index.write_index(spark, draft, stored, cut(kept.select("doc_key")))


def _finish(spark: SparkSession, draft: str, tree: str | None, mode: str, counts: dict) -> int:
    """Manifest, export, state and facts of what is stored in ``draft``; the number of active documents."""
    docs = spark.read.schema(DOCS).parquet(f"{draft}/docs")
    canonical = docs.withColumn("text", F.col("indexed"))
    sinks.write_manifest(canonical, draft)
    found = records.read_records(spark, tree)[1] if tree else None
    sinks.write_export(canonical.filter("is_active"), found, draft)
    sinks.state_table(docs).write.parquet(f"{draft}/state")
    active = incremental.active_count(docs).first().active
    facts = {"version": VERSION, "created_at": datetime.datetime.now(datetime.UTC).isoformat(), "tools": tool_checksum(), "mode": mode, "changes": counts, "active": active}
    # the index is bound to the documents that it was made of
    facts["bindings"] = {"index": nodes.index_binding(docs).first().binding, "manifest": nodes.index_binding(docs.withColumn("title", F.col("text_fingerprint"))).first().binding}
    sinks.write_state(spark, f"{draft}/build_state.json", facts)
    return active


def verify(spark: SparkSession, folder: str) -> bool:
    """Whether the stored index is bound to the stored documents."""
    facts = records.read_state(spark, f"{folder}/build_state.json")
    docs = spark.read.schema(DOCS).parquet(f"{folder}/docs")
    return facts.get("bindings", {}).get("index") == nodes.index_binding(docs).first().binding
