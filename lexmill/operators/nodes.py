"""Tree-structured document records: typed rows, sibling links, implied documents, hashes, locators, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions import text as tx
from ..functions import udf

KINDS = ("doc", "chapter", "section", "article", "item", "block", "clause", "table", "figure", "chunk")


def _clean(name: str):
    return tx.strip(F.coalesce(F.col(name).cast("string"), F.lit("")))


def _or_null(c):
    return F.nullif(c, F.lit(""))


def _flag(rows: DataFrame, name: str):
    """A flag as text for ``parse_flag``: a number is true unless it is 0."""
    if name not in rows.columns:
        return F.lit(None).cast("string")
    kind = rows.schema[name].dataType
    return F.when(F.col(name) != 0, "true").when(F.col(name) == 0, "false") if isinstance(kind, NumericType) else F.col(name).cast("string")


def _alias_list(rows: DataFrame):
    """Aliases as a list; a text is one alias."""
    if "aliases" not in rows.columns:
        return F.lit(None).cast("array<string>")
    return F.when(F.col("aliases").isNotNull(), F.array("aliases")) if isinstance(rows.schema["aliases"].dataType, StringType) else F.col("aliases")


def typed_nodes(rows: DataFrame) -> DataFrame:
    """Node records with defaults; an empty parent, prev or next is null, confidence 0 is 1.0."""
    have = set(rows.columns)
    col = lambda n, kind="string": F.col(n) if n in have else F.lit(None).cast(kind)
    base = rows.select(*(col(n).alias(n) for n in ("doc_id", "node_id", "kind", "title", "label", "parent_id", "prev_id", "next_id", "ref_path", "source_version", "body_md", "body")), col("ordinal", "int").alias("ordinal"), *(_flag(rows, n).alias(n) for n in ("is_leaf", "is_active")), col("confidence", "double").alias("confidence"), _alias_list(rows).alias("aliases"))
    title, label = _or_null(_clean("title")), _or_null(_clean("label"))
    named = F.coalesce(title, label, _clean("node_id"))
    body = F.coalesce(F.concat(tx.rstrip(F.coalesce("body_md", "body")), F.lit("\n")), F.lit(""))
    first = udf.distinct_aliases(F.coalesce("aliases", F.array().cast("array<string>")))
    return base.select(
        _clean("doc_id").alias("doc_id"),
        _clean("node_id").alias("node_id"),
        _clean("kind").alias("kind"),
        named.alias("title"),
        F.coalesce(label, named).alias("label"),
        _or_null(_clean("parent_id")).alias("parent_id"),
        _or_null(_clean("prev_id")).alias("prev_id"),
        _or_null(_clean("next_id")).alias("next_id"),
        F.coalesce(F.col("ordinal").cast("int"), F.lit(0)).alias("ordinal"),
        _clean("ref_path").alias("ref_path"),
        tx.parse_flag(F.col("is_leaf")).alias("is_leaf"),
        tx.parse_flag(F.col("is_active")).alias("is_active"),
        F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        body.alias("body_md"),
        _or_null(_clean("source_version")).alias("source_version"),
        first.alias("aliases"),
        _clean("kind").isin(*KINDS).alias("known_kind"),
    )


def sibling_links(nodes: DataFrame) -> DataFrame:
    """Missing prev_id and next_id from the order (ordinal, node_id) among equal document, parent and kind."""
    near = Window.partitionBy("doc_id", "parent_id", "kind").orderBy("ordinal", "node_id")
    return nodes.withColumns({"prev_id": F.coalesce("prev_id", F.lag("node_id").over(near)), "next_id": F.coalesce("next_id", F.lead("node_id").over(near))})


def document_hashes(nodes: DataFrame) -> DataFrame:
    """(doc_id, doc_hash): digest of the nodes' ids, titles and bodies in the order of the ids."""
    parts = F.array_sort(F.collect_list(F.struct("node_id", "title", "body_md")))
    flat = F.flatten(F.transform(parts, lambda p: F.array(p["node_id"], p["title"], p["body_md"])))
    return nodes.groupBy("doc_id").agg(F.sha2(F.array_join(flat, "\n"), 256).alias("doc_hash"))


def implied_documents(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Documents that have nodes: of equal ids the last row, and one made up for nodes whose document is missing.

    docs: (doc_id, title, source_file, pos); documents without nodes are dropped.
    """
    last = docs.filter("doc_id <> ''").withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("pos").desc()))).filter("nth = 1")
    ids = nodes.select("doc_id").distinct()
    file = F.concat("doc_id", F.lit(".ir"))
    joined = ids.join(last.select("doc_id", "title", "source_file"), "doc_id", "left")
    title = F.coalesce(_or_null(tx.strip(F.col("title"))), F.col("doc_id"))
    source = F.coalesce(_or_null(tx.strip(F.col("source_file"))), file)
    return joined.select("doc_id", title.alias("title"), source.alias("source_file"), tx.source_version(source, title).alias("source_version"))


def locators(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Where each node's text is: nodes left join documents by id and version."""
    texts = docs.select("doc_id", "source_version", "canonical_text_path", "canonical_text_sha256")
    joined = nodes.join(texts, ["doc_id", "source_version"], "left")
    return joined.select("node_id", "doc_id", "source_version", "ref_path", "raw_span_start", "raw_span_end", F.coalesce("canonical_text_path", F.lit("")).alias("canonical_text_path"), F.coalesce("canonical_text_sha256", F.lit("")).alias("canonical_text_sha256"))


def node_references(nodes: DataFrame) -> DataFrame:
    """(doc_id, body): bodies of the active nodes in file order, parted by blank lines; nodes need ``pos``."""
    bodies = F.array_sort(F.collect_list(F.struct("pos", F.rtrim("body_md").alias("body_md"))))
    return nodes.filter("is_active").groupBy("doc_id").agg(F.array_join(F.transform(bodies, lambda b: tx.rstrip(b["body_md"])), "\n\n").alias("body"))


def relation_digest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Digest of the JSON of all rows of each key, in the given order."""
    packed = F.struct(*order, F.to_json(F.struct(*sorted(rows.columns))).alias("__json"))
    lines = F.transform(F.array_sort(F.collect_list(packed)), lambda r: r["__json"])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("digest"))


def index_binding(docs: DataFrame) -> DataFrame:
    """One digest over the active documents, as a tree: documents, at most 4,096 buckets by id, the whole.

    No task holds more than its bucket, and the last one the buckets. A flat digest over all sorted rows would need
    them in one place, so the value differs from one made that way; it serves to tell builds apart.
    """
    digest = F.sha2(F.concat_ws("\n", "doc_id", "title", "version"), 256)
    each = docs.filter("is_active").select(F.substring(F.sha2("doc_id", 256), 1, 3).alias("bucket"), "doc_id", "version", digest.alias("d"))
    joined = lambda *keys: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, "d"))), lambda x: x["d"]), ""), 256)
    buckets = each.groupBy("bucket").agg(joined("doc_id", "version").alias("d"))
    return buckets.agg(joined("bucket").alias("binding"))
