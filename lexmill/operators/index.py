"""The inverted index: postings with weighted frequencies, document lengths, corpus statistics, and their stored form.

Plan: one narrow Arrow pass over the texts makes the postings, counted inside the row, so nothing is
shuffled to count. Stored, they are laid out in segments: a row holds some megabytes of documents with all their postings, in
columns by hash of the token. So nothing is shuffled or sorted to store them either, a search reads the columns of its tokens
alone, and scores add up where the segment is read. A segment carries the lengths of its documents, so scores need no
texts. Document frequencies and the two statistics are stored beside.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segments as sg
from ..functions import tokens as tk
from ..functions import udf
from ..sources.storage import Files, shared_subfolder

POSTINGS = "doc_key long, is_active boolean, dl long, token string, tf_title long, tf_body long"
#: Files of documents that a search names one by one; more are read as a folder.
NAMED_FILES = 1_000


def _texts(docs: DataFrame) -> DataFrame:
    """What is indexed: the column ``indexed`` where there is one, else the text."""
    text = F.col("indexed" if "indexed" in docs.columns else "text")
    return docs.select(F.col("doc_key").cast("long").alias("doc_key"), "is_active", "title", text.alias("text"))


def postings(docs: DataFrame) -> DataFrame:
    """(doc_key, is_active, dl, token, tf_title, tf_body); dl is the number of tokens in title and body."""
    return _texts(docs).mapInArrow(tk.postings, POSTINGS)


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_key, is_active, dl) of every document, also of those without a token."""
    return _texts(docs).mapInArrow(tk.lengths, "doc_key long, is_active boolean, dl long")


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl) over all documents, active or not."""
    return lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def index_texts(docs: DataFrame) -> DataFrame:
    """(doc_key, tokens): the searchable form of each text."""
    return docs.select(F.col("doc_key").cast("long").alias("doc_key"), "text").mapInArrow(tk.index_texts, "doc_key long, tokens string")


def names(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, is_active, a, b, file): identifiers in the form in which they are compared, and the file of the document."""
    return docs.select("doc_key", "doc_id", "is_active", udf.alias_form(F.col("doc_id")).alias("a"), udf.alias_form(F.col("title")).alias("b"), F.col("_metadata.file_name").alias("file"))


@dataclass
class Index:
    """A stored index: ``docs`` with texts, ``names``, ``segments`` of postings, ``terms`` (token, df), and statistics."""

    spark: SparkSession
    folder: str
    n_docs: int
    avgdl: float
    #: Lengths below 4 of the identifiers in ``names``.
    short_names: tuple[int, ...]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    @property
    def docs(self) -> DataFrame:
        return self._table("docs")

    @property
    def names(self) -> DataFrame:
        return self._table("names")

    @property
    def segments(self) -> DataFrame:
        return self.spark.read.schema(sg.SCHEMA).parquet(f"{self.folder}/postings")  # an empty one has no file to tell its schema

    @property
    def postings(self) -> DataFrame:
        return self.segments.mapInArrow(sg.postings, POSTINGS)

    @property
    def terms(self) -> DataFrame:
        return self._table("terms")

    def segments_of(self, tokens: list[str]) -> DataFrame:
        """Segments with the columns that hold the tokens."""
        columns = sorted(set(sg.columns_of(pa.array(tokens, pa.string())).tolist()))
        return self.segments.select("segment", "doc_keys", "is_active", "dl", *(f"c{i}" for i in columns))

    def marked(self, segments: DataFrame, marks: DataFrame, how: str) -> DataFrame:
        """Segments with the rows of ``marks`` (mark, doc_key) that are in them; no more than a segment's is in one place."""
        places = self.segments.select("segment", F.explode("doc_keys").alias("doc_key"))
        held = places.join(marks, "doc_key").groupBy("segment").agg(F.collect_list(F.struct("mark", "doc_key")).alias("marks"))
        return segments.join(held, "segment", how)

    def texts(self, files: list[str] | None) -> DataFrame:
        """Documents; of a list of files only those."""
        if files is None or len(files) > NAMED_FILES:
            return self.docs
        return self.spark.read.schema(self.docs.schema).parquet(*(f"{self.folder}/docs/{f}" for f in files)) if files else self.docs.limit(0)


def write(docs: DataFrame, folder: str) -> None:
    """Store documents and their index in ``folder``. The texts are read once and not shuffled; statistics come from what is stored."""
    docs.write.mode("overwrite").parquet(f"{folder}/docs")
    write_index(docs.sparkSession, folder)


def write_index(spark: SparkSession, folder: str, old: Index | None = None, kept: DataFrame | None = None) -> None:
    """Index the documents stored in ``folder``/docs.

    Of documents in ``kept`` (doc_key) the postings are taken from the ``old`` index, so only the others are tokenised.
    """
    stored = spark.read.parquet(f"{folder}/docs")
    names(stored).write.mode("overwrite").parquet(f"{folder}/names")
    fresh = stored if old is None else stored.join(kept, "doc_key", "left_anti")
    rows = _texts(fresh).mapInArrow(sg.build, sg.SCHEMA)
    if old is not None:
        marks = kept.select(F.lit(None).cast("string").alias("mark"), "doc_key")
        rows = rows.unionByName(old.marked(old.segments, marks, "inner").mapInArrow(sg.kept, sg.SCHEMA))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/postings")
    segments = spark.read.schema(sg.SCHEMA).parquet(f"{folder}/postings")
    segments.mapInArrow(sg.frequencies, "token string, df long").groupBy("token").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{folder}/terms")
    total = segments.agg(F.coalesce(F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda n, x: n + x)), F.lit(0)).alias("n")).first().n
    short = lambda n: F.max((F.length("a") == n) | (F.length("b") == n)).alias(f"s{n}")
    held = spark.read.parquet(f"{folder}/names").agg(F.count("*").alias("n"), short(1), short(2), short(3)).first()
    facts = {"columns": sg.COLUMNS, "n_docs": held.n, "tokens": total, "short_names": [n for n in (1, 2, 3) if held[f"s{n}"]]}
    Files(spark).write_text(f"{folder}/index.json", json.dumps(facts))


def read(spark: SparkSession, folder: str) -> Index:
    """A stored index."""
    facts = json.loads(Files(spark).read_text(f"{folder}/index.json"))
    if facts.get("columns") != sg.COLUMNS:
        raise ValueError(f"{folder} holds an index of another form: build it again")
    return Index(spark, folder, facts["n_docs"], facts["tokens"] / max(1, facts["n_docs"]), tuple(facts["short_names"]))


def temporary(docs: DataFrame) -> Index:
    """An index of ``docs`` in the shared folder, for searches in texts that have no stored one."""
    folder = shared_subfolder(docs.sparkSession, "index")
    write(docs, folder)
    return read(docs.sparkSession, folder)
