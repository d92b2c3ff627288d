"""The corpus pipeline: documents without toxic texts, near duplicates and test items, without
secrets, as token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of ``documents``.

All stages take nulls in any column, empty and very long texts, repeated rows, extra columns of any name and empty tables; their
docstrings say what becomes of them. An empty table comes out of every stage as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bpe import encode_documents
from lexmill.llm.common import shared_subfolder, table
from lexmill.llm.decontaminate import drop_contaminated
from lexmill.llm.near_dedup import drop_near_duplicates
from lexmill.llm.secrets import redact_secrets
from lexmill.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go.

    A null or empty text is never toxic and stays, as does every text if there are no labels of both classes. A null or unlabelled
    language is judged by the counts of all languages. Repeated rows share their verdict, and a long text is read whole.
    """
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id.

    Null texts and texts without a word are in no group and stay. Of rows that repeat id and text one stays; rows of one id with
    different texts, and rows without an id, are documents of their own. Ties go to the smaller id, then to the smaller digest.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go, those without a doc_id too.

    Null and empty texts stay, as does everything if the benchmark is empty. An item of half its shingles or more counts as held; verdicts
    go by text, so of rows with one id only those that hold an item go.
    """
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and n_chars follows; every row stays.

    Null, empty and clean texts stay as they are, byte for byte.
    """
    return redact_secrets(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, ids) of every row.

    A null text has null ids and n_tokens, an empty text no ids and 0. Repeated rows are each returned, long texts whole.
    """
    coded = encode_documents(docs, keep=["doc_id", "lang", "source"])
    return coded.select("row.*", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: The stages decide by models and sketches that SQL cannot express; tests/llm holds each stage
#: against a brute-force version of its decision.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; what each returns is written to the shared folder."""
    folder = shared_subfolder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
