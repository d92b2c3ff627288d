"""Documents from files: Markdown, plain text, word-processor documents."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ElementTree
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions import udf
from ..operators.incremental import document_ids
from ..operators.structure import inferred_headings

SUFFIXES = ("md", "txt", "docx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class SourceError(ValueError):
    """A file that cannot be read as a document."""


_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_LINKS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"


def _images(archive: zipfile.ZipFile) -> dict[str, str]:
    """Targets of the image relationships, by id."""
    try:
        root = ElementTree.fromstring(archive.read("word/_rels/document.xml.rels"))
    except (KeyError, ElementTree.ParseError):
        return {}
    return {link.get("Id"): link.get("Target") for link in root.iter(_LINKS) if link.get("Id") and link.get("Target") and "relationships/image" in link.get("Type", "")}


def docx_to_markdown(data: bytes) -> str:
    """Paragraphs that are not empty, parted by blank lines; heading styles become heading marks.

    In a paragraph with a figure number such as (1.2.3) its inline images stand as [[IMAGE:target]].
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            root = ElementTree.fromstring(archive.read("word/document.xml"))
            images = _images(archive)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as error:
        raise SourceError(f"not a word-processor document: {error}") from error
    out = []
    for paragraph in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in paragraph.iter(f"{_W}t")).strip()
        if not text:
            continue
        if re.search(r"\(\d+(?:\.\d+)+\)", text):
            runs = []
            for run in paragraph.findall(f"{_W}r"):
                runs += [t.text or "" for t in run.iter(f"{_W}t")]
                runs += [f" [[IMAGE:{images.get(i) or i}]] " for blip in run.iter(f"{_A}blip") if (i := blip.get(f"{_R}embed"))]
            text = "".join(runs).strip() or text
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        level = re.match(r"Heading([1-6])", style.get(f"{_W}val", "") if style is not None else "")
        out.append("#" * int(level[1]) + " " + text if level else text)
    return "\n\n".join(out).strip() + "\n"


@F.pandas_udf(T.StringType())
def _docx(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else docx_to_markdown(bytes(b)))


def fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source_path, source_fingerprint) of all files."""
    return _raw(spark, paths).select("source_path", "source_fingerprint")


def _raw(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    raw = spark.read.format("binaryFile").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return raw.select(F.col("path").alias("source_path"), name.alias("source_file"), F.regexp_extract(name, r"^(.*?)(?:\.[^.]*)?$", 1).alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("suffix"), F.sha2("content", 256).alias("source_fingerprint"), "content")


def read_documents(spark: SparkSession, paths: str | list[str], only: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, source_file, source_path, version, is_active, source_fingerprint, text) of all files, or of those whose path is in ``only`` (source_path).

    Text files are decoded by the first fitting encoding; plain text gets its headings inferred. Any
    other suffix, portable documents among them, raises an error when it is read: there is no
    reader for it here.
    """
    files = _raw(spark, paths)
    if only is not None:
        files = files.join(only.select("source_path"), "source_path", "left_semi")
    known = files.withColumn("suffix", F.when(F.col("suffix").isin(*SUFFIXES), F.col("suffix")).otherwise(F.raise_error(F.concat(F.lit("no reader for "), F.col("source_file")))))
    decoded = known.filter("suffix <> 'docx'").withColumn("text", udf.decode_bytes("content")).drop("content")
    marked = decoded.filter("suffix = 'txt'").withColumn("text", inferred_headings(F.col("text")))
    word = known.filter("suffix = 'docx'").withColumn("text", _docx("content")).drop("content")
    texts = decoded.filter("suffix = 'md'").unionByName(marked).unionByName(word)
    titled = texts.withColumn("title", tx.document_title(F.col("text"), F.col("stem")))
    ids = document_ids(titled.select(F.col("source_path").alias("path"), F.col("source_path").alias("pos"), udf.slugify("stem").alias("base")))
    return titled.join(ids.withColumnRenamed("path", "source_path"), "source_path").select("doc_id", "title", "source_file", "source_path", tx.source_version(F.col("stem"), F.col("title")).alias("version"), F.lit(True).alias("is_active"), "source_fingerprint", "text")
