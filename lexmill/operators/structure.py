"""Structure of texts: line offsets, headings, blocks, headings inferred in plain text, keywords, rendered references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions import text as tx
from ..functions.text import bound
from ..functions.tokens import frequent

KEYWORDS, MIN_FREQUENCY, LONGEST = 8, 2, 6


def line_offsets(docs: DataFrame) -> DataFrame:
    """(doc_key, line, offset): character offset of every line of the plain text, and of what follows the last line end."""
    return ln.each(docs, ["doc_key"], ln.offset_rows, "line long, offset long")


def headings(docs: DataFrame) -> DataFrame:
    """(doc_key, line, level, title, start, stop): headings with their character span, line end included."""
    return ln.each(docs, ["doc_key"], ln.heading_rows, "line long, level long, title string, start long, stop long")


def block_spans(docs: DataFrame) -> DataFrame:
    """(doc_key, doc_id, reading_order, start, stop, span_id): maximal runs of lines that are not blank."""
    runs = ln.each(docs, ["doc_key", "doc_id"], ln.block_rows, "reading_order long, start long, stop long")
    return runs.withColumn("span_id", tx.span_id(F.col("doc_id"), F.col("start"), F.col("stop")))


def inferred_headings(text: Column, numbered: bool = True) -> Column:
    """Plain text with headings marked.

    First a line of ``=`` or ``-`` turns the line before it into a heading of level 1 or 2. Then a line between blank
    ones becomes a heading: chapters level 1, numbered lines by their depth, other lines of fewer than 60
    characters that are no list items level 3. Without ``numbered``, chapters and numbered lines stay as they are.
    """
    rows = F.transform(tx.lines(text), lambda x: tx.rstrip(x))

    def underline(acc: Column, x: Column) -> Column:
        s = tx.strip(x)
        level = F.when(s.rlike("^={3,}$"), "# ").when(s.rlike("^-{3,}$"), "## ")
        # an underline replaces the last line; the first line of a text is never one
        popped = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(level, tx.strip(F.element_at(acc, -1)))))
        return F.when(level.isNotNull() & (F.size(acc) > 0), popped).otherwise(F.concat(acc, F.array(F.when(s == "", "").otherwise(x))))

    # only texts with an underline pay for the fold
    def folded(r: Column) -> Column:
        return F.when(F.exists(r, lambda x: tx.strip(x).rlike("^(={3,}|-{3,})$")), F.aggregate(r, F.array().cast("array<string>"), underline)).otherwise(F.transform(r, lambda x: F.when(tx.strip(x) == "", "").otherwise(x)))

    def marked(r: Column) -> Column:
        def mark(x: Column, i: Column) -> Column:
            s = tx.strip(x)
            blank = lambda at: F.coalesce(tx.strip(F.get(r, at)) == "", F.lit(True))
            alone = (s != "") & ~s.startswith("#") & F.when(i == 0, True).otherwise(blank(i - 1)) & blank(i + 1)
            number = F.regexp_extract(s, r"^(\d+(?:\.\d+)+)\s+\S", 1)
            depth = F.least(F.size(F.split(number, r"\.")), F.lit(6))
            item = s.rlike(r"^[-*•·]\s") | (s.rlike(r"^\d+\.\s") & ~s.rlike(r"^\d+\.\d+"))
            chapter = s.rlike(r"(?i)^Chapter\s+") | s.rlike(r"^第[一二三四五六七八九十百千万\d]+[章节篇部]")
            first, deeper = (F.lit("# "), F.concat(F.repeat(F.lit("#"), depth), F.lit(" "))) if numbered else (F.lit(None).cast("string"),) * 2
            prefix = F.when(chapter, first).when(number != "", deeper).when((F.length(s) < 60) & ~item, "### ")
            return F.when(alone & prefix.isNotNull(), F.concat(prefix, s)).otherwise(x)

        return F.transform(r, mark)

    joined = F.array_join(bound(bound(rows, folded), marked), "\n")
    return F.when(joined.endswith("\n"), joined).otherwise(F.concat(joined, F.lit("\n")))


def infer_headings(docs: DataFrame, numbered: bool = True) -> DataFrame:
    """(doc_key, text): plain text with headings marked."""
    return docs.select("doc_key", inferred_headings(F.col("text"), numbered).alias("text"))


def keywords(docs: DataFrame, top: int = KEYWORDS, least: int = MIN_FREQUENCY) -> DataFrame:
    """(doc_key, keywords): frequent ASCII words and CJK substrings of 2 to LONGEST characters.

    Most frequent first, then longer, then by code points; a word inside an accepted longer one is skipped. A row is a document, and
    is counted by itself, so no word is shuffled; a text without a frequent word has no row.
    """

    def find(text: str) -> list[tuple]:
        taken: list[str] = []
        for word in frequent(text, least, LONGEST):
            if len(taken) >= top:
                break
            if not any(word in t and len(t) > len(word) for t in taken):
                taken.append(word)
        return [(" ".join(taken),)] if taken else []

    return ln.each(docs, ["doc_key"], find, "joined string").select("doc_key", F.split("joined", " ").alias("keywords"))


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_key, line_count, char_count, heading_count) of the canonical text."""
    text = tx.canonical_line_ends(F.col("text"))
    heads = F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, rf"^{tx.SPACE}+", "").rlike(r"^#{1,6}\s+."))
    return docs.select("doc_key", F.size(F.split(text, "\n")).cast("long").alias("line_count"), F.length(text).cast("long").alias("char_count"), F.size(heads).cast("long").alias("heading_count"))


def reference_column(doc_id: Column, title: Column, version: Column, text: Column) -> Column:
    """A document with front matter, title, table of contents, figures and its text."""
    text = tx.canonical_line_ends(text)
    lead = lambda x: F.regexp_replace(x, rf"^{tx.SPACE}+", "")
    heads = F.filter(F.transform(F.split(text, "\n"), lead), lambda x: x.rlike(r"^#{1,6}\s+."))
    level = lambda x: F.length(F.regexp_extract(x, "^(#+)", 1))
    entry = lambda x: F.concat(F.repeat(F.lit("  "), level(x) - 1), F.lit("- "), tx.strip(F.regexp_replace(x, r"^#{1,6}\s+", "")))
    toc = F.when(F.size(heads) > 0, F.concat(F.lit("## 目录\n\n"), F.array_join(F.transform(heads, entry), "\n"), F.lit("\n\n"))).otherwise("")
    figures = F.concat(F.lit("## 统计\n\n- 行数: "), F.size(F.split(text, "\n")).cast("string"), F.lit("\n- 字符数: "), F.length(text).cast("string"), F.lit("\n\n"))
    front = F.concat(F.lit("---\ndoc_id: "), doc_id, F.lit("\ntitle: "), title, F.lit("\nsource_version: "), version, F.lit("\nkind: doc\n---\n\n"))
    return F.concat(front, F.lit("# "), title, F.lit("\n\n"), toc, figures, F.lit("---\n\n\n"), tx.rstrip(text), F.lit("\n\n"))


def reference_text(docs: DataFrame) -> DataFrame:
    """(doc_key, reference): the rendered form of each document."""
    return docs.select("doc_key", reference_column(F.col("doc_id"), F.col("title"), F.col("version"), F.col("text")).alias("reference"))
