"""Reading documents by line: ranges, sections, keywords, jumps; batched over requests.

Requests join the documents they ask for, and only then are lines and sections found, inside the row: a document
that no request names is not split, and no line is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as ln
from ..functions import text as tx
from ..functions.text import bound
from .evidence import lowered_hits

MAX_SECTIONS, MAX_HIT_LINES = 200, 30
FALLBACK_BEFORE, FALLBACK_COUNT, CONTEXT, COUNT = 10, 20, 10, 20


def sections(docs: DataFrame, limit: int | None = None) -> DataFrame:
    """(doc_key, nth, line, end_line, heading, line_count): sections of (doc_key, text), the first ``limit`` of each document.

    A section begins at the first line that is not blank and at every heading-like line
    after it, and ends before the next one; blank lines before the first are in none.
    """

    def find(text: str) -> list[tuple]:
        return ln.section_rows(text)[:limit]

    cut = ln.each(docs, ["doc_key"], find, "nth long, line long, end_line long, heading string")
    return cut.withColumn("line_count", F.col("end_line") - F.col("line") + 1)


def section_list(docs: DataFrame) -> DataFrame:
    """The first MAX_SECTIONS sections of each document."""
    return sections(docs, MAX_SECTIONS)


def _asked(docs: DataFrame, requests: DataFrame) -> DataFrame:
    return docs.select("doc_key", "text").join(requests, "doc_key")


def _read(rows: DataFrame, first: Column, count: Column, part: Column | None = None, lines: Callable[[Column], Column] = tx.lines) -> DataFrame:
    """(req_id, part, doc_key, line, text): of (req_id, doc_key, text) the lines from ``first`` on, ``count`` of them, clamped to the document."""
    kept = rows.select("req_id", (F.lit(0) if part is None else part).alias("part"), "doc_key", "text", first.cast("long").alias("first"), count.cast("long").alias("count"))
    # of a range before line 1 only what reaches into the document is read
    begin, stop = F.greatest(F.col("first"), F.lit(1)), F.col("first") + F.col("count")
    size = F.greatest(F.least(stop, F.lit(2**31 - 1)) - begin, F.lit(0))
    taken = bound(lines(F.col("text")), lambda x: F.when(begin <= F.size(x), F.slice(x, begin.cast("int"), size.cast("int"))))
    each = kept.select("req_id", "part", "doc_key", begin.alias("begin"), F.posexplode(taken).alias("at", "line_text"))
    return each.select("req_id", "part", "doc_key", (F.col("begin") + F.col("at")).alias("line"), tx.rstrip(F.col("line_text")).alias("text"))


def read_range(docs: DataFrame, requests: DataFrame, lines: Callable[[Column], Column] = tx.lines) -> DataFrame:
    """Requests (req_id, doc_key, start, count); ``lines`` splits a text."""
    return _read(_asked(docs, requests.select("req_id", "doc_key", "start", "count")), F.col("start"), F.col("count"), lines=lines)


def read_around(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (req_id, doc_key, around, expand): the section around a line and ``expand`` more
    on each side; without a section, FALLBACK_COUNT lines from FALLBACK_BEFORE before.

    The last line of a section is in no section, as in the original.
    """
    rows = _asked(docs, requests.select("req_id", "doc_key", F.col("around").cast("long").alias("around"), F.greatest(F.coalesce("expand", F.lit(0)), F.lit(0)).cast("long").alias("expand")))
    cut = rows.withColumn("cut", ln.sections("text"))
    hit = F.get(F.filter("cut", lambda s: (s["line"] <= F.col("around")) & (F.col("around") < s["end_line"])), F.lit(0))["nth"]
    cut = cut.withColumn("hit", hit)
    a = F.get("cut", F.greatest(F.lit(0), F.col("hit") - F.col("expand") - 1).cast("int"))["line"]
    b = F.get("cut", (F.least(F.size("cut"), F.col("hit") + F.col("expand")) - 1).cast("int"))["end_line"]
    found = F.col("hit").isNotNull()
    first = F.when(found, a).otherwise(F.greatest(F.lit(1), F.col("around") - FALLBACK_BEFORE))
    return _read(cut, first, F.when(found, b - a + 1).otherwise(F.lit(FALLBACK_COUNT)))


def read_find(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (req_id, doc_key, find, after, context): the first line after ``after`` that holds the
    word, with ``context`` lines on each side; 0 means CONTEXT. Requests that find nothing have no rows."""
    context = F.when(F.coalesce("context", F.lit(0)) == 0, F.lit(CONTEXT)).otherwise(F.col("context"))
    rows = _asked(docs, requests.select("req_id", "doc_key", F.lower("find").alias("find"), F.greatest(F.coalesce("after", F.lit(0)), F.lit(0)).alias("after"), context.alias("context")))
    hits = F.transform(tx.lines(F.col("text")), lambda x, i: F.when((i + 1 > F.col("after")) & F.contains(F.lower(x), F.col("find")), i + 1))
    found = rows.withColumn("at", F.array_min(hits)).filter("at is not null")
    return _read(found, F.greatest(F.lit(1), F.col("at") - F.col("context")), 2 * F.col("context") + 1)


def read_jump(docs: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (req_id, doc_key, jump, count): ``a-b`` is a range, ``n`` is COUNT lines or ``count``."""
    parts = requests.select("req_id", "doc_key", F.coalesce(F.nullif("count", F.lit(0)), F.lit(COUNT)).alias("n"), F.posexplode(F.transform(F.split("jump", ","), tx.strip)).alias("part", "p")).filter("p <> ''")
    a, b = F.split_part(F.col("p"), F.lit("-"), F.lit(1)).cast("long"), F.split_part(F.col("p"), F.lit("-"), F.lit(2))
    ranges = parts.select("req_id", "part", "doc_key", a.alias("first"), F.when(F.contains("p", F.lit("-")), b.cast("long") - a + 1).otherwise(F.col("n")).alias("count"))
    return _read(_asked(docs, ranges), F.col("first"), F.col("count"), F.col("part"))


def mark_hits(read: DataFrame, tokens: list[str]) -> DataFrame:
    """Read lines with the number of tokens in each."""
    wanted = F.array(*map(F.lit, tokens)).cast("array<string>")
    return read.withColumn("hits", bound(F.lower("text"), lambda low: lowered_hits(low, wanted)))


def summaries(marked: DataFrame) -> DataFrame:
    """(req_id, doc_key, read_lines, total_hits, hit_lines): hit_lines are the first MAX_HIT_LINES lines with a hit."""
    hits = F.transform(F.array_sort(F.collect_list(F.when(F.col("hits") > 0, F.struct("part", "line")))), lambda x: x["line"])
    return marked.groupBy("req_id", "doc_key").agg(F.count("*").alias("read_lines"), F.sum("hits").alias("total_hits"), F.slice(hits, 1, MAX_HIT_LINES).alias("hit_lines"))


def read_markdown(marked: DataFrame, docs: DataFrame, mode: str) -> DataFrame:
    """(req_id, doc_key, markdown): the lines of each request, hits marked."""
    shown = F.concat(F.lit("L"), F.col("line").cast("string"), F.lit(": "), F.col("text"), F.when(F.col("hits") > 0, " **← HIT**").otherwise(""))
    rows = marked.select("req_id", "doc_key", "part", "line", "hits", shown.alias("shown"))
    body = rows.groupBy("req_id", "doc_key").agg(F.count("*").alias("n"), F.sum("hits").alias("hits"), F.transform(F.array_sort(F.collect_list(F.struct("part", "line", "shown"))), lambda x: x["shown"]).alias("shown"))
    named = body.join(docs.select("doc_key", "doc_id"), "doc_key")
    head = F.concat(F.lit("## "), F.col("doc_id"), F.lit(f" ({mode}, "), F.col("n").cast("string"), F.lit(" lines, "), F.col("hits").cast("string"), F.lit(" hits)\n\n"))
    return named.select("req_id", "doc_key", F.concat(head, F.array_join("shown", "\n"), F.lit("\n")).alias("markdown"))


def missing_documents(requests: DataFrame, docs: DataFrame) -> DataFrame:
    """Requests whose document is not there, with an error."""
    gone = requests.join(docs.select("doc_key"), "doc_key", "left_anti")
    return gone.select("req_id", "doc_key", F.concat(F.lit("Document not found: "), F.col("doc_key").cast("string")).alias("error"))
