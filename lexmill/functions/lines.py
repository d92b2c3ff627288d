"""Lines of texts in narrow Arrow passes: offsets, headings, blocks and sections are found inside the row, so no line is shuffled."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import give_back

HEADING = re.compile(r"(#{1,6})[ \t\n\r\f\v]+(.+)", re.S)
#: Rows of one result batch.
ROWS = 50_000
SECTIONS = T.ArrayType(T.StructType([*(T.StructField(n, T.LongType()) for n in ("nth", "line", "end_line")), T.StructField("heading", T.StringType())]))
HEADING_CHARS = 120
_MARK = re.compile(r"#{1,6}[ \t\n\r\f\v]")
_NUMBERED = re.compile(r"#{0,2}[ \t\n\r\f\v]*(?:第[一二三四五六七八九十百千\d]+[章节回]|[0-9]+(?:\.[0-9]+)*[ \t\n\r\f\v])", re.A)
_LINE_END = re.compile("\r\n|[\n\r\x0b\f\x1c-\x1e\x85  ]")


def starts(parts: list[str]) -> list[int]:
    """Character offset of each part of a text that was split at line feeds."""
    return [0, *accumulate(len(p) + 1 for p in parts)][: len(parts)]


def offset_rows(text: str) -> list[tuple]:
    return [(i + 1, at) for i, at in enumerate(starts(text.split("\n")))]


def heading_rows(text: str) -> list[tuple]:
    """(line, level, title, start, stop) of each heading, its line end included."""
    parts = text.split("\n")
    out = []
    for i, (at, part) in enumerate(zip(starts(parts), parts)):
        if "#" in part and (m := HEADING.match(part.lstrip())):
            out.append((i + 1, len(m[1]), m[2].strip(), at, min(at + len(part) + 1, len(text))))
    return out


def block_rows(text: str) -> list[tuple]:
    """(reading_order, start, stop) of each maximal run of lines that are not blank."""
    parts = text.split("\n")
    out: list[tuple] = []
    first = last = None
    for at, part in zip(starts(parts), parts):
        if part.strip():
            first, last = at if first is None else first, min(at + len(part) + 1, len(text))
        elif first is not None:
            out.append((len(out), first, last))
            first = None
    return [*out, (len(out), first, last)] if first is not None else out


def section_rows(text: str) -> list[tuple]:
    """(nth, line, end_line, heading): a section begins at the first line that is not blank and at every heading-like line after it."""
    parts = _LINE_END.split(text)
    if parts[-1] == "":
        parts.pop()
    begins: list[int] = []
    for i, part in enumerate(parts):
        if (_MARK.match(part) or _NUMBERED.match(part)) if begins else part.strip():
            begins.append(i)
    ends = [*begins[1:], len(parts)]
    return [(n + 1, a + 1, b, parts[a].strip()[:HEADING_CHARS]) for n, (a, b) in enumerate(zip(begins, ends))]


def each(docs: DataFrame, keep: list[str], find: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """One row for each result of ``find`` over the texts of ``docs``, with the columns to keep; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            index: list[int] = []

            def out() -> pa.RecordBatch:
                kept = [batch.column(c).take(pa.array(index, pa.int64())) for c in keep]
                made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                return pa.RecordBatch.from_arrays([*kept, *made], names=[*keep, *names])

            for i, text in enumerate(batch.column("text")):
                if text.is_valid:
                    found = find(text.as_py())
                    rows += found
                    index += [i] * len(found)
                    if len(rows) >= ROWS:
                        yield out()
                        rows, index = [], []
            if rows:
                yield out()
        give_back()

    names = [c.split()[0] for c in columns.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in columns.split(", ")]
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kept}, {columns}")


@F.pandas_udf(SECTIONS)
def sections(texts: pd.Series) -> pd.Series:
    names = ("nth", "line", "end_line", "heading")
    return texts.map(lambda t: [] if t is None else [dict(zip(names, r)) for r in section_rows(t)])
