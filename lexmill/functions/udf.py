"""Functions that have no built-in: Unicode normal form, byte decoding, chunking, names. All are Arrow batches."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text as tx
from .kernels import give_back

SEPARATORS = ("。", "！", "？", ". ", "! ", "? ", "\n\n", "\n", " ")
CHUNK_SIZE, OVERLAP = 1800, 0
CHUNK_BYTES = 1 << 20
ENCODINGS = ("utf-8", "utf-8-sig", "gb18030", "cp1252", "latin-1")


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode normal form KC."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def canonical_text(text: Column) -> Column:
    """NFKC, line feeds only, and one at the end."""
    return tx.canonical_line_ends(nfkc(text))


def alias_form(text: Column) -> Column:
    """Lower case, only ASCII letters, digits and CJK, of the NFKC form."""
    return tx.alias_form(nfkc(text))


_NO_ALIAS = re.compile("[^0-9a-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in tx._RANGES) + "]+")


def alias(text: str) -> str:
    """``alias_form`` of one text, for queries on the driver."""
    return _NO_ALIAS.sub("", unicodedata.normalize("NFKC", text).lower())


@F.pandas_udf(T.ArrayType(T.StringType()))
def distinct_aliases(lists: pd.Series) -> pd.Series:
    """Of each list the aliases that are not blank, stripped; of those with equal normal form the first."""

    def one(items):
        kept: dict[str, str] = {}
        for item in items:
            if item is not None and (form := alias(item.strip())):
                kept.setdefault(form, item.strip())
        return list(kept.values())

    return lists.map(lambda x: None if x is None else one(x))


def decoded(data: bytes) -> str:
    """Text of a file by the first encoding that takes all of it."""
    for name in ENCODINGS:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError("no encoding fits")  # latin-1 takes everything


@F.pandas_udf(T.StringType())
def decode_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decoded(bytes(b)))


def slug(text: str) -> str:
    """Lower-case ASCII letters and digits joined by hyphens, split where letters meet digits; ``v2`` stays whole."""
    folded = unicodedata.normalize("NFKC", text).lower()
    parts = []
    for word in re.findall(r"[a-z0-9]+", folded):
        # a version mark at the front of the word stays with its number if only digits follow
        marked = re.fullmatch(r"v\d+", word)
        parts += [word] if marked else re.findall(r"[a-z]+|\d+", word)
    return "-".join(parts)


@F.pandas_udf(T.StringType())
def slugify(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else slug(t))


_RESERVED = {"CON", "PRN", "AUX", "NUL"} | {f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)}


def shard_file(key: str) -> str:
    """File name of a shard key that every file system takes."""
    if not key:
        return "_EMPTY"
    key = key[:32]
    if key.upper() in _RESERVED or re.search(r'[\x00-\x1f<>:"/\\|?*. ]', key):
        return "U" + "-".join(format(ord(c), "04X") for c in key)
    return key


@F.pandas_udf(T.StringType())
def shard_name(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else shard_file(k))


_TABLE = r"<html><body><table>.*?</table></body></html>"
_PIPES = r"(?:^\|[^\n]*\|$\n?){2,}"
_FENCE = r"(?:^```\w*\n[\s\S]*?^```$\n?)"
_WHOLE = re.compile("|".join((_TABLE, _PIPES, _FENCE)), re.M | re.S)


class Chunker:
    """Cuts a text at the coarsest separator within reach and never inside a table or fenced block."""

    def __init__(self, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS):
        if size <= 0 or not 0 <= overlap < size:
            raise ValueError(f"need 0 <= overlap < size and size > 0, not size {size}, overlap {overlap}")
        self.size, self.overlap, self.separators = size, overlap, [s for s in separators if s]

    def __call__(self, text: str | None) -> list[tuple[int, int, int, str]]:
        """(ordinal, start, stop, text) of each chunk, in order; positions in characters."""
        out: list[tuple[int, int, int, str]] = []
        if not text:
            return out
        starts, stops = self._blocks(text)
        at = 0
        while True:
            stop = self._whole(text, at, self._cut(text, at), starts, stops)
            body = text[at:stop]
            first = at + len(body) - len(body.lstrip())
            last = at + len(body.rstrip())
            if last > first:
                out.append((len(out) + 1, first, last, text[first:last]))
            if stop >= len(text):
                return out
            taken = stop - at
            back = stop - min(self.overlap, taken - 1)
            at = stop if taken < self.overlap or back <= at else back

    @staticmethod
    def _blocks(text: str) -> tuple[list[int], list[int]]:
        starts, stops = [], []
        for m in _WHOLE.finditer(text):
            if stops and m.start() <= stops[-1]:  # blocks that touch are one
                stops[-1] = max(stops[-1], m.end())
            else:
                starts.append(m.start())
                stops.append(m.end())
        return starts, stops

    def _cut(self, text: str, at: int) -> int:
        limit = at + self.size
        if limit >= len(text):
            return len(text)
        for s in self.separators:
            found = text.rfind(s, at, min(len(text), limit + len(s)))
            if found >= 0:
                return found + len(s)
        return limit

    def _whole(self, text: str, at: int, stop: int, starts: list[int], stops: list[int]) -> int:
        """Move a cut out of a block; glue a short lead to the block that follows it."""
        k = bisect.bisect_right(starts, stop) - 1
        if stop < len(text) and k >= 0 and stop < stops[k]:
            stop = starts[k] if starts[k] > at else stops[k]
        if at < stop < len(text):
            k = bisect.bisect_left(starts, stop)
            lead = len(text[at:stop].strip())
            if k < len(starts) and starts[k] == stop and 0 < lead < self.size // 4:
                stop = stops[k]
        return stop if stop > at else min(at + 1, len(text))


def chunk_batches(cut: Chunker) -> Callable:
    """(doc_key, text) to the chunks of each text. A worker holds a text, its chunks and about CHUNK_BYTES of finished ones, however many texts a batch has."""
    names = ["doc_key", "ordinal", "start", "stop", "text"]
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column("doc_key"), batch.column("text")):
                for c in cut(text.as_py()):
                    rows.append((key.as_py(), *c))
                    held += len(c[3])
                    if held >= CHUNK_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        give_back()

    return run


def chunks(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = OVERLAP, separators: Sequence[str] = SEPARATORS) -> DataFrame:
    """(doc_key, ordinal, start, stop, text): the chunks of each text of (doc_key, text)."""
    keyed = docs.select(F.col("doc_key").cast("long").alias("doc_key"), "text")
    return keyed.mapInArrow(chunk_batches(Chunker(size, overlap, separators)), "doc_key long, ordinal int, start int, stop int, text string")
