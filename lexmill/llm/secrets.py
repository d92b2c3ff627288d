"""Secret scans: novelty of candidate strings under a dictionary-primed zstandard.

A candidate is a value near a sensitive word (a whole quoted value, or a run up to the next blank, quote or
bracket), a shorter value of mixed characters that is assigned to a sensitive name, or the body of a private key block. Its novelty is what
it adds to the compressed size of its surroundings: the compressor is primed with a
dictionary of programming identifiers and the text around the candidate, and the bytes
for (surroundings + candidate) less the bytes for the surroundings alone are its marginal
bytes. Words, paths and names repeat what the dictionary or the neighbourhood holds and
cost little; keys cost nearly their entropy. What stays incompressible is reported: what costs
THRESHOLD bits a character, or holds a piece that costs as much as random strings of its alphabet.

Plan: one narrow Arrow pass over (doc_id, text). A vectorised regular expression drops
texts without a candidate; only the others are looked at in Python.
"""

from __future__ import annotations

import bisect
import random
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, table

#: Characters on each side of a candidate that prime the compressor, and those before it that open the frame.
AROUND, FRAME = 2_048, 64
#: Characters of a candidate near a sensitive word, and of one that is assigned to it.
MIN_LENGTH, MIN_ASSIGNED = 16, 8
#: Marginal compressed bits for each character, where literals are not Huffman-coded.
THRESHOLD = 6.0
#: Share of the bytes of random strings (the mean of so many) of its own alphabet and length that a key costs at least.
SHARE, RANDOM = 0.93, 4
MASK = "[SECRET]"
PIECE, HEX = re.compile(r"[A-Za-z0-9]{16,}"), re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
CONTEXT = r"(?i:api[\s_-]?key|access[\s_-]?key|private[\s_-]?key|secret|token|pass[\s_-]?(?:word|wd|phrase)|pwd|credential|bearer|auth(?:orization)?)"
#: The rest of the name that holds the word.
NAME = CONTEXT + r"[A-Za-z0-9_-]*"
#: Characters at most between a sensitive name and a candidate after it (a few words and marks), or before it ("K is the token").
NEAR, NEAR_AHEAD = 40, 16
#: A run ends at a blank, a quote, a bracket, a list mark, an escaped quote or line end, or at the next name of a query string.
RUN = r"(?:(?!&[A-Za-z0-9_.-]+=|\\[\"'nrt])[!#-&*+\-./0-9:=?@A-Z\\^_a-z|~%])"
QUOTED = r"([\"'`])([^\s\"'`]+?)\\?\1"
ASSIGNED = re.compile(NAME + r"\\?[\"'\]]*\s{0,8}(?::=|=>|==?|:)\s{0,8}\\?(?:" + QUOTED + r"|(" + RUN + r"{8,}))")
LONG_RUN = re.compile(RUN + r"{16,}")
_QUOTED = re.compile(QUOTED)
_NAMED = re.compile(NAME + r"[\"']?(?:[:=]+>?|/)")
#: A key block: all its lines are one candidate, up to its end mark or as far as they look like base64.
PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
PEM_BODY = re.compile(PEM + r"(?:\s|\\[nr])*((?s:.{16,65536}?)(?=-----END)|(?:[A-Za-z0-9+/=]|\s|\\[nr]){16,})")
#: What a text must hold to be looked at.
CANDIDATE = rf"{CONTEXT}|{PEM}"
IDENTIFIERS = (
    "true false null none self this return import from class function public private static final const let var async await "
    "config settings environment variable default example placeholder changeme your_api_key_here access_key secret_key client_secret "
    "password username authorization bearer token session cookie header request response content application json text html utf-8 "
    "localhost http https www com org net index main test data value name type id key list map string integer float boolean array object "
    "get set put post delete update create read write open close start stop init load save send receive connect error exception logger "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 ./../usr/local/bin/etc/home/lib/src/include/share "
    "github.com gitlab.com googleapis.com amazonaws.com example.com application_id tenant_id client_id user_id session_id "
    "authorization_code refresh_token access_token id_token csrf_token auth_token private_key public_key ssh-rsa BEGIN END CERTIFICATE "
)
FINDINGS = "array<struct<start:int,stop:int,text:string,marginal_bytes:int,bits:double>>"


class Novelty:
    """Marginal compressed bytes under one identifier dictionary."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        self.identifiers = identifiers.encode()

    def _compressor(self, before: str, after: str) -> zstandard.ZstdCompressor:
        known = zstandard.ZstdCompressionDict(self.identifiers + (after + before).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=19, dict_data=known, write_checksum=False, write_content_size=False, write_dict_id=False)

    def marginal(self, candidate: str, before: str, after: str) -> int:
        """Bytes that the candidate adds when the identifiers and its surroundings are known."""
        compressor, frame = self._compressor(before, after), before[-FRAME:].encode()
        return len(compressor.compress(frame + candidate.encode())) - len(compressor.compress(frame))

    def of_random(self, candidate: str, before: str, after: str) -> float:
        """Mean marginal bytes of random strings of the candidate's length and alphabet, in its place."""
        compressor, frame = self._compressor(before, after), before[-FRAME:].encode()
        draw, alphabet = random.Random(len(candidate)), sorted(set(candidate))
        drawn = ["".join(draw.choices(alphabet, k=len(candidate))).encode() for _ in range(RANDOM)]
        return sum(len(compressor.compress(frame + x)) for x in drawn) / RANDOM - len(compressor.compress(frame))

    def incompressible(self, candidate: str, before: str, after: str, threshold: float) -> tuple[bool, int]:
        """Whether the candidate costs ``threshold`` bits a character, or what a random string would; and its marginal bytes."""
        cost = self.marginal(candidate, before, after)
        if 8 * cost >= threshold * len(candidate):
            return True, cost
        # long strings of a small alphabet are Huffman-coded: even a random one stays below the threshold;
        # words and paths are cut by their marks, so they have no piece to judge
        joined = re.sub(r"[^A-Za-z0-9]", "", candidate)
        pieces = [joined] if HEX.fullmatch(joined) else PIECE.findall(candidate)
        return any(self.marginal(x, before, after) >= SHARE * self.of_random(x, before, after) > 0 for x in pieces if len(set(x)) > 1), cost


def mixed(value: str) -> bool:
    """Whether a short value is no plain word or number: at least two kinds of characters, letters and others among them."""
    kinds = {"a" if c.isalpha() else "0" if c.isdigit() else "-" if c in "-_./" else "!" for c in value}
    return "a" in kinds and bool(kinds & {"0", "!"})


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, stop) of each candidate, in order, none over another: key blocks, assigned values, then quoted values and runs
    near a sensitive name."""
    taken: list[tuple[int, int]] = []  # sorted (start, stop) of what a candidate covers
    spans: list[tuple[int, int]] = []

    def add(start: int, stop: int, low: int, high: int) -> None:
        at = bisect.bisect_left(taken, (low, low))
        if (at < len(taken) and taken[at][0] < high) or (at > 0 and taken[at - 1][1] > low):
            return
        taken.insert(at, (low, high))
        spans.append((start, stop))

    for m in PEM_BODY.finditer(text):
        body = re.sub(r"(?:\s|\\[nr])+$", "", m[1])
        add(m.start(1), m.start(1) + len(body), m.start(), m.end())
    names = [m.span() for m in re.finditer(NAME, text)]
    if names:
        for m in ASSIGNED.finditer(text):
            group = 2 if m[2] is not None else 3
            if MIN_ASSIGNED <= len(m[group]) and mixed(m[group]) and ascii_like(m[group]):
                add(*m.span(group), *m.span(group))

        def near(start: int, stop: int) -> bool:
            at = bisect.bisect_left(names, (start, 0))
            return (at > 0 and start - names[at - 1][1] <= NEAR) or (at < len(names) and names[at][0] - stop <= NEAR_AHEAD)

        for m in _QUOTED.finditer(text):
            if len(m[2]) >= MIN_LENGTH and ascii_like(m[2]) and not _NAMED.search(m[2]) and near(*m.span(2)):
                add(*m.span(2), *m.span(2))
        for m in LONG_RUN.finditer(text):
            start, stop = m.span()
            # the name in name=value belongs to the surroundings
            for named in _NAMED.finditer(text, start, stop):
                start = named.end()
            if stop - start >= MIN_LENGTH and near(start, stop):
                add(start, stop, start, stop)
    yield from sorted(spans)


def ascii_like(value: str) -> bool:
    """Keys are written in ASCII; a value of which more than a quarter is not is prose."""
    return 4 * sum(c.isascii() for c in value) >= 3 * len(value)


def find_secrets(text: str, novelty: Novelty, threshold: float = THRESHOLD) -> list[tuple[int, int, str, int, float]]:
    """(start, stop, text, marginal bytes, bits per character) of each incompressible candidate, in order."""
    out = []
    for start, stop in candidates(text):
        value = text[start:stop]
        if stop >= len(text) or text[stop] not in "\"'`":  # a run may end in the marks of its sentence
            value = value.rstrip(".:?!\\") if not value.endswith("==") else value
        stop = start + len(value)
        # the line ends of a key block are no part of its key
        key = re.sub(r"\s|\\[nr]", "", value)
        if len(key) < MIN_ASSIGNED:
            continue
        # its own repeats say nothing about how guessable it is
        before, after = (x.replace(value, "") for x in (text[max(0, start - AROUND) : start], text[stop : stop + AROUND]))
        novel, cost = novelty.incompressible(key, before, after, threshold)
        if novel:
            out.append((start, stop, value, cost, round(8 * cost / len(key), 6)))
    return out


def _scan(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string()), ("marginal_bytes", pa.int32()), ("bits", pa.float64())]))
        for batch in batches:
            texts = batch.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(texts, CANDIDATE), False).to_pylist()
            found: list = [[] for _ in maybe]
            for i, yes in enumerate(maybe):
                if yes:
                    found[i] = [dict(zip(("start", "stop", "text", "marginal_bytes", "bits"), x)) for x in find_secrets(texts[i].as_py(), novelty, threshold)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, kind)], names=["row", "findings"])

    return run


def secrets(docs: DataFrame, threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """(row, findings) for each row of ``docs``: the secrets of its text, in order; ``row`` is a
    struct of all its columns, or of those to ``keep``.

    * A candidate near a sensitive name has MIN_LENGTH characters or more, within NEAR characters behind the whole name or
      NEAR_AHEAD before it; a value assigned to the name has MIN_ASSIGNED or more, of mixed kinds. Its surroundings are AROUND
      characters on each side, the last FRAME before it open the frame.
    * A null or empty text has no findings; a long text is scanned whole. Repeated rows are each returned.
    * Of overlapping candidates the first counts. Positions count characters from 0.
    * Extra columns stay inside ``row``, so their names cannot clash. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").cast("string").alias("text"))
    return rows.transform(map_batches, _scan(threshold), T.StructType([rows.schema["row"], T.StructField("findings", T._parse_datatype_string(FINDINGS))]))


def redact_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each secret in the text, up to its closing quote or blank, replaced by MASK; n_chars, where there, follows the text.

    * Every row stays, with all its columns, whatever their names; repeated rows are each masked.
    * Null and empty texts stay as they are, and so do texts without a secret. An empty table stays empty.
    """
    found = secrets(docs, threshold)
    text = F.col("row.text").cast("string")
    # what stands between the findings, joined by the mask
    at = F.concat(F.array(F.lit(0)), F.col("findings.stop"))
    to = F.concat(F.col("findings.start"), F.array(F.length(text)))
    kept = F.transform(at, lambda a, i: F.substring(text, a + 1, F.element_at(to, i + 1) - a))
    clean = F.when(F.size("findings") > 0, F.array_join(kept, MASK)).otherwise(text)
    columns = []
    for c in docs.columns:
        column = F.col("row").getField(c)
        if c == "text":
            column = clean
        elif c == "n_chars":
            column = F.when(F.size("findings") > 0, F.length(clean).cast(docs.schema[c].dataType)).otherwise(column)
        columns.append(column.alias(c))
    return found.select(*columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, start, stop, secret, marginal_bytes, bits): each secret of each document."""
    found = secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    one = found.filter(F.size("findings") > 0).select(F.col("row.doc_id").alias("doc_id"), F.explode("findings").alias("f"))
    return one.select("doc_id", F.col("f.start").alias("start"), F.col("f.stop").alias("stop"), F.col("f.text").alias("secret"), F.col("f.marginal_bytes").alias("marginal_bytes"), F.col("f.bits").alias("bits"))
