"""Byte-level BPE encoding of whole texts by overlapping chunks, and decoding.

The pre-tokeniser is the published pattern of the vocabulary

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

computed for all texts of a slice at once from the classes of their characters. Each
distinct pre-token of a slice is encoded once. Long texts are cut into chunks that
overlap; the chunks are pre-tokenised in parallel, and where the boundaries of two
neighbours meet in their overlap the text is stitched: from a common boundary on, the
pattern reads only what follows, so the pieces between stitches have exactly the
boundaries of the whole text. Decoding concatenates the bytes of the ids.

Plan: texts of one chunk are encoded in one narrow Arrow pass. The chunks of longer ones are written once, spread over
the cluster; their boundaries within overlaps come back, and each chunk's piece between two stitches is encoded where the chunk
is. The ids are put together by text. A text with an overlap in which no boundaries meet (a run of one class that long) is encoded whole, in bounded
windows from left to right. Whether the ids decode to the text again is told where the text was encoded, by the same worker; only the ids
of stitched texts, which were put together elsewhere, are decoded in a pass of their own. So no task of op10 keeps two Python workers busy at once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.kernels import gather
from .common import cut, keys_side, map_batches, table
from .kernels import SLICE_BYTES, U64, mix, powers, slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, OVERLAP = 32_768, 1_024
#: Pre-tokens that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 500_000
OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_classes: list[np.ndarray] = []


def character_classes() -> np.ndarray:
    """Class of every code point under the pattern."""
    if not _classes:
        out = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, what in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(what, every):
                shift = [x if x < 0xD800 else x + 0x800 for x in m.span()]
                out[shift[0] : shift[1]] = kind
        _classes.append(out)
    return _classes[0]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def boundaries(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted starts of the pre-tokens of all texts, which lie end to end in ``points``."""
    n = len(points)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = character_classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    change = np.empty(n, bool)
    change[0] = True
    change[1:] = kind[1:] != kind[:-1]
    start = change | first  # starts of runs of one class
    # a run of white space that is followed by other text gives up its last character
    is_space = kind == SPACE
    last_space = np.zeros(n, bool)
    last_space[:-1] = is_space[:-1] & ~is_space[1:] & ~first[1:]
    start |= last_space
    # and a blank there joins the run behind it
    joins = np.zeros(n, bool)
    joins[1:] = last_space[:-1] & (points[:-1] == 32)
    start &= ~joins
    # contractions: an apostrophe that is a pre-token's first character and a run of its own
    mark = np.flatnonzero((points == 39) & start)
    mark = mark[mark + 1 < n]
    mark = mark[~first[mark + 1] & (kind[mark + 1] == LETTER)]
    if len(mark):
        one = points[mark + 1]
        two_there = mark + 2 < n
        after = np.minimum(mark + 2, n - 1)
        two_there &= ~first[after]
        two = np.where(two_there, points[after], 0)
        short = np.isin(one, [ord("s"), ord("t"), ord("m"), ord("d")])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[mark[short | long] + 1] = False
        for ends in (mark[short] + 2, mark[long] + 3):
            ends = ends[ends < n]
            start[ends[(kind[ends] == LETTER)]] = True
    return np.flatnonzero(start)


class Encoder:
    """Ids of pre-tokens by a vocabulary of ranks; remembers what it has encoded."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.coding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.forget()

    def forget(self) -> None:
        # two levels of (sorted hashes, number of each); new pre-tokens go to the small one
        none = (np.zeros(0, U64), np.zeros(0, np.int64))
        self.levels = [none, none]
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def __call__(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens that begin at ``starts``, and the n + 1 offsets of the pre-tokens."""
        if len(starts) == 0:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        ends = np.append(starts[1:], len(points))
        prefix = np.zeros(len(points) + 1, U64)
        np.cumsum((points.astype(U64) + U64(1)) * powers(_BASE, len(points)), out=prefix[1:])
        h = mix((prefix[ends] - prefix[starts]) * powers(_INVERSE, len(points))[starts] ^ ((ends - starts).astype(U64) << U64(48)))
        order = np.argsort(h)
        new = np.append(True, h[order][1:] != h[order][:-1])
        distinct, first = h[order][new], order[new]
        at = self._find(distinct)
        if (at < 0).any():
            if len(self.starts) > REMEMBERED:
                self.forget()
                at = self._find(distinct)
            unknown = np.flatnonzero(at < 0)
            at[unknown] = self._learn(distinct[unknown], points, starts[first[unknown]], ends[first[unknown]])
        number = np.empty(len(h), np.int64)
        number[order] = at[np.cumsum(new) - 1]
        counts = self.starts[number + 1] - self.starts[number]
        offsets = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[np.repeat(self.starts[number] - offsets[:-1], counts) + np.arange(offsets[-1])], offsets

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        for known, numbers in self.levels:
            if len(known):
                near = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out = np.where(known[near] == h, numbers[near], out)
        return out

    def _learn(self, h: np.ndarray, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        encode = self.coding._core_bpe.encode_single_piece
        coded = [encode(points[a:b].tobytes().decode("utf-32-le", "replace").encode()) for a, b in zip(starts.tolist(), ends.tolist())]
        counts = np.fromiter(map(len, coded), np.int64, len(coded))
        numbers = len(self.starts) - 1 + np.arange(len(h))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])
        self.ids = np.concatenate([self.ids, np.fromiter((i for c in coded for i in c), np.int32, int(counts.sum()))])
        at = 1 if len(self.levels[1][0]) + len(h) < 100_000 else 0
        merged = [np.concatenate(x) for x in zip(*self.levels[at:], (h, numbers))]
        order = np.argsort(merged[0], kind="stable")
        self.levels[at:] = [(merged[0][order], merged[1][order]), *([(np.zeros(0, U64), np.zeros(0, np.int64))] if at == 0 else [])]
        return numbers


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary_bytes(path: str) -> list[bytes]:
    """Bytes of every id."""
    with open(path, "rb") as file:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class Decoder:
    """Bytes of ids by a vocabulary of ranks."""

    def __init__(self, path: str):
        pieces = vocabulary_bytes(path)
        self.raw = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of all ids end to end, gathered in bounded windows, and where each of the lists that ``offsets`` part begins and ends."""
        at = np.concatenate([[0], np.cumsum(self.lengths[ids])])
        borders = [0, *np.searchsorted(at, np.arange(SLICE_BYTES, at[-1], SLICE_BYTES)).tolist(), len(ids)]
        windows = (ids[a:b] for a, b in zip(borders, borders[1:]))
        return b"".join(gather(self.raw, self.starts[w], self.starts[w] + self.lengths[w])[0].tobytes() for w in windows), at[offsets]

    def gives(self, texts: list[str], ids: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """Whether the ids of each text, which lie end to end, are its bytes."""
        data, at = self(ids, offsets)
        return [data[a:b] == t.encode() for t, a, b in zip(texts, at.tolist(), at[1:].tolist())]


_decoders: dict[str, Decoder] = {}


def decoder(path: str) -> Decoder:
    if path not in _decoders:
        _decoders[path] = Decoder(path)
    return _decoders[path]


def encode_texts(texts: list[str], code: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n + 1 offsets of the texts."""
    points, offsets = code_points(texts)
    starts = boundaries(points, offsets)
    ids, at = code(points, starts)
    return ids, at[np.searchsorted(starts, offsets)]


def encode_pieces(text: str, cuts: list[int], code: Encoder) -> np.ndarray:
    """Ids of one text, piece by piece between known pre-token starts, so arrays stay small.

    A piece is read with the three characters behind it, which the pattern may look at.
    """
    borders = [0, *cuts, len(text)]
    out = []
    for a, b in zip(borders, borders[1:]):
        seen, _ = code_points([text[a : b + 3]])
        starts = boundaries(seen, np.array([0, len(seen)]))
        out.append(code(seen[: b - a], starts[starts < b - a])[0])
    return np.concatenate(out)


def cuts_within(text: str, window: int = SLICE_BYTES) -> list[int]:
    """Pre-token starts that part a long text into pieces of about ``window`` characters, found from left to right."""
    out, at, reach = [], 0, window
    while len(text) - at > reach:
        points, offsets = code_points([text[at : at + reach]])
        starts = boundaries(points, offsets)
        starts = starts[(starts > 0) & (starts <= reach - 3)]  # the last three characters may read on
        if len(starts):
            at += int(starts[-1])
            out.append(at)
            reach = window
        else:
            reach *= 2
    return out


def encode_bounded(texts: list[str], code: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """``encode_texts``, but a single long text is encoded piece by piece."""
    if len(texts) == 1 and len(texts[0]) > 2 * SLICE_BYTES:
        ids = encode_pieces(texts[0], cuts_within(texts[0]), code)
        return ids, np.array([0, len(ids)])
    return encode_texts(texts, code)


def _id_lists(ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))


def _encode(path: str, check: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                ids, offsets = encode_bounded(texts, code)
                out = {"row": part.column("row"), "ids": _id_lists(ids, offsets)}
                if check:
                    out["exact"] = pa.array(decoder(path).gives(texts, ids, offsets), pa.bool_())
                yield pa.RecordBatch.from_arrays([*out.values()], names=[*out])

    return run


def _encode_chunks(path: str):
    """Ids of the part [a, b) of each chunk; the pattern may look at what follows it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in batches:
            for part in slices(batch, "piece"):
                coded = []
                for text, a, b in zip(*(part.column(c).to_pylist() for c in ("piece", "a", "b"))):
                    seen, _ = code_points([text[a : b + 3]])
                    starts = boundaries(seen, np.array([0, len(seen)]))
                    coded.append(code(seen[: b - a], starts[starts < b - a])[0])
                ids = np.concatenate(coded) if coded else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2", "nth")), _id_lists(ids, np.concatenate([[0], np.cumsum([len(c) for c in coded])]))], names=["k1", "k2", "nth", "ids"])

    return run


def _edges(chunk: int, overlap: int):
    """Of each chunk, the boundaries (positions in the text) in its overlaps with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "piece"):
                pieces = part.column("piece").to_pylist()
                points, offsets = code_points(pieces)
                starts = boundaries(points, offsets)
                at = np.searchsorted(starts, offsets)
                head, tail = [], []
                for i, n in enumerate(part.column("nth").to_pylist()):
                    own, length = starts[at[i] : at[i + 1]] - offsets[i], offsets[i + 1] - offsets[i]
                    # the last three characters may read on beyond the chunk
                    head.append((own[(own > 0) & (own <= min(overlap, length) - 3)] + n * chunk).tolist())
                    tail.append((own[(own > chunk) & (own <= length - 3)] + n * chunk).tolist())
                yield pa.RecordBatch.from_arrays([part.column("k1"), part.column("k2"), part.column("nth"), pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=["k1", "k2", "nth", "head", "tail"])

    return run


def long_chunks(long: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(k1, k2, nth, piece): the chunks of each distinct text (k1, k2, text), spread over the cluster and written once."""
    last = F.floor((F.length("text") - 1) / F.lit(chunk)).cast("int")
    chunks = long.select("k1", "k2", "text", F.explode(F.sequence(F.lit(0), last)).alias("nth")).select("k1", "k2", "nth", F.substring("text", F.col("nth") * chunk + 1, F.lit(chunk + overlap)).alias("piece"))
    # equal texts fold by key here, chunk by chunk, so that no whole text is sorted or shuffled
    return cut(chunks.repartition("k1", "nth").dropDuplicates(["k1", "k2", "nth"]))


def stitches(chunks: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(k1, k2, n, cuts): how many chunks a text has, and the first boundary that each shares with its successor, null where there is none."""
    edges = chunks.transform(map_batches, _edges(chunk, overlap), "k1 long, k2 long, nth int, head array<long>, tail array<long>")
    ordered = edges.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("nth", "head", "tail"))).alias("chunks"))
    meets = F.transform(F.sequence(F.lit(1), F.size("chunks") - 1), lambda i: F.array_min(F.array_intersect(F.element_at("chunks", i)["tail"], F.element_at("chunks", i + 1)["head"])))
    return ordered.select("k1", "k2", F.size("chunks").alias("n"), F.when(F.size("chunks") > 1, meets).otherwise(F.array().cast("array<bigint>")).alias("cuts"))


def encode_documents(docs: DataFrame, path: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP, keep: list[str] | None = None, check: bool = False) -> DataFrame:
    """(row, ids) for each row of ``docs``: the token ids of the whole text; ``row`` is a struct of
    all its columns, or of those to ``keep``. With ``check`` also exact: whether the ids decode to the text again.

    * A null text has null ids and a null exact, an empty text no ids. Repeated rows are each returned.
    * Extra columns stay inside ``row``, so their names cannot clash. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("exact", T.BooleanType())] if check else [])])
    short = rows.filter(F.length("text") <= chunk).transform(map_batches, _encode(path, check), schema)
    empty = rows.filter("text is null").select("row", *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields[1:]))
    keys = F.xxhash64("text"), F.xxhash64(F.lit(1), "text")
    long = rows.filter(F.length("text") > chunk).select("row", "text", keys[0].alias("k1"), keys[1].alias("k2"))
    chunks = long_chunks(long, chunk, overlap)
    cuts = cut(stitches(chunks, chunk, overlap))
    whole = F.exists("cuts", lambda c: c.isNull())
    # chunk nth holds the piece from its cut with the one before to its cut with the next
    own = chunks.join(cuts.filter(~whole), ["k1", "k2"])
    at = F.col("nth") * F.lit(chunk)
    a = F.when(F.col("nth") == 0, F.lit(0)).otherwise(F.get("cuts", F.col("nth") - 1) - at)
    b = F.when(F.col("nth") == F.col("n") - 1, F.length("piece")).otherwise(F.get("cuts", F.col("nth")) - at)
    placed = own.select("k1", "k2", "nth", "piece", a.cast("long").alias("a"), b.cast("long").alias("b"))
    coded = placed.transform(map_batches, _encode_chunks(path), "k1 long, k2 long, nth int, ids array<int>")
    joined = coded.groupBy("k1", "k2").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("nth", "ids"))), lambda c: c["ids"])).alias("ids"))
    if check:
        back = joined.transform(map_batches, _decode(path, ["k1", "k2", "ids"]), "k1 long, k2 long, ids array<int>, text string")
        joined = back.select("k1", "k2", "ids", ((keys[0] == F.col("k1")) & (keys[1] == F.col("k2"))).alias("exact"))
    stitched = long.select("row", "k1", "k2").join(joined, ["k1", "k2"]).select(*schema.names)
    rest = keys_side(cuts.filter(whole).select("k1", "k2"))
    unstitched = long.join(rest, ["k1", "k2"], "left_semi").select("row", "text").transform(map_batches, _encode(path, check), schema)
    return short.unionByName(stitched).unionByName(unstitched).unionByName(empty)


def _decode(path: str, kept: list[str]):
    """Texts of ids, beside the columns to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(path)
        for batch in batches:
            for lead, part in _bounded(batch.column("ids")):
                counts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(part), 0).to_numpy(zero_copy_only=False))])
                data, at = decode(pc.list_flatten(part).to_numpy(zero_copy_only=False), counts)
                known = pc.is_valid(part).to_pylist()
                texts = [data[a:b].decode("utf-8", "replace") if k else None for a, b, k in zip(at.tolist(), at[1:].tolist(), known)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(lead, len(part)) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    return run


def _bounded(lists: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive (start, slice) of lists that hold at most ``most`` ids, or one list."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.list_value_length(lists), 0).to_pylist()):
        if i > start and held + n > most:
            yield start, lists.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lists):
        yield start, lists.slice(start)


def decode_documents(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(row, text) from (row, ids): the bytes of the ids end to end. Null ids give a null text."""
    return encoded.select("row", "ids").transform(map_batches, _decode(path, ["row"]), T.StructType([encoded.schema["row"], T.StructField("text", T.StringType())]))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact) of every document; exact tells whether the decoded ids are the text again."""
    coded = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"], check=True)
    return coded.select("row.doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_tokens"), "ids", "exact")
