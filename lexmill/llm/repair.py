"""Token-ID shards compressed by Re-Pair grammars, with random access.

Documents are encoded to token ids and gathered into shards. In each shard frequent id
pairs are replaced by nonterminals, round after round, until no pair occurs MIN_COUNT
times. Symbols are stored in as many bits as the largest of them needs, so neither the vocabulary nor the number of rules is bounded. A pair never reaches over the end of a
document. The nonterminals of one round do not overlap: no symbol is the left half of
one and the right half of another. Every rule keeps its expansion length, so a token
position is found by summing lengths, and only the symbols that cover it are expanded.

Plan: one narrow Arrow pass over (doc_id, text); a shard never leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import VOCABULARY, encode_bounded, encoder
from .common import map_batches, table
from .kernels import slices

#: A rule costs two symbols and a length, so rarer pairs would add more than they save.
SHARD_TOKENS, MIN_COUNT, ROUND_RULES = 1_000_000, 12, 4096
SHARD = "shard string, doc_ids array<long>, starts array<int>, lengths array<int>, base int, bits int, n_symbols int, n_rules int, expansion_bits int, rules binary, expansions binary, symbols binary"


def pack(symbols: np.ndarray, bits: int) -> bytes:
    """Symbols of ``bits`` bits each, lowest bit first."""
    wide = 8 if bits <= 8 else 16 if bits <= 16 else 32
    raw = symbols.astype(f"<u{wide // 8}")
    if bits == wide:
        return raw.tobytes()
    return np.packbits(np.unpackbits(raw.view(np.uint8), bitorder="little").reshape(-1, wide)[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Symbols [start, stop); only the bytes that hold them are looked at."""
    first, last = start * bits // 8, -(-stop * bits // 8)
    flags = np.unpackbits(np.frombuffer(data, np.uint8)[first:last], bitorder="little")
    skip = start * bits - 8 * first
    out = np.zeros((stop - start, 32), np.uint8)
    out[:, :bits] = flags[skip : skip + (stop - start) * bits].reshape(-1, bits)
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel().astype(np.int64)


def symbol_bits(base: int, rules: int) -> int:
    return max(1, int(base + rules - 1).bit_length())


def _choose(pairs: np.ndarray, counts: np.ndarray, room: int, space: int) -> list[int]:
    """Pairs in order of falling count, such that no symbol takes both roles."""
    order = np.lexsort((pairs, -counts))[: 4 * room]
    left, right = (pairs[order] // space).tolist(), (pairs[order] % space).tolist()
    role: dict[int, int] = {}
    chosen = []
    for i, a, b in zip(order.tolist(), left, right):
        if a == b:
            if a in role:
                continue
            role[a] = 3
        else:
            if role.get(a, 1) != 1 or role.get(b, 2) != 2:
                continue
            role[a], role[b] = 1, 2
        chosen.append(i)
        if len(chosen) == room:
            break
    return chosen


def compress(ids: np.ndarray, starts: np.ndarray, base: int, min_count: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts of the documents in them, rules): rule i is what symbol base + i stands for."""
    seq, rules = ids.astype(np.int64), []
    owner_end = np.zeros(len(seq) + 1, bool)
    owner_end[starts] = True
    first = owner_end[: len(seq)]  # first symbol of a document
    empty = np.diff(np.append(starts, len(ids))) == 0
    while len(seq) > 1:
        space = base + len(rules) + 1
        keys = seq[:-1] * space + seq[1:]
        joined = ~first[1:]
        ordered = np.sort(keys[joined])
        if len(ordered) == 0:
            break
        at = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        counts = np.diff(np.append(at, len(ordered)))
        often = counts >= min_count
        if not often.any():
            break
        pairs, counts = ordered[at[often]], counts[often]
        floor = max(min_count, int(counts.max()) // 1024)  # rarer pairs wait for a later round
        strong = counts >= floor
        pairs, counts = pairs[strong], counts[strong]
        chosen = np.array(_choose(pairs, counts, ROUND_RULES, space))
        chosen = np.sort(pairs[chosen])
        is_left, is_right = np.zeros(space, bool), np.zeros(space, bool)
        is_left[chosen // space] = True
        is_right[chosen % space] = True
        hits = np.flatnonzero(is_left[seq[:-1]] & is_right[seq[1:]] & joined)
        near = np.minimum(np.searchsorted(chosen, keys[hits]), len(chosen) - 1)
        good = chosen[near] == keys[hits]
        hits, which = hits[good], near[good]
        twin = (chosen // space == chosen % space)[which]
        if twin.any():  # of a run of one symbol every second pair is replaced
            run = np.cumsum(np.append(True, (np.diff(hits) != 1) | (np.diff(which) != 0)))
            nth = np.arange(len(hits)) - np.searchsorted(run, run)
            stay = ~twin | (nth % 2 == 0)
            hits, which = hits[stay], which[stay]
        seq[hits] = base + len(rules) + which
        keep = np.ones(len(seq), bool)
        keep[hits + 1] = False
        seq, first = seq[keep], first[keep]
        rules += np.stack([chosen // space, chosen % space], 1).tolist()
    new_starts = np.zeros(len(starts), np.int64)
    new_starts[~empty] = np.flatnonzero(first)
    following = len(seq)
    for i in range(len(starts) - 1, -1, -1):
        if empty[i]:
            new_starts[i] = following
        following = new_starts[i]
    return seq, new_starts, np.array(rules, np.int64).reshape(-1, 2)


def expansion_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    lengths = np.ones(base + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[base + i] = lengths[a] + lengths[b]
    return lengths[base:]


def expand(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Token ids of the symbols."""
    symbols = symbols.astype(np.int64)
    while len(symbols) and symbols.max() >= base:
        wide = symbols >= base
        at = np.arange(len(symbols)) + np.cumsum(wide) - wide
        out = np.empty(len(symbols) + int(wide.sum()), np.int64)
        out[at[~wide]] = symbols[~wide]
        out[at[wide]], out[at[wide] + 1] = rules[symbols[wide] - base].T
        symbols = out
    return symbols


def grammar(shard) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, expansion lengths) of the rules of a shard row."""
    n = shard["n_rules"]
    return unpack(shard["rules"], shard["bits"], 0, 2 * n).reshape(-1, 2), unpack(shard["expansions"], shard["expansion_bits"], 0, n)


def read_tokens(shard, document: int, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Token ids [start, stop) of the document at that place in a shard row; unpacks its symbols and expands only what covers the span."""
    rules, expansions = grammar(shard)
    base, bits, starts = shard["base"], shard["bits"], shard["starts"]
    end = starts[document + 1] if document + 1 < len(starts) else shard["n_symbols"]
    own = unpack(shard["symbols"], bits, starts[document], end)
    stop = shard["lengths"][document] if stop is None else min(stop, shard["lengths"][document])
    if stop <= start:
        return np.zeros(0, np.int64)
    lengths = np.ones(len(own), np.int64)
    made = own >= base
    lengths[made] = expansions[own[made] - base]
    ends = np.cumsum(lengths)
    a, b = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop, side="left") + 1
    before = ends[a - 1] if a else 0
    return expand(own[a:b], rules, base)[start - before : stop - before]


def shard_row(name: str, doc_ids: list, ids: np.ndarray, counts: np.ndarray, base: int, min_count: int = MIN_COUNT) -> dict:
    """A shard of documents with ``counts`` token ids each, end to end in ``ids``."""
    symbols, starts, rules = compress(ids, np.cumsum(counts) - counts, base, min_count)
    lengths = expansion_lengths(rules, base)
    bits, wide = symbol_bits(base, len(rules)), symbol_bits(int(lengths.max(initial=1)), 1)
    sizes = {"starts": starts.astype(np.int32), "lengths": counts.astype(np.int32), "base": base, "bits": bits, "n_symbols": len(symbols), "n_rules": len(rules), "expansion_bits": wide}
    return {"shard": name, "doc_ids": doc_ids} | sizes | {"rules": pack(rules.ravel(), bits), "expansions": pack(lengths, wide), "symbols": pack(symbols, bits)}


def _shards(path: str, shard_tokens: int, min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        base = code.coding.n_vocab
        task, made = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal made, size
            row = shard_row(f"{task:06d}-{made:04d}", list(doc_ids), np.concatenate(held), np.concatenate(lengths), base, min_count)
            made += 1
            doc_ids.clear(), held.clear(), lengths.clear()
            size = 0
            types = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int32()] * 5, *[pa.binary()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

        for batch in batches:
            for part in slices(batch, "text"):
                ids, offsets = encode_bounded(part.column("text").to_pylist(), code)
                doc_ids += part.column("doc_id").to_pylist()
                held.append(ids)
                lengths.append(np.diff(offsets))
                size += len(ids)
                if size >= shard_tokens:
                    yield shard()
        if doc_ids:
            yield shard()

    return run


def repair_shards(docs: DataFrame, path: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, min_count: int = MIN_COUNT) -> DataFrame:
    """One row for each shard: its documents in order, grammar and symbols, packed: pairs and symbols in ``bits`` bits each, expansion lengths in ``expansion_bits``.

    * A null text is stored like an empty one, with no symbols; a null doc_id stays null in ``doc_ids``.
    * Repeated rows are stored each. Other columns are ignored, whatever their names.
    * Any vocabulary is taken: the width of the symbols follows the largest. An empty table gives no shard. A document is never split: a longer one makes a shard of its own size.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.transform(map_batches, _shards(path, shard_tokens, min_count), SHARD)


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            rules, _ = grammar(row)
            ids = expand(unpack(row["symbols"], row["bits"], 0, row["n_symbols"]), rules, row["base"]).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(row["lengths"])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["doc_id", "ids"])


def restore_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document of the shards."""
    return shards.transform(map_batches, _restore, "doc_id long, ids array<int>")


def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_shards(table(spark, sf_dir, "documents"))
