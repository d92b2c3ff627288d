"""Vectorised text kernels shared by the operators of this subpackage.

A *word* is a maximal run of Unicode letters, marks and digits of the lower-cased text; each character of a script
that is written without blanks (Han, kana, Thai, Lao, Khmer, Myanmar) is a word of its own. Everything else, punctuation and
blanks of any width among it, parts words. The kernels work on the UTF-8 buffer of an Arrow string
array, so no Python object is made per word. Slices are bounded in bytes, which
bounds the memory of a worker; the words of a single longer text are hashed piece by piece.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from ..functions.kernels import SLICE_BYTES, U64, buffer, first_of_each, mix, powers, span_hashes, spans
from ..functions.tokens import pieces, slices

__all__ = ["SLICE_BYTES", "U64", "WORDS_SQL", "Words", "buffer", "first_of_each", "minhashes", "mix", "pieces", "powers", "shingles", "slices", "span_hashes", "spans"]

ALONE = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WORD_BYTE = np.zeros(256, np.uint8)
_WORD_BYTE[[*range(48, 58), *range(97, 123)]] = 1
_table: list[np.ndarray] = []


def WORDS_SQL(text: str) -> str:  # noqa: N802 - SQL of the same words
    return rf"regexp_extract_all(regexp_replace(lower({text}), '([{ALONE}])', ' \1 ', 'g'), '[\p{{L}}\p{{M}}\p{{N}}]+')"


def word_classes() -> np.ndarray:
    """Class of every code point: 0 in no word, 1 in a word, 2 a word of its own."""
    if not _table:
        out = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, what in ((1, r"[\p{L}\p{M}\p{N}]+"), (2, rf"[{ALONE}]+")):
            for m in regex.finditer(what, every):
                a, b = (x if x < 0xD800 else x + 0x800 for x in m.span())
                out[a:b] = np.where(out[a:b] > 0, kind, 0) if kind == 2 else kind
        _table.append(out)
    return _table[0]


def word_spans(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of lower-cased texts."""
    kinds = _WORD_BYTE[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead) == 0:
        return spans(kinds > 0, offsets)
    b0 = raw[lead].astype(np.int32)
    wide = np.where(b0 >= 0xF0, 4, np.where(b0 >= 0xE0, 3, 2))
    point = np.where(wide == 4, b0 & 7, np.where(wide == 3, b0 & 15, b0 & 31))
    for k in (1, 2, 3):
        more = wide > k
        point[more] = (point[more] << 6) | (raw[lead[more] + k] & 63)
    kind = word_classes()[np.minimum(point, 0x10FFFF)]
    for k in range(4):
        reach = wide > k
        kinds[lead[reach] + k] = kind[reach]
    alone = lead[kind == 2]
    if len(alone) == 0:
        return spans(kinds > 0, offsets)
    starts, ends = spans(kinds == 1, offsets)
    starts, ends = np.concatenate([starts, alone]), np.concatenate([ends, alone + wide[kind == 2]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


class Words:
    """Words of some texts: their hashes, and the n + 1 word offsets of the texts."""

    def __init__(self, texts: pa.Array):
        raw, offsets = buffer(pc.utf8_lower(pc.fill_null(texts, "")))
        if len(texts) == 1 and len(raw) > 2 * SLICE_BYTES:
            parts = []
            for a, b in pieces(raw):
                starts, ends = word_spans(raw[a:b], np.array([0, b - a]))
                parts.append(span_hashes(raw[a:b], starts, ends))
            self.hashes = np.concatenate(parts)
            self.offsets = np.array([0, len(self.hashes)])
            return
        starts, ends = word_spans(raw, offsets)
        self.hashes = span_hashes(raw, starts, ends)
        self.offsets = np.searchsorted(starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the n + 1 offsets of the texts.

    A text of fewer words, but at least one, has one shingle of all its words; a text
    without a word has none. Repeats are kept.
    """
    n_words = words.counts
    counts = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(offsets[-1], U64)
    keys = [U64(mix(np.array([k + 1], U64))[0] | U64(1)) for k in range(width)]
    long = n_words >= width
    if long.any():
        n = len(words.hashes) - width + 1
        acc = words.hashes[:n] * keys[0]
        for k in range(1, width):
            acc += words.hashes[k : k + n] * keys[k]
        owner = np.repeat(np.arange(len(n_words)), n_words)
        out[np.repeat(long, counts)] = acc[owner[:n] == owner[width - 1 :]]
    for d in np.flatnonzero((n_words > 0) & ~long).tolist():
        h = words.hashes[words.offsets[d] : words.offsets[d + 1]]
        out[offsets[d]] = sum((int(x) * int(k) for x, k in zip(h, keys)), 0) & 0xFFFFFFFFFFFFFFFF
    return mix(out), offsets


def minhashes(hashes: np.ndarray, offsets: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """(k, sets) array of 32-bit minima; every set must hold a member."""
    state = mix(np.arange(1, k + 1, dtype=U64) + U64(seed * 1_000_003))
    xors, factors = (state >> U64(32)).astype(np.uint32), state.astype(np.uint32) | np.uint32(1)
    h = (hashes >> U64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.empty((k, len(offsets) - 1), np.uint32)
    for i in range(k):
        v = (h ^ xors[i]) * factors[i]
        out[i] = np.minimum.reduceat(v ^ (v >> np.uint32(15)), offsets[:-1])
    return out
