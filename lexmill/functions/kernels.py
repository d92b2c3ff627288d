"""Vectorised spans over the UTF-8 buffer of an Arrow string array; no Python object is made per word."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept per worker up to a few slices, made anew for more."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES * 2), base, U64)
        steps[0] = 1
        have = np.cumprod(steps)
        if n <= SLICE_BYTES * 4:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts; a null is empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that stay inside one text."""
    if len(flags) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    filled = offsets[:-1][offsets[1:] > offsets[:-1]]
    before = np.empty(len(flags), bool)
    before[0] = False
    before[1:] = flags[:-1]
    before[filled] = False
    starts = np.flatnonzero(flags & ~before)
    after = np.empty(len(flags), bool)
    after[-1] = False
    after[:-1] = flags[1:]
    after[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = False
    return starts, np.flatnonzero(flags & ~after) + 1


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, by differences of one prefix sum."""
    if len(starts) == 0:
        return np.zeros(0, U64)
    prefix = np.zeros(len(raw) + 1, U64)
    np.cumsum((raw.astype(U64) + U64(1)) * powers(BASE, len(raw)), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * powers(_INVERSE, len(raw))[starts]
    return mix(h ^ ((ends - starts).astype(U64) << U64(56)))


def gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the spans end to end, and their n + 1 offsets."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return raw[np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])], offsets


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.string())


def first_of_each(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one occurrence of each key, and for each entry the number of its key."""
    if len(keys) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(keys)
    new = np.append(True, keys[order][1:] != keys[order][:-1])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
