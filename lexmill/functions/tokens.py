"""The tokeniser over whole Arrow batches: what ``text.search_tokens`` and ``text.index_tokens`` give, at the speed of array operations.

Long texts are cut at bytes that are in no token, so that arrays stay small whatever the length of a text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .kernels import SLICE_BYTES, U64, buffer, first_of_each, gather, give_back, mix, span_hashes, spans, strings
from .stopwords import STOP_WORDS
from .text import _RANGES

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), 95, *range(97, 123)]] = True
_CJK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _RANGES) + "]+")
_ASCII_WORD = re.compile("[A-Za-z0-9_]{2,}")
_STOPS = frozenset(STOP_WORDS)


def _stop_hashes() -> np.ndarray:
    words = [w for w in STOP_WORDS if w.isascii()]
    raw, offsets = buffer(pa.array(words))
    return np.sort(span_hashes(raw, offsets[:-1], offsets[1:]))


_STOP_HASHES = _stop_hashes()


def run_tokens(run: str) -> list[str]:
    """Tokens of one CJK run: itself if it has 2 to 6 characters, then its 2-, 3- and 4-grams, each once."""
    if len(run) == 1:
        return [run]
    grams = [run] if len(run) <= 6 else []
    grams += [run[i : i + k] for k in (2, 3, 4) for i in range(len(run) - k + 1)]
    return list(dict.fromkeys(grams))


def cjk_tokens(text: str) -> list[str]:
    return [t for run in _CJK.findall(text) for t in run_tokens(run) if t not in _STOPS]


def frequent(text: str, least: int, longest: int) -> list[str]:
    """ASCII words and CJK substrings of 2 to ``longest`` characters that occur ``least`` times or more: most frequent first, then longer, then by code points."""
    if len(text) <= SLICE_BYTES:
        count = Counter(map(str.lower, _ASCII_WORD.findall(text)))
    else:  # the words of a long text are not held all at once
        count = Counter(m[0].lower() for m in _ASCII_WORD.finditer(text))
    for run in () if text.isascii() else _CJK.finditer(text):
        for k in range(2, longest + 1):
            count.update(run[0][i : i + k] for i in range(len(run[0]) - k + 1))
    return sorted((w for w, n in count.items() if n >= least and w not in _STOPS), key=lambda w: (-count[w], -len(w), w))


def _kept(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the ASCII words of two or more characters that are no stop words, in lower-case bytes."""
    starts, ends = spans(_WORD[raw], offsets)
    long = ends - starts >= 2
    starts, ends = starts[long], ends[long]
    h = span_hashes(raw, starts, ends)
    near = np.minimum(np.searchsorted(_STOP_HASHES, h), len(_STOP_HASHES) - 1)
    go_on = _STOP_HASHES[near] != h
    return starts[go_on], ends[go_on]


def _parts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the kept words, split at underscores."""
    starts, ends = _kept(raw, offsets)
    if not (raw == 95).any():
        return starts, ends
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    return spans((np.cumsum(inside[:-1]) > 0) & (raw != 95), offsets)


def pieces(raw: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive (start, stop) of a text, cut behind ASCII bytes that are in no word."""
    at, n = 0, len(raw)
    while n - at > limit:
        window = raw[at : at + limit]
        free = np.flatnonzero((window < 128) & ~_WORD[_LOWER[window]])
        stop = at + int(free[-1]) + 1 if len(free) else None
        while stop is None:
            more = raw[at + limit : at + 2 * limit]
            free = np.flatnonzero((more < 128) & ~_WORD[_LOWER[more]])
            if len(free):
                stop = at + limit + int(free[0]) + 1
            else:
                limit, stop = limit + len(more), None if len(more) else n
        yield at, stop
        at = stop
    if n > at:
        yield at, n


def _count(raw: np.ndarray, offsets: np.ndarray, n_docs: int) -> tuple:
    """Counts over texts that are the titles of ``n_docs`` documents, then their bodies:
    (document, bytes of the tokens, offsets of the tokens, tf_title, tf_body)."""
    low = _LOWER[raw]
    starts, ends = _parts(low, offsets)
    owner = np.searchsorted(offsets, starts, side="right") - 1
    doc, body = owner % max(1, n_docs), owner >= n_docs
    first, number = first_of_each(mix(span_hashes(low, starts, ends) + mix(doc.astype(U64))))
    body_count = np.bincount(number, body, len(first)).astype(np.int64)
    data, at = gather(low, starts[first], ends[first])
    return doc[first], data, at, np.bincount(number, minlength=len(first)) - body_count, body_count


def _long(title: str, text: pa.Scalar) -> tuple:
    """The same for one long text, piece by piece; the title goes with the first piece."""
    total: dict[bytes, list[int]] = {}
    raw, _ = buffer(pa.array([text.as_py()], pa.large_string()))
    head = np.frombuffer(title.encode(), np.uint8)
    for i, (a, b) in enumerate(pieces(raw)):
        lead = head if i == 0 else head[:0]
        _, data, at, t, x = _count(np.concatenate([lead, raw[a:b]]), np.array([0, len(lead), len(lead) + b - a]), 1)
        words = data.tobytes()
        for k, (c, d) in enumerate(zip(t.tolist(), x.tolist())):
            have = total.setdefault(words[at[k] : at[k + 1]], [0, 0])
            have[0] += c
            have[1] += d
    data = np.frombuffer(b"".join(total), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(k) for k in total])]).astype(np.int64)
    counts = np.array(list(total.values()), np.int64).reshape(-1, 2)
    return np.zeros(len(total), np.int64), data, at, counts[:, 0], counts[:, 1]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch whose texts hold at most ``limit`` bytes, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def counted(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(document, token, tf_title, tf_body) of a slice of (title, text), and the number of tokens of each document."""
    titles, texts = part.column("title"), part.column("text")
    n = part.num_rows
    if n == 1 and texts[0].is_valid and texts[0].as_buffer().size > SLICE_BYTES:
        doc, data, at, t, b = _long(titles[0].as_py() or "", texts[0])
    else:
        joined = pa.chunked_array([titles.cast(pa.large_string()), texts.cast(pa.large_string())]).combine_chunks()
        doc, data, at, t, b = _count(*buffer(joined), n)
    tokens = strings(data, at)
    wide = np.flatnonzero(pc.or_(*(pc.fill_null(pc.match_substring_regex(c, _CJK_RE2), False) for c in (titles, texts))).to_numpy(zero_copy_only=False))
    if len(wide):
        more: list[tuple[int, str, int, int]] = []
        for d in wide.tolist():
            ahead, behind = Counter(cjk_tokens(titles[d].as_py() or "")), Counter(cjk_tokens(texts[d].as_py() or ""))
            more += [(d, w, ahead[w], behind[w]) for w in dict.fromkeys([*ahead, *behind])]
        d, w, x, y = zip(*more) if more else ((), (), (), ())
        doc, tokens = np.concatenate([doc, np.array(d, np.int64)]), pa.concat_arrays([tokens, pa.array(w, pa.string())])
        t, b = np.concatenate([t, np.array(x, np.int64)]), np.concatenate([b, np.array(y, np.int64)])
    return doc, tokens, t, b, np.bincount(doc, t + b, n).astype(np.int64)


_CJK_RE2 = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in _RANGES) + "]"


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_key, is_active, title, text) to (doc_key, is_active, dl, token, tf_title, tf_body)."""
    for batch in batches:
        for part in slices(batch, "text"):
            doc, tokens, t, b, dl = counted(part)
            if len(doc):
                yield pa.RecordBatch.from_arrays([part.column("doc_key").take(pa.array(doc)), part.column("is_active").take(pa.array(doc)), pa.array(dl[doc]), tokens, pa.array(t), pa.array(b)], names=["doc_key", "is_active", "dl", "token", "tf_title", "tf_body"])
    give_back()


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_key, is_active, title, text) to (doc_key, is_active, dl)."""
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column("doc_key"), part.column("is_active"), pa.array(counted(part)[4])], names=["doc_key", "is_active", "dl"])
    give_back()


def _joined(texts: pa.Array) -> pa.Array:
    """The kept words of each text, joined by blanks."""
    out = []
    for text in _grouped(texts):
        raw, offsets = buffer(text)
        low = _LOWER[raw]
        starts, ends = _kept(low, offsets)
        owner = np.searchsorted(offsets, starts, side="right") - 1
        lead = np.append(False, owner[1:] == owner[:-1])[: len(owner)]  # a blank before each but the first of its text
        sizes = ends - starts + lead
        at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = np.full(at[-1], 32, np.uint8)
        words, inner = gather(low, starts, ends)
        data[np.repeat(at[:-1] + lead - inner[:-1], ends - starts) + np.arange(inner[-1])] = words
        bounds = np.concatenate([[0], np.cumsum(np.bincount(owner, sizes, len(text)))]).astype(np.int64)
        out.append(strings(data, bounds))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _grouped(texts: pa.Array) -> Iterator[pa.Array]:
    one = pa.RecordBatch.from_arrays([texts], names=["text"])
    for part in slices(one, "text"):
        yield part.column("text")


def joined_tokens(texts: pa.Array) -> pa.Array:
    """The searchable form of each text: its CJK tokens, then its words, joined by blanks; null stays null."""
    out = []
    for text in _grouped(texts):
        if len(text) == 1 and text[0].is_valid and text[0].as_buffer().size > SLICE_BYTES:
            raw, _ = buffer(text)
            cut = pa.array([raw[a:b].tobytes().decode() for a, b in pieces(raw)], pa.string())
            plain = pa.array([" ".join(w for w in _joined(cut).to_pylist() if w)], pa.string())
        else:
            plain = _joined(text)
        wide = pc.fill_null(pc.match_substring_regex(text, _CJK_RE2), False)
        if pc.any(wide).as_py():
            plain = pa.array([w if not x else " ".join([*cjk_tokens(t), *([w] if w else [])]) for w, x, t in zip(plain.to_pylist(), wide.to_pylist(), text.to_pylist())], pa.string())
        out.append(pc.if_else(pc.is_valid(text), plain, pa.scalar(None, pa.string())))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def index_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_key, text) to (doc_key, tokens)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_key"), joined_tokens(batch.column("text"))], names=["doc_key", "tokens"])
    give_back()


def search_tokens(text: str | None) -> list[str]:
    """Tokens of one text, for queries on the driver."""
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9_]{2,}", text or "")]
    return [*cjk_tokens(text or ""), *(w for w in words if w not in _STOPS)]
