"""Which of some items stand in each text, as bytes, in one pass over the texts for all items."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from .kernels import U64, buffer, give_back
from .tokens import slices

#: An item is first sought by so many of its bytes; shorter ones are sought as they are.
ANCHOR = 8
_FACTOR, _BITS = U64(0x9E3779B97F4A7C15), U64(48)


def finder(items: list[str]) -> Callable[[pa.Array], set[tuple[int, int]]]:
    """A function from texts to the (text, item) pairs, by place, of which the text holds the item; a null holds none."""
    whole = [i.encode() for i in items]
    short = [n for n, i in enumerate(whole) if len(i) < ANCHOR]
    anchored: dict[int, list[int]] = defaultdict(list)
    for n, i in enumerate(whole):
        if len(i) >= ANCHOR:
            anchored[int(np.frombuffer(i, U64, 1)[0])].append(n)
    near = np.zeros(1 << 16, bool)
    near[((np.array(list(anchored), U64) * _FACTOR) >> _BITS).astype(np.int64)] = True

    def run(texts: pa.Array) -> set[tuple[int, int]]:
        raw, offsets = buffer(texts)
        data, found = raw.tobytes(), set()
        for at in range(min(ANCHOR, len(raw)) if anchored else 0):
            words = raw[at : at + (len(raw) - at) // ANCHOR * ANCHOR].view(U64)
            for k in np.flatnonzero(near[((words * _FACTOR) >> _BITS).astype(np.int64)]).tolist():
                if same := anchored.get(int(words[k])):
                    place = at + k * ANCHOR
                    text = int(np.searchsorted(offsets, place, side="right")) - 1
                    found.update((text, n) for n in same if place + len(whole[n]) <= offsets[text + 1] and data.startswith(whole[n], place))
        for n in short:
            found.update((t, n) for t in range(len(texts)) if texts[t].is_valid and data.find(whole[n], int(offsets[t]), int(offsets[t + 1])) >= 0)
        return found

    return run


def pairs(key: str, items: list[str], ids: pa.Array) -> Callable:
    """(key, text) to (key, query_id) of each text and item that it holds."""
    find = finder(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = sorted(find(part.column("text")))
                if found:
                    text, item = (pa.array(c, pa.int64()) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([part.column(key).take(text), ids.take(item)], names=[key, "query_id"])
        give_back()

    return run
