"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by their number of shingles (powers of two). For the
partition of sets of at most S shingles, each document is cut into windows of 2S
shingles with stride S, so that any run of S shingles lies whole in one window and a
contained item has a Jaccard similarity to it that MinHash can see, however long the
document is. One equal sample makes a candidate (bands of one row); every candidate
is verified by the exact share of the item's shingles that the whole document holds.

Plan: narrow, one Arrow pass over (doc_id, text); the item index is broadcast in
parts of a checked size. A benchmark of more than PART_SHINGLES shingles takes one pass for each part; the driver holds one part at
a time, and what a pass finds is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keys_side, map_batches, table
from .kernels import WORDS_SQL, Words, minhashes, shingles, slices

WIDTH, SAMPLES, THRESHOLD = 5, 64, 0.5
#: Shingles of one broadcast part of the item index (8 bytes each and as much for samples).
PART_SHINGLES = 4_000_000
RESULT = "doc_id long, item_id long, matched long, item_shingles long, containment double"


def _hash_items(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                counts, ids = words.counts, part.column("item_id").to_pylist()
                for w in sorted({min(width, int(n)) for n in counts if n}):
                    hashes, offsets = shingles(words, w)
                    for d in np.flatnonzero(np.minimum(counts, width) == w).tolist():
                        own = np.unique(hashes[offsets[d] : offsets[d + 1]])
                        yield pa.RecordBatch.from_pydict({"item_id": pa.array([ids[d]], pa.int64()), "width": pa.array([w], pa.int32()), "hashes": pa.array([own.tobytes()], pa.binary())})

    return run


def index_parts(items: DataFrame, width: int = WIDTH, samples: int = SAMPLES, part_shingles: int = PART_SHINGLES) -> Iterator[dict]:
    """Search indexes over the items, each of at most ``part_shingles`` shingles or of one item."""
    hashed = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).transform(map_batches, _hash_items(width), "item_id long, width int, hashes binary")
    group, held = [], 0
    for row in hashed.toLocalIterator():
        n = len(row.hashes) // 8
        if group and held + n > part_shingles:
            yield _index(group, samples)
            group, held = [], 0
        group.append((row.item_id, row.width, np.frombuffer(row.hashes, np.uint64)))
        held += n
    if group:
        yield _index(group, samples)


def _index(group: list[tuple[int, int, np.ndarray]], samples: int) -> dict:
    """{(width, S): item ids, shingle sets, sorted samples with their items, and 16-bit filters}."""
    classes: dict = {}
    for item, width, own in group:
        classes.setdefault((width, max(8, 1 << (len(own) - 1).bit_length())), []).append((item, own))
    index = {}
    for key, members in classes.items():
        offsets = np.concatenate([[0], np.cumsum([len(own) for _, own in members])])
        low = minhashes(np.concatenate([own for _, own in members]), offsets, samples)
        order = np.argsort(low, axis=1, kind="stable")
        filters = np.zeros((samples, 1 << 16), bool)
        for i in range(samples):
            filters[i, low[i] >> 16] = True
        index[key] = {"ids": [item for item, _ in members], "sets": [own for _, own in members], "low": np.take_along_axis(low, order, 1), "order": order, "filters": filters}
    return index


def _windows(offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block starts, owner of each block, and whether the next block has the same owner."""
    blocks = -(-np.diff(offsets) // size)
    owner = np.repeat(np.arange(len(blocks)), blocks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return offsets[:-1][owner] + nth * size, owner, np.append(owner[1:] == owner[:-1], False)


def _searcher(shared, samples: int, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                found: list[tuple] = []
                ids = part.column("doc_id").to_pylist()
                for width in sorted({w for w, _ in index}):
                    hashes, offsets = shingles(words, width)
                    if len(hashes) == 0:
                        continue
                    candidates = set()
                    for (w, size), own in index.items():
                        if w == width:
                            candidates |= _candidates(hashes, offsets, size, own, samples, (w, size))
                    by_doc: dict = {}
                    for d, key, m in candidates:
                        by_doc.setdefault(d, []).append((key, m))
                    for d, wanted in by_doc.items():
                        have = np.sort(hashes[offsets[d] : offsets[d + 1]])
                        for key, m in wanted:
                            item = index[key]["sets"][m]
                            at = np.minimum(np.searchsorted(have, item), len(have) - 1)
                            matched = int((have[at] == item).sum())
                            if matched >= threshold * len(item):
                                found.append((ids[d], index[key]["ids"][m], matched, len(item), matched / len(item)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found)], names=["doc_id", "item_id", "matched", "item_shingles", "containment"])

    return search


def _candidates(hashes: np.ndarray, offsets: np.ndarray, size: int, own: dict, samples: int, key: tuple) -> set:
    starts, owner, joined = _windows(offsets, size)
    # minima of blocks, by sample; a window is a block and the next one of the same text
    low = minhashes(hashes, np.append(starts, len(hashes)), samples)
    low[:, :-1] = np.where(joined[:-1], np.minimum(low[:, :-1], low[:, 1:]), low[:, :-1])
    out = set()
    for i in range(samples):
        hits = np.flatnonzero(own["filters"][i][low[i] >> 16])
        if len(hits) == 0:
            continue
        values = low[i][hits]
        left, right = np.searchsorted(own["low"][i], values, "left"), np.searchsorted(own["low"][i], values, "right")
        for h, a, b in zip(hits[right > left].tolist(), left[right > left].tolist(), right[right > left].tolist()):
            out.update((int(owner[h]), key, int(m)) for m in own["order"][i][a:b])
    return out


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, samples: int = SAMPLES, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(doc_id, item_id, matched, item_shingles, containment) of each item found in a document.

    containment is the share of the item's distinct shingles of ``width`` words that the
    document holds; an item of fewer words is one shingle of all its words.

    * Null ids or texts, and texts without a word, are in no result row.
    * Repeated rows give one result row; if rows of one id (of a document or an item) differ in text, each is searched by itself and
      the highest containment counts. Very long texts are searched whole.
    * An empty benchmark or an empty document table gives an empty result.
    * Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found: list[DataFrame] = []
    waiting = None  # the last part's pass stays in the plan of the result; those before it are done one by one
    for index in index_parts(items, width, samples, part_shingles):
        if waiting is not None:
            shared, rows = waiting
            found.append(cut(rows))
            shared.unpersist()
        shared = spark.sparkContext.broadcast(index)
        waiting = shared, texts.transform(map_batches, _searcher(shared, samples, threshold), RESULT)
    if waiting is None:
        return spark.createDataFrame([], RESULT)
    passes = [*found, waiting[1]]
    best = F.max(F.struct("containment", "matched", "item_shingles")).alias("best")
    return reduce(DataFrame.unionByName, passes).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.matched", "best.item_shingles", F.round("best.containment", 6).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows whose text holds a test item.

    * Verdicts go by text, so rows without an id are searched too, and a clean row stays though another of its id goes.
    * Null and empty texts stay. Repeated rows share their verdict. All columns stay, whatever their names; an empty table stays empty.
    """
    rows = docs.select(F.struct("*").alias("row"))  # one column, so that no name clashes with the key's
    text = F.col("row.text").cast("string")
    key = F.xxhash64(text)
    named = rows.filter(text.isNotNull()).select(key.alias("doc_id"), text.alias("text"))
    hit = keys_side(contamination(named, items, **settings).select(F.col("doc_id").alias("key")).distinct())
    return rows.join(hit, key == F.col("key"), "left_anti").select("row.*")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = f"""
WITH items AS (SELECT row_number() OVER () AS i, item_id, {WORDS_SQL('text')} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL)),
item_shingles AS (
  SELECT DISTINCT i, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS s
  FROM (SELECT i, w, least({WIDTH}, len(w)) AS width FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS d, doc_id, {WORDS_SQL('text')} AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE doc_id IS NOT NULL)),
doc_shingles AS (
  SELECT DISTINCT d, width, unnest(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k + width - 1], ' '))) AS s
  FROM docs, (SELECT DISTINCT width FROM item_shingles) WHERE len(w) >= width),
sizes AS (SELECT i, count(*) AS item_shingles FROM item_shingles GROUP BY i),
found AS (
  SELECT d, i, count(*) AS matched, any_value(item_shingles) AS item_shingles
  FROM item_shingles JOIN doc_shingles USING (s, width) JOIN sizes USING (i) GROUP BY d, i HAVING count(*) >= {THRESHOLD} * any_value(item_shingles))
SELECT doc_id, item_id, matched, item_shingles, round(matched / item_shingles, 6) AS containment FROM found JOIN docs USING (d) JOIN items USING (i)
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched / item_shingles DESC, matched DESC, item_shingles DESC) = 1
"""
