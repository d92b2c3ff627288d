"""Near-duplicate groups: banded MinHash candidates, verified by odd sketches.

An odd sketch folds the k MinHash samples of a text into a bitmap of n bits by
flipping one bit for each (sample number, sample) pair. The XOR of two sketches is
the sketch of the symmetric difference, so its population count p gives
|difference| = -n/2 * ln(1 - 2p/n) and similarity = 1 - |difference| / 2k.

Plan: one narrow Arrow pass makes signatures (the texts go no further), equal
signatures fold into one node with map-side combining, and one shuffle of
(band key, node) finds the buckets of two or more. Close copies share most of their
bands, so equal buckets fold into one before any sketch moves; then the sketches join
the members, and the links that pass go through large-star / small-star rounds to
connected components. A bucket of more than HOT members is never one task: its members are written in pieces, each is held
against the bucket's first member, and those that do not resemble it meet all members in blocks of HOT by HOT, spread over
the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, keys_side, map_batches, table
from .kernels import U64, Words, minhashes, mix, shingles, slices

SHINGLE, SAMPLES, BANDS, ROWS, BITS, THRESHOLD = 3, 256, 24, 4, 1024, 0.55
#: Members of a bucket that one task compares.
HOT = 8_192


def odd_sketches(samples: np.ndarray, bits: int) -> np.ndarray:
    """(sets, bits / 8) bytes from the (k, sets) samples."""
    k, n = samples.shape
    number = mix(np.arange(k, dtype=U64) + U64(77))[:, None]
    bit = (mix(samples.astype(U64) ^ number) % U64(bits)).astype(np.int64)
    flips = np.bincount((bit + np.arange(n) * bits).ravel(), minlength=n * bits)
    return np.packbits((flips & 1).astype(bool).reshape(n, bits), axis=1)


def sketch_similarity(differing: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Similarity estimate from XOR population counts; a saturated sketch gives 0."""
    room = np.maximum(1 - 2 * np.asarray(differing, float) / bits, 1e-12)
    return np.clip(1 + bits / (4 * samples) * np.log(room), 0, 1)


def most_differing(samples: int, bits: int, threshold: float) -> int:
    """Largest XOR population count whose estimate reaches the threshold."""
    counts = np.arange(bits // 2)
    return int(counts[sketch_similarity(counts, samples, bits) >= threshold].max())


def _signer(bands: int, rows: int, samples: int, bits: int, width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(bands, dtype=U64) + U64(5))[:, None]
        weights = mix(np.arange(rows, dtype=U64) + U64(900)) | U64(1)
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, offsets = shingles(Words(part.column("text")), width)
                there = np.diff(offsets) > 0
                if not there.any():
                    continue
                low = minhashes(hashes, offsets[np.append(there, True)], samples)
                n = low.shape[1]
                wide = low.astype(U64)
                banded = wide[: bands * rows].reshape(bands, rows, n)
                keys = mix((banded * weights[None, :, None]).sum(1) ^ salts)
                digest = [mix((wide * (mix(np.arange(samples, dtype=U64) + U64(s)) | U64(1))[:, None]).sum(0)) for s in (11, 13)]
                ids = part.column("doc_id").filter(pa.array(there))
                flat = pa.array(np.ascontiguousarray(keys.T).view(np.int64).ravel())
                sketches = odd_sketches(low, bits)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids,
                        pa.array(digest[0].view(np.int64)),
                        pa.array(digest[1].view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), flat),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * (bits // 8)).astype(np.int32)), pa.py_buffer(sketches)]),
                    ],
                    names=["doc_id", "d1", "d2", "bands", "sketch"],
                )

    return sign


def linked(sketches: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (smallest id of the component, other id) of one bucket.

    Breadth first: each member is held against all that are not reached yet, so the
    components are those of all pairs, though a tight bucket takes about one pass.
    """
    order = np.argsort(ids, kind="stable")
    sketches, ids = sketches[order], ids[order]
    rest, left, right = np.arange(len(ids)), [], []
    while len(rest) > 1:
        root, queue, rest = rest[0], [rest[0]], rest[1:]
        while queue and len(rest):
            near = np.bitwise_count(sketches[rest] ^ sketches[queue.pop()]).sum(1) <= most
            if near.any():
                found, rest = rest[near], rest[~near]
                left.append(np.full(len(found), ids[root]))
                right.append(ids[found])
                queue.extend(found.tolist())
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _bucketer(hot: int):
    """Sorted (key, rep) rows to one row for each key of two or more: hash of the members, and the members.

    A key of more than ``hot`` members gives a row for each ``hot`` of them, under the key itself, with its first member as hub.
    """

    def rows(bucket: np.ndarray, hub: np.ndarray | None, offsets: np.ndarray, rep: np.ndarray) -> pa.RecordBatch:
        hubs = pa.nulls(len(bucket), pa.int64()) if hub is None else pa.array(hub)
        return pa.RecordBatch.from_arrays([pa.array(bucket), hubs, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(rep))], names=["bucket", "hub", "reps"])

    def piece(key: int, hub: int, rep: np.ndarray) -> pa.RecordBatch:
        return rows(np.array([key]), np.array([hub]), np.array([0, len(rep)]), rep)

    def whole(key: np.ndarray, rep: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((rep, key))
        key, rep = key[order], rep[order]
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        for s, n in zip(starts[sizes > hot].tolist(), sizes[sizes > hot].tolist()):
            for at in range(s, s + n, hot):
                yield piece(int(key[s]), int(rep[s]), rep[at : min(at + hot, s + n)])
        usual = (sizes > 1) & (sizes <= hot)
        rep, sizes = rep[np.repeat(usual, np.diff(np.append(starts, len(key))))], sizes[usual]
        if len(sizes):
            offsets = np.append(0, np.cumsum(sizes))
            digest = np.add.reduceat(mix(rep.view(U64) ^ mix(np.arange(len(rep), dtype=U64) - np.repeat(offsets[:-1], sizes).astype(U64))), offsets[:-1])
            yield rows(mix(digest).view(np.int64), None, offsets, rep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key: int | None = None  # the last, perhaps unfinished key, and its members
        held: list[np.ndarray] = []
        hub = None  # set while pieces of the held key are written

        def finish() -> Iterator[pa.RecordBatch]:
            if held_key is not None:
                rep = np.concatenate(held)
                if hub is not None:
                    if len(rep):
                        yield piece(held_key, hub, rep)
                else:
                    yield from whole(np.full(len(rep), held_key), rep)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, rep = batch.column("key").to_numpy(), batch.column("rep").to_numpy()
            same = int(np.searchsorted(key, held_key, side="right")) if held_key is not None and key[0] == held_key else 0
            if same:
                held.append(rep[:same])
            if same < len(key):
                yield from finish()
                last = int(np.searchsorted(key, key[-1], side="left"))
                yield from whole(key[same:last], rep[same:last]) if last > same else ()
                held_key, held, hub = int(key[-1]), [rep[last:]], None
            if sum(map(len, held)) > hot:
                rep = np.concatenate(held)
                hub = int(rep[0]) if hub is None else hub
                full = len(rep) // hot * hot
                for at in range(0, full, hot):
                    yield piece(held_key, hub, rep[at : at + hot])
                held = [rep[full:]]
        yield from finish()

    return run


def _words(sketch: pa.Array, bits: int) -> np.ndarray:
    """Sketches as rows of 64-bit words."""
    _, offsets, data = sketch.buffers()
    first = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(sketch.type) else np.int32)[sketch.offset]
    raw = np.frombuffer(data, np.uint8)[first : first + len(sketch) * bits // 8].reshape(len(sketch), bits // 8)
    return np.ascontiguousarray(raw).view(np.uint64)


def _to_hub(bits: int, most: int):
    """Whether each member of a large bucket resembles its hub."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                differ = np.bitwise_count(_words(batch.column("sketch"), bits) ^ _words(batch.column("hub_sketch"), bits)).sum(1)
                kept = ["bucket", "hub", "rep", "sketch"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(differ <= most)], names=[*kept, "near"])

    return run


def _large_edges(pieces: DataFrame, nodes: DataFrame, bits: int, most: int, hot: int) -> DataFrame:
    """Links within the buckets that came in pieces; the components are those of all their pairs."""
    hubs = nodes.select(F.col("rep").alias("hub"), F.col("sketch").alias("hub_sketch"))
    members = pieces.join(hubs, "hub").select("bucket", "hub", "hub_sketch", F.explode("reps").alias("rep")).join(nodes.select("rep", "sketch"), "rep")
    judged = cut(members.select("bucket", "hub", "rep", "sketch", "hub_sketch").transform(map_batches, _to_hub(bits, most), "bucket long, hub long, rep long, sketch binary, near boolean"))
    edges = judged.filter("near and rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    parts = lambda n: F.ceil(n / F.lit(hot)).cast("int")
    sizes = judged.groupBy("bucket").agg(parts(F.sum(F.when(F.col("near"), 0).otherwise(1))).alias("rest"), parts(F.count("*")).alias("all")).filter("rest > 0")
    placed = judged.join(sizes, "bucket")
    # a member that resembles the hub is in the component already: only the others look for links, among all
    side = lambda rows, own, other: rows.select("bucket", "rep", "sketch", F.pmod(F.xxhash64("rep"), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other)).select(F.xxhash64("bucket", "rest", "all").alias("bucket"), "rep", "sketch")
    blocks = side(placed.filter("not near"), "rest", "all").unionByName(side(placed, "all", "rest"))
    linked_blocks = blocks.repartition("bucket").sortWithinPartitions("bucket").transform(map_batches, _linker(bits, most), "a long, b long")
    return edges.unionByName(linked_blocks.filter("a <> b"))


def _linker(bits: int, most: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch):
            return batch.column("bucket").to_numpy(), batch.column("rep").to_numpy(), _words(batch.column("sketch"), bits)

        def links(key, rep, words) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            sizes = np.diff(np.append(starts, len(key)))
            two = starts[sizes == 2]
            near = two[np.bitwise_count(words[two] ^ words[two + 1]).sum(1) <= most]
            left = [np.minimum(rep[near], rep[near + 1])]
            right = [np.maximum(rep[near], rep[near + 1])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                a, b = linked(words[s : s + n], rep[s : s + n], most)
                left.append(a)
                right.append(b)
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        held: list[tuple] = []  # rows of the last, perhaps unfinished bucket
        for batch in batches:
            if batch.num_rows == 0:
                continue
            key, rep, words = rows(batch)
            if held and held[0][0][0] == key[-1]:
                held.append((key, rep, words))
                continue
            last = int(np.searchsorted(key, key[-1], side="left"))
            head = [*held, (key[:last], rep[:last], words[:last])]
            key_, rep_, words_ = (np.concatenate(x) for x in zip(*head))
            if len(key_):
                yield from links(key_, rep_, words_)
            held = [(key[last:], rep[last:], words[last:])]
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held)))

    return link


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest id of its component.

    Alternates large-star and small-star rounds until the links are stars. Each round
    is written to the shared folder, so neither lineage nor a lost executor repeats rounds.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def large_star(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        far = both.filter("b > a").join(low, "a")
        return far.select(F.col("m").alias("a"), "b").filter("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        kept = e.join(low, "b")
        return kept.select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b")).filter("a <> b").distinct()

    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = state(edges)
    while before[0]:
        edges = cut(small_star(large_star(edges)))
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def signatures(docs: DataFrame, width: int = SHINGLE, samples: int = SAMPLES, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """(doc_id, d1, d2, bands, sketch) of every document with an id and at least one word."""
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(map_batches, _signer(bands, rows, samples, bits, width), "doc_id long, d1 long, d2 long, bands array<long>, sketch binary")


def near_groups(docs: DataFrame, threshold: float = THRESHOLD, samples: int = SAMPLES, bits: int = BITS, hot: int = HOT, **more: int) -> DataFrame:
    """One row for each document that has a near duplicate: doc_id, group_id, group_size, keep.

    Two texts are linked when their odd sketches put the Jaccard similarity of their
    word shingles at ``threshold`` or more; groups are the connected components,
    group_id is the smallest doc_id, and that document alone has keep = true.

    * Null ids or texts, and texts without a word, are never in a group.
    * A doc_id that occurs in several rows is one document; if the rows' texts differ, each
      text takes part, and the id takes the smallest group found for it.
    * An id whose rows are all of one text, and that resembles no other, makes no group.
    * Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    signed = cut(signatures(docs, samples=samples, bits=bits, **more))
    nodes = signed.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    banded = nodes.select(F.explode("bands").alias("key"), "rep").repartition("key").sortWithinPartitions("key", "rep")
    found = cut(banded.transform(map_batches, _bucketer(hot), "bucket long, hub long, reps array<long>"))
    buckets = found.filter("hub is null").groupBy("bucket").agg(F.first("reps").alias("reps"))
    members = buckets.select("bucket", F.explode("reps").alias("rep")).join(nodes.select("rep", "sketch"), "rep")
    candidates = members.repartition("bucket").sortWithinPartitions("bucket")
    most = most_differing(samples, bits, threshold)
    edges = candidates.transform(map_batches, _linker(bits, most), "a long, b long")
    pieces = found.filter("hub is not null").select("bucket", "hub", "reps")
    if not pieces.isEmpty():
        edges = edges.unionByName(_large_edges(pieces, nodes, bits, most, hot))
    roots = components(edges)
    folded = signed.groupBy("d1", "d2", "doc_id").agg(F.lit(1).alias("one"))
    reps = folded.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    ids = folded.join(reps, ["d1", "d2"]).join(roots, F.col("rep") == F.col("node"), "left")
    group = ids.groupBy("doc_id").agg(F.min(F.coalesce("root", "rep")).alias("group_id"))
    sizes = group.groupBy("group_id").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    return group.join(sizes, "group_id").select("doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each near-duplicate group.

    * All columns stay, whatever their names. Of rows that repeat one doc_id and text, one stays. Rows of one id with different texts
      are documents of their own. Those, and rows without an id, go by a digest of their text, above 2**62 so that rows
      with an id of their own are kept first.
    * Null texts and texts without a word stay, each row of them if it has no id. An empty table stays empty.

    The texts are not shuffled as long as the keys to drop are few enough to be broadcast.
    """
    rows = docs.select(F.struct("*").alias("row"))  # one column, so that no name clashes with a key's
    text, own_id = F.col("row.text").cast("string"), F.col("row.doc_id").cast("long")
    digest = F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    key = F.xxhash64("row.text")
    seen = cut(rows.filter(own_id.isNotNull()).groupBy(own_id.alias("id")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).filter("n > 1"))
    several = seen.filter("low <> high").select(F.col("id").alias("several"))
    if not several.isEmpty():
        rows = rows.join(keys_side(several), own_id == F.col("several"), "left")
        own_id = F.when(F.col("several").isNull(), own_id)
    own = F.coalesce(own_id, F.when(text.rlike(r"[\p{L}\p{M}\p{N}]") | F.col("row.doc_id").isNotNull(), digest))
    rows = rows.select("row", own.alias("own"))
    named = rows.select(F.col("own").alias("doc_id"), text.alias("text"))
    dropped = keys_side(near_groups(named, **settings).filter("not keep").select(F.col("doc_id").alias("id")))
    left = rows.join(dropped, F.col("own") == F.col("id"), "left_anti")
    again = rows.filter("own is not null").groupBy(F.col("own").alias("id"), key.alias("key")).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    repeated = keys_side(again)
    if not repeated.isEmpty():
        same = (F.col("own") == F.col("id")) & (key == F.col("key"))
        one = left.join(repeated, same, "left_semi").select("row", F.col("own").alias("id"), F.col("row.text").alias("text")).dropDuplicates(["id", "text"]).select("row")
        left = left.join(repeated, same, "left_anti").select("row").unionByName(one)
    return left.select("row.*")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
