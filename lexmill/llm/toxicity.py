"""Toxic documents by two class-conditional Kneser-Ney models of letters in words.

Both models predict each symbol of a word from the ORDER - 1 symbols before it (the
word's start is padded). Their discounted mass backs off to one shared distribution:
the counts of both classes together, which back off to Kneser-Ney continuation counts
of both. The discounts are those of modified Kneser-Ney, estimated from the counts of counts of each class and half;
the shared distribution weighs as much as STRENGTH counts besides. A symbol that only the larger class shows thus says little against the other.
Counts are kept by language; a context that the text's language never showed is judged
by the counts of all languages, and so is all of a text without a labelled language.
Each distinct word of a document counts once, in training and in scoring, so repeated
lines weigh no more than others. The score of a document is the difference of the two
log-likelihoods of its distinct words, divided by their number plus PRIOR_WORDS. Labelled documents are scored by the counts of
the other half of the labels, so no document is judged by its own label; a document is toxic when its score reaches the cut that does best
on them.

Plan: one pass counts the n-grams of the labelled documents of the fit (combined per partition,
then per reducer); the model is broadcast in parts split by context, each of a checked
size, and scoring is one narrow Arrow pass over (doc_id, text) for each part, written once, from which the cut and the verdicts follow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, keys_side, map_batches, table
from .kernels import SLICE_BYTES, U64, first_of_each, mix, pieces, powers, slices, word_classes

#: Chosen by the held-out labels of the table of 1,000 documents; the README gives the results on others.
ORDER, DISCOUNT, STRENGTH, PRIOR_WORDS = 6, 0.75, 300.0, 200.0
#: Labelled documents of the fit; of more labels a share of about so many, chosen by a hash of the id, makes the counts and the cut.
FIT_LABELS = 500_000
#: Labels that are sent to the executors whole; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: n-grams in one broadcast part of the model (24 bytes each).
PART_NGRAMS = 4_000_000
SYMBOLS = 64
#: The bits of an n-gram without its language.
ANY_LANGUAGE = (1 << 36) - 1
STATIC = {"model": "ngram long, c00 long, c01 long, c10 long, c11 long"}


def _symbol_table() -> np.ndarray:
    """Code point -> symbol: 0 outside words, letters 1-26, digits 27, others in 36 classes.

    Any 36 successive code points are in different classes, so the letters of one alphabet hardly share any;
    of scripts with more signs many share a class, and a run of signs tells them apart.
    """
    out = np.zeros(0x110000, np.uint8)
    out[128:] = np.where(word_classes()[128:] > 0, 28 + (np.arange(128, 0x110000) * 7 % 36), 0)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    out[ord("0") : ord("9") + 1] = 27
    return out


_table: list[np.ndarray] = []


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts (0 between words and texts), word starts, word ends, text of each word."""
    if not _table:
        _table.append(_symbol_table())
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    lengths = pc.utf8_length(lower).to_numpy(zero_copy_only=False)
    joined = "\n".join(lower.to_pylist()) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _table[0][points]
    inside = symbols > 0
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    owner = np.searchsorted(np.cumsum(lengths + 1), starts, side="right")
    return symbols, starts, ends, owner


def _ngrams(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed (language, n-gram) that ends at each symbol of each word and at its end; positions of each word."""
    lengths = ends - starts + 1
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    at = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], lengths)
    padded = np.concatenate([np.zeros(ORDER, np.uint8), symbols])
    out = np.repeat(lang, lengths)
    for back in range(ORDER - 1, -1, -1):
        s = padded[at + ORDER - back].astype(np.int64)
        out = (out << 6) | np.where(within >= back, s, 0)
    return out, offsets


def _languages(part: pa.RecordBatch) -> np.ndarray:
    """Class 1-63 of each row's language; 0 for null."""
    codes = {x: 0 if x is None else 1 + zlib.crc32(x.encode()) % 63 for x in pc.unique(part.column("lang")).to_pylist()}
    return np.array([codes[x] for x in part.column("lang").to_pylist()], np.int64)


def _word_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n, base = len(symbols), 0x9E3779B97F4A7C15 | 1
    prefix = np.zeros(n + 1, U64)
    np.cumsum((symbols.astype(U64) + U64(1)) * powers(base, n), out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * powers(pow(base, -1, 1 << 64), n)[starts] + (ends - starts).astype(U64))


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, and of each distinct word of each text its start, end, text and hash."""
    symbols, starts, ends, owner = _words(texts)
    hashes = _word_hashes(symbols, starts, ends)
    if len(starts):
        first, _ = first_of_each(mix(hashes + owner.astype(U64)))
        starts, ends, owner, hashes = starts[first], ends[first], owner[first], hashes[first]
    return symbols, starts, ends, owner, hashes


def _long(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same of one long text, piece by piece: only the symbols of its distinct words are held."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    known: dict[int, np.ndarray] = {}
    for a, b in pieces(raw):
        symbols, starts, ends, _, hashes = _distinct(pa.array([raw[a:b].tobytes().decode("utf-8", "replace")]))
        for h, x, y in zip(hashes.tolist(), starts.tolist(), ends.tolist()):
            if h not in known:
                known[h] = symbols[x:y].copy()
    lengths = np.array([len(w) + 1 for w in known.values()], np.int64)
    ends = np.cumsum(lengths) - 1
    out = np.zeros(int(lengths.sum()), np.uint8)
    for word, end in zip(known.values(), ends.tolist()):
        out[end - len(word) : end] = word
    return out, ends + 1 - lengths, ends, np.zeros(len(known), np.int64), np.array(list(known), U64)


def _once_a_text(part: pa.RecordBatch):
    """Symbols, and of each distinct word of each text its start, end, text, language and hash."""
    texts = part.column("text")
    if len(texts) == 1 and texts[0].is_valid and texts[0].as_buffer().size > 2 * SLICE_BYTES:
        symbols, starts, ends, owner, hashes = _long(texts[0].as_py())
    else:
        symbols, starts, ends, owner, hashes = _distinct(texts)
    return symbols, starts, ends, owner, _languages(part)[owner] if len(owner) else owner, hashes


def _compact(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(counts, first, axis=0)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ngram, counts by class and half) of a partition, combined before they leave it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def out(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(counts[:, i]) for i in range(4))], names=["ngram", "c00", "c01", "c10", "c11"])

    for batch in batches:
        for part in slices(batch, "text"):
            symbols, starts, ends, owner, lang, _ = _once_a_text(part)
            if len(starts) == 0:
                continue
            group = part.column("toxic").to_numpy() * 2 + part.column("half").to_numpy()
            keys, offsets = _ngrams(symbols, starts, ends, lang)
            tag = np.repeat(group[owner], np.diff(offsets)).astype(np.int64)
            tagged = np.sort(keys << 2 | tag)
            first = np.flatnonzero(np.append(True, tagged[1:] != tagged[:-1]))
            n = np.diff(np.append(first, len(tagged)))
            tagged = tagged[first]
            counts = np.zeros((len(n), 4), np.int64)
            counts[np.arange(len(n)), tagged & 3] = n
            held.append(_compact(tagged >> 2, counts))
            size += len(held[-1][0])
            if size > 2_000_000:
                held = [_compact(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size > 1_500_000:
                    yield out(*held[0])
                    held, size = [], 0
    if held:
        yield out(*_compact(*(np.concatenate(x) for x in zip(*held))))


class Lookup:
    """Open-addressing table from sorted distinct int64 keys to their positions."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.mask, self.keys = (1 << bits) - 1, keys
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = (mix(keys.view(U64)) & U64(self.mask)).astype(np.int64)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            stay = self.slots[at] != left
            left, at = left[stay], (at[stay] + 1) & self.mask

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if len(self.keys) == 0:
            return out
        at = (mix(keys.view(U64)) & U64(self.mask)).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[np.maximum(slot, 0)] == keys[left])
            out[left[hit]] = slot[hit]
            go = (slot >= 0) & ~hit
            left, at = left[go], (at[go] + 1) & self.mask
        return out


def shared_backoff(trigrams: np.ndarray) -> np.ndarray:
    """p(c | a, b) for all symbols from continuation counts (64, 64, 64) of both classes."""
    uniform = np.full(SYMBOLS, 1 / SYMBOLS)
    single = trigrams.sum((0, 1)) + 0.0
    p1 = (single + SYMBOLS * DISCOUNT * uniform) / (single.sum() + SYMBOLS * DISCOUNT)
    double = (trigrams > 0).sum(0).astype(float)  # distinct symbols before (b, c)

    def smooth(counts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        total = counts.sum(-1, keepdims=True)
        kinds = (counts > 0).sum(-1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            p = (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds * lower) / total
        return np.where(total > 0, p, lower)

    return smooth(trigrams.astype(float), smooth(double, p1)[None])


def _picks(half: int | None) -> tuple[list[int], list[int], list[int]]:
    """Count columns of both classes, of the toxic and of the ordinary one; of one half, or of both."""
    return ([0, 1, 2, 3], [2, 3], [0, 1]) if half is None else ([half, 2 + half], [2 + half], [half])


def discounts(counts: np.ndarray) -> np.ndarray:
    """What modified Kneser-Ney takes from a count of 0, 1, 2, and 3 or more, by the counts of these counts.

    Where a class of counts is missing, or the estimate is not between 0 and the count, plain DISCOUNT is taken.
    """
    n1, n2, n3, n4 = (int((counts == k).sum()) for k in (1, 2, 3, 4))
    out = np.array([0.0, DISCOUNT, DISCOUNT, DISCOUNT])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        for k, (n, m) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
            if n and 0 < (d := k - (k + 1) * y * m / n) < k:
                out[k] = d
    return out


class Counts:
    """n-grams with their counts, contexts and lookups; ``taken_of`` has the discounts by the columns counted together."""

    def __init__(self, ngrams: np.ndarray, counts: np.ndarray, taken_of: dict[tuple, np.ndarray]):
        self.ngrams, self.counts, self.taken_of = ngrams, counts, taken_of
        contexts = ngrams >> 6
        first = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(ngrams) else np.zeros(0, np.int64)
        self.contexts = contexts[first]
        self.totals = np.add.reduceat(counts, first, axis=0) if len(first) else counts[:0]
        # what the discount takes from the counts of each context, by the columns counted together
        self.taken = {}
        for pick in [p for half in (None, 0, 1) for p in _picks(half)]:
            off = taken_of[tuple(pick)][np.minimum(counts[:, pick].sum(1), 3)]
            self.taken[tuple(pick)] = np.add.reduceat(off, first) if len(first) else off[:0]
        self._ngram = self._context = None

    def log_ratio(self, keys: np.ndarray, shared: np.ndarray, half: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the keys whose context was counted, and the log-ratios there."""
        if self._ngram is None:
            self._ngram, self._context = Lookup(self.ngrams), Lookup(self.contexts)
        both, toxic, ordinary = _picks(half)
        context = self._context(keys >> 6)
        known = np.flatnonzero(context >= 0)
        known = known[self.totals[context[known]][:, both].sum(1) > 0]
        keys, context = keys[known], context[known]
        at = self._ngram(keys)
        seen = np.where((at >= 0)[:, None], self.counts[np.maximum(at, 0)], 0)
        shared = shared[(keys >> 12) & 63, (keys >> 6) & 63, keys & 63]

        def smoothed(pick: list[int], lower: np.ndarray, strength: float) -> np.ndarray:
            c, total = seen[:, pick].sum(1), self.totals[context][:, pick].sum(1)
            back = self.taken[tuple(pick)][context] + strength
            return (c - self.taken_of[tuple(pick)][np.minimum(c, 3)] + back * lower) / (total + strength)

        shared = smoothed(both, shared, 1.0)
        return known, np.log(smoothed(toxic, shared, STRENGTH)) - np.log(smoothed(ordinary, shared, STRENGTH))


class Model:
    """Counts of one part of the contexts, by language and over all languages, and the shared distribution."""

    def __init__(self, ngrams: np.ndarray, counts: np.ndarray, shared: np.ndarray, taken_of: dict[tuple, np.ndarray]):
        self.own, self.shared, self.taken_of = Counts(ngrams, counts, taken_of), shared, taken_of
        self._pooled = None  # made by each worker, so that it is not sent

    def log_ratio(self, keys: np.ndarray, half: int | None = None) -> np.ndarray:
        """log p(toxic) - log p(ordinary) at each n-gram, by its language or else by all languages.

        ``half``: by that half of the labels alone.
        """
        if self._pooled is None:
            ngrams = self.own.ngrams & ANY_LANGUAGE
            self._pooled = Counts(*(_compact(ngrams, self.own.counts) if len(ngrams) else (ngrams, self.own.counts)), self.taken_of)
        out = np.zeros(len(keys))
        known, ratio = self.own.log_ratio(keys, self.shared, half)
        out[known] = ratio
        rest = np.delete(np.arange(len(keys)), known)
        known, ratio = self._pooled.log_ratio(keys[rest] & ANY_LANGUAGE, self.shared, half)
        out[rest[known]] = ratio
        return out


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                symbols, starts, ends, owner, lang, hashes = _once_a_text(part)
                sums, words = np.zeros(part.num_rows), np.bincount(owner, minlength=part.num_rows)
                half = pc.fill_null(part.column("half"), -1).to_numpy(zero_copy_only=False)
                for h in (-1, 0, 1) if len(starts) else ():
                    # a labelled text by the other half of the labels, every other text by all of them
                    mine = np.flatnonzero(half[owner] == h)
                    if len(mine):
                        first, inverse = first_of_each(mix(hashes[mine] + lang[mine].astype(U64)))
                        keys, offsets = _ngrams(symbols, starts[mine[first]], ends[mine[first]], lang[mine[first]])
                        per = np.add.reduceat(model.log_ratio(keys, None if h < 0 else 1 - h), offsets[:-1])
                        sums += np.bincount(owner[mine], per[inverse], part.num_rows)
                names = [x for x in part.schema.names if x not in ("text", "lang", "half")]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), pa.array(sums), pa.array(words.astype(np.int64))], names=[*names, "log_ratio", "words"])

    return score


def _typed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row, text, lang, id): the columns to keep in one struct, so that no name can clash."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.struct(*(keep or ["*"])).alias("row"), F.col("text").cast("string").alias("text"), lang.alias("lang"), F.col("doc_id").cast("long").alias("id"))


def count_ngrams(labelled: DataFrame) -> DataFrame:
    """n-gram counts by class and half over all rows of (text, lang, toxic, half)."""
    counted = labelled.select("text", "lang", F.col("toxic").cast("long").alias("toxic"), F.col("half").cast("long").alias("half")).transform(map_batches, _count, STATIC["model"])
    return counted.groupBy("ngram").agg(*(F.sum(c).alias(c) for c in ("c00", "c01", "c10", "c11")))


def _all_discounts(counts: DataFrame) -> dict[tuple, np.ndarray]:
    """Discounts of every set of columns that is counted together; one small aggregate over all n-grams."""
    names = ("c00", "c01", "c10", "c11")
    picks = [p for half in (None, 0, 1) for p in _picks(half)]
    total = lambda pick: reduce(add, (F.col(names[i]) for i in pick))
    seen = counts.agg(*(F.count(F.when(total(p) == k, 1)).alias(f"n{i}_{k}") for i, p in enumerate(picks) for k in (1, 2, 3, 4))).first()
    return {tuple(p): discounts(np.repeat(np.arange(1, 5), [seen[f"n{i}_{k}"] for k in (1, 2, 3, 4)])) for i, p in enumerate(picks)}


def broadcast_parts(counts: DataFrame, part_ngrams: int = PART_NGRAMS) -> list:
    """The model in broadcast parts of about ``part_ngrams`` n-grams, split by context; all languages of one lie in one part."""
    last = F.col("ngram").bitwiseAND(F.lit((1 << 18) - 1))
    kinds = counts.select(F.col("ngram").bitwiseAND(F.lit(ANY_LANGUAGE)).alias("ngram")).distinct().groupBy(last.alias("last")).agg(F.count("*").alias("n")).toArrow()
    trigrams = np.zeros(SYMBOLS**3)
    trigrams[kinds.column("last").to_numpy()] = kinds.column("n").to_numpy()
    backoff = shared_backoff(trigrams.reshape(SYMBOLS, SYMBOLS, SYMBOLS))
    taken_of = _all_discounts(counts)
    n_parts = max(1, -(-counts.count() // part_ngrams))
    parts = []
    for p in range(n_parts):
        rows = counts.filter(F.pmod(F.xxhash64(F.shiftright(F.col("ngram").bitwiseAND(F.lit(ANY_LANGUAGE)), 6)), F.lit(n_parts)) == p).toArrow()
        keys = rows.column("ngram").to_numpy()
        order = np.argsort(keys)
        columns = np.stack([rows.column(c).to_numpy() for c in ("c00", "c01", "c10", "c11")], 1).astype(np.int32)
        parts.append(counts.sparkSession.sparkContext.broadcast(Model(keys[order], columns[order], backoff, taken_of)))
    return parts


def log_ratios(rows: DataFrame, parts: list) -> DataFrame:
    """``rows`` (row, text, lang, half) to (row, log_ratio, words); half is null for a text that is judged by all labels.

    One part: narrow. More parts: a pass for each, and their sums joined back by what was scored.
    """
    scored = ["text", "lang", "half"]
    if len(parts) == 1:
        return rows.select("row", *scored).transform(map_batches, _scorer(parts[0]), T.StructType([rows.schema["row"], T.StructField("log_ratio", T.DoubleType()), T.StructField("words", T.LongType())]))
    keyed = rows.select("row", *scored, F.xxhash64(*scored).alias("k1"), F.xxhash64(F.lit(1), *scored).alias("k2"))
    sums = [keyed.select("k1", "k2", *scored).transform(map_batches, _scorer(p), "k1 long, k2 long, log_ratio double, words long").groupBy("k1", "k2").agg(F.first("log_ratio").alias("log_ratio"), F.first("words").alias("words")) for p in parts]
    total = reduce(DataFrame.unionByName, sums).groupBy("k1", "k2").agg(F.sum("log_ratio").alias("log_ratio"), F.first("words").alias("words"))
    return keyed.select("row", "k1", "k2").join(total, ["k1", "k2"]).select("row", "log_ratio", "words")


def score_column():
    return F.round(F.col("log_ratio") / (F.col("words") + F.lit(PRIOR_WORDS)), 6)


def best_cut(scored: DataFrame) -> float:
    """The cut with the highest F1 over (score, toxic), in steps of 0.0001; infinite if either class is missing."""
    bins = scored.groupBy(F.round("score", 4).alias("bin"), "toxic").agg(F.count("*").alias("n")).collect()
    table_ = {}
    for b in bins:
        table_.setdefault(b.bin, [0, 0])[int(b.toxic)] += b.n
    cuts = sorted(table_, reverse=True)
    counts = np.array([table_[c] for c in cuts]).reshape(-1, 2)
    if not len(cuts) or not counts.sum(0).all():
        return float("inf")
    false, true = np.cumsum(counts, axis=0).T
    return float(cuts[int(np.argmax(2 * true / (true + false + counts[:, 1].sum())))]) - 0.00005


def _known(labels: DataFrame, fit_labels: int) -> tuple[DataFrame, int]:
    """(__id, __toxic, __half) of the labels of the fit, and how many there are."""
    known = cut(labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("toxic") > 0).cast("long")).alias("__toxic")))
    n = known.count()
    if n > fit_labels:
        known = cut(known.filter(F.pmod(F.xxhash64(F.lit(9), "__id"), F.lit(n)) < fit_labels))
        n = known.count()
    return known.withColumn("__half", F.pmod(F.xxhash64("__id"), F.lit(2)).cast("long")), n


def toxicity(docs: DataFrame, labels: DataFrame, part_ngrams: int = PART_NGRAMS, broadcast_labels: int = BROADCAST_LABELS, keep: list[str] | None = None, fit_labels: int = FIT_LABELS) -> DataFrame:
    """One row (row, score, is_toxic) for each row of ``docs``; ``row`` is a struct of its columns, or of those to ``keep``.

    What is kept of a row is written to the shared folder with its score, so keep no texts of a large table.

    * A null or empty text has score 0; a null language is a language of its own, and like every
      language without labels it is judged by the counts of all. A very long text is read piece by piece, and whole.
    * Labels with a null, and labels of unknown documents, are ignored; of several labels of one
      document the toxic one counts. Repeated rows of a document are scored alike.
    * The fit takes at most about ``fit_labels`` labels; documents of the others are judged like those without a label.
    * Without labels of both classes nothing is toxic. An empty table gives an empty result.
    * Extra columns stay inside ``row``, so their names cannot clash.
    """
    known, n = _known(labels, fit_labels)
    typed = _typed(docs, keep)
    joined = typed.join(F.broadcast(known) if n <= broadcast_labels else known, F.col("id") == F.col("__id"), "left").select(F.struct("row", F.col("__toxic").alias("toxic")).alias("row"), "text", "lang", F.col("__half").alias("half"))
    labelled = joined.filter("half is not null and text is not null").select("text", "lang", F.col("row.toxic").alias("toxic"), "half")
    parts = broadcast_parts(cut(count_ngrams(labelled)), part_ngrams)
    scored = cut(log_ratios(joined, parts).select("row", score_column().alias("score")))
    cut_at = best_cut(scored.filter("row.toxic is not null").select("score", F.col("row.toxic").alias("toxic")))
    return scored.select("row.row", "score", (F.col("score") >= F.lit(cut_at)).alias("is_toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """``docs`` without the rows that are toxic; all columns stay, whatever their names.

    * Null and empty texts and an empty table are handled as ``toxicity`` does: they are never toxic. Repeated rows share
      their verdict. The texts are not shuffled as long as the keys of the toxic rows are few enough to be broadcast.
    """
    rows = docs.select(F.struct("*").alias("row"))  # one column, so that no name clashes with a key's
    lang = F.col("row.lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    parts = [F.col("row.doc_id").cast("long"), lang, F.col("row.text").cast("string")]
    k1, k2 = F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
    named = rows.select(parts[0].alias("doc_id"), parts[1].alias("lang"), parts[2].alias("text"), k1.alias("k1"), k2.alias("k2"))
    toxic = keys_side(toxicity(named, labels, keep=["k1", "k2"], **settings).filter("is_toxic").select("row.*").distinct())
    return rows.join(toxic, (k1 == F.col("k1")) & (k2 == F.col("k2")), "left_anti").select("row.*")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, score, is_toxic) of every document."""
    verdicts = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return verdicts.select(F.col("row.doc_id").alias("doc_id"), "score", "is_toxic")
