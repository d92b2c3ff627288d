"""Batched search over a stored index: exact identifiers, BM25, merging, rank normalisation and window-density rerank.

Queries are rows (query_id, text, top_k, doc_ids); all operators work on the whole batch in one
plan. The batch is computed once: a small one (``small``) becomes a local table with its tokens, whose
derivatives are broadcast; a larger one is written to the shared folder and joined by shuffles.
A small batch is scored inside the segments of the index, of which it reads the columns of its tokens alone, and only the best of each task
go on; texts are read for candidates alone, from the files that hold them.

bm25(d) = - sum over query tokens, repeats included, of
    idf * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl)),   f = 10 tf_title + tf_body
    idf = ln((N - n + 0.5) / (n + 0.5)), or 1e-6 where that is not positive
The parts are added as whole multiples of 1 / UNITS, so the sum is the same in any order and equal documents tie.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import segments as sg
from ..functions import text as tx
from ..functions import udf
from ..functions.text import bound
from ..functions.tokens import search_tokens
from ..sources.storage import cut
from .index import Index

K1, B, TITLE_WEIGHT, BODY_WEIGHT, UNITS = 1.2, 0.75, 10.0, 1.0, 1e12
MAX_TOKENS, POOL, EXACT_SCORE, MIN_IDENTIFIER = 64, 3, -100.0, 4
WINDOW, STEP, MIN_ASCII = 20, 5, 4
#: A batch is small up to so many queries, and so many characters, document ids and (five-fold) results asked for.
BROADCAST_QUERIES, BROADCAST_UNITS = 10_000, 2_000_000
DISPLAYED = 6


@dataclass
class Batch:
    """Queries with their tokens: ``rows`` (query_id, text, top_k, doc_ids, doc_set, tokens, q); q is the text as an identifier."""

    rows: DataFrame
    small: bool
    #: Whether any query has a list of documents.
    restricted: bool
    #: (doc_set, doc_id): the documents of each set that queries name.
    sets: DataFrame | None = None

    def side(self, rows: DataFrame) -> DataFrame:
        """A table whose size the batch bounds: broadcast if the batch is small."""
        return F.broadcast(rows) if self.small else rows

    def tokens(self) -> DataFrame:
        """(query_id, token, times): the first MAX_TOKENS tokens of each query with their repeats; an
        underscored token stands for its parts."""
        first = self.rows.select("query_id", F.explode(F.slice("tokens", 1, MAX_TOKENS)).alias("whole"))
        parts = first.select("query_id", F.explode(F.filter(F.split("whole", "_"), lambda t: t != "")).alias("token"))
        return parts.groupBy("query_id", "token").agg(F.count("*").alias("times"))


def query_rows(queries: DataFrame) -> DataFrame:
    """(query_id, text, top_k, doc_ids, doc_set) with defaults for what is missing."""
    have = set(queries.columns)
    top_k = F.greatest(F.coalesce("top_k", F.lit(10)), F.lit(1)) if "top_k" in have else F.lit(10)
    only = F.filter(F.transform("doc_ids", tx.strip), lambda d: d != "") if "doc_ids" in have else F.lit(None).cast("array<string>")
    return queries.select("query_id", F.coalesce("text", F.lit("")).alias("text"), top_k.cast("int").alias("top_k"), F.when(F.size(only) > 0, only).alias("doc_ids"), (F.col("doc_set") if "doc_set" in have else F.lit(None)).cast("string").alias("doc_set"))


def batch(queries: DataFrame | Batch, sets: DataFrame | None = None) -> Batch:
    """The queries, computed once. A query with a ``doc_set`` is asked of the documents that ``sets`` (doc_set, doc_id) has under it."""
    if isinstance(queries, Batch):
        return queries
    spark, asked = queries.sparkSession, query_rows(queries)
    size = asked.agg(F.count("*").alias("n"), F.count("doc_ids").alias("restricted"), F.coalesce(F.sum(F.length("text") + F.coalesce(F.size("doc_ids"), F.lit(0)) + 5 * F.col("top_k")), F.lit(0)).alias("units")).first()
    if size.n <= BROADCAST_QUERIES and size.units <= BROADCAST_UNITS:
        rows = asked.toArrow()
        texts = rows.column("text").to_pylist()
        tokens = [search_tokens(t) for t in texts]
        rows = rows.append_column("tokens", pa.array(tokens, pa.list_(pa.string())))
        local = spark.createDataFrame(rows.append_column("q", pa.array([udf.alias(t) for t in texts], pa.string())))
        return Batch(local, True, size.restricted > 0, sets)
    return Batch(cut(asked.withColumns({"tokens": tx.search_tokens(F.col("text")), "q": udf.alias_form(F.col("text"))})), False, size.restricted > 0, sets)


def _weights(index: Index, asked: Batch) -> DataFrame:
    """(query_id, token, times, idf) of the batch's tokens that the index has."""
    raw_idf = F.log((F.lit(index.n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw_idf > 0, raw_idf).otherwise(F.lit(1e-6))
    return index.terms.join(asked.side(asked.tokens()), "token").select("query_id", "token", "times", idf.alias("idf"))


def _part(avgdl: float, times, idf, tf_title, tf_body, dl):
    """What a posting adds to a score: of columns or of arrays."""
    f = TITLE_WEIGHT * tf_title + BODY_WEIGHT * tf_body
    return times * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * dl / avgdl))


def bm25_scores(index: Index, queries: DataFrame | Batch) -> DataFrame:
    """(query_id, doc_key, score) of every active document that holds a query token, not rounded.

    The weights of the batch's tokens join the postings, so a frequent token is never one task's work, and parts add up before the
    shuffle by (query_id, doc_key).
    """
    asked = batch(queries)
    part = _part(index.avgdl, *map(F.col, ("times", "idf", "tf_title", "tf_body", "dl")))
    scored = index.postings.filter("is_active").join(asked.side(_weights(index, asked)), "token").select("query_id", "doc_key", F.round(part * UNITS).cast("long").alias("part"))
    return scored.groupBy("query_id", "doc_key").agg((-F.sum("part") / F.lit(UNITS)).alias("score"))


def _segment_scores(index: Index, asked: Batch, pool: int) -> DataFrame:
    """(query_id, doc_key, score): of a small batch the best ``pool`` * top_k documents of each task, scored inside the segments."""
    rows = asked.rows.filter("query_id is not null").select("query_id", "top_k", "doc_set", F.col("doc_ids").isNotNull().alias("restricted")).toArrow()
    limits, marks, listed = ({q: v for q, v in zip(rows.column("query_id").to_pylist(), rows.column(c).to_pylist())} for c in ("top_k", "doc_set", "restricted"))
    ids = list(limits)
    number = {q: n for n, q in enumerate(ids)}
    weights: list[list] = [[] for _ in ids]
    for q, *weight in zip(*(c.to_pylist() for c in _weights(index, asked).toArrow().columns)):
        if q in number:
            weights[number[q]].append(tuple(weight))
    allowed: dict[int, list] = {number[q]: [] for q, v in listed.items() if v}
    if allowed:
        for r in _wanted(index, asked).collect():
            allowed[number[r.query_id]].append(r.doc_key)
    segments = index.segments_of(sorted({w[0] for q in weights for w in q}))
    if asked.sets is not None:
        named = asked.side(asked.rows.select("doc_set").distinct())
        held = asked.sets.join(named, "doc_set").join(index.names.select("doc_key", "doc_id"), "doc_id").select(F.col("doc_set").alias("mark"), "doc_key")
        segments = index.marked(segments, held, "left")
    run = sg.scorer(pa.array(ids, rows.schema.field("query_id").type), [v * pool for v in limits.values()], weights, {n: np.array(k, np.int64) for n, k in allowed.items()}, list(marks.values()), partial(_part, index.avgdl), UNITS)
    return segments.mapInArrow(run, f"query_id {asked.rows.schema['query_id'].dataType.simpleString()}, doc_key long, score double")


def ranked(scores: DataFrame, order: list[Column], limit: Column) -> DataFrame:
    """The first rows of each query, with their rank; a window group limit, not a full sort."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= limit)


def _wanted(index: Index, asked: Batch) -> DataFrame:
    """(query_id, doc_key) of the documents in queries' lists."""
    wanted = asked.rows.filter("doc_ids is not null").select("query_id", F.explode("doc_ids").alias("doc_id")).distinct()
    return index.names.select("doc_key", "doc_id").join(asked.side(wanted), "doc_id").select("query_id", "doc_key")


def _restricted(rows: DataFrame, index: Index, asked: Batch) -> DataFrame:
    """``rows`` (query_id, doc_key, restricted, doc_set, ...) without the documents that a query's list or set leaves out, by equal keys."""
    if asked.restricted:
        allowed = _wanted(index, asked).withColumn("allowed", F.lit(True))
        rows = rows.join(allowed, ["query_id", "doc_key"], "left").filter(~F.col("restricted") | F.col("allowed")).drop("allowed")
    if asked.sets is not None:
        held = asked.sets.join(index.names.select("doc_key", "doc_id"), "doc_id").select("doc_set", "doc_key", F.lit(True).alias("allowed")).distinct()
        rows = rows.join(held, ["doc_set", "doc_key"], "left").filter(F.col("doc_set").isNull() | F.col("allowed")).drop("allowed")
    return rows


def best(index: Index, asked: Batch, pool: int) -> DataFrame:
    """(query_id, doc_key, score, rank): the best ``pool`` * top_k documents; ties by doc_key."""
    limits = asked.rows.select("query_id", "top_k", "doc_set", F.col("doc_ids").isNotNull().alias("restricted"))
    found = _segment_scores(index, asked, pool) if asked.small else bm25_scores(index, asked)
    scores = found.join(asked.side(limits), "query_id")
    if not asked.small:
        scores = _restricted(scores, index, asked)
    return ranked(scores, [F.col("score"), F.col("doc_key")], F.col("top_k") * pool).select("query_id", "doc_key", "score", F.col("rank").cast("long").alias("rank"))


def bm25_top(index: Index, queries: DataFrame | Batch, pool: int = 1) -> DataFrame:
    """(query_id, doc_key, doc_id, score, rank): the best ``pool`` * top_k documents; ties by doc_key."""
    asked = batch(queries)
    top = best(index, asked, pool)
    return index.names.select("doc_key", "doc_id").join(asked.side(top), "doc_key").select("query_id", "doc_key", "doc_id", F.round("score", DISPLAYED).alias("score"), "rank")


def exact_matches(index: Index, queries: DataFrame | Batch) -> DataFrame:
    """(query_id, doc_key, rank): active documents whose id or title contains the normalised query or lies in it.

    Queries of fewer than MIN_IDENTIFIER characters match nothing. The first top_k documents
    count, by doc_key. Candidates share a key of MIN_IDENTIFIER characters, the last ones of the name or of the query.
    """
    asked = batch(queries)
    texts = asked.rows.filter(F.length("q") >= MIN_IDENTIFIER).select("query_id", "q")
    n = MIN_IDENTIFIER
    parts = lambda c, k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (k - 1))), lambda i: F.substring(F.col(c), i, F.lit(k)))
    # a name lies in a query: its last characters, or the whole of a short name, stand somewhere in it
    inner = texts.select("query_id", F.explode(F.array_distinct(F.flatten(F.array(*(parts("q", k) for k in (*index.short_names, n)))))).alias("key"), F.lit(True).alias("inside"))
    # a name holds the query, and so its last characters
    outer = texts.select("query_id", F.right("q", F.lit(n)).alias("key"), F.lit(False).alias("inside"))
    active = index.names.filter("is_active").select("doc_key", F.explode(F.array_distinct(F.array("a", "b"))).alias("name")).filter(F.length("name") > 0)
    keyed = active.select("doc_key", "name", F.explode(F.array_distinct(parts("name", n))).alias("key"))
    met = keyed.join(asked.side(inner.unionByName(outer)), "key").filter(~F.col("inside") | (F.col("key") == F.right("name", F.lit(n)))).select("query_id", "doc_key", "name", "inside")
    held = F.when(F.col("inside"), F.contains("q", F.col("name"))).otherwise(F.contains("name", F.col("q")))
    pairs = met.join(asked.side(texts), "query_id").filter(held).select("query_id", "doc_key").distinct()
    limits = asked.rows.select("query_id", "top_k", "doc_set", F.col("doc_ids").isNotNull().alias("restricted"))
    kept = _restricted(pairs.join(asked.side(limits), "query_id"), index, asked)
    return ranked(kept, [F.col("doc_key")], F.col("top_k")).select("query_id", "doc_key", F.col("rank").cast("long").alias("rank"))


def candidates(index: Index, asked: Batch, pool: int) -> DataFrame:
    """(query_id, doc_key, rank, score, top_k): exact matches first, then BM25 without them, at most ``pool`` * top_k.

    Scores are relative to the first, and not rounded. A query without tokens keeps its exact matches at EXACT_SCORE. Written to the shared folder, so that
    what follows does not repeat the search.
    """
    exact = exact_matches(index, asked).select("query_id", "doc_key", F.lit(0).alias("kind"), F.col("rank").alias("at"), F.lit(EXACT_SCORE).alias("score"))
    found = best(index, asked, pool).select("query_id", "doc_key", F.lit(1).alias("kind"), F.col("rank").alias("at"), "score")
    # of a document that is found both ways the exact match counts
    first = F.min(F.struct("kind", "at", "score"))
    both = exact.unionByName(found).groupBy("query_id", "doc_key").agg(first.alias("m")).select("query_id", "doc_key", "m.*")
    limited = both.join(asked.side(asked.rows.select("query_id", "top_k", F.size("tokens").alias("n_tokens"))), "query_id")
    kept = ranked(limited, [F.col("kind"), F.col("at")], F.col("top_k") * pool)
    top = F.abs(F.first("score").over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    relative = F.when((F.col("n_tokens") > 0) & (top > 0), F.col("score") / top).otherwise(F.col("score"))
    return cut(kept.select("query_id", "doc_key", F.col("rank").cast("long").alias("rank"), relative.alias("score"), "top_k"))


def merged(index: Index, queries: DataFrame | Batch, pool: int = POOL) -> DataFrame:
    """(query_id, doc_key, rank, score, top_k) of the candidates."""
    return candidates(index, batch(queries), pool).withColumn("score", F.round("score", DISPLAYED))


def window_density(text: Column, tokens: Column, window: int = WINDOW, step: int = STEP) -> Column:
    """Most query tokens in any window of lines; tokens are distinct and ASCII.

    A text of at most ``window`` lines counts as one window, in which a token also counts as a
    substring. Windows begin at every ``step``-th line as long as they are whole.
    """
    def held(low: Column) -> Column:
        return F.array_intersect(tokens, F.regexp_extract_all(low, F.lit("[a-z]+"), F.lit(0)))

    def short(low: Column) -> Column:
        return F.greatest(F.size(F.filter(tokens, lambda t: F.contains(low, t))), F.size(held(low)))

    def densest(each: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(each) - window + 1, F.lit(step))
        return F.array_max(F.transform(starts, lambda s: F.size(F.array_distinct(F.flatten(F.slice(each, s, window))))))

    low = F.lower(text)
    n_rows = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    # the tokens of each line are taken once; a window unites those of its lines
    long = bound(F.transform(F.split(low, "\n"), held), densest)
    return F.when((F.size(tokens) == 0) | (text == ""), F.lit(0)).when(n_rows <= window, bound(low, short)).otherwise(long)


def read_candidates(index: Index, asked: Batch, pool: DataFrame) -> DataFrame:
    """The documents of ``pool`` with its columns, the query's tokens, and their texts, read from the files that hold them.

    Texts stay where they are if the batch is small.
    """
    rows = pool.join(asked.side(asked.rows.select("query_id", "tokens")), "query_id")
    files = None
    if asked.small:
        named = index.names.select("doc_key", "file").join(F.broadcast(pool.select("doc_key").distinct()), "doc_key").select("file").distinct()
        files = [r.file for r in named.limit(1_001).collect()]  # more are read as the whole folder
    return index.texts(files).select("doc_key", "doc_id", "title", "source_file", "text").join(asked.side(rows), "doc_key")


def reranked(rows: DataFrame, *kept: Column) -> DataFrame:
    """The final top_k of each query from candidates with texts: (query_id, doc_key, rank, score, density, kept).

    Queries with at least MIN_ASCII distinct ASCII tokens and more than one candidate are ordered by window
    density, ties by their rank so far; scores stay. ``kept`` are further columns to carry.
    """
    ascii_tokens = F.array_distinct(F.filter("tokens", lambda t: t.rlike(r"^[\x00-\x7F]+$")))
    density = F.when((F.size(ascii_tokens) >= MIN_ASCII), window_density(F.col("text"), ascii_tokens))
    scored = rows.select("query_id", "doc_key", F.col("rank").alias("pool_rank"), F.col("score").alias("raw"), "top_k", density.cast("long").alias("each"), *kept)
    several = F.count("*").over(Window.partitionBy("query_id")) > 1
    shown = scored.withColumn("density", F.when(several, F.col("each"))).withColumn("score", F.round("raw", DISPLAYED)).drop("each", "raw")
    first = ranked(shown, [F.coalesce("density", F.lit(0)).desc(), F.col("pool_rank")], F.col("top_k"))
    return first.withColumn("rank", F.col("rank").cast("long")).drop("pool_rank", "top_k")


def search(index: Index, queries: DataFrame | Batch, rerank: bool = True) -> DataFrame:
    """(query_id, doc_key, rank, score, density): the final top_k of each query. Texts are read for the candidates alone."""
    asked = batch(queries)
    if not rerank:
        return merged(index, asked, 1).select("query_id", "doc_key", "rank", "score", F.lit(None).cast("long").alias("density"))
    return reranked(read_candidates(index, asked, candidates(index, asked, POOL))).select("query_id", "doc_key", "rank", "score", "density")


def matches_any(tokens: Column, wanted: list[str], limit: int = MAX_TOKENS) -> Column:
    """Whether a token array holds any of the first ``limit`` distinct wanted tokens."""
    clauses = list(dict.fromkeys(wanted))[:limit]
    return F.arrays_overlap(tokens, F.array(*map(F.lit, clauses))) if clauses else F.lit(False)


def matches_all(tokens: Column, wanted: list[str], limit: int = 16) -> Column:
    """Whether a token array holds all of the first ``limit`` distinct wanted tokens."""
    clauses = list(dict.fromkeys(wanted))[:limit]
    return F.size(F.array_intersect(F.array(*map(F.lit, clauses)), tokens)) == len(clauses) if clauses else F.lit(True)


def match_expression(tokens: Column, terms: list[list[str]], mode: str, must: list[list[str]]) -> Column:
    """Boolean match: ``or`` over all tokens, or ``and`` over the terms' tokens; every must-term in addition.

    ``terms`` and ``must`` hold the tokens of each term. Nothing to match matches nothing.
    """
    clauses = [matches_all(tokens, t) for t in must if t]
    if mode == "and":
        clauses += [matches_all(tokens, t) for t in terms if t]
    elif any(terms):
        clauses.append(matches_any(tokens, [x for t in terms for x in t]))
    out = F.lit(bool(clauses))
    for c in clauses:
        out = out & c
    return out
