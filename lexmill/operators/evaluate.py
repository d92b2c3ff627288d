"""Retrieval quality over records (query, patterns, hits, elapsed_ms, bundle_chars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import contained
from ..functions import text as tx
from .search import BROADCAST_UNITS


def holders(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, query_id): the documents that hold a query's text word for word. All queries are sought in one pass over the texts; too long a batch for that is joined."""
    asked = queries.select("query_id", "text").filter("query_id is not null and text is not null")
    if asked.agg(F.coalesce(F.sum(F.length("text") + 100), F.lit(0)).alias("n")).first().n > BROADCAST_UNITS:
        return docs.select("doc_id", "text").join(asked.withColumnRenamed("text", "q"), F.contains("text", F.col("q"))).select("doc_id", "query_id")
    rows = asked.toArrow()
    run = contained.pairs("doc_id", rows.column("text").to_pylist(), rows.column("query_id").combine_chunks())
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id string, query_id {asked.schema['query_id'].dataType.simpleString()}")


def first_ranks(records: DataFrame) -> DataFrame:
    """``records`` with rank: the place of the first hit that any pattern matches, 0 if none does."""
    hits = F.filter(F.coalesce("hits", F.array().cast("array<string>")), lambda h: tx.strip(h) != "")
    patterns = F.filter(F.coalesce("patterns", F.array().cast("array<string>")), lambda p: tx.strip(p) != "")
    # a pattern without a mark of its own is compared as it is, which spares a regular expression for each pair
    met = lambda h, p: F.when(p.rlike(r"[*?\[]"), F.regexp(h, tx.glob_pattern(p))).otherwise(h == p)
    places = F.transform(hits, lambda h, i: F.when(F.exists(patterns, lambda p: met(h, p)), i + 1))
    return records.withColumn("rank", F.coalesce(F.array_min(F.filter(places, lambda x: x.isNotNull())), F.lit(0)).cast("long"))


def metrics(ranked: DataFrame) -> DataFrame:
    """One row: cases, hit_at_1, hit_at_3, hit_at_5, mrr over all cases; no case gives zeros."""
    within = lambda k: F.coalesce(F.round(F.avg(F.when(F.col("rank").between(1, k), 1.0).otherwise(0.0)), 6), F.lit(0.0))
    mrr = F.coalesce(F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 6), F.lit(0.0))
    return ranked.agg(F.count("*").alias("cases"), within(1).alias("hit_at_1"), within(3).alias("hit_at_3"), within(5).alias("hit_at_5"), mrr.alias("mrr"))


def failures(ranked: DataFrame) -> DataFrame:
    """Cases without a matching hit, with their first ten hits."""
    return ranked.filter("rank = 0").select("query", "patterns", F.slice("hits", 1, 10).alias("hits"))


def latency(records: DataFrame) -> DataFrame:
    """One row: nearest-rank p50 and p95, and the maximum, of elapsed_ms; average and maximum of bundle_chars."""
    nearest = lambda p: F.expr(f"percentile_disc({p}) within group (order by elapsed_ms)")
    zero = F.lit(0.0)
    return records.agg(F.coalesce(nearest(0.5), zero).alias("p50"), F.coalesce(nearest(0.95), zero).alias("p95"), F.coalesce(F.max("elapsed_ms"), zero).alias("max_ms"), F.coalesce(F.round(F.avg("bundle_chars"), 6), zero).alias("avg_chars"), F.coalesce(F.max("bundle_chars").cast("long"), F.lit(0)).alias("max_chars"))
