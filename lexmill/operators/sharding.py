"""Lookup tables in shards by prefix, and keyword rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

MAX_ROWS, MAX_PREFIX = 200, 4


def shard_keys(rows: DataFrame, key: str = "key", max_rows: int = MAX_ROWS, max_prefix: int = MAX_PREFIX) -> DataFrame:
    """``rows`` with the column shard: the shortest prefix, of at most ``max_prefix`` characters, shared by at most ``max_rows`` rows.

    Prefix sizes come from one aggregate by the longest prefix, so the rows themselves are not shuffled for each length.
    """
    full = F.substring(tx.strip(F.col(key)), 1, max_prefix)
    counts = rows.groupBy(full.alias("p")).agg(F.count("*").alias("n"))
    sized = counts
    for n in range(1, max_prefix):
        sized = sized.withColumn(f"n{n}", F.sum("n").over(Window.partitionBy(F.substring("p", 1, n))))
    shard = F.col("p")
    for n in range(max_prefix - 1, 0, -1):
        shard = F.when(F.col(f"n{n}") <= max_rows, F.substring("p", 1, n)).otherwise(shard)
    return rows.withColumn("__p", full).join(sized.select(F.col("p").alias("__p"), shard.alias("shard")), "__p").drop("__p")


def keyword_rows(docs: DataFrame) -> DataFrame:
    """(keyword, doc_id, title): keywords of the titles, once for each document."""
    return docs.select(F.explode(tx.title_keywords(F.col("title"))).alias("keyword"), "doc_id", "title").distinct()


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the last one by ``order``."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return rows.withColumn("__nth", nth).filter("__nth = 1").drop("__nth")
