"""Keeping documents up to date from a stream of changed documents.

Every micro-batch is written under its number, so a batch that is repeated after a failure
overwrites itself; a document's newest row is the one of its last batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow(stream: DataFrame, folder: str, checkpoint: str, once: bool = True, order: str | None = None) -> StreamingQuery:
    """Store a stream of (doc_id, is_active, ...) rows; ``once`` takes what is there and stops.

    Of several rows of a document in one micro-batch the last by the column ``order`` counts. Without such a column their
    order is unknown, and a deletion (is_active false) wins over other rows, as it does among rows of equal order.
    """

    def store(batch: DataFrame, number: int) -> None:
        later = [F.col(order).desc_nulls_last()] if order else []
        rest = [F.col(c) for c in batch.columns if c not in ("doc_id", "is_active", order)]
        newest = F.row_number().over(Window.partitionBy("doc_id").orderBy(*later, F.col("is_active").asc(), *rest))
        batch.withColumn("__n", newest).filter("__n = 1").drop("__n").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each document that is active."""
    rows = spark.read.parquet(folder)
    last = rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("batch").desc())))
    return last.filter("__n = 1 and is_active").drop("__n", "batch")
