"""Session helpers of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import give_back
from ..sources.storage import cut, shared_folder, shared_subfolder

__all__ = ["BATCH_BYTES", "BATCH_ROWS", "BROADCAST_KEYS", "cut", "keys_side", "map_batches", "shared_folder", "shared_subfolder", "table"]

#: Rows and bytes of one Arrow batch: texts are long, and a batch is held by the JVM and by Python at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
#: Rows of keys that are sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys_side(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` computed once, and broadcast if there are at most ``limit`` rows."""
    keys = cut(keys)
    return F.broadcast(keys) if keys.count() <= limit else keys


def map_batches(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` in batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes, to which the session is set if it has more.

    Workers live on from task to task, so each task ends by giving its memory back.
    """

    def run(batches):
        yield from function(batches)
        give_back()

    conf = df.sparkSession.conf
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    now = conf.get(size, None)  # older sessions have no such bound
    if now is not None and not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        conf.set(size, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)
