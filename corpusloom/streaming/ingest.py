"""Files that have arrived since the last run, to chunks: an available-now stream.

The checkpoint is the ledger: a rerun over the same files adds no rows, and a
batch that fails leaves nothing behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ingest(spark: SparkSession, source: str, schema: T.StructType, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, per_batch: int = 1000) -> int:
    """Read new Parquet files of ``source``, transform each batch and append it to ``target``; batches written."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        # a batch that is repeated after a failure replaces what it may have left
        transform(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def updates(ledger: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Latest entry of each key of a streamed ledger; entries later than ``late`` are left out."""
    from pyspark.sql import functions as F

    return ledger.withWatermark(at, late).groupBy(key).agg(F.max_by(F.struct(*ledger.columns), F.col(at)).alias("last"))
