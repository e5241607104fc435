"""A stream against a table: each micro-batch is reconciled by the batch engine.

An extension: the batch semantics hold within a micro-batch, so keys are duplicates only of keys in
the same one.  The result is written with the batch's id, so a batch that runs again after a failure
replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from keyweave.config import Comparison
from keyweave.operators.reconcile import reconcile


def reconcile_stream(stream: DataFrame, other: DataFrame, config: Comparison, path: str, checkpoint: str, **options) -> DataStreamWriter:
    """A writer, not yet started, of one Parquet folder ``path/batch=N`` for each micro-batch; the stream is side A."""

    def each(batch: DataFrame, number: int) -> None:
        result = reconcile(batch, other, config, **options)
        result.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
