"""Crash-safe processing of arriving files: the streaming form of a resumable write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(
    spark: SparkSession,
    source: str,
    schema: StructType,
    step: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> None:
    """Run ``step`` over the parquet files that no earlier run has committed, then stop.

    Every micro-batch commits on its own, so a crash costs at most ``files_per_batch`` files and no row is
    written twice. ``step`` must be row-local (rendering, rating, parsing, scoring).
    """
    incoming = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    )
    query = (
        step(incoming)
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
