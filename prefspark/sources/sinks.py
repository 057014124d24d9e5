"""Writing result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "json", "csv")


def write_table(
    df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "overwrite"
) -> None:
    """Save a table as parquet, JSON lines or CSV. CSV cannot hold arrays, maps or structs."""
    if format not in FORMATS:
        raise ValueError(f"unknown format {format!r}")
    if format == "csv":
        nested = [
            f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
        ]
        if nested:
            raise ValueError(f"CSV cannot hold the nested columns {nested}")
    writer = df.write.mode(mode).format(format)
    if format == "csv":
        writer = writer.options(header=True, quoteAll=True, escape='"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def write_no_clobber(
    df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = ()
) -> None:
    """Save a table; fail where the path already holds a result."""
    write_table(df, path, format, partition_by, mode="errorifexists")


def _finished_keys(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame | None:
    try:
        return spark.read.parquet(path).select(*key)
    except AnalysisException:
        return None


def resumable_write(df: DataFrame, path: str, key: Sequence[str], buckets: int = 64) -> DataFrame:
    """Append the rows whose key is not stored yet, in ``bucket`` folders; returns the stored table.

    A run that dies leaves no half-written rows: the next run reads the committed keys and continues after
    them. Where the input arrives as files, the streaming form commits file by file instead.
    """
    spark = df.sparkSession
    finished = _finished_keys(spark, path, key)
    todo = df if finished is None else df.join(finished, list(key), "left_anti")
    (
        todo.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        .hint("rebalance", "bucket")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )
    return spark.read.parquet(path).drop("bucket")
