"""Reading pair sets and sample sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_pairs(
    spark: SparkSession, path: str, schema: StructType | None = None, split: str | None = None
) -> DataFrame:
    """A pair set, optionally one split; a ``split`` partition column lets Spark skip the other folders."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    pairs = reader.parquet(path)
    return pairs if split is None else pairs.where(F.col("split") == split)


def read_scored_samples(
    spark: SparkSession, path: str, schema: StructType | None = None, split: str = "train"
) -> DataFrame:
    """Samples from JSON lines when the path says so, else the given split of a parquet table."""
    if path.rstrip("/").endswith((".json", ".jsonl")):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    samples = read_interchange(spark, path)
    if "split" in samples.columns:
        samples = samples.where(F.col("split") == split)
    return samples


def read_interchange(spark: SparkSession, path: str) -> DataFrame:
    """Comparison and pseudo-label tables exchanged between stages, kept as parquet."""
    return spark.read.parquet(path)
