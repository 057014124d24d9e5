"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app: str = "prefspark",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **settings: str,
) -> SparkSession:
    """A session with adaptive execution and skew handling on; ``master`` is left to spark-submit by default."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a temporary one only for a local master that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="prefspark-")
        context.setCheckpointDir(os.path.join(_local_roots[context.applicationId], "checkpoints"))
    return _local_roots[context.applicationId]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for an intermediate table."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a table that several later steps read to the shared folder, and continue from the written copy.

    Later steps then start from stored columns instead of repeating the work, and a lost executor costs a
    read. The caller keeps such tables narrow.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_BYTES = 64 * 2**20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a small input (at most SMALL_BYTES by Spark's own estimate) dealt over the cores.

    Heavy per-row work on a small table that is one split then uses every core. The bound does not depend on the
    cluster: no larger input is ever shuffled here.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if size <= SMALL_BYTES else df
