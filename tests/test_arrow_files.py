"""Arrow files: round trips, splits, files of other tools, two-phase commits."""

import datetime
import os

import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import feather
from pyspark.sql import functions as F

from prefspark.sources.arrow_files import read_arrow, write_arrow

SCHEMA = "k bigint, t string, v double, a array<string>, s struct<x:int,y:string>, d date, ts timestamp"


def rows():
    day, time = datetime.date(2020, 1, 2), datetime.datetime(2020, 1, 2, 3, 4, 5)
    return [(i, f"é{i}" * (i % 7), i / 3, ["p", None], (i, "q"), day, time) for i in range(500)] + [
        (None, None, None, None, None, None, None), (7, "", float("inf"), [], (None, None), day, time), (7, "x" * 2_000_000, 0.0, [], None, day, time)
    ]


def test_round_trip_append_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    write_arrow(df, path)
    assert sorted(map(str, read_arrow(spark, path).collect())) == sorted(map(str, df.collect()))
    write_arrow(df.limit(3), path)
    assert read_arrow(spark, path).count() == 503 + 3
    write_arrow(df.where("k = 7"), path, "overwrite")
    assert read_arrow(spark, path).count() == 3
    assert all(name.endswith(".arrow") for name in os.listdir(path))


def test_several_splits_a_file_and_pruned_columns(spark, tmp_path):
    path = str(tmp_path / "one.feather")
    frame = pd.DataFrame({"k": range(10_000), "c": pd.Categorical(["u", "v"] * 5_000), "t": ["text"] * 10_000})
    feather.write_feather(frame, path, chunksize=500)
    found = read_arrow(spark, path, split_bytes=os.path.getsize(path) // 10 + 1)
    assert found.rdd.getNumPartitions() == 10
    assert found.agg(F.sum("k"), F.count_distinct("c"), F.count("t")).first() == (sum(range(10_000)), 2, 10_000)
    assert read_arrow(spark, path).rdd.getNumPartitions() == 1
    pruned = read_arrow(spark, path, spark.createDataFrame([], "k bigint, absent string").schema)
    assert pruned.agg(F.count("k"), F.count("absent")).first() == (10_000, 0)


def test_other_tools_read_the_files(spark, tmp_path):
    path = tmp_path / "table"
    write_arrow(spark.range(100).selectExpr("id", "string(id) AS t").coalesce(1), str(path))
    (name,) = os.listdir(path)
    assert feather.read_table(str(path / name)).num_rows == 100


def test_empty_tables_keep_their_schema(spark, tmp_path):
    path = str(tmp_path / "none")
    write_arrow(spark.createDataFrame([], SCHEMA), path)
    found = read_arrow(spark, path)
    assert found.count() == 0 and found.schema.names == ["k", "t", "v", "a", "s", "d", "ts"]
    with pytest.raises(Exception):
        read_arrow(spark, str(tmp_path / "absent")).count()


def test_a_failed_write_leaves_no_rows(spark, tmp_path):
    path = str(tmp_path / "failed")
    write_arrow(spark.range(10), path)
    broken = spark.range(1_000, numPartitions=4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("no"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception):
        write_arrow(broken, path)
    assert read_arrow(spark, path).count() == 10 and not [n for n in os.listdir(path) if n.startswith("_")]
