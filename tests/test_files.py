"""File layouts as other tools write them, refusals, resumed runs and the streaming form."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark import schemas
from prefspark.plans import flows
from prefspark.sources import json_layouts, sinks, tables
from prefspark.streaming.resumable import process_new_files

SCHEMA = T.StructType().add("prompt", T.StringType()).add("score", T.DoubleType())


@pytest.mark.parametrize("indent", [None, 2])
def test_keyed_json(spark, tmp_path, indent):
    path = tmp_path / "k.json"
    data = {"17": {"prompt": "a\nb", "response": ["x", "y"]}, "3": {"prompt": "c", "response": []}}
    path.write_text(json.dumps(data, indent=indent))
    rows = json_layouts.read_keyed_json(spark, str(path), schemas.NESTED_SAMPLES, pretty=indent is not None).collect()
    assert {(r.row_key, r.prompt, tuple(r.response)) for r in rows} == {("17", "a\nb", ("x", "y")), ("3", "c", ())}


def test_column_json_layouts(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"prompt": ["a", "b"], "score": [1.5, None]}))
    (tmp_path / "m.json").write_text(json.dumps({"prompt": {"0": "a", "10": "b"}, "score": {"10": None, "0": 1.5}}))
    as_list = json_layouts.read_column_json(spark, str(tmp_path / "l.json"), SCHEMA)
    assert {tuple(r) for r in as_list.collect()} == {(0, "a", 1.5), (1, "b", None)}
    as_map = json_layouts.read_column_json(spark, str(tmp_path / "m.json"), SCHEMA, "map")
    assert {tuple(r) for r in as_map.collect()} == {(0, "a", 1.5), (10, "b", None)}


def test_many_json_prefix_match_missing_columns_and_numbers(spark, tmp_path):
    write = lambda name, data: (tmp_path / name).write_text(json.dumps(data))
    write("ds_evaluation0_1.json", {"prompt": ["a", "b"], "score": [1.0, 2.0]})
    write("ds_evaluation0_2.json.bak", {"prompt": ["c"]})
    write("other_ds_evaluation0_1.json", {"prompt": ["no"], "score": [9.0]})
    rows = json_layouts.read_many_json(spark, str(tmp_path), r"ds_evaluation\d+_\d+\.json", SCHEMA).orderBy("row_index").collect()
    assert [(r.row_index, r.prompt, r.score) for r in rows] == [(0, "a", 1.0), (1, "b", 2.0), (2, "c", None)]


def test_refusals(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a"])], "k int, v array<string>")
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x"), "csv")
    with pytest.raises(ValueError):
        sinks.write_table(df, str(tmp_path / "x"), "feather")
    sinks.write_no_clobber(df, str(tmp_path / "y"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        sinks.write_no_clobber(df, str(tmp_path / "y"))


def test_split_reading_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "c", "x", "y", "train"), (2, "c", "x", "y", "test")], schemas.pairs())
    sinks.write_table(df, str(tmp_path / "p"), partition_by=["split"])
    read = tables.read_pairs(spark, str(tmp_path / "p"), schemas.pairs(), "test")
    assert [r.pair_id for r in read.collect()] == [2]
    assert "PartitionFilters: [isnotnull(split" in read._jdf.queryExecution().executedPlan().toString()


def test_resumed_write_adds_only_missing_rows(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("k"), F.rand(1).alias("v"))
    path = str(tmp_path / "r")
    sinks.resumable_write(df.where("k < 40"), path, ["k"], buckets=4)
    stored = sinks.resumable_write(df, path, ["k"], buckets=4)
    assert stored.count() == 100 and stored.select("k").distinct().count() == 100


def test_stream_processes_each_file_once(spark, tmp_path):
    source, target, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    schema = T.StructType().add("id", T.LongType())
    step = lambda rows: rows.withColumn("twice", F.col("id") * 2)
    for low in (0, 10):
        spark.range(low, low + 10).coalesce(1).write.mode("append").parquet(source)
        process_new_files(spark, source, schema, step, target, marks, files_per_batch=1)
        process_new_files(spark, source, schema, step, target, marks)
    assert sorted(r.twice for r in spark.read.parquet(target).collect()) == list(range(0, 40, 2))


def test_experiment_grid_collects_metrics(spark):
    table = flows.experiment_grid(spark, [{"n": 1}, {"n": 2}], lambda run: [{"square": run["n"] ** 2}])
    assert sorted(tuple(r) for r in table.collect()) == [(1, 1), (2, 4)]
