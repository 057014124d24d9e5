"""JSON documents that hold a table in one object: keyed by row, or one list or map per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prefspark.session import settle


def _documents(spark: SparkSession, path: str | Sequence[str], pretty: bool, **options: str) -> DataFrame:
    """One row per JSON document: a line of a file, or a whole file when documents span lines."""
    paths = [path] if isinstance(path, str) else list(path)
    return (
        spark.read.options(**options)
        .text(paths, wholetext=pretty)
        .where(F.length(F.trim("value")) > 0)
        .select(
            F.col("_metadata.file_name").alias("_file"),
            F.col("_metadata.file_path").alias("_path"),
            F.col("_metadata.file_block_start").alias("_start"),
            F.monotonically_increasing_id().alias("_line"),
            "value",
        )
    )


def read_keyed_json(
    spark: SparkSession, path: str, value_schema: T.StructType, pretty: bool = False
) -> DataFrame:
    """Rows of ``{"<key>": {…}, …}`` objects: the key as ``row_key`` and the value's fields as columns."""
    keyed = F.from_json("value", T.MapType(T.StringType(), value_schema), {"mode": "FAILFAST"})
    rows = _documents(spark, path, pretty).select(F.explode(keyed).alias("row_key", "row"))
    return rows.select("row_key", "row.*")


def write_keyed_json(df: DataFrame, path: str, key: str, bucket: Column) -> None:
    """Write ``{"<key>": {…}}`` objects, one per ``bucket`` value; a bucket must hold a bounded number of rows."""
    fields = [c for c in df.columns if c != key]
    entry = F.struct(F.col(key).cast("string"), F.struct(*fields))
    (
        df.groupBy(bucket.alias("_bucket"))
        .agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
        .select("value")
        .write.text(path)
    )


_PLACE = ("_file", "_path", "_start", "_line")


def _list_rows(documents: DataFrame, schema: T.StructType) -> DataFrame:
    columns = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in schema])
    parsed = documents.withColumn("t", F.from_json("value", columns, {"mode": "FAILFAST"}))
    zipped = F.arrays_zip(*[F.coalesce(F.col(f"t.{f.name}"), F.array()).alias(f.name) for f in schema])
    return parsed.select(*_PLACE, F.posexplode(zipped).alias("_pos", "row")).select(*_PLACE, "_pos", "row.*")


def _map_rows(documents: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows put together inside their own document, from the union of its columns' keys.

    A column that has all keys lends its cells in key order; only a column with gaps is looked up key by key.
    """
    columns = T.StructType([T.StructField(f.name, T.MapType(T.StringType(), f.dataType)) for f in schema])
    parsed = documents.withColumn("t", F.from_json("value", columns, {"mode": "FAILFAST"}))
    held = {f.name: F.coalesce(F.col(f"t.{f.name}"), F.create_map().cast(columns[f.name].dataType)) for f in schema}
    keys = F.array_sort(F.array_distinct(F.concat(*[F.map_keys(m) for m in held.values()])))
    keyed = parsed.withColumn("_keys", keys)

    def cells(name: str) -> Column:
        entries = F.array_sort(F.map_entries(held[name]), lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))
        found = F.transform(F.col("_keys"), lambda k: F.try_element_at(held[name], k))
        return F.when(F.size(held[name]) == F.size("_keys"), F.transform(entries, lambda e: e["value"])).otherwise(found)

    zipped = F.arrays_zip(F.col("_keys").alias("_pos"), *[cells(f.name).alias(f.name) for f in schema])
    return keyed.select(*_PLACE, F.explode(zipped).alias("row")).select(*_PLACE, "row.*")


def read_column_json(
    spark: SparkSession, path: str, schema: T.StructType, layout: str = "list", pretty: bool = False
) -> DataFrame:
    """Rows of ``{column: […]}`` (``list``) or ``{column: {"0": …}}`` (``map``) documents, with ``row_index``."""
    if layout not in ("list", "map"):
        raise ValueError(f"unknown layout {layout!r}")
    rows = (_list_rows if layout == "list" else _map_rows)(_documents(spark, path, pretty), schema)
    return rows.select(F.col("_pos").cast("bigint").alias("row_index"), *schema.names)


def read_many_json(
    spark: SparkSession, directory: str, name_regex: str, schema: T.StructType, pretty: bool = False
) -> DataFrame:
    """All rows of the list-layout files whose name starts with a match of ``name_regex``.

    A column missing from a file is null. ``row_index`` numbers the rows through all files in name order and, inside a
    file, through its documents. Documents are parsed once, into a written table. Documents are numbered inside their
    file by counted rows; the driver adds up one count per file, a list no longer than the one it read the files by.
    """
    documents = _documents(spark, directory, pretty, recursiveFileLookup="true").where(
        F.regexp_like("_file", F.lit(f"^(?:{name_regex})"))
    )
    rows = settle(_list_rows(documents, schema), "json_rows")
    per_document = rows.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_file", "_path").orderBy("_start", "_line").rowsBetween(Window.unboundedPreceding, -1)
    inside = per_document.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    counts = per_document.groupBy("_file", "_path").agg(F.sum("_rows").alias("n")).collect()
    offsets, reached = [], 0
    for file in sorted(counts, key=lambda r: (r["_file"], r["_path"])):
        offsets.append((file["_file"], file["_path"], reached))
        reached += file.n
    placed = spark.createDataFrame(offsets, "_file string, _path string, _offset bigint")
    return (
        rows.join(inside.drop("_rows"), list(_PLACE))
        .join(placed, ["_file", "_path"])
        .select(
            (F.col("_pos") + F.col("_before") + F.col("_offset")).alias("row_index"),
            F.col("_file").alias("file_name"),
            *schema.names,
        )
    )


def list_layout(df: DataFrame, order_by: str) -> Column:
    """Aggregate expression: the rows of a bounded group as one ``{column: […]}`` document in ``order_by`` order."""
    columns = [c for c in df.columns if c != order_by]
    rows = F.array_sort(F.collect_list(F.struct(order_by, *columns)))
    return F.to_json(F.struct(*[rows[c].alias(c) for c in columns]))


def map_layout(df: DataFrame, order_by: str) -> Column:
    """Aggregate expression: the rows of a bounded group as one ``{column: {"<order_by>": …}}`` document."""
    columns = [c for c in df.columns if c != order_by]
    rows = F.array_sort(F.collect_list(F.struct(order_by, *columns)))

    def column_map(name: str) -> Column:
        return F.map_from_entries(F.transform(rows, lambda r: F.struct(r[order_by].cast("string"), r[name])))

    return F.to_json(F.struct(*[column_map(c).alias(c) for c in columns]))


