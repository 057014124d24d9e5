"""Registered queries: sources and sinks, each as a round trip through the shared folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prefspark import schemas
from prefspark.functions.text import response_length
from prefspark.operators import select
from prefspark.plans import inputs
from prefspark.plans.registered.common import PAIRS, SAMPLES_NUM, Query, r6, sql
from prefspark.plans.registered.selection import ORACLES as SELECTION_SQL
from prefspark.session import settle, work_path
from prefspark.sources import arrow_files, json_layouts, sinks, tables
from prefspark.streaming.resumable import process_new_files

SCORES = (
    T.StructType().add("prompt", T.StringType()).add("response", T.StringType()).add("score", T.DoubleType())
)
ROWS_PER_DOCUMENT = 1000
#: Files of read_many_json: this many at least, and one for so many documents.
FILES, DOCUMENTS_PER_FILE = 5, 64


def _plain_pairs(spark, sf_dir):
    return inputs.pairs(spark, sf_dir).select("pair_id", "context", "chosen", "rejected", "split")


def _digests(pairs):
    return pairs.select(
        "pair_id", "context", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"), "split"
    )


def read_pairs(spark, sf_dir):
    path = work_path(spark, "pairs")
    sinks.write_table(_plain_pairs(spark, sf_dir), path, partition_by=["split"])
    return _digests(tables.read_pairs(spark, path, schemas.pairs(), split="train"))


def read_scored_samples(spark, sf_dir):
    columns = ["prompt", "event_id", "response", "score_a", "score_b"]
    samples = inputs.samples_num(spark, sf_dir).select(*columns)
    path = work_path(spark, "samples") + ".json"
    sinks.write_table(samples, path, "json")
    return tables.read_scored_samples(spark, path, samples.schema)


def read_keyed_json(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("prompt"), F.array("text", "lang").alias("response")
    )
    path = work_path(spark, "keyed")
    json_layouts.write_keyed_json(documents, path, "doc_id", F.floor(F.col("doc_id") / 64))
    rows = json_layouts.read_keyed_json(spark, path, schemas.NESTED_SAMPLES)
    return rows.select(
        "row_key", "prompt", F.size("response").alias("n"), F.md5(F.element_at("response", 1)).alias("first_md5"),
        F.element_at("response", 2).alias("second"),
    )


def _score_documents(spark, sf_dir, layout):
    """Events as column documents, one per thousand event numbers."""
    scored = inputs.samples_num(spark, sf_dir).select("event_id", "prompt", "response", F.col("score_a").alias("score"))
    build = json_layouts.list_layout if layout == "list" else json_layouts.map_layout
    bucket = F.floor(F.col("event_id") / ROWS_PER_DOCUMENT).alias("bucket")
    return scored.groupBy(bucket).agg(build(scored, "event_id").alias("value"))


def read_column_json(spark, sf_dir):
    """Both layouts, each stored twice in one folder: equal documents are documents of their own."""
    found = None
    for layout in ("list", "map"):
        path = work_path(spark, f"columns-{layout}")
        documents = _score_documents(spark, sf_dir, layout).select("value")
        documents.unionByName(documents).write.text(path)
        rows = json_layouts.read_column_json(spark, path, SCORES, layout).withColumn("layout", F.lit(layout))
        found = rows if found is None else found.unionByName(rows)
    return found.select("layout", "prompt", "response", "score", (F.col("row_index") % ROWS_PER_DOCUMENT).alias("row_index"))


def read_many_json(spark, sf_dir):
    """Files of several documents each, beside files whose name does not match.

    Each part is one file. Names are Spark's own, so row numbers are compared inside each part, and over all by their
    count.
    """
    path = work_path(spark, "many")
    documents = _score_documents(spark, sf_dir, "list")
    files = max(FILES, -(-documents.select("bucket").count() // DOCUMENTS_PER_FILE))
    documents = documents.withColumn("part", F.pmod("bucket", F.lit(files)))
    dealt = documents.repartition("part").sortWithinPartitions("part", "bucket").select("value", "part")
    dealt.write.partitionBy("part").text(path)
    documents.select("value").write.json(f"{path}/other")
    wanted = SCORES.add("missing", T.StringType())
    rows = json_layouts.read_many_json(spark, path, r"part-\d+.*[.]txt$", wanted)
    part = F.pmod(F.floor(F.split("response", "#")[1].cast("bigint") / ROWS_PER_DOCUMENT), F.lit(files))
    first = F.min("row_index").over(Window.partitionBy(part))
    numbers = rows.agg(F.count_distinct("row_index").alias("numbers"), (F.max("row_index") + 1).alias("reached"))
    return rows.select(
        "prompt", "response", "score", "missing", (F.col("row_index") - first).alias("in_file"), part.alias("part"),
        numbers.select("numbers").scalar().alias("numbers"), numbers.select("reached").scalar().alias("reached"),
    )


def read_interchange(spark, sf_dir):
    picked = select.bon_candidates(
        inputs.samples_num(spark, sf_dir), ["score_a", "score_b"], order_by=("ts", "event_id")
    )
    path = work_path(spark, "candidates")
    sinks.write_table(picked, path)
    stored = tables.read_interchange(spark, path)
    return stored.select("model", "prompt", F.element_at("response", 1).alias("baseline"), F.element_at("response", 2).alias("best"))


def arrow_interchange(spark, sf_dir):
    """The candidates through Arrow files: written by tasks, committed, and read in splits."""
    picked = select.bon_candidates(
        inputs.samples_num(spark, sf_dir), ["score_a", "score_b"], order_by=("ts", "event_id")
    )
    path = work_path(spark, "candidates-arrow")
    arrow_files.write_arrow(picked, path)
    stored = arrow_files.read_arrow(spark, path)
    return stored.select("model", "prompt", F.element_at("response", 1).alias("baseline"), F.element_at("response", 2).alias("best"))


def write_table(spark, sf_dir):
    pairs = settle(_plain_pairs(spark, sf_dir), "plain_pairs")
    found = None
    for format in sinks.FORMATS:
        path = work_path(spark, f"table-{format}")
        sinks.write_table(pairs, path, format, partition_by=["split"])
        reader = spark.read.schema(schemas.pairs())
        if format == "csv":
            reader = reader.options(header=True, multiLine=True, escape='"')
        stored = _digests(reader.format(format).load(path)).withColumn("format", F.lit(format))
        found = stored if found is None else found.unionByName(stored)
    return found


def write_no_clobber(spark, sf_dir):
    pairs, path = _plain_pairs(spark, sf_dir), work_path(spark, "kept")
    sinks.write_no_clobber(pairs, path)
    try:
        sinks.write_no_clobber(pairs.limit(0), path)
    except AnalysisException:
        return _digests(spark.read.parquet(path))
    raise AssertionError("a second write must be refused")


def resumable_write(spark, sf_dir):
    """The train rows are stored by a first run; the second run adds only what is missing."""
    pairs, path = _plain_pairs(spark, sf_dir), work_path(spark, "resumed")
    sinks.resumable_write(pairs.where(F.col("split") == "train"), path, ["pair_id"])
    return _digests(sinks.resumable_write(pairs, path, ["pair_id"]))


def resumable_stream(spark, sf_dir):
    """Files processed as they arrive: a second file set after the first run, nothing twice."""
    pairs = _plain_pairs(spark, sf_dir)
    source, target, marks = (work_path(spark, f"stream-{part}") for part in ("source", "target", "marks"))
    for split in ("train", "test"):
        pairs.where(F.col("split") == split).write.mode("append").parquet(source)
        process_new_files(
            spark, source, schemas.pairs(),
            lambda rows: rows.select(
                "pair_id", "split", *[response_length(side).alias(f"length_{side}") for side in ("chosen", "rejected")]
            ),
            target, marks,
        )
    lengths = [r6(f"length_{side}").alias(f"length_{side}") for side in ("chosen", "rejected")]
    return spark.read.parquet(target).select("pair_id", "split", *lengths)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        read_pairs, read_scored_samples, read_keyed_json, read_column_json, read_many_json, read_interchange,
        arrow_interchange, write_table, write_no_clobber, resumable_write, resumable_stream,
    )
}

_DIGESTS = "pair_id, context, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5, split"

ORACLES: dict[str, str] = {
    "read_pairs": sql(PAIRS, body=f"SELECT {_DIGESTS} FROM pairs WHERE split = 'train'"),
    "read_scored_samples": sql(SAMPLES_NUM, body="SELECT prompt, event_id, response, score_a, score_b FROM samples_num"),
    "read_keyed_json": "SELECT cast(doc_id AS string) AS row_key, source AS prompt, 2 AS n, md5(text) AS first_md5, lang AS second FROM documents",
    "read_column_json": sql(
        SAMPLES_NUM,
        "twice AS (SELECT unnest([1, 2]) AS time)",
        body="SELECT 'list' AS layout, prompt, response, score_a AS score, row_number() OVER (PARTITION BY time, event_id // 1000 ORDER BY event_id) - 1 AS row_index FROM samples_num, twice "
        "UNION ALL SELECT 'map', prompt, response, score_a, event_id % 1000 FROM samples_num, twice",
    ),
    "read_many_json": sql(
        SAMPLES_NUM,
        f"files AS (SELECT greatest({FILES}, (count(DISTINCT event_id // 1000) + {DOCUMENTS_PER_FILE - 1}) // {DOCUMENTS_PER_FILE}) AS files FROM samples_num)",
        body="SELECT prompt, response, score_a AS score, cast(NULL AS string) AS missing, event_id // 1000 % files AS part, "
        "row_number() OVER (PARTITION BY event_id // 1000 % files ORDER BY event_id) - 1 AS in_file, "
        "count(*) OVER () AS numbers, count(*) OVER () AS reached FROM samples_num, files",
    ),
    "read_interchange": SELECTION_SQL["bon_candidates"],
    "arrow_interchange": SELECTION_SQL["bon_candidates"],
    "write_table": sql(
        PAIRS,
        body=" UNION ALL ".join(f"SELECT {_DIGESTS}, '{f}' AS format FROM pairs" for f in sinks.FORMATS),
    ),
    "write_no_clobber": sql(PAIRS, body=f"SELECT {_DIGESTS} FROM pairs"),
    "resumable_write": sql(PAIRS, body=f"SELECT {_DIGESTS} FROM pairs"),
    "resumable_stream": sql(
        PAIRS,
        body="SELECT pair_id, split, round(length(chosen) / 100.0, 6) AS length_chosen, "
        "round(length(rejected) / 100.0, 6) AS length_rejected FROM pairs",
    ),
}
