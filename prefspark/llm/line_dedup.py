"""Removal of lines that many documents share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.session import settle

MIN_CHARS = 40
MIN_DOCS = 5
_BLANK = " \t\n\x0b\f\r"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    slow = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(slow)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_BLANK)))


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """Per row ``doc_id, n_lines, n_dropped, kept_text``: lines in ``min_docs`` documents stay in the largest id only.

    Lines are exploded once to a written table (document, position, 128-bit digest of the normalised line); texts stay
    behind. Documents of
    a digest are counted over distinct (digest, document), first combined inside each task, so a line that a third of
    all documents hold is never one task's group. Digests over the limit are written first, so their size is known:
    Spark broadcasts them where they are few and splits skewed join partitions where they are not. The positions to drop come back as one array per document, and the
    remaining lines are joined by position.

    Null text is one empty line. A null id counts for no document and keeps no shared line. Rows with one id are one
    document when documents are counted, and each gets its own text back. No rows in, no rows out. Other columns are
    ignored.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = rows.select("doc_id", F.xxhash64("text").alias("text_key"), F.split("text", "\n", -1).alias("lines"))
    keyed = settle(
        split.select("doc_id", "text_key", F.posexplode("lines").alias("pos", "line"))
        .select("doc_id", "text_key", "pos", line_key(F.col("line")).alias("line"))
        .where(F.char_length("line") >= min_chars)
        .select("doc_id", "text_key", "pos", F.unhex(F.md5("line")).alias("key")),
        "line_keys",
    )
    common = settle(
        keyed.select("key", "doc_id")
        .distinct()
        .groupBy("key")
        .agg(F.count("doc_id").alias("docs"), F.max("doc_id").alias("last"))
        .where(F.col("docs") >= min_docs),
        "shared_lines",
    )
    dropped = (
        keyed.join(common, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
        .agg(F.collect_set("pos").alias("dropped"))
    )
    joined = split.join(dropped, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    all_lines = F.sequence(F.lit(0), F.size("lines") - 1)
    kept = F.array_except(all_lines, F.coalesce("dropped", F.array().cast("array<int>")))
    return joined.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("dropped").isNull(), F.array_join("lines", "\n"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
        .alias("kept_text"),
    )
