"""Exact deduplication that stays even when one text holds a third of all rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.session import settle

SALTS = 16


def sha256_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _salted(few: DataFrame, salts: int) -> DataFrame:
    """Rows of a table of distinct digests once for each salt."""
    return few.withColumn("salt", F.explode(F.array(*map(F.lit, range(salts)))))


def exact_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_of,
) -> DataFrame:
    """Class of every row under equality of the whole text: ``doc_id, keep_id, group_size, kept, digest``.

    1. Ids and digests are written once; a digest met once is a class of its own and its text never moves.
    2. Texts of the other digests are combined by digest *and* text, so two texts never meet on their digest alone: Spark's partial
       aggregate combines copies inside each task, a shuffle by (digest, text, salt) merges at most ``salts`` parts of a
       group, and a second one combines the winners of the parts.
    3. Rows find the winners of their class by digest, and by digest and text where two texts share one.

    Every join on a digest is salted by the place of a row, so neither a text nor a null id that a third of all rows share is one task's group.

    Null text counts as empty. The largest id stays; a null id is below all others and stays only where the class has
    no other. Of rows that repeat both id and text one is kept. No rows in, no rows out. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(salts)).cast("int")
    keyed = rows.select("doc_id", digest(F.col("text")).alias("digest"), "text", place.alias("salt"))
    narrow = keyed.select("doc_id", "digest", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    narrow = settle(narrow, "exact_digests")
    often = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    often = settle(often, "exact_shared")
    # The same plan at every size: texts meet the repeated digests by a sort-merge join, also where these are few.
    copies = keyed.join(_salted(often, salts).hint("merge"), ["digest", "salt"], "left_semi")
    parts = copies.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    classes = parts.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    stored = settle(classes.select("digest", "keep_id", "group_size"), "exact_classes")
    clashes = stored.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    clashes = settle(clashes, "exact_clashes")
    own = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id")
    shown = ["doc_id", own, F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), "digest"]
    if clashes.isEmpty():
        placed = narrow.join(_salted(stored, salts), ["digest", "salt"], "left").select(*shown, F.lit(0).cast("long").alias("text_no"))
    else:
        single = narrow.join(clashes, "digest", "left_anti").join(_salted(stored, salts), ["digest", "salt"], "left")
        inside = keyed.join(clashes, "digest", "left_semi").drop("salt")
        by_text = inside.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        numbered = by_text.withColumn("text_no", F.xxhash64("text"))
        among = inside.join(numbered, ["digest", "text"]).select(*shown, "text_no")
        placed = single.select(*shown, F.lit(0).cast("long").alias("text_no")).unionByName(among)
    placed = settle(placed.withColumn("row", F.monotonically_increasing_id()), "exact_placed")
    # Of rows that repeat id and text the first stays. They are looked for only among rows that could stay.
    staying = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    same = placed.where(staying & (F.col("group_size") > 1)).groupBy("doc_id", "digest", "text_no")
    repeated = same.agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first")).where("n > 1")
    repeated = settle(repeated.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), F.col("text_no").alias("r_no"), "first"), "exact_repeated")
    kept = staying
    if not repeated.isEmpty():
        salted = repeated.withColumn("r_salt", F.explode(F.array(*map(F.lit, range(salts)))))
        again = (
            staying & F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest"))
            & (F.col("text_no") == F.col("r_no")) & (F.pmod("row", F.lit(salts)) == F.col("r_salt"))
        )
        placed = placed.join(salted, again, "left")
        kept = staying & (F.col("first").isNull() | (F.col("row") == F.col("first")))
    return placed.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")
