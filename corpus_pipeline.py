"""A corpus from documents to tokens: toxicity, exact dedup, near dedup, mixing, encoding.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and returns a DataFrame; ``run``
writes each result to the shared folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from prefspark.llm.labelled import labelled_sample, remainder
from prefspark.session import settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject. It learns on labelled ``docs`` outside the held-out part.

    Rows pass through the scoring task whole, so no text is shuffled to meet its score. Null and empty texts score like
    texts without a known word, repeated rows score alike, and rows without an id teach nothing. No rows in, no rows out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = remainder("doc_id", 5) != 0
    sample = labelled_sample(docs, labels, "toxic", learn, toxicity.TRAIN_ROWS, "text", "lang")
    return toxicity.drop_toxic(docs, toxicity.fit(sample))


def _packed(docs: DataFrame) -> DataFrame:
    """Documents as one column ``row``, so that no column of theirs meets one of a stage's own."""
    return docs.select(F.struct(*docs.columns).alias("row"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest id. A null text is an empty one.

    Only rows that repeat both id and text meet as whole rows, to leave one of them; all others pass through.
    """
    decided = exact_dedup.exact_dedup(docs).groupBy("doc_id", "digest")
    decided = settle(decided.agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "exact_decisions")
    dropped = settle(decided.where("NOT kept").select(F.col("doc_id").alias("id"), F.col("digest").alias("key")), "dropped")
    digest = exact_dedup.sha256_of(F.coalesce("row.text", F.lit("")))
    alike = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("key"))
    # The same join at every size; whole rows move once.
    kept = _packed(docs).withColumn("digest", digest).join(dropped.hint("merge"), alike, "left_anti")
    repeated = settle(decided.where("kept AND n > 1").select(F.col("doc_id").alias("id"), F.col("digest").alias("key")), "repeated")
    if not repeated.isEmpty():
        among = kept.join(repeated, alike, "left_semi").groupBy("row.doc_id", "digest").agg(F.first("row").alias("row"))
        kept = kept.join(repeated, alike, "left_anti").select("row").unionByName(among.select("row"))
    return kept.select("row.*")


#: Similarity, in percent of the union of two shingle sets, from which documents are near copies of each other.
NEAR_PERCENT = 85


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts: that with the smallest id, or one text where no row has an id.

    Rows without an id are found by their text, all others by id alone.
    """
    decided = near_dedup.decisions(docs, percent=NEAR_PERCENT).where("NOT kept")
    key = F.when(F.col("doc_id").isNull(), F.col("text_key"))
    dropped = settle(decided.select(F.col("doc_id").alias("id"), key.alias("key")).distinct(), "near_dropped")
    own = F.when(F.col("row.doc_id").isNull(), near_dedup.text_key(F.col("row.text")))
    alike = F.col("row.doc_id").eqNullSafe(F.col("id")) & own.eqNullSafe(F.col("key"))
    return _packed(docs).join(dropped.hint("merge"), alike, "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them: some not at all, some up to three times.

    Documents without words (null, empty, blank) have no share and go. A null source is a source. No rows in, no rows out.
    """
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the decoded text of each document of the mixture; null counts as empty."""
    return bpe.encode_decode(docs, ("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("bpe", encode),
]

#: The classifier and the merges are beyond SQL; tests/llm compares the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
