"""Preference-data inputs derived from the given tables: pairs, samples, transcripts, replies and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.ordering import keyed_draw, with_position
from prefspark.functions.text import ASSISTANT, HUMAN
from prefspark.session import settle, spread

#: Roles whose turns make up a transcript: preference data knows these two headers.
DIALOGUE_ROLES = ("user", "assistant")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents for work on their whole texts."""
    return spread(table(spark, sf_dir, "documents").select(*columns), "doc_id")


def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every good document with a bad one of the same language, in turn; key ``pair_id``. No texts.

    The ranks serve the good side, the bad side and the counts, so they are stored once.
    """
    described = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labelled = described.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    ranked = settle(with_position(labelled, ["lang", "quality"], ["doc_id"], "rn"), "ranked_documents")
    good = ranked.where("quality = 1").select("doc_id", "lang", "source", "rn")
    bad = ranked.where("quality = 0").select("lang", F.col("rn").alias("bad_rn"), F.col("doc_id").alias("rejected_id"))
    per_lang = ranked.where("quality = 0").groupBy("lang").agg(F.count(F.lit(1)).alias("nb"))
    train = F.substr(keyed_draw(7, "doc_id"), F.lit(1), F.lit(1)) < F.lit("8")
    return (
        good.join(per_lang, "lang")
        .withColumn("bad_rn", F.pmod(F.col("rn") - 1, F.col("nb")) + 1)
        .join(bad, ["lang", "bad_rn"])
        .select(
            F.col("doc_id").alias("pair_id"),
            F.concat("source", F.lit("/"), "lang").alias("context"),
            "rejected_id",
            F.when(train, "train").otherwise("test").alias("split"),
        )
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair keys with the texts of both documents."""
    texts = documents(spark, sf_dir, "doc_id", "text")
    chosen = texts.select(F.col("doc_id").alias("pair_id"), F.col("text").alias("chosen"))
    rejected = texts.select(F.col("doc_id").alias("rejected_id"), F.col("text").alias("rejected"))
    return (
        spread(settle(pair_keys(spark, sf_dir), "pair_keys"), "pair_id")
        .join(chosen, "pair_id")
        .join(rejected, "rejected_id")
        .select("pair_id", "context", "chosen", "rejected", "rejected_id", "split")
    )


def numbered_documents(df: DataFrame) -> DataFrame:
    """Add ``sample_idx``, the number of a document among those of its source (``prompt``)."""
    return with_position(df, ["prompt"], ["doc_id"], "sample_idx")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as responses to their source, numbered by document; texts repeat.

    Only keys are numbered; a text moves once, by its own document.
    """
    keys = table(spark, sf_dir, "documents").select(F.col("source").alias("prompt"), "doc_id")
    texts = documents(spark, sf_dir, "doc_id", "text").withColumnRenamed("text", "response")
    return numbered_documents(keys).join(texts, "doc_id").select("prompt", "sample_idx", "doc_id", "response")


def samples_num(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples of their user with two scores. ``ts`` and ``event_id`` give the order."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("prompt"),
        "ts",
        "event_id",
        F.concat("event_type", F.lit("#"), F.col("event_id").cast("string")).alias("response"),
        F.col("value").alias("score_a"),
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("score_b"),
    )


def transcripts(spark: SparkSession, sf_dir: str, roles: Sequence[str] = DIALOGUE_ROLES) -> DataFrame:
    """One text per dialogue: its turns in order, each behind its role's header. Turns of other roles are left out."""
    turns = table(spark, sf_dir, "conversations").where(F.col("role").isin(*roles))
    part = F.concat(F.when(F.col("role") == "user", HUMAN).otherwise(ASSISTANT), "text").alias("part")
    told = turns.select("conv_id", "turn", part).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part"))).alias("p"))
    return told.select("conv_id", F.array_join(F.col("p.part"), "").alias("t"))


def transcript_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dialogue, or its first round for every other one, beside its own opening with the next dialogue's last reply."""
    dialogues = transcripts(spark, sf_dir)
    replies = dialogues.select(
        (F.col("conv_id") - 1).alias("conv_id"), F.substring_index("t", ASSISTANT, -1).alias("reply")
    )
    first_round = F.substring_index("t", HUMAN, 2)
    return dialogues.join(replies, "conv_id").select(
        "conv_id",
        F.when(F.col("conv_id") % 2 == 0, first_round).otherwise(F.col("t")).alias("chosen"),
        F.concat(F.substring_index("t", ASSISTANT, 1), F.lit(ASSISTANT), "reply").alias("rejected"),
    )


def rating_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rater output, well and badly formed."""
    digit = F.pmod("event_id", F.lit(13)).cast("string")
    kind = F.pmod("event_id", F.lit(5))
    reply = (
        F.when(kind == 0, F.concat(digit, F.lit(" out of 10")))
        .when(kind == 1, digit)
        .when(kind == 2, F.concat(F.lit(" "), digit))
        .when(kind == 3, F.concat(F.lit("score "), digit))
        .otherwise(F.concat(digit, F.lit(".5")))
    )
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))


def judge_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw judge output in six shapes."""
    a = (F.pmod("o_orderkey", F.lit(10)) + 1).cast("string")
    b = (F.pmod("o_custkey", F.lit(10)) + 1).cast("string")
    kind = F.pmod("o_orderkey", F.lit(6))
    reply = (
        F.when(kind == 0, F.concat(a, F.lit(" "), b, F.lit("\nbecause")))
        .when(kind == 1, F.concat(F.lit("Assistant 1: "), a, F.lit("\nAssistant 2: "), b))
        .when(kind == 2, F.concat(a, F.lit("\n"), b))
        .when(kind == 3, "no idea")
        .when(kind == 4, F.concat(F.lit("Assistant 1: "), a))
        .otherwise(F.concat(F.lit("  "), a, F.lit(".5   "), b, F.lit("\nx")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", reply.alias("reply"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sequences with log-probabilities; end token ``purchase``, pad token ``error``."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    ranked = with_position(events, ["user_id"], ["ts", "event_id"], "rank")
    return ranked.select(
        F.col("user_id").alias("sample_id"),
        (F.col("rank") - 1).alias("pos"),
        F.col("event_type").alias("token"),
        (-F.col("value") / 10).alias("logprob"),
    )
