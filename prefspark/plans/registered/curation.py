"""Registered queries: filters, samples, splits, column choices and text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import text
from prefspark.operators import curate, reshape
from prefspark.operators.rating import RUBRIC_FEATURES, rate_pairs_wide
from prefspark.plans import inputs
from prefspark.plans.registered.common import (
    PAIRS,
    RATED,
    RATING_REPLIES,
    SAMPLES,
    SIDED,
    TRANSCRIPT_PAIRS,
    TRANSCRIPTS,
    Query,
    quote,
    r6,
    rated_pairs,
    sided_pairs,
    sql,
)

HOLDOUT = 100


def single_round_filter(spark, sf_dir):
    kept = curate.single_round_filter(inputs.transcript_pairs(spark, sf_dir), ["chosen", "rejected"])
    return kept.select("conv_id", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


def max_length_filter(spark, sf_dir):
    kept = curate.max_length_filter(inputs.pairs(spark, sf_dir), ["chosen", "rejected"], 1000)
    chars = [F.length(side).cast("bigint").alias(f"{side}_chars") for side in ("chosen", "rejected")]
    return kept.select("pair_id", *chars)


def drop_incomplete(spark, sf_dir):
    rated = inputs.rating_replies(spark, sf_dir).withColumn("rating", text.parse_rating("reply"))
    return curate.drop_incomplete(rated).select("event_id", "rating")


def sample_n(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return curate.sample_n(documents, "doc_id", 100, 42).select("doc_id", "source", F.md5("text").alias("text_md5"))


def take_first(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    nested = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("rows"))
    first = curate.take_first(nested.select("conv_id", F.col("rows.text").alias("text")), "conv_id", 100, "text", 3)
    return first.select("conv_id", F.size("text").alias("parts"), F.md5(F.array_join("text", "|")).alias("text_md5"))


def half_split(spark, sf_dir):
    documents = inputs.table(spark, sf_dir, "documents").select("doc_id", "source")
    return curate.half_split(documents, "doc_id").select("doc_id", "split")


def select_split(spark, sf_dir):
    pairs = inputs.pair_keys(spark, sf_dir).select("pair_id", "split")
    roles = curate.select_split(pairs, "all", "pair_id", HOLDOUT).withColumnRenamed("role", "role_all")
    roles = curate.select_split(roles, "test", "pair_id").withColumnRenamed("role", "role_test")
    roles = curate.select_split(roles, "train", "pair_id").withColumnRenamed("role", "role_train")
    return roles.select("pair_id", "role_all", "role_test", "role_train")


def prune_columns(spark, sf_dir):
    pruned = curate.prune_columns(
        sided_pairs(spark, sf_dir), ["helpfulness", "too-long", "length"], keep=("pair_id", "labels")
    )
    return pruned.toDF("pair_id", "labels", "help_a", "help_b", "long_a", "long_b", "length_a", "length_b")


def round_features(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events").select("event_id", "value", (F.floor("value") + 0.5).alias("half"))
    return curate.round_features(events, ["value", "half"])


def select_features(spark, sf_dir):
    names = curate.select_features(RUBRIC_FEATURES, prefix="zeroshot_", subset="short")
    rated = rate_pairs_wide(inputs.pairs(spark, sf_dir), prefix="zeroshot_")
    for side in ("chosen", "rejected"):
        rated = reshape.feature_array(rated, names, side, out=f"features_{side}")
    return rated.select(
        "pair_id",
        *[F.get(f"features_{s}", F.lit(i)).alias(f"f{i}_{s}") for s in ("chosen", "rejected") for i in range(len(names))],
    )


def drop_duplicates(spark, sf_dir):
    kept = curate.drop_duplicates(inputs.samples(spark, sf_dir), ["prompt", "response"], ["sample_idx"])
    return kept.select("prompt", "sample_idx", "doc_id", F.md5("response").alias("response_md5"))


def drop_duplicate_rows(spark, sf_dir):
    texts = inputs.table(spark, sf_dir, "documents").select("source", "text")
    return curate.drop_duplicates(texts).select("source", F.md5("text").alias("text_md5"))


def prompt_of_transcript(spark, sf_dir):
    return inputs.transcripts(spark, sf_dir).select(
        "conv_id", F.md5(text.prompt_of_transcript("t")).alias("prompt_md5")
    )


def split_prompt_response(spark, sf_dir):
    good, rejects = curate.split_prompt_response(inputs.transcript_pairs(spark, sf_dir))
    none = F.lit(None).cast("string")
    split = good.select(
        "conv_id", none.alias("reason"), F.md5("prepend").alias("prepend_md5"),
        F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"),
    )
    held = rejects.select(
        "conv_id", "reason", none.alias("prepend_md5"), none.alias("chosen_md5"), none.alias("rejected_md5")
    )
    return split.unionByName(held)


def render_context(spark, sf_dir):
    pairs = inputs.pairs(spark, sf_dir).select("pair_id", "context", "chosen", "rejected")
    full = curate.apply_context(pairs, "hh-rlhf", sides=("chosen", "rejected"))
    split = curate.apply_context(full.withColumnsRenamed({"chosen": "full_chosen", "rejected": "full_rejected"}), "shp-prepend_split")
    return split.select(
        "pair_id", "prepend", F.md5("full_chosen").alias("chosen_md5"), F.md5("full_rejected").alias("rejected_md5")
    )


def rewrite_role_headers(spark, sf_dir):
    posts = inputs.transcripts(spark, sf_dir).withColumn("post", text.rewrite_role_headers("t", "shp"))
    back = text.rewrite_role_headers("post", "hh")
    return posts.select("conv_id", F.md5("post").alias("post_md5"), F.md5(back).alias("back_md5"))


def strip_role_headers(spark, sf_dir):
    return inputs.transcripts(spark, sf_dir).select(
        "conv_id",
        F.md5(text.strip_role_headers("t")).alias("bare_md5"),
        F.md5(text.strip_role_headers("t", legacy_headers=True)).alias("legacy_md5"),
    )


def response_length(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", r6(text.response_length("text")).alias("length"))


def token_count(spark, sf_dir):
    return inputs.table(spark, sf_dir, "documents").select("doc_id", text.token_count("text").alias("tokens"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        single_round_filter, max_length_filter, drop_incomplete, sample_n, take_first, half_split, select_split,
        prune_columns, round_features, select_features, drop_duplicates, drop_duplicate_rows, prompt_of_transcript,
        split_prompt_response, render_context, rewrite_role_headers, strip_role_headers, response_length, token_count,
    )
}


def _occurs_once(column: str, mark: str) -> str:
    return f"(length({column}) - length(replace({column}, {quote(mark)}, ''))) = length({quote(mark)})"


def _chained(column: str, old: tuple[str, ...], new: tuple[str, ...]) -> str:
    for before, after in zip(old, new):
        column = f"replace({column}, {quote(before)}, {quote(after)})"
    return column


_BARE = ("", "", "", "")
_POSTED = _chained("t", (text.HUMAN, text.ASSISTANT), (text.POST, text.RESPONSE))

ORACLES: dict[str, str] = {
    "single_round_filter": sql(
        TRANSCRIPT_PAIRS,
        body="SELECT conv_id, md5(chosen) AS chosen_md5, md5(rejected) AS rejected_md5 FROM transcript_pairs WHERE "
        + " AND ".join(_occurs_once(c, m) for c in ("chosen", "rejected") for m in text.TURN_MARKS),
    ),
    "max_length_filter": sql(
        PAIRS,
        body="SELECT pair_id, length(chosen) AS chosen_chars, length(rejected) AS rejected_chars FROM pairs "
        "WHERE length(chosen) < 1000 AND length(rejected) < 1000",
    ),
    "drop_incomplete": sql(
        RATING_REPLIES,
        body=r"SELECT event_id, cast(regexp_extract(reply, '^\d+') AS bigint) AS rating FROM rating_replies WHERE regexp_matches(reply, '^\d+')",
    ),
    "sample_n": "SELECT doc_id, source, md5(text) AS text_md5 FROM documents ORDER BY md5(concat('42:', cast(doc_id AS string))), cast(doc_id AS string) LIMIT 100",
    "take_first": """WITH d AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
k AS (SELECT DISTINCT conv_id FROM d ORDER BY 1 LIMIT 100)
SELECT conv_id, cast(count(*) AS integer) AS parts, md5(string_agg(text, '|' ORDER BY turn)) AS text_md5 FROM d JOIN k USING (conv_id) WHERE rn <= 3 GROUP BY conv_id""",
    "half_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) FROM documents) // 2 THEN 'train' ELSE 'test' END AS split FROM documents",
    "select_split": sql(
        PAIRS,
        f"r AS (SELECT pair_id, split, row_number() OVER (PARTITION BY split ORDER BY pair_id DESC) AS back FROM pairs)",
        body=f"SELECT pair_id, CASE WHEN split = 'test' AND back <= {HOLDOUT} THEN 'test' ELSE 'train' END AS role_all, "
        "CASE WHEN split = 'train' THEN 'test' ELSE 'train' END AS role_test, split AS role_train FROM r",
    ),
    "prune_columns": sql(
        SIDED,
        body='SELECT pair_id, labels, "helpfulness_a"::double AS help_a, "helpfulness_b"::double AS help_b, "too-long_a"::double AS long_a, '
        '"too-long_b"::double AS long_b, length_a, length_b FROM sided',
    ),
    "round_features": "SELECT event_id, round_even(value, 0) AS value, round_even(floor(value) + 0.5, 0) AS half FROM events",
    "select_features": sql(
        RATED,
        body='SELECT pair_id, "readability_chosen"::double AS f0_chosen, "enough-detail_chosen"::double AS f1_chosen, '
        '"fail-to-consider-context_chosen"::double AS f2_chosen, "readability_rejected"::double AS f0_rejected, '
        '"enough-detail_rejected"::double AS f1_rejected, "fail-to-consider-context_rejected"::double AS f2_rejected FROM rated',
    ),
    "drop_duplicates": sql(
        SAMPLES,
        body="SELECT prompt, sample_idx, doc_id, md5(response) AS response_md5 FROM samples "
        "QUALIFY row_number() OVER (PARTITION BY prompt, response ORDER BY sample_idx) = 1",
    ),
    "drop_duplicate_rows": "SELECT source, md5(text) AS text_md5 FROM (SELECT DISTINCT source, text FROM documents)",
    "prompt_of_transcript": sql(
        TRANSCRIPTS,
        f"p AS (SELECT conv_id, string_split(t, {quote(text.PROMPT_HEADER)}) AS parts FROM transcripts)",
        body=f"SELECT conv_id, md5(array_to_string(parts[1:len(parts) - 1], {quote(text.PROMPT_HEADER)}) || {quote(text.PROMPT_HEADER)}) AS prompt_md5 FROM p",
    ),
    "split_prompt_response": sql(
        TRANSCRIPT_PAIRS,
        f"p AS (SELECT conv_id, string_split(chosen, {quote(text.ASSISTANT)}) AS c, string_split(rejected, {quote(text.ASSISTANT)}) AS r FROM transcript_pairs)",
        "s AS (SELECT *, CASE WHEN len(c) <> 2 THEN 'chosen has ' || len(c) || ' parts' WHEN len(r) < 2 THEN 'rejected has no response' END AS reason FROM p)",
        body=f"""SELECT conv_id, reason, CASE WHEN reason IS NULL THEN md5(c[1] || {quote(text.ASSISTANT)}) END AS prepend_md5,
CASE WHEN reason IS NULL THEN md5(c[2]) END AS chosen_md5, CASE WHEN reason IS NULL THEN md5(r[2]) END AS rejected_md5 FROM s""",
    ),
    "render_context": sql(
        PAIRS,
        body=f"""SELECT pair_id, {quote(text.POST)} || context || {quote(text.RESPONSE)} AS prepend,
md5({quote(text.HUMAN)} || context || {quote(text.ASSISTANT)} || chosen) AS chosen_md5,
md5({quote(text.HUMAN)} || context || {quote(text.ASSISTANT)} || rejected) AS rejected_md5 FROM pairs""",
    ),
    "rewrite_role_headers": sql(
        TRANSCRIPTS,
        body=f"SELECT conv_id, md5({_POSTED}) AS post_md5, md5({_chained(_POSTED, (text.POST, text.RESPONSE), (text.HUMAN, text.ASSISTANT))}) AS back_md5 FROM transcripts",
    ),
    "strip_role_headers": sql(
        TRANSCRIPTS,
        body=f"SELECT conv_id, md5({_chained('t', (text.HUMAN, text.ASSISTANT, text.POST, text.RESPONSE), _BARE)}) AS bare_md5, "
        f"md5({_chained('t', (text.HUMAN, text.LEGACY_ASSISTANT, text.POST, text.RESPONSE), _BARE)}) AS legacy_md5 FROM transcripts",
    ),
    "response_length": "SELECT doc_id, round(length(text) / 100.0, 6) AS length FROM documents",
    "token_count": r"SELECT doc_id, cast(len(regexp_extract_all(text, '\S+')) AS bigint) AS tokens FROM documents",
}
