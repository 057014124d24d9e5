"""Shared pieces of the registered queries: SQL forms of the derived inputs, and models with given weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.features import add_features
from prefspark.functions.text import response_length
from prefspark.operators.labels import randomize_sides
from prefspark.operators.models import RewardModel
from prefspark.operators.rating import RUBRIC_FEATURES, rate_pairs_wide
from prefspark.plans import inputs
from prefspark.session import settle

Query = Callable[[SparkSession, str], DataFrame]

FEATURES = (*RUBRIC_FEATURES, "length")
SIDE_SEED = 11


def given_model(name: str, sign: float = 1.0) -> RewardModel:
    """A model with plain, fixed numbers, so that both engines compute the same rewards."""
    size = len(FEATURES)
    return RewardModel(
        name,
        FEATURES,
        tuple(1.0 + i for i in range(size)),
        tuple(2.0 + i % 3 for i in range(size)),
        tuple((1.0 if i % 2 == 0 else sign) * (i + 1) / 10 for i in range(size)),
        reward_mean=0.25,
        reward_std=1.5,
    )


MODEL_A, MODEL_B = given_model("model_a"), given_model("model_b", -0.5)


def rated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with the rubric ratings and the length of both sides, stored without their texts."""
    rated = rate_pairs_wide(inputs.pairs(spark, sf_dir))
    measured = add_features(
        rated, {"chosen": "chosen", "rejected": "rejected"}, "context", {"length": response_length}
    )
    return settle(measured.drop("chosen", "rejected"), "rated_pairs")


def sided_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rated pairs with keyed sides a and b."""
    return randomize_sides(rated_pairs(spark, sf_dir), "pair_id", SIDE_SEED, FEATURES, response=None)


def r6(value: str | Column) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6)


# --- SQL ---------------------------------------------------------------------------------------------------


def sql(*ctes: str, body: str) -> str:
    return ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body


def q6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0"


def quote(text: str) -> str:
    """A Python text as an SQL text expression."""
    return "('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


PAIRS = """pairs AS (
WITH j AS (SELECT d.doc_id, d.lang, d.source, d.text, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM j WHERE quality = 1),
b AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY lang) AS nb FROM j WHERE quality = 0)
SELECT g.doc_id AS pair_id, concat(g.source, '/', g.lang) AS context, g.text AS chosen, b.text AS rejected, b.doc_id AS rejected_id,
       CASE WHEN substr(md5(concat('7:', cast(g.doc_id AS string))), 1, 1) < '8' THEN 'train' ELSE 'test' END AS split
FROM g JOIN b ON g.lang = b.lang AND b.rn = ((g.rn - 1) % b.nb) + 1)"""

SAMPLES = """samples AS (
SELECT source AS prompt, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sample_idx, doc_id, text AS response FROM documents)"""

SAMPLES_NUM = """samples_num AS (
SELECT concat('u', cast(user_id AS string)) AS prompt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sample_idx,
       event_id, concat(event_type, '#', cast(event_id AS string)) AS response, value AS score_a,
       cast(regexp_extract(props, '([0-9]+)', 1) AS double) AS score_b
FROM events)"""

TRANSCRIPTS = """transcripts AS (
SELECT conv_id, string_agg((CASE WHEN role = 'user' THEN chr(10)||chr(10)||'Human: ' ELSE chr(10)||chr(10)||'Assistant: ' END) || text, '' ORDER BY turn) AS t
FROM conversations WHERE role <> 'system' GROUP BY 1)"""

TRANSCRIPT_PAIRS = (
    TRANSCRIPTS
    + """,
cut AS (SELECT conv_id, t, string_split(t, chr(10)||chr(10)||'Assistant: ') AS a, string_split(t, chr(10)||chr(10)||'Human: ') AS h FROM transcripts),
transcript_pairs AS (
SELECT x.conv_id, CASE WHEN x.conv_id % 2 = 0 THEN array_to_string(x.h[1:2], chr(10)||chr(10)||'Human: ') ELSE x.t END AS chosen,
       x.a[1] || chr(10)||chr(10)||'Assistant: ' || y.a[len(y.a)] AS rejected
FROM cut x JOIN cut y ON y.conv_id = x.conv_id + 1)"""
)

RATING_REPLIES = """rating_replies AS (
SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat(cast(event_id % 13 AS string), ' out of 10') WHEN 1 THEN cast(event_id % 13 AS string)
       WHEN 2 THEN concat(' ', cast(event_id % 13 AS string)) WHEN 3 THEN concat('score ', cast(event_id % 13 AS string))
       ELSE concat(cast(event_id % 13 AS string), '.5') END AS reply
FROM events)"""

JUDGE_REPLIES = """judge_replies AS (
WITH o AS (SELECT o_orderkey, cast(o_orderkey % 10 + 1 AS string) AS a, cast(o_custkey % 10 + 1 AS string) AS b FROM orders)
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN concat(a, ' ', b, chr(10), 'because') WHEN 1 THEN concat('Assistant 1: ', a, chr(10), 'Assistant 2: ', b)
       WHEN 2 THEN concat(a, chr(10), b) WHEN 3 THEN 'no idea' WHEN 4 THEN concat('Assistant 1: ', a)
       ELSE concat('  ', a, '.5   ', b, chr(10), 'x') END AS reply
FROM o)"""

JUDGE_SCORES = (
    JUDGE_REPLIES
    + r""",
judge_scores AS (
SELECT o_orderkey,
  CASE WHEN regexp_matches(reply, '(?m)^\s*([\d.]+)\s+([\d.]+)\s*$')
       THEN regexp_extract(reply, '(?m)^\s*([\d.]+)\s+([\d.]+)\s*$', 1) || ' ' || regexp_extract(reply, '(?m)^\s*([\d.]+)\s+([\d.]+)\s*$', 2)
       WHEN regexp_matches(reply, '(?:Assistant 1:|Assistant 2:)\s+(\d+)')
       THEN array_to_string(regexp_extract_all(reply, '(?:Assistant 1:|Assistant 2:)\s+(\d+)', 1), ' ')
       ELSE '0 0' END AS scores,
  NOT (regexp_matches(reply, '(?m)^\s*([\d.]+)\s+([\d.]+)\s*$') OR regexp_matches(reply, '(?:Assistant 1:|Assistant 2:)\s+(\d+)')) AS parse_failed
FROM judge_replies)"""
)

TOKENS = """tokens AS (
SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS token, -value / 10 AS logprob FROM events)"""


def ratings_sql(name: str, source: str, text: str, context: str, keep: str) -> str:
    """CTEs ending in ``name``: the kept columns, one rating column per rubric feature, and the length."""
    percent = "(sh * 100 // greatest(cwn, 1))"
    ratings = [
        "1 + least(words // 20, 9)",
        "1 + least(dw // 15, 9)",
        "1 + least(sh, 9)",
        "1 + least(digits // 2, 9)",
        "11 - (1 + least((chars // greatest(words, 1)) // 2, 9))",
        f"1 + least({percent} // 10, 9)",
        "11 - (1 + least((words // greatest(stops, 1)) // 4, 9))",
        "1 + least(breaks // 2, 9)",
        "1 + least(shouts, 9)",
        "11 - (1 + least(sh // 2, 9))",
        "1 + least((dw * 100 // greatest(words, 1)) // 10, 9)",
        f"1 + least({percent} // 20, 9)",
        "11 - (1 + least(words // 50, 9))",
    ]
    named = ", ".join(f'{r} AS "{f}"' for r, f in zip(ratings, RUBRIC_FEATURES))
    return rf"""{name}_sig AS (
SELECT {keep}, {text} AS t, regexp_extract_all(lower({text}), '\S+') AS w, list_distinct(regexp_extract_all(lower({context}), '\S+')) AS cw FROM {source}),
{name}_cnt AS (
SELECT {keep}, length(t) AS chars, len(w) AS words, len(list_distinct(w)) AS dw, len(cw) AS cwn, len(list_intersect(cw, list_distinct(w))) AS sh,
  length(t) - length(translate(t, '0123456789', '')) AS digits, length(t) - length(translate(t, '.!?', '')) AS stops,
  length(t) - length(translate(t, '!', '')) AS shouts, length(t) - length(translate(t, chr(10), '')) AS breaks FROM {name}_sig),
{name} AS (SELECT {keep}, {named}, chars / 100.0 AS length FROM {name}_cnt)"""


RATED = ",\n".join(
    [
        PAIRS,
        "pair_sides AS (SELECT pair_id, context, split, 'chosen' AS side, chosen AS text FROM pairs UNION ALL "
        "SELECT pair_id, context, split, 'rejected', rejected FROM pairs)",
        ratings_sql("rated_long", "pair_sides", "text", "context", "pair_id, split, side"),
        "rated AS (SELECT c.pair_id, c.split, "
        + ", ".join(f'c."{f}" AS "{f}_chosen", r."{f}" AS "{f}_rejected"' for f in FEATURES)
        + " FROM rated_long c JOIN rated_long r ON c.pair_id = r.pair_id WHERE c.side = 'chosen' AND r.side = 'rejected')",
    ]
)

_HEADS = f"substr(md5(concat('{SIDE_SEED}:', cast(pair_id AS string))), 1, 1) < '8'"

SIDED = (
    RATED
    + ",\nsided AS (SELECT pair_id, split, CASE WHEN "
    + _HEADS
    + " THEN 1 ELSE 0 END AS labels, "
    + ", ".join(
        f'CASE WHEN {_HEADS} THEN "{f}_chosen" ELSE "{f}_rejected" END AS "{f}_a", '
        f'CASE WHEN {_HEADS} THEN "{f}_rejected" ELSE "{f}_chosen" END AS "{f}_b"'
        for f in FEATURES
    )
    + " FROM rated)"
)


def reward_sql(model: RewardModel, suffix: str = "") -> str:
    return " + ".join(
        f"""("{f}{suffix}" - {m}::double) / {s}::double * {w}::double"""
        for f, m, s, w in zip(model.features, model.means, model.stds, model.coefs)
    )


def pair_scores_sql(model: RewardModel) -> str:
    """CTE ``<model>_scores`` over ``sided``."""
    a, b = reward_sql(model, "_a"), reward_sql(model, "_b")
    return (
        f"{model.name}_ab AS (SELECT pair_id, split, labels, {a} AS score_a, {b} AS score_b FROM sided),\n"
        f"{model.name}_scores AS (SELECT '{model.name}' AS model, pair_id, split, "
        "CASE WHEN labels = 1 THEN score_a ELSE score_b END AS score_chosen, "
        f"CASE WHEN labels = 1 THEN score_b ELSE score_a END AS score_rejected, score_a, score_b FROM {model.name}_ab)"
    )
