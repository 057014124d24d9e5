"""Registered queries: best-of-n, candidates, chunks, rating and judging."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from prefspark.functions.text import has_judge_scores, parse_judge_scores, parse_rating, token_count
from prefspark.operators import judge, rating, reshape, select
from prefspark.plans import flows, inputs
from prefspark.plans.registered.common import (
    JUDGE_SCORES,
    PAIRS,
    RATED,
    RATING_REPLIES,
    SAMPLES_NUM,
    Query,
    q6,
    quote,
    r6,
    sql,
)

from prefspark.session import settle

ORDER = ("ts", "event_id")
SIDES = ("chosen", "rejected")


def best_of_n(spark, sf_dir):
    return select.best_of_n(inputs.samples_num(spark, sf_dir), order_by=ORDER)


def bon_curve(spark, sf_dir):
    curve = select.bon_curve(select.best_of_n(inputs.samples_num(spark, sf_dir), order_by=ORDER))
    rounded = [r6(f"{part}_{side}").alias(f"{part}_{side}") for part in ("mean", "std", "low", "high") for side in "ab"]
    return curve.select("n", *rounded, "prompts")


def bon_band(spark, sf_dir):
    band = select.bon_band(select.best_of_n(inputs.samples_num(spark, sf_dir), order_by=ORDER))
    return band.select("n", *[r6(f"{part}_{side}").alias(f"{part}_{side}") for part in ("mean", "low", "high") for side in "ab"], "replicates")


def bon_candidates(spark, sf_dir):
    picked = select.bon_candidates(inputs.samples_num(spark, sf_dir), ["score_a", "score_b"], order_by=ORDER)
    return picked.select("model", "prompt", F.element_at("response", 1).alias("baseline"), F.element_at("response", 2).alias("best"))


def chunk_samples(spark, sf_dir):
    chunked = select.chunk_samples(inputs.samples_num(spark, sf_dir), order_by=ORDER)
    return chunked.select("prompt", "chunk", "event_id", "response")


def _chunk_candidates(spark, sf_dir):
    chunked = select.chunk_samples(inputs.samples_num(spark, sf_dir), order_by=ORDER)
    return select.bon_candidates(chunked, ["score_a", "score_b"], order_by=ORDER, by=["chunk"])


def chunk_candidates(spark, sf_dir):
    picked = _chunk_candidates(spark, sf_dir)
    return picked.select(
        "model", "chunk", "prompt", F.element_at("response", 1).alias("baseline"), F.element_at("response", 2).alias("best")
    )


def _event_number(answer: str) -> F.Column:
    return F.regexp_extract(answer, "([0-9]+)$", 1).cast("bigint")


def _digit_reply(answer1, answer2) -> F.Column:
    """A judge that scores by the last digit of the event numbers and has no idea about every seventeenth."""
    first, second = _event_number(answer1), _event_number(answer2)
    scores = F.concat((first % 10 + 1).cast("string"), F.lit(" "), (second % 10).cast("string"))
    return F.when(first % 17 == 0, "no idea").otherwise(scores)


def preference_rate(spark, sf_dir):
    """Candidates judged in both orders, then win rates over chunks."""
    tasks = judge.render_judge_task(_chunk_candidates(spark, sf_dir))
    replies = judge.scored_replies(tasks.withColumn("reply", _digit_reply("answer1", "answer2")))
    return _rates(judge.judge_debias(replies, ["model", "chunk", "prompt"]))


def _rates(debiased):
    rates = judge.preference_rate(debiased)
    shares = [r6(f"{o}{s}").alias(f"{o}{s}") for o in ("win", "tie", "loss") for s in ("", "_std")]
    return rates.select("model", *shares, "chunks", "n", "failed")


def _digit_judge():
    """The same judge reading the task's text, as a model would, one call per batch."""
    numbers = re.compile(r"#([0-9]+)")

    def judged(text: str) -> str:
        first, second = (int(n) for n in numbers.findall(text)[-2:])
        return "no idea" if first % 17 == 0 else f"{first % 10 + 1} {second % 10}"

    return lambda texts: [judged(text) for text in texts]


def judge_candidates(spark, sf_dir):
    """Two proxy scores and an external one, which some samples lack: candidates, both orders, win rates."""
    samples = inputs.samples_num(spark, sf_dir)
    external = samples.where("event_id % 3 <> 0").select(
        "prompt", "response", (F.col("event_id") * 7 % 101).cast("double").alias("score")
    )
    rates = flows.judge_candidates(samples, ["score_a", "score_b"], ORDER, external, _digit_judge)
    shares = [r6(f"{o}{s}").alias(f"{o}{s}") for o in ("win", "tie", "loss") for s in ("", "_std")]
    return rates.select("model", *shares, "chunks", "n", "failed")


def judge_record(spark, sf_dir):
    """Both tasks, both replies and the debiased scores of every comparison of a pair."""
    compared = inputs.pairs(spark, sf_dir).select(
        "pair_id", F.col("context").alias("prompt"), F.array("rejected", "chosen").alias("response")
    )
    replies = judge.judge_with(judge.render_judge_task(compared, count_words=True))
    judged = judge.scored_replies(replies)
    records = judge.judge_record(judged, ["pair_id"])
    return records.select(
        "pair_id", F.md5("prompt").alias("prompt_md5"), F.md5("prompt_swap").alias("swap_md5"), "response", "response_swap",
        "assistant1", "assistant2",
    )


def select_and_judge(spark, sf_dir):
    """Good against bad answers with the offline judge, in both orders."""
    counts = settle(inputs.documents(spark, sf_dir, "doc_id", "text").select("doc_id", token_count("text").alias("words")), "word_counts")
    sides = [counts.withColumnsRenamed({"doc_id": key, "words": f"{key}_words"}) for key in ("pair_id", "rejected_id")]
    keys = inputs.pair_keys(spark, sf_dir).select("pair_id", "rejected_id", "split")
    compared = keys.join(sides[0], "pair_id").join(sides[1], "rejected_id")
    replies = judge.scored_replies(judge.judge_with(judge.judged_by_words(compared, "rejected_id_words", "pair_id_words")))
    debiased = judge.judge_debias(replies, ["pair_id", "split"])
    rates = judge.preference_rate(debiased, by=["split"], chunk=None)
    return rates.select("split", *[r6(o).alias(o) for o in ("win", "tie", "loss")], "n", "failed")


def _both_sides(spark, sf_dir):
    return reshape.pairs_to_long(
        inputs.pairs(spark, sf_dir).select("pair_id", "context", "chosen", "rejected"), SIDES, [], bare=["response"]
    )


def render_rating_task(spark, sf_dir):
    tasks = rating.render_rating_task(_both_sides(spark, sf_dir), kind="shp")
    return tasks.select("pair_id", "side", "feature_pos", "feature", F.md5("task").alias("task_md5"))


def render_judge_task(spark, sf_dir):
    compared = inputs.pairs(spark, sf_dir).select(
        "pair_id", F.col("context").alias("prompt"), F.array("chosen", "rejected").alias("response")
    )
    tasks = judge.render_judge_task(compared)
    return tasks.select("pair_id", "order", F.md5("answer1").alias("answer1_md5"), F.md5("task").alias("task_md5"))


def parse_rating_replies(spark, sf_dir):
    return inputs.rating_replies(spark, sf_dir).select("event_id", parse_rating("reply").alias("rating"))


def parse_judge_replies(spark, sf_dir):
    return inputs.judge_replies(spark, sf_dir).select(
        "o_orderkey", parse_judge_scores("reply").alias("scores"), (~has_judge_scores("reply")).alias("parse_failed")
    )


def judge_scores_to_numbers(spark, sf_dir):
    scored = inputs.judge_replies(spark, sf_dir).select("o_orderkey", parse_judge_scores("reply").alias("scores"))
    return judge.with_numbers(scored).select("o_orderkey", "score1", "score2", "reason")


def _both_orders(spark, sf_dir):
    """Judge replies of neighbouring orders taken as the two orders of one comparison."""
    good, _ = judge.judge_scores_to_numbers(parse_judge_replies(spark, sf_dir))
    return good.select(
        F.floor(F.col("o_orderkey") / 2).alias("comparison"),
        F.when(F.col("o_orderkey") % 2 == 0, "direct").otherwise("swapped").alias("order"),
        "score1",
        "score2",
    )


def judge_debias(spark, sf_dir):
    return judge.judge_debias(_both_orders(spark, sf_dir), ["comparison"])


def judge_debias_wide(spark, sf_dir):
    both = _both_orders(spark, sf_dir)
    direct, swapped = (both.where(F.col("order") == o) for o in judge.ORDERS)
    return judge.judge_debias_wide(direct, swapped, ["comparison"])


def judge_with(spark, sf_dir):
    compared = inputs.pairs(spark, sf_dir).select(
        "pair_id", F.col("context").alias("prompt"), F.array("chosen", "rejected").alias("response")
    )
    replies = judge.judge_with(judge.render_judge_task(compared, count_words=True))
    return replies.select("pair_id", "order", "reply")


def rate_with(spark, sf_dir):
    return rating.rate_samples(_both_sides(spark, sf_dir)).select("pair_id", "side", "feature", "rating")


def _count_words():
    """A rater that needs the task text itself: it stands where a model would, one call per batch."""
    word = re.compile(r"\S+", re.ASCII)
    return lambda texts: [f"{min(10, 1 + len(word.findall(text)) // 40)} of 10" for text in texts]


def rate_with_plugin(spark, sf_dir):
    long = rating.rate_samples(_both_sides(spark, sf_dir), rater=_count_words)
    return long.select("pair_id", "side", "feature", "rating")


QUERIES: dict[str, Query] = {
    "best_of_n": best_of_n,
    "bon_curve": bon_curve,
    "bon_band": bon_band,
    "bon_candidates": bon_candidates,
    "chunk_samples": chunk_samples,
    "chunk_candidates": chunk_candidates,
    "preference_rate": preference_rate,
    "judge_candidates": judge_candidates,
    "judge_record": judge_record,
    "select_and_judge": select_and_judge,
    "render_rating_task": render_rating_task,
    "render_judge_task": render_judge_task,
    "parse_rating": parse_rating_replies,
    "parse_judge_scores": parse_judge_replies,
    "judge_scores_to_numbers": judge_scores_to_numbers,
    "judge_debias": judge_debias,
    "judge_debias_wide": judge_debias_wide,
    "judge_with": judge_with,
    "rate_with": rate_with,
    "rate_with_plugin": rate_with_plugin,
}

_BON = f"""sizes AS (SELECT unnest([1, 2, 4, 8, 16]) AS n),
reach AS (SELECT prompt, count(*) AS rows_total FROM samples_num GROUP BY prompt),
bon AS (SELECT n, score_a AS best_score_a, score_b AS best_score_b, response, s.prompt FROM samples_num s CROSS JOIN sizes WHERE sample_idx <= n
QUALIFY row_number() OVER (PARTITION BY s.prompt, n ORDER BY score_a DESC, sample_idx) = 1)"""

_CHUNKS = """cnt AS (SELECT prompt, count(*) AS c FROM samples_num GROUP BY prompt),
chunked AS (SELECT s.*, chunk FROM samples_num s JOIN cnt USING (prompt) CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5]) AS chunk)
WHERE sample_idx <= least(c, (chunk + 1) * 16) AND sample_idx > least(c, (chunk + 1) * 16) - 16)"""


def _candidates(source: str, keys: str, models: tuple[str, ...] = ("score_a", "score_b")) -> str:
    each = " UNION ALL ".join(f"SELECT {keys}, sample_idx, response, '{m}' AS model, {m} AS score FROM {source}" for m in models)
    return f"""models AS ({each}),
best AS (SELECT model, {keys}, response AS best FROM models QUALIFY row_number() OVER (PARTITION BY model, {keys} ORDER BY score DESC, sample_idx) = 1),
base AS (SELECT {keys}, response AS baseline FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY sample_idx) = 1),
candidates AS (SELECT model, {keys}, baseline, best FROM best JOIN base USING ({keys}))"""


_SIDES_SQL = """sides AS (SELECT pair_id, context, 'chosen' AS side, chosen AS response FROM pairs UNION ALL
SELECT pair_id, context, 'rejected', rejected FROM pairs)"""


def _rating_task_sql(kind: str, response: str, result: str) -> str:
    opening, context_mark, reply_mark = rating._FRAMES[kind]
    rubric = " UNION ALL ".join(
        f"SELECT {i} AS feature_pos, {quote(r.feature)} AS feature, {quote(r.description)} AS d, {quote(r.low)} AS lo, {quote(r.high)} AS hi"
        for i, r in enumerate(rating.RUBRIC)
    )
    text = " || ".join(
        [
            quote(opening), "d", quote(". Use whole numbers from 1 ("), "lo", quote(") to 10 ("), "hi", quote(")."),
            quote(context_mark), "context", quote(reply_mark), response, quote("\n\nReply with the number alone.\n\nNumber:"),
        ]
    )
    return sql(
        PAIRS, _SIDES_SQL, f"rubric AS ({rubric})",
        body=f"SELECT pair_id, side, feature, {result.format(text)} FROM sides CROSS JOIN rubric",
    )


def word_rating_sql(response: str) -> str:
    """Ratings by the number of words in the task, as :func:`_count_words` gives them."""
    return _rating_task_sql("hh", response, "cast(least(10, 1 + len(regexp_extract_all({0}, '\\S+')) // 40) AS bigint) AS rating")


def _judge_task_sql() -> str:
    question, first, second, before = judge._FRAMES["hh"]
    text = " || ".join(
        [quote(judge._OPENING), quote(question), "context", quote(first), "a1", quote(second), "a2", quote(before), quote(judge._CLOSING)]
    )
    return sql(
        PAIRS,
        "o AS (SELECT pair_id, context, 'direct' AS \"order\", chosen AS a1, rejected AS a2 FROM pairs UNION ALL SELECT pair_id, context, 'swapped', rejected, chosen FROM pairs)",
        body=f'SELECT pair_id, "order", md5(a1) AS answer1_md5, md5({text}) AS task_md5 FROM o',
    )


_RULE = "least(len(regexp_extract_all({0}, '\\S+')) // 15 + 1 + {1}, 10)"


def _judge_record_sql() -> str:
    text = " || ".join(
        [quote(judge._OPENING), quote(judge._FRAMES["hh"][0]), "context", quote(judge._FRAMES["hh"][1]), "{0}",
         quote(judge._FRAMES["hh"][2]), "{1}", quote(judge._FRAMES["hh"][3]), quote(judge._CLOSING)]
    )
    reply = "cast(" + _RULE.format("{0}", 1) + " AS string) || ' ' || cast(" + _RULE.format("{1}", 0) + " AS string)"
    mean = "(" + _RULE.format("{0}", 1) + " + " + _RULE.format("{0}", 0) + ") / 2.0"
    return sql(
        PAIRS,
        body=f"SELECT pair_id, md5({text.format('rejected', 'chosen')}) AS prompt_md5, md5({text.format('chosen', 'rejected')}) AS swap_md5, "
        f"{reply.format('rejected', 'chosen')} AS response, {reply.format('chosen', 'rejected')} AS response_swap, "
        f"{mean.format('rejected')} AS assistant1, {mean.format('chosen')} AS assistant2 FROM pairs",
    )


_NUMBERS = r"""numbers AS (SELECT o_orderkey, string_split(scores, ' ') AS p FROM judge_scores),
parsed AS (SELECT o_orderkey, CASE WHEN len(p) = 2 THEN cast(p[1] AS double) END AS score1, CASE WHEN len(p) = 2 THEN cast(p[2] AS double) END AS score2,
CASE WHEN len(p) <> 2 THEN 'not two scores' END AS reason FROM numbers),
orders_of AS (SELECT o_orderkey // 2 AS comparison, o_orderkey % 2 AS swapped, score1, score2 FROM parsed WHERE reason IS NULL)"""


_JUDGED = rf"""pair_orders AS (SELECT pair_id, split, 'direct' AS "order", rejected AS a1, chosen AS a2 FROM pairs UNION ALL SELECT pair_id, split, 'swapped', chosen, rejected FROM pairs),
rule AS (SELECT pair_id, split, "order", {_RULE.format('a1', 1)} AS s1, {_RULE.format('a2', 0)} AS s2 FROM pair_orders),
debiased AS (SELECT pair_id, split, avg(CASE WHEN "order" = 'direct' THEN s1 ELSE s2 END) AS assistant1, avg(CASE WHEN "order" = 'direct' THEN s2 ELSE s1 END) AS assistant2 FROM rule GROUP BY 1, 2)"""


def _share(test: str) -> str:
    return f"avg(CASE WHEN {test} THEN 1.0 ELSE 0.0 END)"


_WINS = {"win": "assistant2 > assistant1", "tie": "assistant2 = assistant1", "loss": "assistant2 < assistant1"}

_RATES = (
    "e AS (SELECT model, chunk, cast(regexp_extract(baseline, '([0-9]+)$', 1) AS bigint) AS x, cast(regexp_extract(best, '([0-9]+)$', 1) AS bigint) AS y FROM candidates)",
    "d AS (SELECT model, chunk, x % 17 = 0 OR y % 17 = 0 AS failed, (x % 10 + 1 + x % 10) / 2 AS assistant1, (y % 10 + y % 10 + 1) / 2 AS assistant2 FROM e)",
    "per AS (SELECT model, chunk, "
    + ", ".join(f"avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END) FILTER (NOT failed) AS {o}" for o, t in _WINS.items())
    + ", count(*) FILTER (NOT failed) AS n, count(*) FILTER (failed) AS failed FROM d GROUP BY 1, 2)",
)
_RATE_ROWS = (
    "SELECT model, " + ", ".join(f"{q6(f'avg({o})')} AS {o}, {q6(f'stddev_samp({o})')} AS {o}_std" for o in _WINS)
    + ", count(*) AS chunks, cast(sum(n) AS bigint) AS n, cast(sum(failed) AS bigint) AS failed FROM per GROUP BY model"
)

ORACLES: dict[str, str] = {
    "best_of_n": sql(SAMPLES_NUM, _BON, body="SELECT n, best_score_a, best_score_b, response, prompt FROM bon"),
    "bon_band": sql(
        SAMPLES_NUM,
        _BON,
        "drawn AS (SELECT prompt, rep, ('0x' || substr(md5('0:' || rep || ':' || prompt), 1, 8))::BIGINT / 4294967296.0::double AS u "
        f"FROM (SELECT DISTINCT prompt FROM bon), (SELECT unnest(range(1, {select.REPLICATES + 1})) AS rep))",
        "times AS (SELECT prompt, rep, " + " + ".join(f"(u >= {p!r}::double)::bigint" for p in select._DRAWN) + " AS times FROM drawn)",
        "curves AS (SELECT n, rep, "
        + ", ".join(f"sum(times * best_score_{s}) / sum(times) FILTER (best_score_{s} IS NOT NULL) AS mean_{s}" for s in "ab")
        + " FROM bon JOIN times USING (prompt) WHERE times > 0 GROUP BY n, rep)",
        "ends AS (SELECT n, "
        + ", ".join(f"quantile_cont(mean_{s}, {(1 - 0.95) / 2!r}) AS low_{s}, quantile_cont(mean_{s}, {1 - (1 - 0.95) / 2!r}) AS high_{s}" for s in "ab")
        + ", count(*) AS replicates FROM curves GROUP BY n)",
        "means AS (SELECT n, avg(best_score_a) AS mean_a, avg(best_score_b) AS mean_b FROM bon GROUP BY n)",
        body="SELECT n, " + ", ".join(f"{q6(f'{part}_{s}')} AS {part}_{s}" for part in ("mean", "low", "high") for s in "ab") + ", replicates FROM means JOIN ends USING (n)",
    ),
    "bon_curve": sql(
        SAMPLES_NUM,
        _BON,
        body="SELECT n, "
        + ", ".join(
            f"{q6(f'avg(best_score_{s})')} AS mean_{s}, {q6(f'stddev_samp(best_score_{s})')} AS std_{s}, "
            f"{q6(f'avg(best_score_{s}) - 1.96 * stddev_samp(best_score_{s}) / sqrt(count(*))')} AS low_{s}, "
            f"{q6(f'avg(best_score_{s}) + 1.96 * stddev_samp(best_score_{s}) / sqrt(count(*))')} AS high_{s}"
            for s in "ab"
        )
        + ", count(*) AS prompts FROM bon GROUP BY n",
    ),
    "bon_candidates": sql(SAMPLES_NUM, _candidates("samples_num", "prompt"), body="SELECT model, prompt, baseline, best FROM candidates"),
    "chunk_samples": sql(SAMPLES_NUM, _CHUNKS, body="SELECT prompt, chunk, event_id, response FROM chunked"),
    "chunk_candidates": sql(
        SAMPLES_NUM, _CHUNKS, _candidates("chunked", "chunk, prompt"), body="SELECT model, chunk, prompt, baseline, best FROM candidates"
    ),
    "preference_rate": sql(SAMPLES_NUM, _CHUNKS, _candidates("chunked", "chunk, prompt"), *_RATES, body=_RATE_ROWS),
    "judge_candidates": sql(
        SAMPLES_NUM.replace("samples_num AS", "all_samples AS", 1),
        "samples_num AS (SELECT prompt, row_number() OVER (PARTITION BY prompt ORDER BY sample_idx) AS sample_idx, event_id, response, score_a, score_b, "
        "event_id * 7 % 101 AS external FROM all_samples WHERE event_id % 3 <> 0)",
        _CHUNKS, _candidates("chunked", "chunk, prompt", ("score_a", "score_b", "external")), *_RATES, body=_RATE_ROWS,
    ),
    "judge_record": _judge_record_sql(),
    "select_and_judge": sql(
        PAIRS, _JUDGED,
        body="SELECT split, " + ", ".join(f"{q6(_share(t))} AS {o}" for o, t in _WINS.items())
        + ", count(*) AS n, cast(0 AS bigint) AS failed FROM debiased GROUP BY split",
    ),
    "render_rating_task": _rating_task_sql("shp", "response", "feature_pos, md5({0}) AS task_md5"),
    "rate_with_plugin": word_rating_sql("response"),
    "render_judge_task": _judge_task_sql(),
    "parse_rating": sql(
        RATING_REPLIES, body=r"SELECT event_id, try_cast(nullif(regexp_extract(reply, '^\d+'), '') AS bigint) AS rating FROM rating_replies"
    ),
    "parse_judge_scores": sql(JUDGE_SCORES, body="SELECT o_orderkey, scores, parse_failed FROM judge_scores"),
    "judge_scores_to_numbers": sql(JUDGE_SCORES, _NUMBERS, body="SELECT o_orderkey, score1, score2, reason FROM parsed"),
    "judge_debias": sql(
        JUDGE_SCORES,
        _NUMBERS,
        body="SELECT comparison, CASE WHEN count(*) = 2 THEN avg(CASE swapped WHEN 0 THEN score1 ELSE score2 END) END AS assistant1, "
        "CASE WHEN count(*) = 2 THEN avg(CASE swapped WHEN 0 THEN score2 ELSE score1 END) END AS assistant2 FROM orders_of GROUP BY comparison",
    ),
    "judge_debias_wide": sql(
        JUDGE_SCORES,
        _NUMBERS,
        body="SELECT d.comparison, (d.score1 + s.score2) / 2 AS assistant1, (d.score2 + s.score1) / 2 AS assistant2 "
        "FROM orders_of d JOIN orders_of s ON d.comparison = s.comparison AND d.swapped = 0 AND s.swapped = 1",
    ),
    "judge_with": sql(
        PAIRS,
        rf"""o AS (SELECT pair_id, 'direct' AS "order", chosen AS a1, rejected AS a2 FROM pairs UNION ALL SELECT pair_id, 'swapped', rejected, chosen FROM pairs)""",
        body=f"""SELECT pair_id, "order", {_RULE.format('a1', 1)} || ' ' || {_RULE.format('a2', 0)} || chr(10) || 'counted words' AS reply FROM o""",
    ),
    "rate_with": sql(
        RATED,
        body=" UNION ALL ".join(
            f"""SELECT pair_id, '{side}' AS side, '{f}' AS feature, "{f}_{side}" AS rating FROM rated"""
            for f in rating.RUBRIC_FEATURES for side in SIDES
        ),
    ),
}
