"""Comparison tasks, judge replies, order-debiased scores and win rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.text import (
    ASSISTANT,
    HUMAN,
    has_judge_scores,
    parse_judge_scores,
    strip_role_headers,
    token_count,
)
from prefspark.operators.rating import Rater
from prefspark.operators.replies import replied

ORDERS = ("direct", "swapped")

_FRAMES = {
    "hh": ("\n[Question]\n", "\n[Answer of Assistant 1]\n", "\n[Answer of Assistant 2]\n", "\n\n"),
    "shp": ("\n[Question]\n", "\n\n[Answer of Assistant 1]\n", "\n\n[Answer of Assistant 2]\n", "\n\n[Task]\n"),
}

_OPENING = "Two assistants answered the question below. Compare their answers fairly.\n"
_CLOSING = (
    "Weigh usefulness, fit to the question, truth and depth. On the first line write two numbers from 1 to 10 "
    "with a blank between them, for Assistant 1 and Assistant 2. Explain the numbers on the next line. "
    "The order of the answers must not matter.\n"
)


def _task(kind: str, question: Column, answer1: Column, answer2: Column) -> Column:
    question_mark, first_mark, second_mark, before_closing = _FRAMES[kind]
    return F.concat(
        F.lit(_OPENING),
        F.lit(question_mark),
        question,
        F.lit(first_mark),
        answer1,
        F.lit(second_mark),
        answer2,
        F.lit(before_closing),
        F.lit(_CLOSING),
    )


def render_judge_task(
    df: DataFrame,
    indices: Sequence[int] = (0, 1),
    kind: str = "hh",
    prompt: str = "prompt",
    response: str = "response",
    count_words: bool = False,
) -> DataFrame:
    """Two tasks per comparison, ``direct`` and ``swapped``, with the answers in the order shown.

    ``indices`` are 0-based positions in the response list; one past the end is an error. ``count_words`` adds
    the answers' word counts, taken once per answer, for the offline judge.
    """
    if len(indices) != 2:
        raise ValueError("a comparison needs exactly two responses")
    first, second = (F.element_at(response, i + 1) for i in indices)
    question = strip_role_headers(prompt, (HUMAN, ASSISTANT))
    compared = df.withColumns({"_first": first, "_second": second, "_question": question}).drop(response)
    if count_words:
        compared = compared.withColumns({f"_words{side}": token_count(side) for side in ("_first", "_second")})

    def shown(order: str, answer1: str, answer2: str) -> Column:
        fields = [F.lit(order).alias("order"), F.col(answer1).alias("answer1"), F.col(answer2).alias("answer2")]
        if count_words:
            fields += [F.col(f"_words{answer1}").alias("words1"), F.col(f"_words{answer2}").alias("words2")]
        return F.struct(*fields)

    orders = F.array(shown("direct", "_first", "_second"), shown("swapped", "_second", "_first"))
    kept = [c for c in df.columns if c != response]
    return (
        compared.select(*kept, "_question", F.inline(orders))
        .withColumn("task", _task(kind, F.col("_question"), F.col("answer1"), F.col("answer2")))
        .drop("_question")
    )


def judged_by_words(df: DataFrame, first: str, second: str) -> DataFrame:
    """Both orders of each comparison with nothing but the answers' word counts, which is all the offline judge reads."""
    fields = ("order", "words1", "words2")
    orders = F.array(
        *[F.struct(*[c.alias(n) for c, n in zip((F.lit(o), F.col(a), F.col(b)), fields)]) for o, a, b in zip(ORDERS, (first, second), (second, first))]
    )
    return df.select(*[c for c in df.columns if c not in (first, second)], F.inline(orders))


def rule_based_reply(words1: str | Column = "words1", words2: str | Column = "words2") -> Column:
    """The offline judge's reply: a score per answer from its number of words, the first answer one point up.

    The lean towards the first answer is deliberate; the swapped order has to cancel it.
    """

    def score(words: str | Column, lean: int) -> Column:
        words = F.col(words) if isinstance(words, str) else words
        return F.least(F.floor(words / 15) + 1 + lean, F.lit(10)).cast("string")

    return F.concat(score(words1, 1), F.lit(" "), score(words2, 0), F.lit("\ncounted words"))


def judge_with(
    tasks: DataFrame, judge: Rater | None = None, out: str = "reply", store: str | None = None, name: str = ""
) -> DataFrame:
    """Add the judge's reply per task; without a judge the offline rule reads the answers' word counts.

    A plugged-in judge is called once for each distinct task, and its replies are kept in ``store`` (``replied``).
    """
    if judge is None:
        if "words1" in tasks.columns:
            return tasks.withColumn(out, rule_based_reply()).drop("words1", "words2")
        return tasks.withColumn(out, rule_based_reply(token_count("answer1"), token_count("answer2")))
    return replied(tasks, judge, store, name, out=out)


def with_numbers(df: DataFrame, col: str = "scores") -> DataFrame:
    """Score texts as columns ``score1`` and ``score2``, and the ``reason`` for which a row has none."""
    numbers = F.transform(F.split(F.col(col), " ", -1), lambda p: F.trim(p).try_cast("double"))
    reason = F.when(F.col("_numbers").isNull() | (F.size("_numbers") != 2), "not two scores").when(
        F.exists("_numbers", lambda x: x.isNull()), "not a number"
    )
    marked = df.withColumn("_numbers", numbers).withColumn("reason", reason)
    scores = {f"score{i + 1}": F.when(F.col("reason").isNull(), F.get("_numbers", F.lit(i))) for i in range(2)}
    return marked.withColumns(scores).drop("_numbers")


def judge_scores_to_numbers(df: DataFrame, col: str = "scores") -> tuple[DataFrame, DataFrame]:
    """Score texts as columns ``score1`` and ``score2``; returns (good rows, quarantined rows with a reason).

    Who needs both halves again takes ``scored_replies``, which keeps them in one table.
    """
    marked = with_numbers(df, col)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull()).drop("score1", "score2")


def _with_scores(judged: DataFrame, reply: str) -> DataFrame:
    return judged.withColumns({"scores": parse_judge_scores(reply), "parse_failed": ~has_judge_scores(reply)})


def parse_replies(judged: DataFrame, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """Replies to numbers with ``parse_failed`` set where the reply held no scores; returns (good, quarantined)."""
    return judge_scores_to_numbers(_with_scores(judged, reply), "scores")


def scored_replies(judged: DataFrame, reply: str = "reply") -> DataFrame:
    """Every reply once, with its scores: those without two numbers have null scores, a ``reason`` and ``parse_failed`` set."""
    numbered = with_numbers(_with_scores(judged, reply), "scores")
    return numbered.withColumn("parse_failed", F.col("reason").isNotNull() | F.coalesce("parse_failed", F.lit(True)))


def with_failed(good: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Parsed replies and quarantined ones together: the latter have null scores and ``parse_failed`` set."""
    held = quarantined.drop("reason").withColumn("parse_failed", F.lit(True))
    return good.unionByName(held, allowMissingColumns=True)


def judge_debias(scored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mean score of each answer over both orders: ``assistant1`` and ``assistant2``.

    In the swapped order the second score belongs to the first answer. A comparison without exactly one usable reply
    per order has null scores. Where replies carry ``parse_failed``, a comparison carries it if one of them does.
    """
    direct = F.col("order") == ORDERS[0]
    own = F.when(direct, F.col("score1")).otherwise(F.col("score2"))
    other = F.when(direct, F.col("score2")).otherwise(F.col("score1"))
    usable = F.col("score1").isNotNull() & F.col("score2").isNotNull()
    counts = [F.count_if(F.col("order") == order) == 1 for order in ORDERS]
    both = counts[0] & counts[1] & (F.count_if(usable) == 2) & (F.count(F.lit(1)) == 2)
    carried = []
    if "parse_failed" in scored.columns:
        carried.append(F.coalesce(F.bool_or("parse_failed"), F.lit(False)).alias("parse_failed"))
    return scored.groupBy(*key).agg(
        F.when(both, F.avg(own)).alias("assistant1"), F.when(both, F.avg(other)).alias("assistant2"), *carried
    )


def judge_debias_wide(direct: DataFrame, swapped: DataFrame, key: Sequence[str]) -> DataFrame:
    """The same from one table per order with ``score1`` and ``score2``."""
    other = swapped.select(*key, F.col("score1").alias("_s1"), F.col("score2").alias("_s2"))
    return direct.join(other, list(key)).select(
        *key,
        ((F.col("score1") + F.col("_s2")) / 2).alias("assistant1"),
        ((F.col("score2") + F.col("_s1")) / 2).alias("assistant2"),
    )


def preference_rate(
    judged: DataFrame, by: Sequence[str] = ("model",), chunk: str | None = "chunk", failed_as_tie: bool = False
) -> DataFrame:
    """Share of comparisons the second answer wins, ties and loses, with the spread of the shares over chunks.

    ``assistant1`` is the baseline and ``assistant2`` the model's candidate. ``n`` counts the comparisons with usable
    scores, ``failed`` the others: null scores, and replies without scores. ``failed_as_tie`` takes replies without
    scores as the ``0 0`` they were parsed to.
    """
    usable = F.col("assistant1").isNotNull() & F.col("assistant2").isNotNull()
    if "parse_failed" in judged.columns and not failed_as_tie:
        usable = usable & ~F.coalesce("parse_failed", F.lit(False))
    outcome = {
        "win": F.col("assistant2") > F.col("assistant1"),
        "tie": F.col("assistant2") == F.col("assistant1"),
        "loss": F.col("assistant2") < F.col("assistant1"),
    }
    shares = [F.avg(F.when(usable, test.cast("double"))).alias(name) for name, test in outcome.items()]
    group = [*by, chunk] if chunk else list(by)
    per_chunk = judged.groupBy(*group).agg(*shares, F.count_if(usable).alias("n"), F.count_if(~usable).alias("failed"))
    if not chunk:
        return per_chunk
    summary = []
    for name in outcome:
        summary += [F.avg(name).alias(name), F.stddev_samp(name).alias(f"{name}_std")]
    totals = [F.sum("n").alias("n"), F.sum("failed").alias("failed")]
    return per_chunk.groupBy(*by).agg(*summary, F.count(F.lit(1)).alias("chunks"), *totals)


def judge_record(judged: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per comparison: both tasks, both score texts and the debiased scores."""
    sides = judged.groupBy(*key).agg(
        *[
            F.max(F.when(F.col("order") == order, F.col(source))).alias(target)
            for order, suffix in (("direct", ""), ("swapped", "_swap"))
            for source, target in (("task", f"prompt{suffix}"), ("scores", f"response{suffix}"))
        ]
    )
    return sides.join(judge_debias(judged, key), list(key))
