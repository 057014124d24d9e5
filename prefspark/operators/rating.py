"""Rubric, rating tasks and raters."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefspark.functions.features import add_lexical_signals
from prefspark.functions.text import parse_rating, strip_role_headers


@dataclass(frozen=True)
class RubricRow:
    """One rated feature: what is asked, and what the ends of the 1–10 scale mean."""

    feature: str
    description: str
    low: str
    high: str


# The feature names, spelled as the rated data sets spell them ("biased" without its colon).
RUBRIC_FEATURES = (
    "helpfulness",
    "specificity",
    "intent",
    "factuality",
    "easy-to-understand",
    "relevance",
    "readability",
    "enough-detail",
    "biased",
    "fail-to-consider-individual-preferences",
    "repetetive",
    "fail-to-consider-context",
    "too-long",
)

_WORDING = (
    ("would help the asker get further", "of no use", "of great use"),
    ("gives particulars instead of generalities", "entirely vague", "full of particulars"),
    ("shows that the asker's aim was grasped", "aim missed", "aim fully grasped"),
    ("states things that are true", "grossly wrong", "wholly right"),
    ("can be followed without effort", "hard to follow", "effortless to follow"),
    ("stays with what was asked", "beside the point", "exactly to the point"),
    ("reads smoothly at the asker's level", "tiring to read", "pleasant to read"),
    ("goes into as much depth as the asker needs", "far too thin", "thorough"),
    ("takes one side unfairly", "strongly slanted", "even-handed"),
    ("passes over the asker's own background and tastes", "they are respected", "they are passed over"),
    ("says the same thing again and again", "constant repetition", "no repetition"),
    ("passes over the situation described", "situation passed over", "situation respected"),
    ("goes on longer than it should", "much too long", "of fitting length"),
)

RUBRIC = tuple(RubricRow(name, *words) for name, words in zip(RUBRIC_FEATURES, _WORDING))

_FRAMES = {
    "shp": ("Below are a forum post and one answer to it. Decide how far the answer ", "\n\nPOST:\n", "\n\nReply:\n"),
    "hh": (
        "Below are a person's message to an assistant and the assistant's answer. Decide how far the answer ",
        "\n\nHuman:\n",
        "\n\nAssistant:\n",
    ),
}


def rubric_table(spark: SparkSession, rubric: Sequence[RubricRow] = RUBRIC) -> DataFrame:
    """The rubric as a dimension table with ``feature_pos`` from 0."""
    return spark.createDataFrame(
        [(i, r.feature, r.description, r.low, r.high) for i, r in enumerate(rubric)],
        "feature_pos int, feature string, description string, low string, high string",
    )


def _rubric_rows(rubric: Sequence[RubricRow]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("feature_pos"),
                F.lit(r.feature).alias("feature"),
                F.lit(r.description).alias("description"),
                F.lit(r.low).alias("low"),
                F.lit(r.high).alias("high"),
            )
            for i, r in enumerate(rubric)
        ]
    )


def task_text(kind: str, context: Column, response: Column, description: Column, low: Column, high: Column) -> Column:
    """The rater's task. Texts are concatenated in place, so braces inside them stay as they are."""
    opening, context_mark, reply_mark = _FRAMES[kind]
    return F.concat(
        F.lit(opening),
        description,
        F.lit(". Use whole numbers from 1 ("),
        low,
        F.lit(") to 10 ("),
        high,
        F.lit(")."),
        F.lit(context_mark),
        context,
        F.lit(reply_mark),
        response,
        F.lit("\n\nReply with the number alone.\n\nNumber:"),
    )


def render_rating_task(
    samples: DataFrame,
    rubric: Sequence[RubricRow] = RUBRIC,
    kind: str = "hh",
    context: str = "context",
    response: str = "response",
    strip_headers: bool = False,
    keep_texts: bool = False,
) -> DataFrame:
    """One task per sample and rubric row, in column ``task``.

    The rubric is a literal array, so the thirteen-fold growth happens inside the scanning task, without a
    join. Texts leave with the rendering unless ``keep_texts``.
    """
    shown = strip_role_headers(context) if strip_headers else F.col(context)
    texts = [] if keep_texts else [c for c in (context, response) if c in samples.columns]
    kept = [c for c in samples.columns if c not in texts]
    tasks = samples.withColumn("_rubric", F.explode(_rubric_rows(rubric)))
    rendered = task_text(
        kind, shown, F.col(response), F.col("_rubric.description"), F.col("_rubric.low"), F.col("_rubric.high")
    )
    return tasks.select(
        *kept, F.col("_rubric.feature_pos").alias("feature_pos"), F.col("_rubric.feature").alias("feature"), rendered.alias("task")
    )


def _ratio(top: str, bottom: str) -> str:
    """Whole-number quotient, zero over zero being zero."""
    return f"floor({top} / greatest({bottom}, 1))"


def _band(signal: str, step: int, falling: bool = False) -> str:
    """A signal cut into ten bands of equal width, 1 the lowest; ``falling`` gives large signals low ratings."""
    band = f"least(floor({signal} / {step}), 9)"
    return f"10 - {band}" if falling else f"1 + {band}"


def lexical_ratings(signals: str) -> dict[str, Column]:
    """A 1–10 rating per rubric feature from the counts of :func:`add_lexical_signals`."""
    s = f"`{signals}`"
    shared_percent = _ratio(f"{s}.shared_words * 100", f"{s}.context_words")
    bands = (
        _band(f"{s}.words", 20),
        _band(f"{s}.distinct_words", 15),
        _band(f"{s}.shared_words", 1),
        _band(f"{s}.digits", 2),
        _band(_ratio(f"{s}.chars", f"{s}.words"), 2, falling=True),
        _band(shared_percent, 10),
        _band(_ratio(f"{s}.words", f"{s}.stops"), 4, falling=True),
        _band(f"{s}.line_breaks", 2),
        _band(f"{s}.shouts", 1),
        _band(f"{s}.shared_words", 2, falling=True),
        _band(_ratio(f"{s}.distinct_words * 100", f"{s}.words"), 10),
        _band(shared_percent, 20),
        _band(f"{s}.words", 50, falling=True),
    )
    return {name: F.expr(f"cast({band} as bigint)") for name, band in zip(RUBRIC_FEATURES, bands)}


def lexical_reply(signals: str, feature: str | Column = "feature") -> Column:
    """The offline rater's reply text for the feature of a task."""
    feature = F.col(feature) if isinstance(feature, str) else feature
    choice = None
    for name, rating in lexical_ratings(signals).items():
        choice = F.when(feature == name, rating) if choice is None else choice.when(feature == name, rating)
    return choice.cast("string")


Rater = Callable[[], Callable[[Sequence[str]], Sequence[str | None]]]


def rate_with(
    tasks: DataFrame, rater: Rater | None = None, task: str = "task", out: str = "reply", signals: str = "signals"
) -> DataFrame:
    """Add a reply per task.

    Without a rater the offline lexical one reads the ``signals`` struct and stays inside Spark expressions.
    A rater is a factory: it runs once per Spark task and returns a function from a batch of task texts to
    replies. A batch that fails is tried text by text, and a text that fails gets a null reply.
    """
    if rater is None:
        return tasks.withColumn(out, lexical_reply(signals))
    schema = T.StructType([*tasks.schema.fields, T.StructField(out, T.StringType())])

    def one(call, text):
        try:
            return list(call([text]))[0]
        except Exception:
            return None

    def run(batches: Iterator) -> Iterator:
        call = rater()
        for batch in batches:
            texts = batch[task].tolist()
            try:
                replies = list(call(texts))
                if len(replies) != len(texts):
                    raise ValueError("one reply per task is needed")
            except Exception:
                replies = [one(call, text) for text in texts]
            batch[out] = replies
            yield batch

    return tasks.mapInPandas(run, schema)


def rate_samples(
    samples: DataFrame,
    context: str = "context",
    response: str = "response",
    rater: Rater | None = None,
    kind: str = "hh",
    rubric: Sequence[RubricRow] = RUBRIC,
    store: str | None = None,
    name: str = "",
) -> DataFrame:
    """Long ratings (sample columns, feature, rating) of every sample on every rubric feature.

    A plugged-in rater is called once for each distinct task, and its replies are kept in ``store`` (``replied``).
    """
    if rater is None:
        measured = add_lexical_signals(samples, response, context)
        kept = [c for c in samples.columns if c not in (context, response)]
        named = F.array(
            *[
                F.struct(F.lit(i).alias("feature_pos"), F.lit(name).alias("feature"), rating.cast("string").alias("reply"))
                for i, (name, rating) in enumerate(lexical_ratings("signals").items())
                if name in {r.feature for r in rubric}
            ]
        )
        replies = measured.select(*kept, F.inline(named))
    else:
        from prefspark.operators.replies import replied

        def render(rows: DataFrame) -> DataFrame:
            return render_rating_task(rows, rubric, kind, context, response)

        replies = replied(samples, rater, store, name, render=render, within=["feature_pos"])
    return replies.withColumn("rating", parse_rating("reply")).drop("reply")


def rate_pairs_wide(
    pairs: DataFrame, context: str = "context", sides: Sequence[str] = ("chosen", "rejected"), prefix: str = ""
) -> DataFrame:
    """Lexical ratings of both sides as ``<prefix><feature>_<side>`` columns: row-local, no shuffle."""
    measured = pairs
    for side in sides:
        measured = add_lexical_signals(measured, side, context, f"_signals_{side}")
    ratings = {
        f"{prefix}{name}_{side}": rating
        for side in sides
        for name, rating in lexical_ratings(f"_signals_{side}").items()
    }
    return measured.withColumns(ratings).drop(*[f"_signals_{s}" for s in sides])
