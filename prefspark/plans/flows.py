"""The reference stages as single plans: annotate, fit, select and judge, compare reward models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.features import add_features, registered_features
from prefspark.operators import curate, joins, judge, labels, select, stats
from prefspark.operators.fit import fit_reward_model
from prefspark.operators.models import RewardModel, score_samples
from prefspark.operators.rating import RUBRIC_FEATURES, Rater, rate_pairs_wide, rate_samples
from prefspark.operators.reshape import long_to_pairs, pairs_to_long, pivot_ratings
from prefspark.session import settle


def annotate_pairs(pairs: DataFrame, rater: Rater | None = None, kind: str = "hh", prefix: str = "") -> DataFrame:
    """Pairs with a rating column per rubric feature and side.

    The offline rater works inside each row. A plugged-in rater gets one task per side and feature; its
    ratings come back to one row per pair with one shuffle of keys and small numbers.
    """
    if rater is None:
        return rate_pairs_wide(pairs, prefix=prefix)
    sides = ("chosen", "rejected")
    texts = pairs.select("pair_id", "context", *sides)
    rated = rate_samples(pairs_to_long(texts, sides, [], bare=["response"]), rater=rater, kind=kind)
    per_side = pivot_ratings(rated, ["pair_id", "side"], RUBRIC_FEATURES, prefix=prefix)
    wide = long_to_pairs(per_side, ["pair_id"], sides, [f"{prefix}{f}" for f in RUBRIC_FEATURES])
    return pairs.join(wide, "pair_id", "left")


def fit_rows(
    annotated: DataFrame,
    scores: DataFrame | None = None,
    split: str = "train",
    subset: int | None = None,
    seed: int = 100,
    short: bool = False,
) -> tuple[DataFrame, list[str]]:
    """The rows a reward model is fitted on, stored, and the stems of their features.

    Annotated pairs get their computed features, optional pseudo-labels and keyed sides; ``scores`` re-labels the fitted
    split, ``subset`` draws so many rows.
    """
    features = curate.select_features(RUBRIC_FEATURES, subset="short" if short else None)
    rated = [f for f in features if f in RUBRIC_FEATURES]
    fitted = annotated.where(F.col("split") == split)
    computed = {f: fn for f, fn in registered_features().items() if f in features}
    if computed:
        fitted = add_features(fitted, {"chosen": "chosen", "rejected": "rejected"}, "context", computed)
    stems = [*rated, *computed]
    sides = [f"{f}_{side}" for f in stems for side in ("chosen", "rejected")]
    fitted = fitted.select("pair_id", "split", *[F.col(f"`{c}`").cast("double").alias(c) for c in sides])
    if scores is not None:
        fitted, _ = labels.pseudo_label_swap(fitted, scores, "pair_id", stems, bare=False)
    sided = labels.randomize_sides(curate.drop_incomplete(fitted), "pair_id", seed, stems, response=None)
    if subset:
        sided = curate.sample_n(sided, "pair_id", subset, seed)
    return settle(sided, "fit_rows"), stems


def fit_pairs(
    annotated: DataFrame,
    scores: DataFrame | None = None,
    split: str = "train",
    subset: int | None = None,
    seed: int = 100,
    short: bool = False,
    name: str = "g",
    **search,
) -> tuple[RewardModel, list[dict]]:
    """Annotated pairs (chosen/rejected columns) to a reward model; the other split keeps its labels."""
    sided, stems = fit_rows(annotated, scores, split, subset, seed, short)
    return fit_reward_model(sided, stems, split=split, name=name, **search)


def score_both(samples: DataFrame, model_a: RewardModel, model_b: RewardModel) -> DataFrame:
    """Complete samples with both models' normalized rewards as ``score_a`` and ``score_b``."""
    complete = curate.drop_incomplete(samples, list(dict.fromkeys([*model_a.features, *model_b.features])))
    for name, model in (("score_a", model_a), ("score_b", model_b)):
        complete = stats.normalize_reward(score_samples(complete, model, name), name, model)
    return complete


def compare_models(
    samples: DataFrame, model_a: RewardModel, model_b: RewardModel, order_by: Sequence[str] = ("sample_idx",)
) -> tuple[DataFrame, DataFrame]:
    """Over-optimization report: (curve of both rewards under the first model's choice, their correlation)."""
    scored = score_both(samples, model_a, model_b)
    return select.bon_curve(select.best_of_n(scored, order_by=order_by)), stats.score_correlation(scored, "score_a", "score_b")


def judge_candidates(
    samples: DataFrame,
    score_cols: Sequence[str],
    order_by: Sequence[str] = ("sample_idx",),
    external: DataFrame | None = None,
    judge_fn: Rater | None = None,
    kind: str = "hh",
    store: str | None = None,
    name: str = "",
) -> DataFrame:
    """Win rates of every model's best response over the first response, per model, with the spread over chunks.

    A plugged-in judge sees every distinct task once; ``store`` keeps its replies for later runs.

    ``external`` holds (prompt, response, score); its normalized score is one more model. The external join
    comes first, so chunks hold rows that have every score.
    """
    scored, models = samples, list(score_cols)
    if external is not None:
        named = external.select("prompt", "response", F.col("score").alias("external"))
        scored = stats.normalize_external(joins.attach_scores_inner(scored, named), "external")
        models.append("external")
    chunked = select.chunk_samples(scored, order_by=order_by)
    candidates = select.bon_candidates(chunked, models, order_by=order_by, by=["chunk"])
    tasks = judge.render_judge_task(candidates, kind=kind, count_words=judge_fn is None)
    judged = judge.scored_replies(judge.judge_with(tasks, judge_fn, store=store, name=name))
    return judge.preference_rate(judge.judge_debias(judged, ["model", "chunk", "prompt"]))


def experiment_grid(
    spark: SparkSession, runs: Iterable[dict], step: Callable[[dict], Iterable[dict]]
) -> DataFrame:
    """Run ``step`` for every run and put the metrics of all runs, beside their attributes, into one table.

    A run is a small dict of settings; each step is Spark work of its own, and only metrics come back.
    """
    rows = [{**run, **metrics} for run in runs for metrics in step(run)]
    columns = list(dict.fromkeys(name for row in rows for name in row))
    return spark.createDataFrame([tuple(row.get(c) for c in columns) for row in rows], columns)
