"""The linear reward model and its tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark import schemas
from prefspark.functions.rewards import standardized_dot
from prefspark.operators.reshape import feature_array


@dataclass(frozen=True)
class RewardModel:
    """Standardization and weights per feature, with the reward's own mean and spread on the fitted split."""

    name: str
    features: tuple[str, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    coefs: tuple[float, ...]
    reward_mean: float | None = None
    reward_std: float | None = None
    acc: float | None = None

    def __post_init__(self):
        sizes = {len(self.features), len(self.means), len(self.stds), len(self.coefs)}
        if len(sizes) != 1:
            raise ValueError("a mean, a std and a coefficient are needed per feature")
        if any(not std > 0 for std in self.stds):
            raise ValueError("every std must be positive")

    def with_stats(self, reward_mean: float, reward_std: float) -> RewardModel:
        return replace(self, reward_mean=reward_mean, reward_std=reward_std)


def linear_reward(features_col: str, model: RewardModel) -> Column:
    """Reward of an ``ARRAY<DOUBLE>`` feature column in the model's feature order."""
    return standardized_dot(features_col, model.means, model.stds, model.coefs)


def score_samples(df: DataFrame, model: RewardModel, out: str | None = None) -> DataFrame:
    """Reward of samples whose features are columns named as in the model."""
    scored = feature_array(df, model.features, out="_features")
    return scored.withColumn(out or model.name, linear_reward("_features", model)).drop("_features")


def pair_scores(
    df: DataFrame,
    model: RewardModel,
    label: str = "labels",
    sides: tuple[str, str] = ("a", "b"),
    keep: Sequence[str] = ("pair_id", "split"),
) -> DataFrame:
    """Scores of both sides, also routed to chosen and rejected: label 1 makes the first side the chosen one."""
    wide = df
    for side in sides:
        wide = feature_array(wide, model.features, side, out=f"_features_{side}")
    first, second = (linear_reward(f"_features_{side}", model) for side in sides)
    scored = wide.withColumns({"score_a": first, "score_b": second})
    preferred = F.col(label).eqNullSafe(F.lit(1))
    return scored.select(
        F.lit(model.name).alias("model"),
        *keep,
        F.when(preferred, F.col("score_a")).otherwise(F.col("score_b")).alias("score_chosen"),
        F.when(preferred, F.col("score_b")).otherwise(F.col("score_a")).alias("score_rejected"),
        "score_a",
        "score_b",
    )


#: Rows of a table of models that travel to every task.
MAX_TERMS = 100_000


def score_models(
    df: DataFrame,
    terms: DataFrame,
    label: str = "labels",
    sides: tuple[str, str] = ("a", "b"),
    keep: Sequence[str] = ("pair_id", "split"),
) -> DataFrame:
    """Scores of both sides under every model of a table of terms: ``model, *keep, score_chosen, score_rejected``.

    One plan of the same length for any number of models: the table becomes one row, a scalar subquery, and each pair grows a
    row per model inside the scanning task. The table has at most MAX_TERMS rows, which is checked; a feature that the pairs
    lack is an error. A missing feature value gives a null score.
    """
    sized = terms.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set("feature")).alias("names")).first()
    if sized.n > MAX_TERMS:
        raise ValueError(f"{sized.n} terms, at most {MAX_TERMS} are scored at once")
    if not sized.n:
        raise ValueError("no model to score with")
    place = (F.array_position(F.array(*map(F.lit, sized.names)), F.col("feature")) - 1).cast("int")
    term = F.struct("feature_pos", place.alias("at"), "mean", "std", "coef")
    listed = terms.groupBy("model").agg(F.array_sort(F.collect_list(term)).alias("terms"))
    models = listed.agg(F.array_sort(F.collect_list(F.struct("model", "terms"))).alias("models")).scalar()
    wide = df
    for side in sides:
        wide = feature_array(wide, sized.names, side, out=f"_features_{side}")
    kept = wide.select(*keep, label, *[f"_features_{side}" for side in sides])
    each = kept.select("*", F.inline(models))

    def score(side: str) -> Column:
        def add(total: Column, t: Column) -> Column:
            return total + (F.get(f"_features_{side}", t["at"]) - t["mean"]) / t["std"] * t["coef"]

        return F.aggregate("terms", F.lit(0.0), add)

    first, second = (score(side) for side in sides)
    scored = each.withColumns({"score_a": first, "score_b": second})
    preferred = F.col(label).eqNullSafe(F.lit(1))
    return scored.select(
        "model",
        *keep,
        F.when(preferred, F.col("score_a")).otherwise(F.col("score_b")).alias("score_chosen"),
        F.when(preferred, F.col("score_b")).otherwise(F.col("score_a")).alias("score_rejected"),
    )


def model_tables(spark: SparkSession, models: Sequence[RewardModel]) -> tuple[DataFrame, DataFrame]:
    """Models as (terms, headers): one row per feature, one row per model."""
    terms = [
        (m.name, i, m.features[i], m.means[i], m.stds[i], m.coefs[i]) for m in models for i in range(len(m.features))
    ]
    headers = [(m.name, m.reward_mean, m.reward_std, m.acc) for m in models]
    return (
        spark.createDataFrame(terms, schemas.MODEL_TERMS),
        spark.createDataFrame(headers, schemas.MODEL_HEADERS),
    )


def save_model(spark: SparkSession, model: RewardModel, path: str) -> None:
    """Store a model as two small parquet tables; fails where one is stored already."""
    terms, headers = model_tables(spark, [model])
    terms.coalesce(1).write.mode("errorifexists").parquet(f"{path}/terms")
    headers.coalesce(1).write.mode("errorifexists").parquet(f"{path}/headers")


def load_model(spark: SparkSession, path: str) -> RewardModel:
    terms = spark.read.schema(schemas.MODEL_TERMS).parquet(f"{path}/terms").orderBy("feature_pos").collect()
    header = spark.read.schema(schemas.MODEL_HEADERS).parquet(f"{path}/headers").first()
    return RewardModel(
        header.model,
        tuple(t.feature for t in terms),
        tuple(t["mean"] for t in terms),
        tuple(t["std"] for t in terms),
        tuple(t.coef for t in terms),
        header.reward_mean,
        header.reward_std,
        header.acc,
    )
