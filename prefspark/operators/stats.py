"""Moments, normalization, accuracy, losses and correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.rewards import beats, softplus


def pooled_summaries(df: DataFrame, stems: dict[str, Sequence[str]], by: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    """``mean_<stem>``, ``std_<stem>`` and ``n_<stem>`` over the listed columns of each stem taken as one column.

    Each column is summarized in place and the summaries are combined afterwards, so rows are not multiplied
    and the variance never passes through a difference of large sums.
    """
    columns = list(dict.fromkeys(c for cols in stems.values() for c in cols))
    position = {c: i for i, c in enumerate(columns)}
    parts = [
        F.expr(f"{function}(`{c}`) AS _{letter}{i}")
        for c, i in position.items()
        for letter, function in (("n", "count"), ("m", "avg"), ("v", "var_pop"))
    ]
    table = df.groupBy(*by).agg(*parts) if by else df.agg(*parts)
    numbers = {stem: [position[c] for c in cols] for stem, cols in stems.items()}

    def added(term: str, at: Sequence[int]) -> str:
        return " + ".join(term.format(i=i) for i in at)

    means, stds = [], []
    for stem, at in numbers.items():
        count = added("_n{i}", at)
        means.append(f"{count} AS `n_{stem}`")
        means.append(f"({added('_n{i} * coalesce(_m{i}, 0D)', at)}) / nullif({count}, 0) AS `mean_{stem}`")
        around = added(f"_n{{i}} * (coalesce(_v{{i}}, 0D) + pow(coalesce(_m{{i}}, 0D) - `mean_{stem}`, 2))", at)
        stds.append(f"sqrt(({around}) / nullif(greatest(`n_{stem}` - {ddof}, 0), 0)) AS `std_{stem}`")
    names = [f"`{part}_{stem}`" for stem in stems for part in ("mean", "n")]
    return table.selectExpr("*", *means).selectExpr(*[f"`{b}`" for b in by], *names, *stds)


def pooled_moments(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), ddof: int = 0) -> DataFrame:
    """Mean and standard deviation over the listed columns pooled, per group of ``by``."""
    summary = pooled_summaries(df, {"all": cols}, by, ddof)
    return summary.select(
        *by, F.col("mean_all").alias("mean"), F.col("std_all").alias("std"), F.col("n_all").alias("n")
    )


def _scalar(row: DataFrame) -> Column:
    """The columns of a one-row table as one struct inside a scalar subquery."""
    return row.select(F.struct(*row.columns)).scalar()


def pooled_feature_moments(
    df: DataFrame, features: Sequence[str], sides: tuple[str, str] = ("a", "b"), eps: float = 0.0
) -> DataFrame:
    """One row with ``mean_<i>`` and ``std_<i>`` per feature over both sides together (population)."""
    stems = {str(i): [f"{feature}_{side}" for side in sides] for i, feature in enumerate(features)}
    summary = pooled_summaries(df, stems)
    return summary.select(
        *[F.col(f"mean_{i}") for i in stems], *[(F.col(f"std_{i}") + F.lit(eps)).alias(f"std_{i}") for i in stems]
    )


def pooled_standardize(
    df: DataFrame, features: Sequence[str], sides: tuple[str, str] = ("a", "b"), eps: float = 1e-7
) -> DataFrame:
    """(x − mean) / (std + eps) with moments over both sides together. ``eps=0`` gives the plain form, with
    null for a constant feature."""
    moments = _scalar(pooled_feature_moments(df, features, sides, eps))
    scaled = {}
    for i, feature in enumerate(features):
        for side in sides:
            name = f"{feature}_{side}"
            spread = F.nullif(moments[f"std_{i}"], F.lit(0.0))
            scaled[name] = (F.col(f"`{name}`") - moments[f"mean_{i}"]) / spread
    return df.withColumns(scaled)


def side_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``mean_<i>`` and ``std_<i>`` per column; a spread of zero counts as one."""
    columns = []
    for i, name in enumerate(cols):
        spread = F.stddev_pop(F.col(f"`{name}`"))
        columns += [
            F.avg(F.col(f"`{name}`")).alias(f"mean_{i}"),
            F.when(spread == 0, F.lit(1.0)).otherwise(spread).alias(f"std_{i}"),
        ]
    return df.agg(*columns)


def side_standardize(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Each column by its own mean and population standard deviation."""
    moments = _scalar(side_moments(df, cols))
    return df.withColumns(
        {c: (F.col(f"`{c}`") - moments[f"mean_{i}"]) / moments[f"std_{i}"] for i, c in enumerate(cols)}
    )


def normalize_external(df: DataFrame, col: str, ddof: int = 0) -> DataFrame:
    """A score column by its own mean and standard deviation (population by default); null where that is zero."""
    deviation = F.stddev_pop(col) if ddof == 0 else F.stddev_samp(col)
    moments = _scalar(df.agg(F.avg(col).alias("mean"), deviation.alias("std")))
    return df.withColumn(col, (F.col(col) - moments["mean"]) / F.nullif(moments["std"], F.lit(0.0)))


def normalize_reward(df: DataFrame, col: str, model=None) -> DataFrame:
    """A reward by the model's mean and spread, or, without a model, by the data's mean and sample deviation."""
    if model is None or model.reward_mean is None or model.reward_std is None:
        return normalize_external(df, col, ddof=1)
    return df.withColumn(col, (F.col(col) - F.lit(model.reward_mean)) / F.lit(model.reward_std))


def pairwise_accuracy(
    scores: DataFrame,
    by: Sequence[str] = ("model", "split"),
    chosen: str = "score_chosen",
    rejected: str = "score_rejected",
) -> DataFrame:
    """Share of pairs whose chosen score is strictly greater, per group."""
    hit = beats(F.col(chosen), F.col(rejected)).cast("double")
    summary = [F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n")]
    return scores.groupBy(*by).agg(*summary) if by else scores.agg(*summary)


def reward_stats(
    scores: DataFrame, split: str | None = None, cols: tuple[str, str] = ("score_chosen", "score_rejected")
) -> DataFrame:
    """Mean and population standard deviation over both sides, of one split where given."""
    if split is not None:
        scores = scores.where(F.col("split") == split)
    return pooled_moments(scores, cols).select(
        F.col("mean").alias("reward_mean"), F.col("std").alias("reward_std"), "n"
    )


def pair_losses(
    df: DataFrame,
    winner: str = "score_chosen",
    loser: str = "score_rejected",
    targets: Sequence[tuple[str, str]] | None = None,
) -> DataFrame:
    """Mean −log σ(winner − loser); with (prediction, target) column pairs also the sum of their mean squared errors."""
    columns = [
        F.avg(softplus(F.col(loser) - F.col(winner))).alias("ranking_loss"),
        F.count(F.lit(1)).alias("n"),
    ]
    if targets:
        errors = [F.avg(F.pow(F.col(p) - F.col(t), F.lit(2.0))) for p, t in targets]
        columns.append(sum(errors[1:], errors[0]).alias("squared_loss"))
    return df.agg(*columns)


def score_correlation(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson r of two score columns with the row count, the t statistic of r = 0 and its two-sided p-value.

    Without groups the one summary row comes to the driver, which takes the p-value. With groups a small function takes it from the
    summary row of each; no scored row goes through it.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    r = F.corr(a, b)
    n = F.count(F.when(both, 1))
    summary = [r.alias("r"), n.alias("n")]
    table = df.groupBy(*by).agg(*summary) if by else df.agg(*summary)
    if not by:
        found = table.first()
        r, n = found.r, found.n
        t = None if r is None or n <= 2 or r * r >= 1 else r * math.sqrt((n - 2) / (1 - r * r))
        p = None if r is None else correlation_p_value(r, n)
        return df.sparkSession.createDataFrame([(r, n, t, p)], "r double, n long, t double, p double")
    r, n = F.col("r"), F.col("n")
    t = r * F.sqrt((n - 2) / F.nullif(1 - r * r, F.lit(0.0)))
    p = F.udf(lambda r, n: None if r is None else correlation_p_value(r, n), "double")
    return table.withColumn("t", F.when(n > 2, t)).withColumn("p", p("r", "n"))


def correlation_p_value(r: float, n: int) -> float:
    """Two-sided p-value of a Pearson r over n rows, from the incomplete beta function of its t statistic."""
    freedom = n - 2
    if freedom <= 0:
        return 1.0
    if abs(r) >= 1.0:
        return 0.0
    return _incomplete_beta(freedom / 2, 0.5, 1.0 - r * r)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by its continued fraction (modified Lentz evaluation)."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x > (a + 1) / (a + b + 2):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    tiny, d, c, fraction = 1e-300, 0.0, 1.0, 1.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / ((1.0 + term * d) or tiny)
        c = (1.0 + term / c) or tiny
        step = c * d
        fraction *= step
        if abs(step - 1.0) < 1e-14:
            break
    return front * (fraction - 1.0) / a
