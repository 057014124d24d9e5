"""Ratings predicted from texts: ridge regression of several targets at once on hashed words and prompt crosses."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.operators.hashed_text import add_scores, bounded_batches, hashed_rows, summed
from prefspark.session import settle

NUM_FEATURES = 1 << 14
REG = 0.01
#: A fit has settled when no slope of a target's mean squared error, halved, exceeds this.
SLOPE = 1e-7


@dataclass(frozen=True)
class RatingRegressor:
    """Means and weights per target; a prediction is the mean plus the product with the text's vector."""

    targets: tuple[str, ...]
    means: np.ndarray
    weights: np.ndarray
    reg: float
    with_prompt: bool
    passes: int

    def predict(self, df: DataFrame, text: str = "response", prompt: str = "context", suffix: str = "_predicted") -> DataFrame:
        """``df`` with a prediction per target. A null text gets the means."""
        names = [f"{t}{suffix}" for t in self.targets]
        return add_scores(df, [(text, names)], prompt if self.with_prompt else None, self.weights, self.means)

    def weight_table(self, spark: SparkSession) -> DataFrame:
        """``bucket, weights`` with one weight per target, for buckets that have any. It goes to the JVM as a table: no executor starts
        Python for it."""
        used = np.flatnonzero(self.weights.any(axis=0))
        weights = pa.array(list(self.weights[:, used].T), pa.list_(pa.float64()))
        return spark.createDataFrame(pa.table({"bucket": pa.array(used, pa.int32()), "weights": weights}), "bucket int, weights array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store as two small tables; fails where one is stored already."""
        self.weight_table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/weights")
        header = [(list(self.targets), [float(m) for m in self.means], self.weights.shape[1], self.reg, self.with_prompt, self.passes)]
        schema = "targets array<string>, means array<double>, num_features int, reg double, with_prompt boolean, passes int"
        spark.createDataFrame(header, schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/header")


def load_regressor(spark: SparkSession, path: str) -> RatingRegressor:
    header = spark.read.parquet(f"{path}/header").first()
    weights = np.zeros((len(header.targets), header.num_features))
    for row in spark.read.parquet(f"{path}/weights").collect():
        weights[:, row.bucket] = row["weights"]
    return RatingRegressor(tuple(header.targets), np.array(header.means), weights, header.reg, header.with_prompt, header.passes)


def _targets_of(batch, size: int) -> np.ndarray:
    """Rows x targets; a missing rating is NaN."""
    return batch.column("y").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)


def fit_ratings(
    samples: DataFrame,
    targets: Sequence[str],
    text: str = "response",
    prompt: str = "context",
    num_features: int = NUM_FEATURES,
    reg: float = REG,
    max_passes: int = 300,
) -> RatingRegressor:
    """Least squares with a penalty of reg / 2 |w|^2 on the mean, for all targets at once.

    The normal equations of every target are solved by conjugate gradients that share their passes: a pass over the sparse rows, which
    are written once, multiplies the directions of all targets that are not done. Each stops when its residual, which is the slope
    of its objective, is at most SLOPE; a fit that does not get there within ``max_passes`` raises. Rows without a rating count for their
    other targets; a target without any has mean and weights zero. Null texts are empty.
    """
    size, with_prompt = len(targets), prompt in samples.columns
    rated = F.array(*[F.col(f"`{t}`").cast("double") for t in targets]).alias("y")
    hashed = hashed_rows(samples, [(text, 1.0)], prompt if with_prompt else None, num_features, [rated])
    with bounded_batches(samples.sparkSession):
        rows = settle(hashed, "regression_rows")

    def totals(_, batch):
        y = _targets_of(batch, size)
        return np.r_[np.isfinite(y).sum(0), np.nansum(y, axis=0)].astype(float)

    def correlations(means):
        def part(block, batch):
            return block.back(np.nan_to_num(_targets_of(batch, size) - means), num_features).ravel()

        return part

    def products(directions, chosen):
        def part(block, batch):
            known = np.isfinite(_targets_of(batch, size)[:, chosen])
            return block.back(block.times(directions) * known, num_features).ravel()

        return part

    counted = summed(rows, totals, 2 * size)
    n = np.maximum(counted[:size], 1.0)
    means = counted[size:] / n
    residual = summed(rows, correlations(means), size * num_features).reshape(size, -1) / n[:, None]
    weights, direction = np.zeros((size, num_features)), residual.copy()
    length, passes = (residual**2).sum(1), 2
    open_ = np.flatnonzero(np.abs(residual).max(1) > SLOPE)
    while len(open_):
        if passes >= max_passes:
            raise RuntimeError(f"{len(open_)} of {size} targets have not settled after {passes} passes")
        p = direction[open_]
        image = summed(rows, products(p, open_), len(open_) * num_features).reshape(len(open_), -1) / n[open_, None] + reg * p
        passes += 1
        step = length[open_] / (p * image).sum(1)
        weights[open_] += step[:, None] * p
        residual[open_] -= step[:, None] * image
        grown = (residual[open_] ** 2).sum(1)
        direction[open_] = residual[open_] + (grown / length[open_])[:, None] * p
        length[open_] = grown
        open_ = open_[np.abs(residual[open_]).max(1) > SLOPE]
    return RatingRegressor(tuple(targets), means, weights, reg, with_prompt, passes)


def regression_slopes(
    model: RatingRegressor, samples: DataFrame, key: str, text: str = "response", prompt: str = "context"
) -> DataFrame:
    """``target, slope, n``: the largest slope of each target's objective over ``samples``, by aggregates apart from the solver.

    The weights, whose size is that of the model, go to the rows, and rows move whole to their errors: no entry is shuffled by itself.
    """
    spark, size = samples.sparkSession, len(model.targets)
    rated = F.array(*[F.col(f"`{t}`").cast("double") for t in model.targets]).alias("y")
    hashed = hashed_rows(samples, [(text, 1.0)], prompt if model.with_prompt else None, model.weights.shape[1], [key, rated])
    with bounded_batches(spark):
        rows = settle(hashed, "slope_rows")
    weights = settle(model.weight_table(spark), "slope_weights")
    entry = F.inline(F.arrays_zip(F.col("index").alias("bucket"), "value"))
    at = range(size)
    sums = [F.sum(F.get("weights", F.lit(t)) * F.col("value")).alias(f"f{t}") for t in at]
    fitted = rows.select(key, entry).join(F.broadcast(weights), "bucket").groupBy(key).agg(*sums)
    errors = rows.select(key, "y").join(fitted, key, "left").select(
        key, *[(F.coalesce(f"f{t}", F.lit(0.0)) + F.lit(float(model.means[t])) - F.get("y", F.lit(t))).alias(f"e{t}") for t in at]
    )
    errors = settle(errors, "slope_errors")
    n = errors.agg(*[F.count(f"e{t}").alias(f"n{t}") for t in at]).first()
    missed = rows.select(key, "index", "value").join(errors, key).select(*[f"e{t}" for t in at], entry)
    slopes = missed.groupBy("bucket").agg(*[F.sum(F.col(f"e{t}") * F.col("value")).alias(f"g{t}") for t in at])
    left = [
        F.max(F.abs(F.coalesce(f"g{t}", F.lit(0.0)) / max(n[t], 1) + model.reg * F.coalesce(F.get("weights", F.lit(t)), F.lit(0.0))))
        for t in at
    ]
    found = slopes.join(weights, "bucket", "full").agg(*[c.alias(f"s{t}") for t, c in enumerate(left)])
    named = [F.struct(F.lit(model.targets[t]).alias("target"), F.col(f"s{t}").alias("slope"), F.lit(n[t]).cast("long").alias("n")) for t in at]
    return found.select(F.inline(F.array(*named)))
