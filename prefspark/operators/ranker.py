"""A preference model learned from the texts themselves: hashed words and prompt crosses, linear reward."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.rewards import sigmoid
from prefspark.operators.hashed_text import add_scores, hashed_rows, summed
from prefspark.session import settle

NUM_FEATURES = 1 << 16
#: A fit has settled when no slope of its mean loss exceeds this.
SLOPE = 1e-7
MEMORY = 10


@dataclass(frozen=True)
class TextPairRanker:
    """Scalar reward of a text, given its prompt where the model was fitted with prompts."""

    weights: np.ndarray
    reg: float
    with_prompt: bool
    acc: float | None = None
    settled: bool | None = None
    passes: int | None = None

    @property
    def num_features(self) -> int:
        return len(self.weights)

    def score(self, df: DataFrame, text: str = "response", out: str = "score", prompt: str = "prompt") -> DataFrame:
        """``df`` with the reward of ``text``. A null text scores 0; a null prompt adds no crosses."""
        return self._scored(df, [(text, [out])], prompt)

    def _scored(self, df: DataFrame, sides, prompt: str, keep: Sequence[str] | None = None) -> DataFrame:
        return add_scores(df, sides, prompt if self.with_prompt else None, self.weights[None, :], np.zeros(1), keep=keep)

    def score_pairs(
        self, pairs: DataFrame, name: str = "ranker", keep: Sequence[str] = ("pair_id", "split"), prompt: str = "context"
    ) -> DataFrame:
        """Scores of both sides of chosen/rejected pairs, in one pass over the texts."""
        sides = [("chosen", ["score_chosen"]), ("rejected", ["score_rejected"])]
        scored = self._scored(pairs, sides, prompt, keep)
        return scored.select(F.lit(name).alias("model"), *keep, "score_chosen", "score_rejected")

    def weight_table(self, spark: SparkSession) -> DataFrame:
        """``bucket, weight`` of the weights that are not zero."""
        used = np.flatnonzero(self.weights)
        return spark.createDataFrame([(int(i), float(self.weights[i])) for i in used], "bucket int, weight double")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store as two small tables; fails where one is stored already."""
        self.weight_table(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/weights")
        header = [(self.num_features, self.reg, self.with_prompt, self.acc, self.settled, self.passes)]
        schema = "num_features int, reg double, with_prompt boolean, acc double, settled boolean, passes int"
        spark.createDataFrame(header, schema).coalesce(1).write.mode("errorifexists").parquet(f"{path}/header")


def load_ranker(spark: SparkSession, path: str) -> TextPairRanker:
    header = spark.read.parquet(f"{path}/header").first()
    weights = np.zeros(header.num_features)
    for row in spark.read.parquet(f"{path}/weights").collect():
        weights[row.bucket] = row.weight
    return TextPairRanker(weights, header.reg, header.with_prompt, header.acc, header.settled, header.passes)


def _direction(gradient: np.ndarray, steps: list[np.ndarray], changes: list[np.ndarray]) -> np.ndarray:
    """Quasi-Newton direction from the last steps and the changes of the gradient along them."""
    d, alphas = -gradient, []
    for s, y in zip(reversed(steps), reversed(changes)):
        alphas.append((s @ d) / (s @ y))
        d = d - alphas[-1] * y
    if steps:
        d = d * (steps[-1] @ changes[-1]) / (changes[-1] @ changes[-1])
    for s, y, alpha in zip(steps, changes, reversed(alphas)):
        d = d + s * (alpha - (y @ d) / (s @ y))
    return d


def minimize(
    evaluate: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], models: int, size: int, max_passes: int, slope: float = SLOPE
) -> tuple[np.ndarray, np.ndarray, int]:
    """Weights of several smooth convex problems that share their passes, whether each has settled, and the passes made.

    ``evaluate`` gives loss and gradient of every row of a matrix of weights, of the models named, in one pass. Each problem has its own
    quasi-Newton memory and step length; a step that does not lower its loss enough is halved. The
    stop is by the gradient alone.
    """
    best, trial = np.zeros((models, size)), np.zeros((models, size))
    loss, gradient = np.full(models, np.inf), np.zeros((models, size))
    memory: list[tuple[list, list]] = [([], []) for _ in range(models)]
    moves, lengths = np.zeros((models, size)), np.ones(models)
    settled, active, passes = np.zeros(models, dtype=bool), np.arange(models), 0
    while len(active) and passes < max_passes:
        values, slopes = evaluate(trial[active], active)
        passes += 1
        for m, value, g in zip(active, values, slopes):
            if np.isfinite(loss[m]):
                # Near the optimum the loss no longer tells steps apart, the slope still does.
                enough = value <= loss[m] + 1e-4 * lengths[m] * (gradient[m] @ moves[m]) or (
                    value <= loss[m] * (1 + 1e-12) and np.abs(g).max() < np.abs(gradient[m]).max()
                )
                if not enough and lengths[m] > 1e-10:
                    lengths[m] /= 2
                    trial[m] = best[m] + lengths[m] * moves[m]
                    continue
                step, change = trial[m] - best[m], g - gradient[m]
                if step @ change > 1e-16 * (change @ change):
                    memory[m][0].append(step)
                    memory[m][1].append(change)
                    del memory[m][0][:-MEMORY], memory[m][1][:-MEMORY]
            best[m], loss[m], gradient[m] = trial[m], value, g
            settled[m] = np.abs(g).max() <= slope
            moves[m], lengths[m] = _direction(g, *memory[m]), 1.0
            trial[m] = best[m] + moves[m]
        active = np.flatnonzero(~settled)
    return best, settled, passes


def _ranking_loss(rows: DataFrame, n: int, regs: np.ndarray, size: int):
    """Mean of -log sigmoid(w x) plus reg / 2 |w|^2, and its gradient, for the given models in one pass."""

    def evaluate(weights: np.ndarray, models: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def part(block, _):
            margin = block.times(weights)
            decayed = np.exp(-np.abs(margin))
            share = np.where(margin >= 0, decayed, 1.0) / (1.0 + decayed)
            losses = np.maximum(-margin, 0.0) + np.log1p(decayed)
            return np.concatenate([losses.sum(0), -block.back(share, size).ravel()])

        k, pull = len(weights), regs[models]
        total = summed(rows, part, k * (size + 1)) / n
        return total[:k] + 0.5 * pull * (weights**2).sum(1), total[k:].reshape(k, size) + pull[:, None] * weights

    return evaluate


def _accuracies(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Share of rows with a positive margin, for every model in one pass; 0 without rows."""

    def part(block, _):
        return np.r_[(block.times(weights) > 0).sum(0), block.rows].astype(float)

    found = summed(rows, part, len(weights) + 1)
    return found[:-1] / max(found[-1], 1)


def text_pair_ranker(
    pairs: DataFrame,
    num_features: int = NUM_FEATURES,
    regs: Sequence[float] = (0.01, 0.1),
    key: str = "pair_id",
    max_iter: int = 200,
    prompt: str = "context",
) -> TextPairRanker:
    """Fit on the ``train`` role of chosen/rejected pairs and keep the strength with the best ``test`` accuracy.

    A text is a sparse vector of its hashed words and, where pairs have a ``prompt`` column, of their crosses with the
    prompt's words: words alone would cancel out of what a prompt says about its two responses. A
    pair is the difference of its two vectors, written once. All strengths are fitted in shared passes over these rows and
    stop by the slope of their loss; ``settled`` says whether each came to rest within ``max_iter`` passes. Among equal accuracies the
    first strength wins. Null texts are empty; other roles take no part; without training rows all weights are zero.
    """
    with_prompt = prompt in pairs.columns
    used = pairs.where(F.col("role").isin("train", "test"))
    hashed = hashed_rows(used, [("chosen", 1.0), ("rejected", -1.0)], prompt if with_prompt else None, num_features, [key, "role"])
    stored = settle(hashed, "ranker_rows")
    train, test = stored.where("role = 'train'").select("index", "value"), stored.where("role = 'test'").select("index", "value")
    strengths, rows = np.array(regs, dtype=float), train.persist()
    try:
        evaluate = _ranking_loss(rows, max(rows.count(), 1), strengths, num_features)
        weights, settled, passes = minimize(evaluate, len(strengths), num_features, max_iter)
    finally:
        rows.unpersist()
    accuracy = _accuracies(test, weights)
    best = int(np.argmax(np.round(accuracy, 12)))
    return TextPairRanker(weights[best], float(strengths[best]), with_prompt, float(accuracy[best]), bool(settled.all()), passes)


def ranker_slope(ranker: TextPairRanker, pairs: DataFrame, key: str = "pair_id", prompt: str = "context") -> DataFrame:
    """``slope, n``: the largest slope of the ranker's mean loss over ``pairs``, by aggregates apart from the solver.

    Entries of the sparse rows meet the weights in a join, margins are summed per pair and slopes per bucket.
    """
    spark = pairs.sparkSession
    hashed = hashed_rows(
        pairs, [("chosen", 1.0), ("rejected", -1.0)], prompt if ranker.with_prompt else None, ranker.num_features, [key]
    )
    rows = settle(hashed, "slope_rows")
    n = rows.count()
    weights = settle(ranker.weight_table(spark), "slope_weights")
    entries = rows.select(key, F.inline(F.arrays_zip("index", "value"))).withColumnRenamed("index", "bucket")
    margins = entries.join(weights, "bucket").groupBy(key).agg(F.sum(F.col("weight") * F.col("value")).alias("margin"))
    shares = rows.select(key).join(margins, key, "left").select(key, sigmoid(-F.coalesce("margin", F.lit(0.0))).alias("share"))
    slopes = entries.join(settle(shares, "slope_shares"), key).groupBy("bucket").agg(F.sum(-F.col("share") * F.col("value")).alias("g"))
    left = F.abs(F.coalesce("g", F.lit(0.0)) / F.lit(float(max(n, 1))) + F.lit(ranker.reg) * F.coalesce("weight", F.lit(0.0)))
    return slopes.join(weights, "bucket", "full").agg(F.max(left).alias("slope")).withColumn("n", F.lit(n).cast("long"))
