"""Sequence log-probabilities and the energy model over pairs, in log space throughout."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefspark.functions.rewards import dot, log_sum_exp, sigmoid

# Step and tolerance of the moment-matching ascent.
LEARNING_RATE = 0.1
TOLERANCE = 1e-3

SLOT_TOKENS = 65_536
#: Numbers that one task of an ascent step reads (16 MiB), as far as stored partitions can be put together.
TASK_NUMBERS = 2**21
#: Up to so many tasks the driver adds up a step's sums itself.
DIRECT_TASKS = 256


def first_index(ids: str | Column, token) -> Column:
    """0-based position of the first occurrence in an array, −1 where there is none."""
    return F.array_position(ids, F.lit(token)) - 1


def sequence_log_prob_arrays(
    df: DataFrame,
    ids: str,
    logprobs: str,
    eos,
    pad=None,
    forced_bos=None,
    out: str = "log_prob",
    start: str | Column | None = None,
) -> DataFrame:
    """Masked log-probability of one token sequence per row (ids and log-probabilities as arrays).

    Where rows are pages of longer sequences, ``start`` is the position of a page's first token; pages then go through
    :func:`merge_pages`. Adds ``first_end``, the position of the first end token, −1 where there is none.
    """
    start = F.lit(0) if start is None else F.col(start) if isinstance(start, str) else start
    found = first_index(ids, eos)
    end = F.when(found < 0, F.lit(-1)).otherwise(found + start)
    pairs = F.transform(
        F.arrays_zip(F.col(ids).alias("id"), F.col(logprobs).alias("lp")),
        lambda t, i: F.struct((i + start).alias("i"), t["id"].alias("id"), t["lp"].alias("lp")),
    )
    token = lambda t: _scored(t["i"], t["id"], F.col("first_end"), eos, pad, forced_bos)
    total = F.aggregate(
        pairs, F.lit(0.0), lambda acc, t: acc + F.when(token(t), t["lp"]).otherwise(F.lit(0.0))
    )
    return df.withColumn("first_end", end.cast("bigint")).withColumn(out, total)


def merge_pages(df: DataFrame, key: Sequence[str], page: str, value: str = "log_prob") -> DataFrame:
    """Sequences from their pages' sums: pages after the first one with an end token do not count."""
    ended = F.min(F.when(F.col("first_end") >= 0, F.col(page))).over(Window.partitionBy(*key))
    counted = F.col("_last").isNull() | (F.col(page) <= F.col("_last"))
    return (
        df.withColumn("_last", ended)
        .groupBy(*key)
        .agg(
            F.sum(F.when(counted, F.col(value))).alias(value),
            F.coalesce(F.max(F.when(F.col(page) == F.col("_last"), F.col("first_end"))), F.lit(-1)).alias("first_end"),
        )
    )


def _scored(pos: Column, token: Column, end: Column, eos, pad, forced_bos) -> Column:
    """Whether a token counts: not after the first end token; no pad, save in first place; no forced first token."""
    is_end = token.eqNullSafe(F.lit(eos))
    plain = F.lit(True) if pad is None else ~token.eqNullSafe(F.lit(pad)) | is_end
    counted = F.when(pos == 0, F.lit(True)).otherwise(plain)
    if forced_bos is not None:
        counted = F.when((pos == 0) & token.eqNullSafe(F.lit(forced_bos)), is_end).otherwise(counted)
    return counted & ((end < 0) | (pos <= end))


def sequence_log_prob(
    tokens: DataFrame,
    key: str = "sample_id",
    eos=None,
    pad=None,
    forced_bos=None,
    pos: str = "pos",
    token: str = "token",
    logprob: str = "logprob",
    slot_tokens: int = SLOT_TOKENS,
) -> DataFrame:
    """Masked log-probability per sequence from one row per token.

    ``pos`` is the 0-based position. Sequences are cut into slots of ``slot_tokens`` positions; each slot is
    summed up to its own first end token, and only the slot sums of a sequence meet. One long sequence
    therefore never lands in one task.
    """
    slotted = tokens.withColumn("_slot", F.floor(F.col(pos) / slot_tokens))
    inside = Window.partitionBy(key, "_slot")
    slot_end = F.min(F.when(F.col(token) == F.lit(eos), F.col(pos))).over(inside)
    marked = slotted.withColumn("_end", F.coalesce(slot_end, F.lit(-1)))
    counted = _scored(F.col(pos), F.col(token), F.col("_end"), eos, pad, forced_bos)
    slots = marked.groupBy(key, "_slot").agg(
        F.sum(F.when(counted, F.col(logprob)).otherwise(0.0)).alias("log_prob"), F.max("_end").alias("first_end")
    )
    return merge_pages(slots, [key], "_slot")


def _log_scores(coefficients: Sequence[float]) -> tuple[Column, Column]:
    return (
        F.col("log_score_a") + dot("features_a", coefficients),
        F.col("log_score_b") + dot("features_b", coefficients),
    )


def ebm_scores(df: DataFrame, coefficients: Sequence[float]) -> DataFrame:
    """Log score (log-probability plus reward) and normalized share of each option.

    Input columns: ``log_score_<side>`` and ``features_<side>`` (``ARRAY<DOUBLE>``) for sides a and b.
    """
    a, b = _log_scores(coefficients)
    return df.withColumns({"ebm_log_a": a, "ebm_log_b": b}).withColumns(
        {
            "ebm_share_a": sigmoid(F.col("ebm_log_a") - F.col("ebm_log_b")),
            "ebm_share_b": sigmoid(F.col("ebm_log_b") - F.col("ebm_log_a")),
        }
    )


def ebm_moments(df: DataFrame, coefficients: Sequence[float]) -> DataFrame:
    """Mean feature values under the model's shares: one row per ``feature_pos``."""
    scored = ebm_scores(df, coefficients)
    means = [
        F.struct(
            F.lit(i).alias("feature_pos"),
            F.avg(
                F.col("ebm_share_a") * F.get("features_a", F.lit(i)) + F.col("ebm_share_b") * F.get("features_b", F.lit(i))
            ).alias("moment"),
        )
        for i in range(len(coefficients))
    ]
    return scored.agg(F.array(*means).alias("m")).select(F.inline("m"))


def target_moments(df: DataFrame, features: int, pref: str = "preferred") -> DataFrame:
    """Mean feature values of the preferred options ('A' or 'B'): one row per ``feature_pos``."""
    means = [
        F.struct(
            F.lit(i).alias("feature_pos"),
            F.avg(
                F.when(F.col(pref) == "A", F.get("features_a", F.lit(i))).otherwise(F.get("features_b", F.lit(i)))
            ).alias("target"),
        )
        for i in range(features)
    ]
    return df.agg(F.array(*means).alias("m")).select(F.inline("m"))


def log_likelihood(df: DataFrame, coefficients: Sequence[float], pref: str = "preferred") -> DataFrame:
    """Mean log share of the preferred option."""
    a, b = _log_scores(coefficients)
    preferred = F.when(F.col(pref) == "A", a).otherwise(b)
    return df.agg(F.avg(preferred - log_sum_exp(a, b)).alias("log_likelihood"), F.count(F.lit(1)).alias("n"))


def option_accuracy(df: DataFrame, coefficients: Sequence[float], pref: str = "preferred") -> DataFrame:
    """Share of pairs whose higher-scored option is the preferred one; a tie goes to the second option."""
    a, b = _log_scores(coefficients)
    predicted = F.when(a > b, "A").otherwise("B")
    return df.agg(F.avg((predicted == F.col(pref)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def moment_gap(df: DataFrame, coefficients: Sequence[float], pref: str = "preferred") -> list[float]:
    """Target minus model moments, the gradient of the log-likelihood, in one pass."""
    scored = ebm_scores(df, coefficients)
    gaps = []
    for i in range(len(coefficients)):
        a, b = F.get("features_a", F.lit(i)), F.get("features_b", F.lit(i))
        wanted = F.when(F.col(pref) == "A", a).otherwise(b)
        gaps.append(F.avg(wanted - F.col("ebm_share_a") * a - F.col("ebm_share_b") * b).alias(f"g{i}"))
    return list(scored.agg(*gaps).first())


_BLOCK = "x binary, offset binary, prefers_a binary"


def _difference_blocks(df: DataFrame, features: int, pref: str):
    """Rows as blocks of numbers: feature differences, differences of log scores, and whether the first option is preferred.

    Rows with a null feature or log score have no share and stay out. A block is one Arrow batch.
    """
    pairs = df.select(
        F.array(
            *[F.get("features_a", F.lit(i)).cast("double") - F.get("features_b", F.lit(i)).cast("double") for i in range(features)]
        ).alias("x"),
        (F.col("log_score_a") - F.col("log_score_b")).cast("double").alias("offset"),
        F.when(F.col(pref) == "A", 1.0).otherwise(0.0).alias("prefers_a"),
    ).where(F.col("offset").isNotNull() & F.forall("x", lambda v: v.isNotNull()))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, offset, prefers_a = batch.columns
            parts = (x.flatten(), offset, prefers_a)
            packed = [pa.array([part.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for part in parts]
            yield pa.RecordBatch.from_arrays(packed, names=["x", "offset", "prefers_a"])

    def unpack(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, offset, prefers_a = (np.frombuffer(part, dtype=np.float64) for part in row)
        return x.reshape(len(offset), features), offset, prefers_a

    return pairs.mapInArrow(pack, _BLOCK).rdd.map(unpack)


def moment_matching_fit(
    df: DataFrame,
    features: int,
    lr: float = LEARNING_RATE,
    tol: float = TOLERANCE,
    max_steps: int = 10_000,
    pref: str = "preferred",
    start: Sequence[float] | None = None,
) -> tuple[list[float], int, float]:
    """Gradient ascent on the coefficients until the largest moment gap is below ``tol``.

    The rows are packed into blocks of numbers once and kept by the executors (on disk where memory ends; a lost block is packed
    again from ``df``). A step is one job over them without a plan of its own, and a block sends one number per feature.
    Returns (coefficients, steps, last gap). Fits that need thousands of steps are better served by :func:`conditional_fit`.
    """
    blocks = _difference_blocks(df, features, pref).persist(StorageLevel.MEMORY_AND_DISK)
    weights = np.zeros(features) if start is None else np.array(start, dtype=np.float64)

    def gaps(total: np.ndarray, block: tuple[np.ndarray, np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
        x, offset, prefers_a = block
        share = 0.5 * (1.0 + np.tanh(0.5 * (offset + x @ at)))
        return total + np.append((prefers_a - share) @ x, len(offset))

    try:
        rows = blocks.map(lambda block: len(block[1])).sum()
        if not rows:
            raise ValueError("no row has all features and log scores")
        tasks = min(blocks.getNumPartitions(), -(-rows * (features + 2) // TASK_NUMBERS))
        dealt, depth = blocks.coalesce(tasks), 1 if tasks <= DIRECT_TASKS else 2
        for step in range(1, max_steps + 1):
            at = weights
            total = dealt.treeAggregate(np.zeros(features + 1), lambda t, b: gaps(t, b, at), np.add, depth)
            gap = total[:-1] / total[-1]
            weights = weights + lr * gap
            error = float(np.abs(gap).max())
            if error < tol:
                return weights.tolist(), step, error
    finally:
        blocks.unpersist()
    raise RuntimeError(f"gap {error:g} after {max_steps} steps is not below {tol:g}")


def conditional_fit(df: DataFrame, features: int, pref: str = "preferred", reg: float = 0.0) -> list[float]:
    """The maximum of the same likelihood: a binomial regression of the preference on feature differences, with the
    difference of the log scores as the offset and no intercept."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GeneralizedLinearRegression

    difference = F.zip_with("features_a", "features_b", lambda a, b: a - b)
    rows = df.select(
        array_to_vector(difference).alias("x"),
        F.when(F.col(pref) == "A", 1.0).otherwise(0.0).alias("label"),
        (F.col("log_score_a") - F.col("log_score_b")).alias("offset"),
    )
    fitter = GeneralizedLinearRegression(
        family="binomial", link="logit", featuresCol="x", labelCol="label", offsetCol="offset",
        fitIntercept=False, regParam=reg, maxIter=100, tol=1e-10,
    )
    return [float(w) for w in fitter.fit(rows).coefficients]
