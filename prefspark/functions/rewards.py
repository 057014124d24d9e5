"""Column arithmetic for rewards and log-space pair models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(vector: str, weights: Sequence[float]) -> Column:
    """Weighted sum over an ``ARRAY<DOUBLE>`` column, unrolled so that it stays inside generated code."""
    terms = [f"get(`{vector}`, {i}) * {float(weight)!r}D" for i, weight in enumerate(weights)]
    return F.expr(" + ".join(terms))


def standardized_dot(
    vector: str, means: Sequence[float], stds: Sequence[float], weights: Sequence[float]
) -> Column:
    """Σ ((x − mean) / std) · weight over an ``ARRAY<DOUBLE>`` column."""
    terms = [
        f"(get(`{vector}`, {i}) - ({float(mean)!r}D)) / {float(std)!r}D * {float(weight)!r}D"
        for i, (mean, std, weight) in enumerate(zip(means, stds, weights))
    ]
    return F.expr(" + ".join(terms))


def softplus(value: Column) -> Column:
    """log(1 + exp(value)) without overflow."""
    return F.greatest(value, F.lit(0.0)) + F.log1p(F.exp(-F.abs(value)))


def log_sum_exp(left: Column, right: Column) -> Column:
    return F.greatest(left, right) + F.log1p(F.exp(-F.abs(left - right)))


def sigmoid(value: Column) -> Column:
    """1 / (1 + exp(−value)), evaluated on the side that cannot overflow."""
    decayed = F.exp(-F.abs(value))
    return F.when(value >= 0, 1 / (1 + decayed)).otherwise(decayed / (1 + decayed))


def beats(left: Column, right: Column) -> Column:
    """Strictly greater, false when either score is NaN, null when either is null."""
    return (left > right) & ~F.isnan(left) & ~F.isnan(right)
