"""Attaching scores and features to samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digest_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    """Join on long texts: rows sort by a 64-bit digest, and the texts decide."""
    left = left.withColumn("_digest", F.xxhash64(*on))
    right = right.withColumn("_digest_r", F.xxhash64(*on)).withColumnsRenamed({c: f"_r_{c}" for c in on})

    def same(name: str) -> Column:
        ours, theirs = F.col(f"`{name}`"), F.col(f"`_r_{name}`")
        return ours.eqNullSafe(theirs) if null_safe else ours == theirs

    condition = reduce(lambda a, b: a & b, [same(c) for c in on], F.col("_digest") == F.col("_digest_r"))
    return left.join(right, condition, how).drop("_digest", "_digest_r", *[f"_r_{c}" for c in on])


def attach_scores_inner(
    df: DataFrame, scores: DataFrame, on: Sequence[str] = ("prompt", "response"), null_safe: bool = True
) -> DataFrame:
    """Samples with their scores; samples without one go.

    Exact duplicates of the score table count once, while different scores for one text each give a row.
    Null keys match one another.
    """
    return _digest_join(df, scores.dropDuplicates(), on, "inner", null_safe)


def attach_features_left(
    df: DataFrame,
    feats: DataFrame,
    on: Sequence[str] = ("prompt", "response"),
    keep_first_by: Sequence[str] | None = None,
    prefix: str = "extra_",
    null_safe: bool = True,
) -> DataFrame:
    """Extra features beside every sample; clashing names get the prefix, missing features stay null."""
    from prefspark.operators.curate import drop_duplicates

    columns = [c for c in feats.columns if c not in on]
    first = drop_duplicates(feats, on, keep_first_by or columns)
    renamed = first.withColumnsRenamed({c: f"{prefix}{c}" for c in columns if c in df.columns})
    return _digest_join(df, renamed, on, "left", null_safe)


class UnmatchedKeysError(ValueError):
    """Two tables that should match one to one do not."""


def attach_by_key(df: DataFrame, cols: DataFrame, key: Sequence[str]) -> DataFrame:
    """Columns of a table with the same rows, matched by key; any missing or repeated key is an error."""
    clash = [c for c in cols.columns if c in df.columns and c not in key]
    if clash:
        raise ValueError(f"columns {clash} exist already")
    left = df.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
    right = cols.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    sides = left.union(right).groupBy(*key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    odd = sides.where((F.col("_l") != 1) | (F.col("_r") != 1)).limit(3).collect()
    if odd:
        raise UnmatchedKeysError(f"keys that do not match one to one, such as {[r.asDict() for r in odd]}")
    return df.join(cols, list(key))


def add_original_fields(
    records: DataFrame, samples: DataFrame, key: Sequence[str], indices: tuple[int, int] = (0, 1)
) -> DataFrame:
    """Original prompt and both compared answers beside each judge record; an index past the end is an error."""
    first, second = indices
    originals = samples.select(
        *key,
        F.col("prompt").alias("original_prompt"),
        F.element_at("response", first + 1).alias("original_response1"),
        F.element_at("response", second + 1).alias("original_response2"),
    )
    return records.join(originals, list(key))
