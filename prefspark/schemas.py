"""Schemas of the interchange tables. Every table carries a stable key."""

from __future__ import annotations

from pyspark.sql import types as T

SIDES_AB = ("a", "b")
SIDES_CHOSEN = ("chosen", "rejected")


def pairs(feature_names: tuple[str, ...] = ()) -> T.StructType:
    """Chosen/rejected pairs with optional feature columns per side."""
    schema = (
        T.StructType()
        .add("pair_id", T.LongType(), False)
        .add("context", T.StringType())
        .add("chosen", T.StringType())
        .add("rejected", T.StringType())
        .add("split", T.StringType())
    )
    for name in feature_names:
        for side in SIDES_CHOSEN:
            schema = schema.add(f"{name}_{side}", T.DoubleType())
    return schema


NESTED_SAMPLES = (
    T.StructType()
    .add("prompt", T.StringType())
    .add("response", T.ArrayType(T.StringType()))
)

FLAT_SAMPLES = (
    T.StructType()
    .add("prompt", T.StringType())
    .add("sample_idx", T.LongType())
    .add("response", T.StringType())
)

JUDGE_RECORDS = (
    T.StructType()
    .add("prompt", T.StringType())
    .add("response", T.StringType())
    .add("prompt_swap", T.StringType())
    .add("response_swap", T.StringType())
    .add("assistant1", T.DoubleType())
    .add("assistant2", T.DoubleType())
    .add("original_prompt", T.StringType())
    .add("original_response1", T.StringType())
    .add("original_response2", T.StringType())
)

MODEL_TERMS = (
    T.StructType()
    .add("model", T.StringType(), False)
    .add("feature_pos", T.IntegerType(), False)
    .add("feature", T.StringType(), False)
    .add("mean", T.DoubleType(), False)
    .add("std", T.DoubleType(), False)
    .add("coef", T.DoubleType(), False)
)

MODEL_HEADERS = (
    T.StructType()
    .add("model", T.StringType(), False)
    .add("reward_mean", T.DoubleType())
    .add("reward_std", T.DoubleType())
    .add("acc", T.DoubleType())
)
