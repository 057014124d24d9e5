"""Computed features: a registry of Column builders, and the lexical signals behind the offline rater."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.text import response_length, token_count, words

FeatureFn = Callable[[Column, Column], Column]

_registry: dict[str, FeatureFn] = {"length": response_length}


def register_feature(name: str, fn: FeatureFn) -> None:
    """Add a named feature ``fn(response, context) -> Column``; Python functions over values are not accepted."""
    probe = fn(F.lit("reply"), F.lit("context"))
    if not isinstance(probe, Column):
        raise TypeError(f"feature {name!r} must build a Column")
    _registry[name] = fn


def registered_features() -> dict[str, FeatureFn]:
    return dict(_registry)


def word_feature() -> None:
    """Switch on the optional token-count feature."""
    register_feature("token_length", token_count)


def add_features(
    df: DataFrame,
    responses: dict[str, str],
    context: str,
    features: dict[str, FeatureFn] | None = None,
) -> DataFrame:
    """Apply every feature to each response column. ``responses`` maps a suffix ('' for none) to its column."""
    features = registered_features() if features is None else features
    columns = {}
    for suffix, response in responses.items():
        for name, fn in features.items():
            target = f"{name}_{suffix}" if suffix else name
            columns[target] = fn(F.col(response), F.col(context)).cast("double")
    return df.withColumns(columns)


def add_lexical_signals(df: DataFrame, response: str, context: str, out: str = "signals") -> DataFrame:
    """Integer counts of a response and its overlap with the context, as one struct (null for a null response).

    The word lists and the struct are columns of their own, and the struct is conditional, so that the optimizer
    keeps each of them as one evaluation instead of copying it into every expression that reads a field. The counts are taken
    in a function over an array of one text, which Spark evaluates apart from the code it generates for the stage: with
    the counts of both sides of a pair that code was one method too large for the JVM to compile.
    """
    text, asked, reply = F.col(response), f"_asked_{out}", f"_reply_{out}"

    def counts(t: Column) -> Column:
        def occurrences(pattern: str) -> Column:
            return F.regexp_count(t, F.lit(pattern))

        return F.struct(
            F.length(t).alias("chars"),
            F.size(reply).alias("words"),
            F.size(F.array_distinct(reply)).alias("distinct_words"),
            F.size(asked).alias("context_words"),
            F.size(F.array_intersect(asked, reply)).alias("shared_words"),
            occurrences("[0-9]").alias("digits"),
            occurrences("[.!?]").alias("stops"),
            occurrences("!").alias("shouts"),
            occurrences("\n").alias("line_breaks"),
        )

    listed = df.withColumns({reply: words(text), asked: F.array_distinct(words(context))})
    counted = F.transform(F.array(text), lambda t: F.when(t.isNotNull(), counts(t)))[0]
    return listed.withColumn(out, counted).drop(reply, asked)
