"""Side assignment, label forms, pseudo-labels and score calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.ordering import keyed_draw
from prefspark.functions.rewards import beats
from prefspark.operators.stats import pooled_moments


def _stem_columns(stems: Sequence[str], sides: tuple[str, str], bare: bool) -> dict[str, tuple[str, str]]:
    names = {stem: (f"{stem}_{sides[0]}", f"{stem}_{sides[1]}") for stem in stems}
    if bare:
        names[""] = sides
    return names


def coin(key: str, seed: int) -> Column:
    """A fair coin per key and seed: heads where the digest's first hex digit is below eight."""
    return F.substr(keyed_draw(seed, key), F.lit(1), F.lit(1)) < F.lit("8")


def randomize_sides(
    df: DataFrame, key: str, seed: int, stems: Sequence[str], response: str | None = "response"
) -> DataFrame:
    """Chosen/rejected columns to a/b columns by a keyed coin, with ``labels`` 1 where a is the chosen side.

    All sided columns of a row move together. The ``chosen`` and ``rejected`` columns themselves become
    ``<response>_a`` and ``<response>_b``; ``response=None`` says there are none.
    """
    heads = F.col("_heads")
    named = _stem_columns(stems, ("chosen", "rejected"), response is not None)
    used = {name for pair in named.values() for name in pair}
    columns = [F.col(f"`{c}`") for c in df.columns if c not in used]
    columns.append(F.when(heads, 1).otherwise(0).alias("labels"))
    for stem, (chosen, rejected) in named.items():
        target = stem or response
        winner, loser = F.col(f"`{chosen}`"), F.col(f"`{rejected}`")
        columns.append(F.when(heads, winner).otherwise(loser).alias(f"{target}_a"))
        columns.append(F.when(heads, loser).otherwise(winner).alias(f"{target}_b"))
    return df.withColumn("_heads", coin(key, seed)).select(*columns)


def orient_by_label(
    df: DataFrame,
    label: str,
    stems: Sequence[str],
    null_label: str = "quarantine",
    response: str | None = "response",
) -> tuple[DataFrame, DataFrame]:
    """A/b columns to chosen/rejected columns; returns (oriented rows, quarantined rows).

    Label 1 makes a the chosen side, any other value b. A null label is quarantined, or with
    ``null_label='other'`` treated like any other value.
    """
    if null_label not in ("quarantine", "other"):
        raise ValueError(f"unknown treatment {null_label!r}")
    first = F.col(label).eqNullSafe(F.lit(1))
    named = _stem_columns(stems, ("a", "b"), False)
    if response is not None:
        named[""] = (f"{response}_a", f"{response}_b")
    used = {name for pair in named.values() for name in pair}
    columns = [F.col(f"`{c}`") for c in df.columns if c not in used]
    for stem, (a, b) in named.items():
        prefix = f"{stem}_" if stem else ""
        left, right = F.col(f"`{a}`"), F.col(f"`{b}`")
        columns.append(F.when(first, left).otherwise(right).alias(f"{prefix}chosen"))
        columns.append(F.when(first, right).otherwise(left).alias(f"{prefix}rejected"))
    unlabelled = F.col(label).isNull() if null_label == "quarantine" else F.lit(False)
    return df.where(~unlabelled).select(*columns), df.where(unlabelled)


def option_of_label(label: str | Column, options: Sequence[str] = ("A", "B")) -> Column:
    """Option name of a label: 1 is the first option, 0 the second; names pass through, anything else is an error."""
    label = F.col(label) if isinstance(label, str) else label
    text = label.cast("string")
    return (
        F.when(text == "1", F.lit(options[0]))
        .when(text == "0", F.lit(options[1]))
        .when(text.isin(*options) | text.isNull(), text)
        .otherwise(F.raise_error(F.concat(F.lit("label without an option: "), text)))
    )


def preference_option(label: str | Column, options: Sequence[str] = ("A", "B")) -> Column:
    """The vector form: 1 is the first option, everything else the second."""
    label = F.col(label) if isinstance(label, str) else label
    return F.when(label.eqNullSafe(F.lit(1)), F.lit(options[0])).otherwise(F.lit(options[1]))


def pseudo_label_swap(
    pairs: DataFrame,
    scores: DataFrame,
    key: str,
    stems: Sequence[str],
    label: str | None = None,
    sides: tuple[str, str] = ("chosen", "rejected"),
    bare: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Re-label pairs by a scorer; returns (pairs with ``model_predict``, quarantined pairs).

    ``scores`` holds ``score_<side>`` per key. ``correct`` needs the winner's score to be strictly greater;
    every sided column of a ``wrong`` pair changes sides, by name. With ``label`` the winner of an a/b pair
    is the first side for 1 and the second for 0. Pairs without scores or with another label are
    quarantined.
    """
    first, second = F.col(f"score_{sides[0]}"), F.col(f"score_{sides[1]}")
    joined = pairs.join(scores.select(key, f"score_{sides[0]}", f"score_{sides[1]}"), key, "left")
    if label is None:
        correct = beats(first, second)
        usable = F.lit(True)
    else:
        correct = F.when(F.col(label) == 1, beats(first, second)).otherwise(beats(second, first))
        usable = F.col(label).isin(0, 1) & F.col(label).isNotNull()
    usable = usable & first.isNotNull() & second.isNotNull()
    marked = joined.withColumn("model_predict", F.when(usable, F.when(correct, "correct").otherwise("wrong")))
    wrong = F.col("model_predict") == "wrong"
    swapped = {}
    for left, right in _stem_columns(stems, sides, bare).values():
        swapped[left] = F.when(wrong, F.col(f"`{right}`")).otherwise(F.col(f"`{left}`"))
        swapped[right] = F.when(wrong, F.col(f"`{left}`")).otherwise(F.col(f"`{right}`"))
    scored = [f"score_{side}" for side in sides]
    good = marked.where(F.col("model_predict").isNotNull()).withColumns(swapped).drop(*scored)
    rejects = marked.where(F.col("model_predict").isNull()).drop(*scored, "model_predict")
    return good, rejects


def adopt_pseudo_labels(df: DataFrame, pseudo: str = "pseudo_labels", label: str = "labels") -> DataFrame:
    """Pseudo-labels in place of the labels."""
    return df.drop(label).withColumnRenamed(pseudo, label)


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows in which two label columns agree."""
    same = F.col(a) == F.col(b)
    return df.agg(F.avg(same.cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def debias_scores(scores: DataFrame, train: str = "train") -> tuple[DataFrame, DataFrame]:
    """Subtract each model's mean score over both sides of its train split; returns (scores, statistics).

    ``scores`` has model, split, score_chosen and score_rejected. The statistics are mean and population
    standard deviation before the shift, and accuracy, per model and split.
    """
    sides = ("score_chosen", "score_rejected")
    moments = pooled_moments(scores, sides, by=("model", "split"), ddof=0)
    bias = moments.where(F.col("split") == train).select("model", F.col("mean").alias("_bias"))
    shifted = scores.join(bias, "model").withColumns({s: F.col(s) - F.col("_bias") for s in sides}).drop("_bias")
    hits = scores.groupBy("model", "split").agg(
        F.avg(beats(F.col(sides[0]), F.col(sides[1])).cast("double")).alias("accuracy")
    )
    return shifted, moments.select("model", "split", "mean", "std").join(hits, ["model", "split"])


def cross_fit_attach(pairs: DataFrame, scores_by_model: dict[str, DataFrame], key: str) -> DataFrame:
    """Scores of several models beside every pair, matched by key whichever split a model was trained on."""
    attached = pairs
    for name, scores in scores_by_model.items():
        columns = scores.select(
            key,
            F.col("score_chosen").alias(f"{name}_chosen"),
            F.col("score_rejected").alias(f"{name}_rejected"),
        )
        attached = attached.join(columns, key, "left")
    return attached
