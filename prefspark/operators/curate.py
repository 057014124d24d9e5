"""Filters, samples, splits and column choices over pair sets and sample sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from prefspark.functions.ordering import key_at_rank, keyed_draw
from prefspark.functions.text import (
    ASSISTANT,
    TURN_MARKS,
    count_literal,
    render_context,
    split_parts,
)

# The three features that the short form keeps.
SHORT_FEATURES = ("readability", "enough-detail", "fail-to-consider-context")


def single_round_filter(
    df: DataFrame, cols: Sequence[str], headers: Sequence[str] = TURN_MARKS
) -> DataFrame:
    """Rows in which every listed text holds each header exactly once."""
    checks = [count_literal(col, header) == 1 for col in cols for header in headers]
    return df.where(reduce(lambda a, b: a & b, checks))


def max_length_filter(df: DataFrame, cols: Sequence[str], n: int) -> DataFrame:
    """Rows in which every listed text is strictly shorter than ``n``; a null text drops the row."""
    checks = [F.length(col) < n for col in cols]
    return df.where(reduce(lambda a, b: a & b, checks))


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without a null or NaN in the given columns (all by default). Run before any best-of-n ranking."""
    names = list(cols) if cols is not None else df.columns
    present = []
    for name in names:
        col = F.col(f"`{name}`")
        present.append(col.isNotNull())
        if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
            present.append(~F.isnan(col))
    return df.where(reduce(lambda a, b: a & b, present))


def require_unique(df: DataFrame, key: str) -> None:
    """Raise where a key that is not null repeats. Keys are counted with a partial aggregate; rows do not move."""
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    repeated = counted.where("n > 1").orderBy(key).limit(1).collect()
    if repeated:
        raise ValueError(f"{key} {repeated[0][key]!r} repeats; a unique key is needed")


def sample_n(df: DataFrame, key: str, n: int, seed: int, allow_fewer: bool = False) -> DataFrame:
    """Exactly ``n`` rows drawn without replacement by a digest of seed and key.

    Only the draws are ranked; rows, with their texts, are then kept by comparison with the cut and never move. Keys
    must be unique; rows without a key are never drawn. Too few rows is an error unless ``allow_fewer``.
    """
    require_unique(df, key)
    keyed = df.where(F.col(key).isNotNull())
    present = keyed.count()
    if present < n and not allow_fewer:
        raise ValueError(f"{n} rows wanted, only {present} present")
    if not min(n, present):
        return df.limit(0)
    drawn = keyed.withColumn("_draw", F.concat(keyed_draw(seed, key), F.lit(":"), F.col(key).cast("string")))
    cut = key_at_rank(drawn, "_draw", min(n, present))
    return drawn.where(F.col("_draw") <= F.lit(cut)).drop("_draw")


def take_first(
    df: DataFrame, key: str, n: int, array_col: str | None = None, m: int | None = None
) -> DataFrame:
    """The first ``n`` keys' rows and, where asked, the first ``m`` elements of an array column.

    Rows without a key come last, hence never among the first. Of a repeated key all rows are taken.
    """
    keys = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("one"))
    cut = keys.select(key).orderBy(key).limit(n).agg(F.max(key)).scalar()
    taken = df.where(F.col(key) <= cut)
    if array_col is not None and m is not None:
        taken = taken.withColumn(array_col, F.slice(array_col, 1, m))
    return taken


def half_split(df: DataFrame, key: str) -> DataFrame:
    """Add ``split``: the first half of the rows by key is ``train``, the rest, with the odd row, ``test``.

    The key in the middle is found by narrowing; assigning the split is then a comparison inside each task. Keys must be
    unique; rows without a key belong to the second half.
    """
    require_unique(df, key)
    half = df.count() // 2
    keyed = df.where(F.col(key).isNotNull())
    half = min(half, keyed.count())
    if half == 0:
        return df.withColumn("split", F.lit("test"))
    middle = key_at_rank(keyed, key, half)
    return df.withColumn("split", F.when(F.col(key) <= F.lit(middle), "train").otherwise("test"))


def select_split(df: DataFrame, mode: str, key: str, holdout: int = 1000) -> DataFrame:
    """Add ``role`` (train or test). ``all`` trains on everything but the last ``holdout`` rows of the test split."""
    split = F.col("split")
    if mode == "train":
        return df.withColumn("role", split)
    if mode == "test":
        return df.withColumn("role", F.when(split == "train", "test").otherwise("train"))
    if mode != "all":
        raise ValueError(f"unknown mode {mode!r}")
    cut = (
        df.where(split == "test")
        .select(key)
        .orderBy(F.col(key).desc())
        .limit(holdout)
        .agg(F.min(key))
        .scalar()
    )
    held_out = (split == "test") & (F.col(key) >= cut)
    return df.withColumn("role", F.when(held_out, "test").otherwise("train"))


def prune_columns(
    df: DataFrame, features: Sequence[str], sides: Sequence[str] = ("a", "b"), keep: Sequence[str] = ("labels",)
) -> DataFrame:
    """The kept columns and exactly the named features per side, as doubles."""
    wanted = [f"{feature}_{side}" for feature in features for side in sides]
    missing = [c for c in [*keep, *wanted] if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return df.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("double") for c in wanted])


def round_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Numeric columns rounded to whole numbers, half to even."""
    return df.withColumns({c: F.bround(F.col(f"`{c}`"), 0) for c in cols})


def select_features(
    rubric: Sequence[str],
    computed: Sequence[str] = ("length",),
    prefix: str | None = None,
    subset: str | Sequence[str] | None = None,
) -> list[str]:
    """Feature names in position order: rubric names with the prefix, then computed names without it.

    ``subset`` is 'short', 'all' (rubric features only) or a list of rubric features.
    """
    rated = [f"{prefix or ''}{name}" for name in rubric]
    if subset is None:
        return [*rated, *computed]
    if subset == "short":
        return [name for name in [*rated, *computed] if any(part in name for part in SHORT_FEATURES)]
    if subset == "all":
        return rated
    unknown = [name for name in subset if name not in rubric]
    if unknown:
        raise ValueError(f"unknown features {unknown}")
    return [rated[i] for i, name in enumerate(rubric) if name in subset]


def drop_duplicates(
    df: DataFrame, on: Sequence[str] | None = None, keep_first_by: Sequence[str] | None = None
) -> DataFrame:
    """Distinct rows, or the first row per ``on`` in ``keep_first_by`` order.

    The rank filter lets Spark keep one row per key and task before the shuffle, so many copies of one key cost one
    row per task. A digest leads the key, so that long keys are told apart by eight bytes.
    """
    if on is None:
        return df.dropDuplicates()
    if not keep_first_by:
        raise ValueError("keep_first_by must name the order that makes a row the first")
    if not [c for c in df.columns if c not in on]:
        return df.dropDuplicates()
    copies = Window.partitionBy("_digest", *on).orderBy(*keep_first_by)
    ranked = df.withColumn("_digest", F.xxhash64(*on)).withColumn("_copy", F.row_number().over(copies))
    return ranked.where(F.col("_copy") == 1).drop("_digest", "_copy")


def split_prompt_response(
    df: DataFrame,
    strict: bool = False,
    mode: str = "prepend_split",
    chosen: str = "chosen",
    rejected: str = "rejected",
) -> tuple[DataFrame, DataFrame]:
    """Split transcripts at the assistant header; returns (good rows, quarantined rows with a reason).

    ``chosen`` must have exactly two parts. A mode without ``prepend_split`` checks but replaces nothing.
    """
    parsed = df.withColumns({"_chosen": split_parts(chosen), "_rejected": split_parts(rejected)})
    parts, other = F.size("_chosen"), F.try_element_at("_rejected", F.lit(2))
    replaces = "prepend_split" in mode
    reason = F.when(F.col("_chosen").isNull(), "chosen is null").when(
        parts != 2, F.concat(F.lit("chosen has "), parts.cast("string"), F.lit(" parts"))
    )
    if replaces:
        reason = reason.when(other.isNull(), "rejected has no response")
    if strict:
        reason = F.when(reason.isNotNull(), F.raise_error(reason)).otherwise(F.lit(None).cast("string"))
    marked = parsed.withColumn("reason", reason)
    good = marked.where(F.col("reason").isNull())
    if replaces:
        good = good.withColumns(
            {
                "prepend": F.concat(F.get("_chosen", F.lit(0)), F.lit(ASSISTANT)),
                chosen: F.get("_chosen", F.lit(1)),
                rejected: other,
            }
        )
    rejects = marked.where(F.col("reason").isNotNull()).drop("_chosen", "_rejected")
    return good.drop("_chosen", "_rejected", "reason"), rejects


def apply_context(
    df: DataFrame, mode: str, context: str = "context", sides: Sequence[str] = ("response_a", "response_b")
) -> DataFrame:
    """Put the rendered context in ``prepend``, or, outside split modes, in front of both responses."""
    rendered = render_context(context, mode)
    if "prepend_split" in mode:
        return df.withColumn("prepend", rendered)
    return df.withColumns({side: F.concat(rendered, F.col(side)) for side in sides})
