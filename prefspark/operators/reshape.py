"""Nested samples to rows and back, and the sides of a pair as rows or columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE_ROWS = 256


def explode_samples(df: DataFrame, arrays: Sequence[str]) -> DataFrame:
    """One row per array element, parallel arrays kept together, with a 1-based ``sample_idx``."""
    others = [c for c in df.columns if c not in arrays]
    zipped = F.arrays_zip(*[F.col(c) for c in arrays])
    return df.select(*others, F.posexplode(zipped).alias("_pos", "_row")).select(
        *others,
        (F.col("_pos") + 1).cast("bigint").alias("sample_idx"),
        *[F.col("_row")[c].alias(c) for c in arrays],
    )


def collect_samples(
    df: DataFrame, key: Sequence[str], order_by: str, cols: Sequence[str], page_rows: int = PAGE_ROWS
) -> DataFrame:
    """Rows back to one list per group, in ``order_by`` order, in pages of a bounded number of rows.

    ``order_by`` is the 1-based position of a row in its group. A group of up to ``page_rows`` rows is one
    page; a larger one continues on the next page, so no list grows with the data and no row is left out.
    """
    page = F.floor((F.col(order_by) - 1) / page_rows).cast("bigint")
    rows = F.array_sort(F.collect_list(F.struct(order_by, *cols)))
    return (
        df.groupBy(*key, page.alias("page"))
        .agg(rows.alias("_rows"))
        .select(
            *key,
            "page",
            F.size("_rows").alias("n"),
            *[F.col("_rows")[c].alias(c) for c in cols],
        )
    )


def flatten_batches(df: DataFrame, col: str) -> DataFrame:
    """A list of batches as one list; a short last batch is kept."""
    return df.withColumn(col, F.flatten(col))


def _check_columns(df: DataFrame, wanted: Sequence[str]) -> None:
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise ValueError(f"unknown columns {missing}")


def pairs_to_long(df: DataFrame, sides: Sequence[str], cols: Sequence[str], bare: Sequence[str] = ()) -> DataFrame:
    """One row per pair and side. ``cols`` are stems of ``<stem>_<side>``; ``bare`` names columns that are the side itself.

    With ``bare=('response',)`` the column named like the side becomes ``response``.
    """
    stems = {stem: {side: f"{stem}_{side}" for side in sides} for stem in cols}
    stems.update({name: {side: side for side in sides} for name in bare})
    sided = [name for by_side in stems.values() for name in by_side.values()]
    _check_columns(df, sided)
    others = [c for c in df.columns if c not in sided]
    rows = F.array(
        *[
            F.struct(F.lit(side).alias("side"), *[F.col(f"`{names[side]}`").alias(stem) for stem, names in stems.items()])
            for side in sides
        ]
    )
    return df.select(*[F.col(f"`{c}`") for c in others], F.inline(rows))


def long_to_pairs(df: DataFrame, key: Sequence[str], sides: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """One row per pair from one row per pair and side; the sides are listed, so nothing is scanned for them."""
    _check_columns(df, [*key, "side", *cols])
    picked = [
        F.max(F.when(F.col("side") == side, F.col(f"`{c}`"))).alias(f"{c}_{side}") for c in cols for side in sides
    ]
    return df.groupBy(*key).agg(*picked)


def feature_array(df: DataFrame, features: Sequence[str], side: str | None = None, out: str = "features") -> DataFrame:
    """Feature columns as one ``ARRAY<DOUBLE>`` in the given order; an unknown feature is an error."""
    names = [f"{f}_{side}" if side else f for f in features]
    _check_columns(df, names)
    return df.withColumn(out, F.array(*[F.col(f"`{n}`").cast("double") for n in names]))


def index_samples(df: DataFrame, key: Sequence[str], order_by: str) -> DataFrame:
    """Lookup from key to row number; the last of several rows with the same key wins."""
    return df.groupBy(*key).agg(F.max(order_by).alias("row_index"))


def pivot_ratings(
    rated: DataFrame, key: Sequence[str], features: Sequence[str], value: str = "rating", prefix: str = ""
) -> DataFrame:
    """Rows (key, feature, value) as one column per listed feature."""
    picked = [F.max(F.when(F.col("feature") == f, F.col(value))).alias(f"{prefix}{f}") for f in features]
    return rated.groupBy(*key).agg(*picked)


def concat_datasets(dfs: Sequence[DataFrame]) -> DataFrame:
    """Datasets below one another by column name; differing columns are an error."""
    return reduce(lambda top, bottom: top.unionByName(bottom), dfs)
