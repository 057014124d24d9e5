"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefspark.functions.ordering import keyed_draw
from prefspark.session import settle

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
SEED = 11
SLICE_ROWS = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """Targets per source from ``source, source_size, n``: one row per source, so the unpartitioned windows are short.

    Weights repeat over sources in code-point order, null last. A target is ``min(repeats * size, level * weight)``;
    the level that spends the whole budget is the largest of (budget - caps so far) / (weights left) when sources are
    taken by their cap per unit of weight.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    return (
        sizes.withColumn("rank", rank)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * repeats)
        .withColumn("budget", F.sum("source_size").over(everything))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.max(F.col("left") / F.sum("weight").over(onward)).over(everything))
        .select(
            "source",
            "rank",
            "source_size",
            "n",
            "budget",
            F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def running_total(df: DataFrame, group: list[str], slot: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running total of ``value`` per group in (slot, order) order; no task sorts more than one slot of a group."""
    earlier = Window.partitionBy(*group).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*group, slot)
        .agg(F.sum(value).alias("_sum"))
        .select(*group, slot, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*group, slot).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [*group, slot])
        .withColumn(out, F.col("_inside") + F.col("_before"))
        .drop("_inside", "_before")
    )


def _draw(seed: int, id_col: Column) -> Column:
    return keyed_draw(seed, F.coalesce(id_col.cast("string"), F.lit("null")))


def _mixture(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    repeats: int = MAX_REPEATS,
    seed: int = SEED,
    slice_rows: int = SLICE_ROWS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Taken items in mixing order, all rows with their source's target, and the sources."""
    rows = settle(
        df.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ).withColumn("row_id", F.monotonically_increasing_id()),
        "mix_rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    targets = settle(source_targets(sizes, weights, repeats), "mix_targets").withColumnRenamed("source", "of")
    known = rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of", "source")
    draw = _draw(seed, F.col("doc_id"))
    slots = F.ceil(F.col("n") / slice_rows)
    slot = F.floor(F.conv(F.substr("draw", F.lit(1), F.lit(8)), 16, 10).cast("double") / 2.0**32 * slots)
    shuffled = running_total(
        known.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("draw", draw).withColumn("slot", slot),
        ["rank"],
        "slot",
        ["draw", "doc_id", "size", "row_id"],
        "size",
        "words",
    )
    counts = rows.agg(F.ceil(F.count(F.lit(1)) * repeats / slice_rows).alias("slices"))
    items = (
        shuffled.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        .withColumn(
            "finish",
            (F.col("repeat") * F.col("source_size") + F.col("words") - F.col("size") / 2) / F.col("target"),
        )
        .withColumn("slices", F.lit(counts.first().slices))
        .withColumn("slice", F.floor(F.col("finish") * F.col("slices") / repeats))
        .withColumn("everything", F.lit(0))
    )
    ordered = running_total(items, ["everything"], "slice", ["finish", "rank", "repeat"], "size", "position")
    taken = ordered.where(F.col("position") <= F.col("budget"))
    return taken, known, targets


def mix(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The mixture and its account: (items in mixing order, one row per input row).

    Each source is shuffled by a digest of seed and id and may run through ``repeats`` times. An item's virtual finish
    time is its source's running words, up to the middle of the document, divided by the source's target; counting to
    the middle lets a source miss its target by half a document to either side. Items are sorted by that time over the
    whole corpus, in slices of equal virtual time, and cut where their running words reach the budget.

    Only (row, source, size) is shuffled. Running totals go by hash slots inside a source and by time slices over all,
    with counted offsets, so no task holds a whole source. The table of sources has one row per source; Spark
    broadcasts it only below its size threshold, since it is read from its written copy.

    Items: ``row_id, doc_id, source, repeat, words, finish, position`` (running words up to and with the item). Account:
    ``doc_id, size, source_size, target, taken``. Null text has size 0; empty documents are never taken. Null source
    is a source, the last one. Null and repeated ids are rows of their own; rows equal in id and size share a place at
    random only among themselves. No rows in, no rows out. Other columns are ignored.
    """
    taken, known, targets = _mixture(df, **options)
    names = targets.select("rank", F.col("of").alias("source"))
    mixture = taken.join(names, "rank").select(
        "row_id", "doc_id", "source", "repeat", F.col("size").alias("words"), "finish", "position"
    )
    counted = taken.groupBy("row_id").agg(F.sum("size").alias("taken"))
    account = known.join(counted, "row_id", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken")
    )
    return mixture, account


def mixed_rows(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, **options
) -> DataFrame:
    """The rows of ``df``, all columns, as often as the mixture takes them.

    A source's items are taken in the order of (repeat, draw, id, size) up to its last one, so that one row per source
    decides about all its documents where they are read, and no text is shuffled. Rows that repeat id and size are
    taken alike.
    """
    taken, _, targets = _mixture(df, id_col, text_col, source_col, seed=seed, **options)
    last = F.max_by(F.struct("repeat", "draw", "doc_id", "size"), "position").alias("last")
    cuts = settle(taken.groupBy("rank").agg(last).join(targets.select("rank", "of"), "rank"), "mix_cuts")
    packed = df.select(F.struct(*df.columns).alias("row"))
    words, key = word_count(F.col(f"row.{text_col}")), F.col(f"row.{id_col}")
    own = packed.withColumns({"size": words, "draw": _draw(seed, key)})
    joined = own.join(cuts, F.col(f"row.{source_col}").eqNullSafe(F.col("of"))).where(F.col("size") > 0)
    reached = F.struct(F.col("draw"), key.alias("doc_id"), F.col("size")) <= F.struct(
        F.col("last.draw"), F.col("last.doc_id"), F.col("last.size")
    )
    times = F.col("last.repeat") + F.when(reached, 1).otherwise(0)
    repeated = joined.withColumn("times", times).where("times > 0")
    return repeated.withColumn("time", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")
