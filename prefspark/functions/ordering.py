"""Ranks and cuts over tables too large, or groups too hot, for one sorted window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keyed_draw(seed: int, key: str | Column) -> Column:
    """Hex digest that depends on seed and key alone, so a recomputed task draws the same value."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


SLOT_ROWS = 65_536
MAX_SLOTS = 1_024
PROBES = 20_000


def counted_slots(df: DataFrame, key: str, slot_rows: int | None = None) -> Column:
    """Number of the key range that a row falls into, for ranges of about ``slot_rows`` rows whatever the keys are.

    Cuts come from a hash-ordered sample of the keys of bounded size, hence are the same on every run. Rows of one key
    share a slot. Beyond MAX_SLOTS ranges, slots grow with the table.
    """
    slots = min(MAX_SLOTS, -(-df.count() // (slot_rows or SLOT_ROWS)))
    if slots < 2:
        return F.lit(0)
    keys = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    sample = sorted(r.k for r in keys.orderBy(F.xxhash64("k"), "k").limit(PROBES).collect())
    cuts = sorted({sample[len(sample) * i // slots] for i in range(1, slots)}) if sample else []
    if not cuts:
        return F.lit(0)
    return F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))))


def with_position(
    df: DataFrame, group: Sequence[str], order_by: Sequence[str], out: str = "position", slot_rows: int | None = None
) -> DataFrame:
    """Number the rows of each group 1, 2, … in ``order_by`` order without sorting a whole group in one task.

    The range of the first order column is cut into slots of counted size. Rows are ranked inside (group, slot); the
    rank then moves up by the number of rows in the earlier slots of the group, which is counted with a partial
    aggregate.
    """
    slotted = df.withColumn("_slot", counted_slots(df, order_by[0], slot_rows))
    earlier = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        slotted.groupBy(*group, "_slot")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*group, "_slot").orderBy(*order_by)
    return (
        slotted.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, [*group, "_slot"], "left")
        .withColumn(out, F.col("_rank") + F.col("_before"))
        .drop("_rank", "_before", "_slot")
    )


def key_at_rank(df: DataFrame, key: str, rank: int, probes: int = 20_000, final_rows: int = 50_000):
    """The value of the unique, non-null column ``key`` at 1-based ``rank``, found by narrowing a key range.

    Each round reads only the key column: a hash-ordered probe of bounded size brackets the rank, and one
    counting aggregate keeps the bracket or rejects it. No global sort, no text moves. The driver sees at
    most ``probes`` keys.
    """
    keys = df.select(F.col(key).alias("k")).where(F.col("k").isNotNull())
    window, before, size = keys, 0, keys.count()
    if not 1 <= rank <= size:
        raise ValueError(f"rank {rank} is outside 1..{size}")
    while size > final_rows:
        sampled = window.orderBy(F.xxhash64("k"), "k").limit(probes)
        grid = [row.k for row in sampled.orderBy("k").collect()]
        centre = (rank - before) / size * len(grid)
        margin = 4 * max(1.0, (centre * (1 - centre / len(grid))) ** 0.5)
        low = grid[int(centre - margin)] if centre - margin > 0 else None
        high = grid[int(centre + margin)] if centre + margin < len(grid) else None
        under = F.lit(False) if low is None else F.col("k") <= F.lit(low)
        upto = F.lit(True) if high is None else F.col("k") <= F.lit(high)
        counted = window.agg(
            F.count_if(under).alias("under"), F.count_if(upto).alias("upto")
        ).first()
        previous = size
        if rank <= before + counted.under:
            window, size = window.where(under), counted.under
        elif rank > before + counted.upto:
            window, before, size = window.where(~upto), before + counted.upto, size - counted.upto
        else:
            window = window.where(upto & ~under)
            before, size = before + counted.under, counted.upto - counted.under
        if size == previous:
            raise ValueError(f"{key} repeats too often to rank by; a unique key is needed")
    return window.orderBy("k").limit(rank - before).agg(F.max("k")).first()[0]
