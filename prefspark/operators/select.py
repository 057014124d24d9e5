"""Best-of-n selection, its curve, candidates for comparison, and chunks of samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Sizes of the best-of-n curve; size and number of chunks.
BON_SIZES = (1, 2, 4, 8, 16)
CHUNK_SIZE = 16
CHUNKS = 6


# Ranks above this bound are not cut before the shuffle by Spark's default settings.
GROUP_LIMIT_ROWS = 1000
SALTS = 64


def _head(df: DataFrame, prompt: str, order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of every prompt with their rank and number.

    The rank filter lets Spark keep ``n`` rows per prompt and task before the shuffle, so a prompt with a
    large share of all rows stays small. Beyond the size for which Spark does that, salted parts of each
    prompt are cut to ``n`` rows first.
    """
    rows = df.where(F.col(prompt).isNotNull())
    if n > GROUP_LIMIT_ROWS:
        part = Window.partitionBy(prompt, "_salt").orderBy(*order_by)
        rows = (
            rows.withColumn("_salt", F.pmod(F.xxhash64(*order_by), F.lit(SALTS)))
            .withColumn("_part_rank", F.row_number().over(part))
            .where(F.col("_part_rank") <= n)
            .drop("_salt", "_part_rank")
        )
    order = Window.partitionBy(prompt).orderBy(*order_by)
    first = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
    return first.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy(prompt)))


def best_of_n(
    df: DataFrame,
    prompt: str = "prompt",
    order_by: Sequence[str] = ("sample_idx",),
    select_by: str = "score_a",
    other: str = "score_b",
    response: str = "response",
    sizes: Sequence[int] = BON_SIZES,
) -> DataFrame:
    """Per prompt and size n: among its first n rows the one with the highest ``select_by`` score, the first on a tie.

    A prompt with fewer than n rows uses all of them. A row with a NaN or null score is chosen only where all are such.
    """
    head = _head(df, prompt, order_by, max(sizes))
    running = Window.partitionBy(prompt).orderBy("_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    usable = F.when(~F.isnan(F.col(select_by).cast("double")), F.col(select_by))
    candidate = F.struct(
        usable.alias("a"), (-F.col("_rank")).alias("order"), F.col(other).alias("b"), F.col(response).alias("r")
    )
    reached = F.filter(
        F.array(*[F.lit(n) for n in sorted(sizes)]), lambda n: F.least(n.cast("bigint"), F.col("_rows")) == F.col("_rank")
    )
    return (
        head.withColumn("_best", F.max(candidate).over(running))
        .select(prompt, F.explode(reached).alias("n"), "_best")
        .select(
            "n",
            F.col("_best.a").alias("best_score_a"),
            F.col("_best.b").alias("best_score_b"),
            F.col("_best.r").alias("response"),
            prompt,
        )
    )


def bon_curve(bon: DataFrame) -> DataFrame:
    """Mean selected score by n for both scorers, with standard deviation, count and a 95 % band."""
    columns: list[Column] = []
    for side in ("a", "b"):
        score = f"best_score_{side}"
        error = F.stddev_samp(score) / F.sqrt(F.count(score))
        columns += [
            F.avg(score).alias(f"mean_{side}"),
            F.stddev_samp(score).alias(f"std_{side}"),
            (F.avg(score) - 1.96 * error).alias(f"low_{side}"),
            (F.avg(score) + 1.96 * error).alias(f"high_{side}"),
        ]
    return bon.groupBy("n").agg(*columns, F.count(F.lit(1)).alias("prompts"))


REPLICATES = 1_000
#: Chances that a prompt is drawn at most 0, 1, 2, ... times in a replicate: Poisson with mean 1.
_DRAWN = tuple(sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9))


def bon_band(
    bon: DataFrame, replicates: int = REPLICATES, seed: int = 0, level: float = 0.95, prompt: str = "prompt"
) -> DataFrame:
    """Resampled band of the curve: per n the mean selected score of both scorers between the quantiles of its replicates.

    In a replicate a prompt counts a Poisson number of times, read off a digest of seed, replicate and prompt: the same in every
    run, and the same for all n, so replicates are whole curves. Prompts grow their replicates inside the task and a partial aggregate
    adds them up; the shuffle carries one row per n and replicate. Null scores do not count; null prompts are one prompt.
    """
    listed = bon.groupBy(prompt).agg(F.collect_list(F.struct("n", "best_score_a", "best_score_b")).alias("picked"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.coalesce(F.col(prompt).cast("string"), F.lit("")))
    draw = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    times = sum((F.when(draw >= F.lit(p), 1).otherwise(0) for p in _DRAWN[1:]), F.when(draw >= F.lit(_DRAWN[0]), 1).otherwise(0))
    drawn = listed.select(prompt, "picked", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"))
    counted = drawn.withColumn("times", times).where(F.col("times") > 0).select("replicate", "times", F.inline("picked"))
    sides = {"a": "best_score_a", "b": "best_score_b"}
    sums = [
        c
        for side, score in sides.items()
        for c in (
            F.sum(F.col("times") * F.col(score)).alias(f"sum_{side}"),
            F.sum(F.when(F.col(score).isNotNull(), F.col("times"))).alias(f"count_{side}"),
        )
    ]
    curves = counted.groupBy("n", "replicate").agg(*sums)
    tail = (1 - level) / 2
    ends = [
        F.percentile(F.col(f"sum_{side}") / F.col(f"count_{side}"), F.lit(q)).alias(f"{name}_{side}")
        for side in sides
        for name, q in (("low", tail), ("high", 1 - tail))
    ]
    means = bon.groupBy("n").agg(*[F.avg(score).alias(f"mean_{side}") for side, score in sides.items()])
    return means.join(curves.groupBy("n").agg(*ends, F.count(F.lit(1)).alias("replicates")), "n")


def bon_candidates(
    df: DataFrame,
    score_cols: Sequence[str],
    prompt: str = "prompt",
    order_by: Sequence[str] = ("sample_idx",),
    response: str = "response",
    by: Sequence[str] = (),
) -> DataFrame:
    """Per prompt and model: the first response as the baseline beside the model's best response.

    The first row wins a tie and a NaN or null score never wins. Every model is one column of a single
    aggregate, which combines before the shuffle. ``by`` adds keys such as a chunk.
    """
    position = F.struct(*order_by)

    def best(score: str) -> Column:
        value = F.col(f"`{score}`")
        usable = value.isNotNull() & ~F.isnan(value.cast("double"))
        return F.min_by(response, F.when(usable, F.struct(-value, position)))

    picked = [
        F.struct(F.lit(score).alias("model"), best(score).alias("best_response")).alias(f"_model_{i}")
        for i, score in enumerate(score_cols)
    ]
    group = [*by, prompt]
    return (
        df.where(F.col(prompt).isNotNull())
        .groupBy(*group)
        .agg(F.min_by(response, position).alias("baseline"), *picked)
        .select(*group, "baseline", F.inline(F.array(*[f"_model_{i}" for i in range(len(score_cols))])))
        .select("model", *group, F.array("baseline", "best_response").alias("response"))
    )


def chunk_samples(
    df: DataFrame,
    prompt: str = "prompt",
    order_by: Sequence[str] = ("sample_idx",),
    size: int = CHUNK_SIZE,
    chunks: int = CHUNKS,
) -> DataFrame:
    """Add ``chunk``: chunk c is the last ``size`` of the prompt's first (c + 1) · ``size`` rows.

    A prompt with fewer rows gives its last ``size`` rows, so its later chunks repeat them.
    """
    head = _head(df, prompt, order_by, size * chunks)
    end = lambda c: F.least(F.col("_rows"), (c + 1) * size)
    holds = F.filter(
        F.sequence(F.lit(0), F.lit(chunks - 1)),
        lambda c: (F.col("_rank") <= end(c)) & (F.col("_rank") > end(c) - size),
    )
    return head.withColumn("chunk", F.explode(holds)).drop("_rank", "_rows")
