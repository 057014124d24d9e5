"""Replies of a plugged-in model, asked for once per distinct task and kept where a later run finds them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.operators.rating import Rater, rate_with
from prefspark.session import settle, work_path

STORED = "key binary, reply string, attempts int, wave int"
#: A run commits its replies in so many parts; a crash loses the part it was at.
WAVES = 8
#: Calls after which a task without a reply is given up, over all runs.
ATTEMPTS = 3
HOT_ROWS = 4_096


def _stored(df: DataFrame, store: str) -> DataFrame:
    """The last word on every key of a store: its reply if it has one, and the calls made for it."""
    spark = df.sparkSession
    try:
        rows = spark.read.schema(STORED).parquet(store)
        rows.isEmpty()
    except AnalysisException:
        rows = spark.createDataFrame([], STORED)
    return rows.groupBy("key").agg(F.max("reply").alias("reply"), F.sum("attempts").cast("int").alias("attempts"))


def _some_failed(df: DataFrame, store: str) -> bool:
    """Whether a store holds a call without a reply; otherwise nothing that was asked is asked again, and no row need move to find out."""
    try:
        return not df.sparkSession.read.schema(STORED).parquet(store).where("reply IS NULL").isEmpty()
    except AnalysisException:
        return False


def _locator(within: Sequence[str]) -> Column:
    """Where a task comes from: its source row and its place among the tasks of that row."""
    return F.struct("_row", *within)


def replied(
    tasks: DataFrame,
    rater: Rater,
    store: str | None = None,
    name: str = "",
    task: str = "task",
    out: str = "reply",
    waves: int = WAVES,
    attempts: int = ATTEMPTS,
    render: Callable[[DataFrame], DataFrame] | None = None,
    within: Sequence[str] = (),
) -> DataFrame:
    """``tasks`` with a reply each, from ``store`` or from one call per distinct task text.

    The store is a table of replies by digest of ``name`` (which names the rater and its settings) and task. Tasks it holds are
    not asked again. The others are asked in waves, each committed by Spark's own write before the next begins: a wave
    that dies leaves no rows, and the next run goes on after the committed ones. A task that gets no reply is
    asked again, in this run and later ones, until it has had ``attempts`` calls; then its reply stays null. The replies
    are read back from the store, so whatever is computed from them never calls the rater again.

    With ``render``, ``tasks`` are the rows that tasks are made of: it turns rows into rows with a ``task`` each, any number per row, row by row, and keeps
    other columns; ``within`` names those that tell the tasks of a row apart. Texts then are written and move as they are in the
    rows, not once for each task, and tasks are rendered where they are digested and where they are asked; the result has no ``task``.

    Without ``store`` a fresh one in the shared folder serves this call alone. A null task gets a null reply and no call.
    Tasks that repeat more than HOT_ROWS times meet their reply in several partitions. No rows in, no rows out.
    """
    spark = tasks.sparkSession
    store = store or work_path(spark, "replies")
    digest = F.unhex(F.sha2(F.concat(F.lit(f"{name}\n"), F.col(task)).cast("binary"), 256))
    # Written once, so that a row keeps its number whatever is computed again.
    sources = settle(tasks.withColumn("_row", F.monotonically_increasing_id()), "task_sources")
    made = render(sources) if render else sources
    columns = [c for c in made.columns if c != "_row" and not (render and c == task)]
    keyed = made.select(*columns, "_row", digest.alias("_key"))
    if render:
        keyed = settle(keyed, "keyed_tasks")
    counted = keyed.where(F.col("_key").isNotNull()).groupBy(F.col("_key").alias("key"))
    distinct = settle(counted.agg(F.min(_locator(within)).alias("at"), F.count(F.lit(1)).alias("n")), "distinct_tasks")
    wave = F.pmod(F.xxhash64("key"), F.lit(waves)).cast("int")
    for attempt in range(attempts):
        if attempt and not _some_failed(tasks, store):
            break
        known = _stored(tasks, store)
        done = known.where(F.col("reply").isNotNull() | (F.col("attempts") >= attempts)).select("key")
        todo = distinct.join(done, "key", "left_anti").select(F.col("at._row").alias("_row"), F.struct("at", "key", wave.alias("wave")).alias("ask"))
        asks = todo.groupBy("_row").agg(F.collect_list("ask").alias("_asks"))
        opened = settle(sources.join(asks, "_row"), "open_tasks")
        open_waves = sorted(r.wave for r in opened.select(F.explode("_asks.wave").alias("wave")).distinct().collect())
        for number in open_waves:
            rows = opened.withColumn("_asks", F.filter("_asks", lambda a: a.wave == number)).where(F.size("_asks") > 0)
            own = F.filter("_asks", lambda a: a["at"] == _locator(within))
            found = (render(rows) if render else rows).withColumn("_own", own).where(F.size("_own") > 0)
            chosen = found.select(F.col("_own")[0].key.alias("key"), F.col(task).alias("task"), F.lit(number).alias("wave"))
            asked = rate_with(chosen, rater, out="reply")
            asked.select("key", "reply", F.lit(1).alias("attempts"), "wave").write.mode("append").parquet(store)
        if not open_waves:
            break
    replies = _stored(tasks, store).select(F.col("key").alias("_key"), F.col("reply").alias(out))
    hot = settle(
        distinct.where(F.col("n") > HOT_ROWS).select(F.col("key").alias("_key"), F.ceil(F.col("n") / HOT_ROWS).alias("_parts")), "hot_tasks"
    )
    if hot.isEmpty():
        return keyed.join(replies, "_key", "left").select(*columns, out)
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = keyed.join(hot, "_key", "left").withColumn("_part", F.pmod(F.xxhash64("_row", *columns), parts)).drop("_parts")
    copies = replies.join(hot, "_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(copies.drop("_parts"), ["_key", "_part"], "left").select(*columns, out)
