"""Texts as sparse vectors of hashed words and of their crosses with the prompt, and passes over such vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A prompt is crossed with a response through the smallest hashes of its words: all words of a short prompt, a hash
#: sample of a long one.
PROMPT_KEYS = 4
#: Entries of vectors that a task works on at once. Its arrays grow with this, or with one text that has more, and not with an Arrow batch.
ENTRIES = 1 << 19
#: Bytes of an Arrow batch on its way to Python. Spark holds a batch several times over outside of its heap, in each task.
BATCH_BYTES = 4 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Summaries of a pass that reach the driver; more are added up in groups on the way.
SUMMARIES = 8
_BASE = np.uint64(0x9E3779B97F4A7C15)


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """What runs here sends Python Arrow batches of at most BATCH_BYTES (or one row); then the session's own bound holds again."""
    own = spark.conf.get(_BYTES_SETTING, None)
    if own is None:
        spark.conf.set(_BYTES_SETTING, BATCH_BYTES)
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(_BYTES_SETTING)


def word_hashes(text: Column) -> Column:
    """64-bit hash of every word of a text; null has none."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def prompt_keys(prompt: Column, keys: int = PROMPT_KEYS) -> Column:
    return F.slice(F.array_sort(F.array_distinct(word_hashes(prompt))), 1, keys)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of an array column."""
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy()


def _blocks(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows, in order, that have at most ENTRIES entries together; a row with more is a run of its own."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + ENTRIES, side="right")))
        yield slice(start, stop)
        start = stop


def _text_blocks(batch: pa.RecordBatch, keys: str | int, words: Sequence[str | int]) -> Iterator[pa.RecordBatch]:
    """A batch of hashed texts in parts of bounded numbers of entries: each word counts by itself and with every key."""
    crossed = 1 + _lists(batch.column(keys))[0]
    sizes = sum(_lists(batch.column(w))[0] for w in words) * crossed
    for part in _blocks(sizes):
        yield batch.slice(part.start, part.stop - part.start)


def _combined(row: np.ndarray, index: np.ndarray, value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of equal row and index added up, in order; those that cancel are left out."""
    keys, place = np.unique(row * buckets + index, return_inverse=True)
    total = np.bincount(place, weights=value, minlength=len(keys))
    keep = total != 0
    return keys[keep] // buckets, keys[keep] % buckets, total[keep]


def vectors(words: pa.Array, keys: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, index, value`` of hashed texts: each distinct word with log(1 + count), by itself and crossed with every key
    of its prompt; words and crosses have length one each."""
    sizes, hashes = _lists(words)
    row = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])] if len(row) else np.zeros(0, bool))
    count = np.diff(np.r_[first, len(row)])
    row, hashes = row[first], hashes[first].view(np.uint64)
    value = np.log1p(count)
    length = np.sqrt(np.bincount(row, weights=value**2, minlength=len(words)))
    value = value / length[row]
    many, key = _lists(keys)
    starts, times = np.cumsum(many) - many, many[row]
    each = np.repeat(np.arange(len(row)), times)
    inside = np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times)
    crossed = (hashes[each] ^ (key[starts[row[each]] + inside].view(np.uint64) * _BASE)) * _BASE
    crossed ^= crossed >> np.uint64(31)
    return (
        np.concatenate([row, row[each]]),
        np.concatenate([hashes, crossed]).astype(np.uint64) % np.uint64(buckets),
        np.concatenate([value, value[each] / np.sqrt(np.maximum(many[row[each]], 1))]),
    )


def hashed_rows(
    df: DataFrame, sides: Sequence[tuple[str, float]], prompt: str | None, buckets: int, keep: Sequence[str | Column], keys: int = PROMPT_KEYS
) -> DataFrame:
    """``keep`` and ``index, value``: the sum of ``sign`` times the vector of each ``(text column, sign)``, in index order."""
    none = F.array().cast("array<bigint>")
    hashed = df.select(
        *keep,
        (prompt_keys(F.col(prompt), keys) if prompt else none).alias("_keys"),
        *[word_hashes(F.col(text)).alias(f"_words_{i}") for i, (text, _) in enumerate(sides)],
    )
    kept = hashed.columns[: len(keep)]
    schema = T.StructType(
        [*[hashed.schema[c] for c in kept], T.StructField("index", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.DoubleType()))]
    )
    signs, words = [sign for _, sign in sides], [f"_words_{i}" for i in range(len(sides))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _text_blocks(whole, "_keys", words):
                parts = []
                for name, sign in zip(words, signs):
                    row, index, value = vectors(batch.column(name), batch.column("_keys"), buckets)
                    parts.append((row, index.astype(np.int64), sign * value))
                row, index, value = _combined(*(np.concatenate(p) for p in zip(*parts)), buckets)
                ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (index.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *lists], names=[*kept, "index", "value"])

    return hashed.mapInArrow(run, schema)


class Block:
    """Sparse rows of one part of an Arrow batch."""

    def __init__(self, batch: pa.RecordBatch):
        sizes, self.index = _lists(batch.column("index"))
        self.value = batch.column("value").flatten().to_numpy()
        self.rows = batch.num_rows
        self.row = np.repeat(np.arange(self.rows), sizes)

    def times(self, weights: np.ndarray) -> np.ndarray:
        """Products of the rows with each row of ``weights``: rows x models."""
        out = np.empty((self.rows, len(weights)))
        for m, w in enumerate(weights):
            out[:, m] = np.bincount(self.row, weights=self.value * w[self.index], minlength=self.rows)
        return out

    def back(self, shares: np.ndarray, buckets: int) -> np.ndarray:
        """Sum over rows of (row of ``shares``) x (row of the block): models x buckets."""
        return np.stack(
            [np.bincount(self.index, weights=self.value * s[self.row], minlength=buckets) for s in shares.T]
        )


def summed(rows: DataFrame, part: Callable[[Block, pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum of ``part`` over all blocks of ``rows``: one pass, one summary a task, a bounded number of them to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for rows_of in _blocks(_lists(batch.column("index"))[0]):
                some = batch.slice(rows_of.start, rows_of.stop - rows_of.start)
                found = part(Block(some), some)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(batch.num_rows):
                found = batch.column("part")[i].values.to_numpy()
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["part"])

    parts, tasks = rows.mapInArrow(run, "part array<double>"), rows.rdd.getNumPartitions()
    while tasks > SUMMARIES:
        tasks = max(SUMMARIES, tasks // 16)
        parts = parts.repartition(tasks).mapInArrow(add, "part array<double>")
    total = np.zeros(size)
    with bounded_batches(rows.sparkSession):
        sums = parts.toArrow().column("part").to_pylist()
    for found in sums:
        total += np.asarray(found)
    return total


def add_scores(
    df: DataFrame,
    sides: Sequence[tuple[str, Sequence[str]]],
    prompt: str | None,
    weights: np.ndarray,
    constants: np.ndarray,
    keys: int = PROMPT_KEYS,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``, without which no text enters Python) with the products of each text's vector and every row of
    ``weights``, plus constants, under the names of its side."""
    buckets = weights.shape[1]
    none = F.array().cast("array<bigint>")
    words = [f"_words_{i}" for i in range(len(sides))]
    hashed = df.select(
        *(["*"] if keep is None else keep),
        (prompt_keys(F.col(prompt), keys) if prompt else none).alias("_keys"),
        *[word_hashes(F.col(text)).alias(name) for name, (text, _) in zip(words, sides)],
    )
    kept = hashed.schema.fields[: -1 - len(words)]
    names, columns = [name for _, out in sides for name in out], len(kept)
    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _text_blocks(whole, columns, range(columns + 1, columns + 1 + len(words))):
                scores = []
                for i in range(len(words)):
                    row, index, value = vectors(batch.column(columns + 1 + i), batch.column(columns), buckets)
                    for w, c in zip(weights, constants):
                        scores.append(pa.array(c + np.bincount(row, weights=value * w[index.astype(np.int64)], minlength=batch.num_rows)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:columns], *scores], names=[*batch.schema.names[:columns], *names])

    return hashed.mapInArrow(run, schema)
