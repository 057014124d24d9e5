"""Approximate nearest neighbours by inner product with an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefspark.session import settle

NEAREST = 20
#: The index is fitted on about this many vectors; it holds every vector.
SAMPLE_ROWS = 8_000
TRIALS = 100
AIM = 0.95
SHARES = tuple(n / 100 for n in (2, 5, *range(10, 100, 5), 100))
MAX_CENTROIDS = 256
#: Sizes of working blocks; they do not change a result.
ENTRY_BLOCK = 2_048
QUERY_BLOCK = 512


@dataclass
class Codebooks:
    """Centroids of the two halves, and the share of all entries that a search reads."""

    left: np.ndarray
    right: np.ndarray
    share: float

    @property
    def half(self) -> int:
        return self.left.shape[1]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _closest(vectors[:, : self.half], self.left), _closest(vectors[:, self.half :], self.right)


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _closest(x, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        sizes = np.bincount(nearest, minlength=k)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def traverse(query: np.ndarray, books: Codebooks, counts: np.ndarray, wanted: float) -> list[tuple[int, int]]:
    """Centroid pairs, nearest sum first, until their cells hold ``wanted`` entries. Empty cells cost nothing.

    The distance of a half to a centroid is its negative inner product, so that sums rank by the measure searched for.
    """
    far_left, far_right = -(books.left @ query[: books.half]), -(books.right @ query[books.half :])
    by_left, by_right = np.argsort(far_left, kind="stable"), np.argsort(far_right, kind="stable")
    d_left, d_right = far_left[by_left].tolist(), far_right[by_right].tolist()
    rows, columns = by_left.tolist(), by_right.tolist()
    heap, reached, found = [(d_left[0] + d_right[0], 0, 0)], 0, []
    while heap and reached < wanted:
        _, i, j = heapq.heappop(heap)
        n = int(counts[rows[i], columns[j]])
        if n:
            found.append((rows[i], columns[j]))
            reached += n
        if j + 1 < len(columns):
            heapq.heappush(heap, (d_left[i] + d_right[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (d_left[i + 1] + d_right[0], i + 1, 0))
    return found


def _share_for(vectors: np.ndarray, books: Codebooks, rng: np.random.Generator, nearest: int) -> float:
    """Smallest share of entries that finds AIM of the true neighbours, tried inside the sample.

    At one share a larger table gives a higher recall, so the share found on a sample is on the safe side.
    """
    a, b = books.cells(vectors)
    counts = np.zeros((len(books.left), len(books.right)), dtype=np.int64)
    np.add.at(counts, (a, b), 1)
    trials = rng.choice(len(vectors), min(TRIALS, len(vectors)), replace=False)
    needed = []
    for t in trials:
        scores = vectors @ vectors[t]
        scores[t] = -np.inf
        true = np.argsort(-scores, kind="stable")[:nearest]
        reached, upto = 0, {}
        for i, j in traverse(vectors[t], books, counts, len(vectors)):
            upto[i, j] = reached
            reached += int(counts[i, j])
        needed.extend(upto[a[x], b[x]] / len(vectors) for x in true)
    needed = np.array(needed)
    return next((s for s in SHARES if (needed < s).mean() >= AIM), 1.0)


def fit(entries: DataFrame, rows: int, nearest: int = NEAREST) -> Codebooks:
    """Codebooks from about SAMPLE_ROWS of ``entries`` (distinct vectors, ``rows`` of them), chosen by hash."""
    share = min(1.0, SAMPLE_ROWS / max(1, rows))
    sample = entries.where(F.pmod(F.xxhash64("entry"), F.lit(1 << 20)) < F.lit(share * (1 << 20)))
    collected = sample.select("entry", "vector").toArrow().sort_by("entry")
    vectors = np.stack(collected["vector"].to_numpy()).astype(np.float64)
    rng, half = np.random.default_rng(29), vectors.shape[1] // 2
    k = 2 ** round(math.log2(max(2.0, math.sqrt(rows) / 4)))
    k = max(1, min(k, MAX_CENTROIDS, len(vectors)))
    if half == 0:
        return Codebooks(np.zeros((1, 0)), _k_means(vectors, k, rng), 1.0)
    books = Codebooks(_k_means(vectors[:, :half], k, rng), _k_means(vectors[:, half:], k, rng), 1.0)
    books.share = _share_for(vectors, books, rng, nearest)
    return books


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of the rows that take part: an id, the usual length, finite components, not all zero; once each."""
    v = F.col("vector")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    usable = rows.where(
        F.col("id").isNotNull()
        & v.isNotNull()
        & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    usual = usable.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return usable.where(F.size(v) == F.lit(usual.n if usual else 0)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy().astype(np.float64)
    return flat.reshape(len(column), -1)


def _with_cells(entries: DataFrame, books: Codebooks) -> DataFrame:
    """Entries with their numbers of left and right centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = books.cells(_matrix(batch.column("vector")))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))],
                    names=[*batch.schema.names, "left", "right"],
                )

    kind = entries.schema["vector"].dataType.simpleString()
    return entries.mapInArrow(run, f"entry bigint, ids array<bigint>, vector {kind}, left int, right int")


def _probes(queries: DataFrame, books: Codebooks, counts: np.ndarray) -> DataFrame:
    """``query, vector, left, rights``: for each query and left centroid the right centroids whose cells are read."""
    wanted = books.share * counts.sum()
    kind = queries.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, lefts, rights = [], [], []
            for n, vector in enumerate(_matrix(batch.column("vector"))):
                lists: dict[int, list[int]] = {}
                for left, right in traverse(vector, books, counts, wanted):
                    lists.setdefault(left, []).append(right)
                rows.extend([n] * len(lists))
                lefts.extend(lists)
                rights.extend(lists.values())
            taken = batch.select(["query", "vector"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(lefts, pa.int32()), pa.array(rights, pa.list_(pa.int32()))],
                names=["query", "vector", "left", "rights"],
            )

    return queries.mapInArrow(run, f"query bigint, vector {kind}, left int, rights array<int>")


def _tile(entries: pa.Table, queries: pa.Table, keep: int) -> pa.RecordBatch:
    """Best ``keep`` entries of one block for each query of another, among the cells that the query reads."""
    x, q = _matrix(entries["vector"].combine_chunks()), _matrix(queries["vector"].combine_chunks())
    right = entries["right"].to_numpy()
    order = np.argsort(right, kind="stable")
    x, right = x[order], right[order]
    reads = np.zeros((len(q), int(right[-1]) + 1), dtype=bool)
    lists = queries["rights"].combine_chunks()
    owner = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
    wanted = lists.flatten().to_numpy()
    inside = wanted <= right[-1]
    reads[owner[inside], wanted[inside]] = True
    scores = np.full((len(q), len(x)), -np.inf)
    starts = np.flatnonzero(np.r_[True, right[1:] != right[:-1]])
    for a, b in zip(starts, np.r_[starts[1:], len(right)]):
        some = np.flatnonzero(reads[:, right[a]])
        if len(some):
            scores[some, a:b] = q[some] @ x[a:b].T
    k = min(keep + 4, len(x))
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    row, column = np.repeat(np.arange(len(q)), k), best.ravel()
    live = np.isfinite(scores[row, column])
    row, column = row[live], column[live]
    # The rank goes by a sum in fixed order: the same for a pair in whatever block it was met.
    exact = (q[row] * x[column]).sum(axis=1)
    first = entries["entry"].to_numpy()[order][column]
    sorted_ = np.lexsort((first, -exact, row))
    row, column, exact = row[sorted_], column[sorted_], exact[sorted_]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    row, column, exact = row[rank < keep], column[rank < keep], exact[rank < keep]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(queries["query"].to_numpy()[row]),
            pa.array(entries["entry"].to_numpy()[order[column]]),
            pa.array(exact),
        ],
        names=["query", "entry", "score"],
    )


def _search(cells: DataFrame, probes: DataFrame, keep: int) -> DataFrame:
    """``query, entry, score``: the best entries of every tile (block of a left list x block of its queries).

    Lists and their queries are dealt to blocks of bounded size and each pair of blocks is one tile, so neither a full
    cell nor a popular list is ever one task's group. A task holds one tile.
    """
    lists = cells.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / ENTRY_BLOCK).alias("blocks"))
    asked = probes.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("query_blocks"))
    sizes = settle(lists.join(asked, "left"), "tile_sizes")
    dealt = [
        cells.join(sizes, "left").select(
            "left",
            F.pmod(F.xxhash64("entry"), F.col("blocks")).alias("block"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_blocks") - 1)).alias("query_block"),
            F.lit(0).alias("role"),
            "vector",
            "entry",
            "right",
        ),
        probes.join(sizes, "left").select(
            "left",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("query"), F.col("query_blocks")).alias("query_block"),
            F.lit(1).alias("role"),
            "vector",
            "query",
            "rights",
        ),
    ]
    rows = (
        dealt[0]
        .unionByName(dealt[1], allowMissingColumns=True)
        .repartition("left", "block", "query_block")
        .sortWithinPartitions("left", "block", "query_block", "role")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        current = None

        def finish():
            if held[0] and held[1]:
                yield _tile(pa.Table.from_batches(held[0]), pa.Table.from_batches(held[1]), keep)
            held[0], held[1] = [], []

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if current is not None and tuple(keys[start][:3]) != current:
                    yield from finish()
                current = tuple(keys[start][:3])
                held[int(keys[start][3])].append(batch.slice(start, end - start))
        yield from finish()

    return rows.mapInArrow(run, "query bigint, entry bigint, score double")


def nearest(
    df: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = NEAREST,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each row where ``is_query(id)`` holds.

    Equal vectors are one entry with its k + 1 smallest ids, cut before the shuffle, so a vector that a third of all
    rows share is one entry and one query. Each half of a vector is quantised by its own codebook; the pair of numbers
    is its cell. A query walks through centroid pairs by summed distance with a heap until the cells hold the share of
    entries that the sample asked for, and those entries are ranked by the inner product of the original vectors in
    double precision. The driver sees the sample and one count per cell.

    Rows without id, with null, zero or non-finite vectors, or of another length than most, take no part; repeated rows
    count once. Fewer candidates than ``k`` give fewer rows; ties go to the smaller id. An id with several vectors is
    several candidates. No rows in, no rows out. Other columns are ignored.
    """
    spark = df.sparkSession
    valid = settle(valid_vectors(df, id_col, vector_col), "vectors")
    same = Window.partitionBy("vector").orderBy("id")
    entries = settle(
        valid.withColumn("n", F.row_number().over(same))
        .where(F.col("n") <= k + 1)
        .groupBy("vector")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .select(F.element_at("ids", 1).alias("entry"), "ids", "vector"),
        "entries",
    )
    rows = entries.count()
    if not rows:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    books = fit(entries, rows, k)
    cells = settle(_with_cells(entries, books), "cells")
    counts = np.zeros((len(books.left), len(books.right)), dtype=np.int64)
    for row in cells.groupBy("left", "right").count().collect():
        counts[row["left"], row["right"]] = row["count"]
    asking = valid.where(is_query(F.col("id")))
    queries = asking.groupBy("vector").agg(F.min("id").alias("query")).select("query", "vector")
    queries = settle(queries, "queries")
    probes = settle(_probes(queries, books, counts), "probes")
    found = _search(cells, probes, k + 1)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    top = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query", "entry", "score")
    listed = top.join(entries.select("entry", "ids"), "entry").select(
        "query", "score", F.explode("ids").alias("vec_id")
    )
    askers = asking.join(queries, "vector").select(F.col("id").alias("query_id"), "query")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        askers.join(listed, "query")
        .where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
