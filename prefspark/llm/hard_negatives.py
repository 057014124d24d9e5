"""Hard negatives by an inverted multi-index whose search stops when the asked score window is certain."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefspark.session import settle

POSITIVES = 5
NEGATIVES = 5
#: A negative scores at least this many percent of the positive, and at most the positive's score.
LEAST_PERCENT = 80
#: Codebooks are fitted on about this many vectors, and on this many numbers at most; every vector is indexed.
SAMPLE_ROWS = 8_000
SAMPLE_NUMBERS = 4_000_000
MAX_CENTROIDS = 256
#: Rows with a scaled component of this size do not take part: a hundred inner products of 1,024 smaller ones fit a long.
LARGEST = 2**23
#: Entries that the first round reads for each anchor; every further round reads GROWTH times as many.
FIRST_READ = 16_384
GROWTH = 16
#: Sizes of working blocks; they do not change a result.
ENTRY_BLOCK = 2_048
ANCHOR_BLOCK = 1_024
HOT_ANCHORS = 4_096


@dataclass
class Index:
    """Codebooks of the two halves, the radius of every centroid, and the number of entries of every cell."""

    left: np.ndarray
    right: np.ndarray
    left_radii: np.ndarray
    right_radii: np.ndarray
    counts: np.ndarray

    @property
    def half(self) -> int:
        return self.left.shape[1]


def _closest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centroids = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        nearest = _closest(x, centroids)
        sizes = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0, None]
    return centroids


def half_bounds(query: np.ndarray, centroids: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """For each centroid a score that no member of its list exceeds with this half of the query; -inf for empty lists."""
    far = np.sqrt(query @ query) * radii
    bounds = centroids @ query + far
    return bounds + 1e-9 * (np.abs(bounds) + far) + 1e-6


def visit(query: np.ndarray, index: Index) -> Iterator[tuple[float, int, int]]:
    """All cells that hold entries, as (bound on their scores, left, right), by falling sum of the half bounds."""
    by_half = []
    for part, centroids, radii in (
        (query[: index.half], index.left, index.left_radii),
        (query[index.half :], index.right, index.right_radii),
    ):
        bounds = half_bounds(part, centroids, radii)
        order = np.argsort(-bounds, kind="stable")
        order = order[np.isfinite(bounds[order])]
        by_half.append((bounds[order].tolist(), order.tolist()))
    (high, rows), (wide, columns) = by_half
    heap = [(-(high[0] + wide[0]), 0, 0)] if rows and columns else []
    while heap:
        bound, i, j = heapq.heappop(heap)
        if index.counts[rows[i], columns[j]]:
            yield -bound, rows[i], columns[j]
        if j + 1 < len(columns):
            heapq.heappush(heap, (-(high[i] + wide[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(rows):
            heapq.heappush(heap, (-(high[i + 1] + wide[0]), i + 1, 0))


def scaled(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``id, label, vector, key`` of the rows that take part, each once; ``key`` is a 128-bit digest of vector and label."""
    v = F.col("_v")
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("_v"))
    fits = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * 256 >= LARGEST))
    whole = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & fits)
    usual = whole.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    kept = whole.where(F.size(v) == F.lit(usual.n if usual else 0)).select(
        F.col("id").cast("long"), F.col("label").cast("long"), scaled(v).cast("array<int>").alias("vector")
    )
    written = F.concat(F.array_join(F.transform("vector", lambda x: x.cast("string")), ","), F.lit(":"), "label")
    return kept.distinct().withColumn("key", F.unhex(F.md5(written.cast("binary"))))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integers: in double precision where every sum fits it, else in 64-bit integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2**53:
        return (q @ x.T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


def _fitted(entries: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Codebooks from about SAMPLE_ROWS of ``entries``, chosen by hash."""
    width = len(entries.select("vector").first()["vector"])
    wanted = min(SAMPLE_ROWS, SAMPLE_NUMBERS // width)
    draw = F.pmod(F.xxhash64("entry"), F.lit(1 << 20))
    sample = entries.where(draw < F.lit(min(1.0, wanted / rows) * (1 << 20))).select("entry", "vector").toArrow().sort_by("entry")
    if not sample.num_rows:
        sample = entries.select("entry", "vector").limit(1).toArrow()
    vectors, rng = _matrix(sample["vector"]), np.random.default_rng(31)
    k = min(2 ** round(math.log2(max(1.0, math.sqrt(rows) / 4))), MAX_CENTROIDS, len(vectors))
    half = width // 2
    return (_codebook(vectors[:, :half], k, rng) if half else np.zeros((1, 0))), _codebook(vectors[:, half:], k, rng)


def _with_cells(entries: DataFrame, left: np.ndarray, right: np.ndarray) -> DataFrame:
    """Entries with their cell and their distances from both of its centroids."""
    half = left.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"))
            a, b = _closest(x[:, :half], left), _closest(x[:, half:], right)
            far = np.linalg.norm(x[:, :half] - left[a], axis=1), np.linalg.norm(x[:, half:] - right[b], axis=1)
            extra = [pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), *map(pa.array, far)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *extra], names=[*batch.schema.names, "left", "right", "left_far", "right_far"]
            )

    kind = "entry bigint, key binary, label bigint, vector array<int>, ids array<bigint>"
    return entries.mapInArrow(run, f"{kind}, left int, right int, left_far double, right_far double")


def _index(cells: DataFrame, left: np.ndarray, right: np.ndarray) -> Index:
    """Radii and counts: at most MAX_CENTROIDS ** 2 rows come to the driver, whatever the table holds."""
    index = Index(
        left, right, np.full(len(left), -np.inf), np.full(len(right), -np.inf), np.zeros((len(left), len(right)), np.int64)
    )
    sums = [F.count(F.lit(1)).alias("n"), F.max("left_far").alias("a"), F.max("right_far").alias("b")]
    for row in cells.groupBy("left", "right").agg(*sums).collect():
        index.counts[row.left, row.right] = row.n
        index.left_radii[row.left] = max(index.left_radii[row.left], row.a)
        index.right_radii[row.right] = max(index.right_radii[row.right], row.b)
    return index


def _walks(asked: DataFrame, index: Index, budget: int) -> DataFrame:
    """One round of every search: ``entry, label, vector, windows, lowest, floor, seen, rest, lists``.

    The walk skips the ``seen`` cells of earlier rounds and takes cells by falling bound until they hold ``budget``
    entries or the bound falls below ``floor``, under which no entry can change the result. ``rest`` is the
    bound of the first cell not taken (null: none is left above the floor); ``lists`` holds the cells taken, by left centroid.
    """
    names = ["entry", "label", "vector", "windows", "lowest", "floor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            seen, rests, lists = [], [], []
            floors, before = batch.column("floor").to_pylist(), batch.column("seen").to_pylist()
            for vector, floor, skip in zip(_matrix(batch.column("vector")), floors, before):
                taken: dict[int, list[int]] = {}
                held, rest, at = 0, None, 0
                for bound, left, right in visit(vector, index):
                    if floor is not None and bound < floor:
                        break
                    if at >= skip:
                        if held >= budget:
                            rest = bound
                            break
                        taken.setdefault(left, []).append(right)
                        held += int(index.counts[left, right])
                    at += 1
                seen.append(at)
                rests.append(rest)
                lists.append([{"left": a, "rights": b} for a, b in taken.items()])
            kind = pa.list_(pa.struct([("left", pa.int32()), ("rights", pa.list_(pa.int32()))]))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], pa.array(seen, pa.int64()), pa.array(rests, pa.float64()), pa.array(lists, kind)],
                names=[*names, "seen", "rest", "lists"],
            )

    schema = "entry bigint, label bigint, vector array<int>, windows array<bigint>, lowest bigint, floor bigint, seen bigint, rest double"
    dealt = asked.repartition(asked.sparkSession.sparkContext.defaultParallelism, "entry")
    return dealt.mapInArrow(run, f"{schema}, lists array<struct<left:int,rights:array<int>>>")


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the first ``keep`` of each row by falling score and rising id."""
    order = np.lexsort((ids, -score, row))
    rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
    return order[rank < keep]


def _tile(entries: pa.Table, anchors: pa.Table) -> pa.RecordBatch:
    """Best rows of a block of entries for each anchor of another block, among the cells that the anchor reads.

    Without windows these are the highest POSITIVES + 1 rows of the anchor's label; with windows, the highest NEGATIVES
    of another label in each window. Rows below the anchor's floor cannot count any more.
    """
    x, q = _matrix(entries["vector"]), _matrix(anchors["vector"])
    right, rights = entries["right"].to_numpy(), anchors["rights"].combine_chunks()
    reads = np.zeros((len(q), int(right.max()) + 1), dtype=bool)
    owner, wanted = np.repeat(np.arange(len(q)), rights.value_lengths().to_numpy()), rights.flatten().to_numpy()
    reads[owner[wanted < reads.shape[1]], wanted[wanted < reads.shape[1]]] = True
    scores = _products(q, x)
    floors = np.array([np.iinfo(np.int64).min if f is None else f for f in anchors["floor"].to_pylist()])
    live = reads[:, right] & (scores >= floors[:, None])
    same = anchors["label"].to_numpy()[:, None] == entries["label"].to_numpy()[None, :]
    asker, number = anchors["entry"].to_numpy(), entries["entry"].to_numpy()
    lists = entries["ids"].combine_chunks()
    sizes = lists.value_lengths().to_numpy()
    starts = np.cumsum(sizes) - sizes
    flat = lists.flatten().to_numpy()
    first = flat[starts]
    windows = anchors["windows"].to_pylist()
    out: list[list[np.ndarray]] = [[], [], [], [], []]

    def take(row: np.ndarray, column: np.ndarray, high: np.ndarray | None, keep: int) -> None:
        """Whole rows of the best entries of each row of the tile."""
        score = scores[row, column]
        best = _best(row, score, first[column], keep)
        row, column, score = row[best], column[best], score[best]
        many = sizes[column]
        each = np.repeat(np.arange(len(column)), many)
        ids = flat[starts[column[each]] + np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)]
        chosen = _best(row[each], score[each], ids, keep)
        each, ids = each[chosen], ids[chosen]
        out[0].append(asker[row[each]])
        out[1].append(np.zeros(len(each), np.int64) if high is None else high[row[each]])
        out[2].append(ids)
        out[3].append(score[each])
        out[4].append(number[column[each]] == asker[row[each]])

    if windows[0] is None:
        live &= same
        keep = POSITIVES + 1
        for at in range(len(q)):
            # What ties with the last place stays, so that ids decide.
            candidates = np.flatnonzero(live[at])
            if len(candidates) > keep:
                own = scores[at, candidates]
                candidates = candidates[own >= np.partition(own, len(own) - keep)[len(own) - keep]]
            live[at] = False
            live[at, candidates] = True
        take(*np.nonzero(live), None, keep)
    else:
        live &= ~same
        for slot in range(max(map(len, windows))):
            high = np.array([w[slot] if slot < len(w) else -1 for w in windows])
            inside = live & (scores <= high[:, None]) & (100 * scores >= LEAST_PERCENT * high[:, None]) & (high >= 0)[:, None]
            take(*np.nonzero(inside), high, NEGATIVES)
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c), k) for c, k in zip(out, kinds)], names=["entry", "high", "id", "score", "own"]
    )


_FOUND = "entry bigint, high bigint, id bigint, score bigint, own boolean"


def _read(cells: DataFrame, walks: DataFrame) -> DataFrame:
    """Best rows of every tile: a block of a left centroid's list by a block of the anchors that read from it.

    Lists and their anchors are dealt to blocks of bounded size and each pair of blocks is one tile, so neither a full
    list nor a popular one is one task's group. A task holds one tile at a time.
    """
    probes = walks.select("entry", "label", "vector", "windows", "floor", F.explode("lists").alias("l")).select(
        "*", F.col("l.left").alias("left"), F.col("l.rights").alias("rights")
    ).drop("l")
    probes = settle(probes, "negative_probes")
    lists = cells.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / ENTRY_BLOCK).alias("blocks"))
    asked = probes.groupBy("left").agg(F.ceil(F.count(F.lit(1)) / ANCHOR_BLOCK).alias("anchor_blocks"))
    sizes = settle(lists.join(asked, "left"), "negative_tiles")
    none = F.lit(None)
    dealt = cells.join(sizes, "left").select(
        "left",
        F.pmod(F.xxhash64("entry"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("anchor_blocks") - 1)).alias("anchor_block"),
        F.lit(0).alias("role"),
        "entry", "label", "vector", "ids", "right",
        none.cast("array<bigint>").alias("windows"), none.cast("bigint").alias("floor"), none.cast("array<int>").alias("rights"),
    ).unionByName(
        probes.join(sizes, "left").select(
            "left",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
            F.pmod(F.xxhash64("entry"), F.col("anchor_blocks")).alias("anchor_block"),
            F.lit(1).alias("role"),
            "entry", "label", "vector", none.cast("array<bigint>").alias("ids"), none.cast("int").alias("right"),
            "windows", "floor", "rights",
        )
    )
    tile = ["left", "block", "anchor_block"]
    rows = dealt.repartition(*tile).sortWithinPartitions(*tile, "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in range(4)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if current != tuple(keys[start][:3]):
                    if held[0] and held[1]:
                        yield _tile(pa.Table.from_batches(held[0]), pa.Table.from_batches(held[1]))
                    held, current = ([], []), tuple(keys[start][:3])
                held[int(keys[start][3])].append(batch.slice(start, end - start))
        if held[0] and held[1]:
            yield _tile(pa.Table.from_batches(held[0]), pa.Table.from_batches(held[1]))

    return rows.mapInArrow(run, _FOUND)


def _certified(cells: DataFrame, index: Index, asked: DataFrame, keep: int) -> DataFrame:
    """Best ``keep`` rows of every (anchor, window), certain: ``entry, high, id, score, own``.

    ``asked`` holds ``entry, label, vector, windows, lowest``. Each round reads the next cells of every open search.
    The ``keep``-th score of a window, or the window's lower end, is its floor; the least floor of an
    anchor is where its walk may stop. The driver only learns whether a search is open.
    """
    open_, budget, best = asked.withColumn("floor", F.col("lowest")).withColumn("seen", F.lit(0).cast("long")), FIRST_READ, None
    while True:
        walks = settle(_walks(open_, index, budget), "negative_walks")
        found = _read(cells, walks)
        found = found if best is None else found.unionByName(best)
        order = Window.partitionBy("entry", "high").orderBy(F.desc("score"), "id", "own")
        ranked = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
        best = settle(ranked.drop("n"), "negative_best")
        waiting = walks.where("rest IS NOT NULL")
        if waiting.isEmpty():
            return best
        full = best.groupBy("entry", "high").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score"))
        reached = F.map_from_entries(F.collect_list(F.struct("high", "score"))).alias("reached")
        state = waiting.join(full.where(F.col("n") >= keep).groupBy("entry").agg(reached), "entry", "left")
        # A window that is not full yet wants everything down to its lower end.
        ends = F.transform("windows", lambda h: F.coalesce(F.element_at("reached", h), _lower_end(h)))
        floor = F.when(F.col("windows").isNull(), F.element_at("reached", F.lit(0).cast("long"))).otherwise(F.array_min(ends))
        state = state.withColumn("floor", F.coalesce(floor, "lowest")).where("floor IS NULL OR rest >= floor")
        open_ = settle(state.select("entry", "label", "vector", "windows", "lowest", "floor", "seen"), "negative_open")
        if open_.isEmpty():
            return best
        budget *= GROWTH


def _lower_end(high: Column) -> Column:
    """A score that nothing in the window below ``high`` undercuts."""
    return F.call_function("div", high * LEAST_PERCENT, F.lit(100))


def _classes(rows: DataFrame) -> DataFrame:
    """``entry, key, label, vector, ids``: rows of equal vector and label as one entry with their smallest ids.

    Ids are cut to the number that any result can show before the shuffle, so a vector that a third of all rows share is
    one entry like any other.
    """
    keep = max(POSITIVES + 1, NEGATIVES)
    same = Window.partitionBy("key").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(same)).where(F.col("n") <= keep)
    grouped = first.groupBy("key", "label", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return settle(grouped.withColumn("entry", F.monotonically_increasing_id()).select("entry", "key", "label", "vector", "ids"), "negative_entries")


def _by_anchor(anchors: DataFrame, results: DataFrame) -> DataFrame:
    """Anchors ``id, key`` beside their class's one row of ``results``. Classes of many anchors are dealt to several tasks."""
    often = anchors.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_ANCHORS)
    hot = settle(often.select("key", F.ceil(F.col("n") / HOT_ANCHORS).alias("parts")), "negative_hot")
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    dealt = anchors.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("id"), parts)).drop("parts")
    copies = results.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return dealt.join(copies.drop("parts"), ["key", "part"])


def mine(
    df: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for rows where ``is_anchor(id)`` holds.

    Scores are inner products of floor(256 x), in integers. An anchor's positives are its POSITIVES highest other rows
    of one label; each has the NEGATIVES highest rows of other labels that score between LEAST_PERCENT of it and itself. Ties
    go to the smaller id. The result is exact.

    Two codebooks, one for each half of a vector, form the cells. A search walks the cells with a heap by falling sum of
    two half-score bounds, (half of the anchor) x centroid + its length x the centroid's radius, and stops when no cell left can
    change the asked window: first when POSITIVES + 1 rows score above the bound, then when each window holds
    NEGATIVES rows above the bound or the bound is below its lower end. Walks go in rounds, each with a larger budget, and
    only searches that are not certain go on. How much is read depends on how well vectors cluster: without any
    structure, as in random vectors, bounds exclude little and blocks of anchors meet nearly all blocks of entries.

    Copies of a vector with one label are one entry and one search. The driver sees the sample the codebooks are fitted on
    and one row for each cell.

    Rows without id, label or vector, with null or non-finite components, with components of 2 ** 15 or more, or of
    another length than most take no part; repeated rows count once. An id with several vectors or labels is as many
    rows, each of them an anchor of its own. Positives that score below 0 have no negatives, as their window is empty. Fewer candidates give
    fewer rows, and no rows in, none out. Other columns are ignored.
    """
    spark = df.sparkSession
    rows = settle(usable_rows(df, id_col, vector_col, label_col), "negative_rows")
    anchors = rows.where(is_anchor(F.col("id"))).select("id", "key")
    entries = _classes(rows)
    number = entries.count()
    if not number:
        kinds = "positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
        return spark.createDataFrame([], f"anchor_id bigint, {kinds}")
    left, right = _fitted(entries, number)
    cells = settle(_with_cells(entries, left, right), "negative_cells")
    index = _index(cells, left, right)
    cells = cells.drop("key", "left_far", "right_far")
    classes = settle(entries.join(anchors.select("key").distinct(), "key").drop("ids"), "negative_classes")
    none = F.lit(None)
    asked = classes.select("entry", "label", "vector", none.cast("array<bigint>").alias("windows"), none.cast("bigint").alias("lowest"))
    top = _certified(cells, index, asked, POSITIVES + 1)
    listed = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "id", "score", "own")))
    positives = top.groupBy("entry").agg(listed.alias("positives"), F.count_if("own").alias("copies"))
    # The only row of a class is nobody's positive.
    useful = F.filter("positives", lambda p: (p.score >= 0) & ~(p.own & (F.col("copies") == 1)))
    windows = positives.withColumn("windows", F.array_distinct(F.transform(useful, lambda p: p.score)))
    windows = windows.where(F.size("windows") > 0).withColumn("lowest", F.array_min(F.transform("windows", _lower_end)))
    asked = classes.join(windows, "entry").select("entry", "label", "vector", "windows", "lowest")
    found = _certified(cells, index, settle(asked, "negative_windows"), NEGATIVES)
    each = F.array_sort(F.collect_list(F.struct("high", (-F.col("score")).alias("order"), "id", "score")))
    results = (
        classes.select("entry", "key")
        .join(positives, "entry")
        .join(found.groupBy("entry").agg(each.alias("negatives")), "entry")
        .select("key", "positives", "negatives")
    )
    shown = _by_anchor(anchors, results)
    others = F.slice(F.filter("positives", lambda p: ~(p.own & (p.id == F.col("anchor_id")))), 1, POSITIVES)
    return (
        shown.withColumnRenamed("id", "anchor_id")
        .select("anchor_id", "negatives", F.explode(others).alias("p"))
        .select("anchor_id", "p", F.posexplode(F.filter("negatives", lambda n: n.high == F.col("p.score"))).alias("at", "n"))
        .select(
            "anchor_id",
            F.col("p.id").alias("positive_id"),
            (F.col("at") + 1).alias("rank"),
            F.col("n.id").alias("negative_id"),
            F.col("p.score").alias("positive_score"),
            F.col("n.score").alias("negative_score"),
        )
    )
