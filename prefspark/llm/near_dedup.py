"""Near-duplicates by MinHash bands, sequential Bayesian pruning and exact comparison of whole shingle sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.components import components
from prefspark.llm.labelled import text_blocks
from prefspark.session import settle

WORDS = 5
THRESHOLD = 85
BANDS, ROWS = 24, 5
PERMUTATIONS = BANDS * ROWS
BATCH = 24
#: A candidate is dropped when the posterior chance that its similarity reaches the threshold falls below this.
MISS = 1e-6
#: Sizes of working blocks; none changes a result.
TILE = 1_024
TEXT_TILE = 256
TEXT_CHARS = 4_000_000
PAIRS = 65_536
PAIR_BLOCK = 8_192
PARTNERS = 256
CACHED_WORDS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of a word, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str, hashes: WordHashes, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text.

    Lower-casing and splitting bytes touches A-Z and ASCII white space only. A shorter text is one shingle of all its
    words, a text without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    take = min(width, len(words))
    rolled = np.full(len(words) - take + 1, take, dtype=np.uint64)
    for i in range(take):
        rolled = rolled * _BASE + own[i : i + len(rolled)]
    return np.unique(_mixed(rolled))


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    factors = rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
    return factors, rng.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """PERMUTATIONS minima per non-empty set."""
    sizes = np.array([len(s) for s in sets])
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), PERMUTATIONS), dtype=np.uint32)
    for i, (factor, shift) in enumerate(zip(*_permutations())):
        out[:, i] = np.minimum.reduceat(flat * factor + shift, starts)
    return out


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """After each batch of compared values: the fewest matches with which a pair stays a candidate.

    With a uniform prior the similarity of a pair with m matches among n values follows Beta(m + 1, n - m + 1); its
    chance to be at least t is that of at most m successes in n + 1 draws of chance t.
    """
    bounds = {}
    for n in range(BATCH, PERMUTATIONS + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        bounds[n] = m
    return bounds


def survivors(left: np.ndarray, right: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two signature tables that stay candidates batch after batch, and their matches."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int32)
    for n, least in least_matches(threshold).items():
        part = slice(n - BATCH, n)
        matches[alive] += (left[alive, part] == right[alive, part]).sum(axis=1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def _table(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, PERMUTATIONS)


def text_key(text: Column) -> Column:
    """128-bit digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def profiles(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text_key, n, digest, signature``: key of each text; size, 128-bit digest and MinHash signature of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start, texts in text_blocks(batch, "_text"):
                sets = [shingle_set(t, hashes) for t in texts]
                full = [s for s in sets if len(s)]
                rows = iter(signatures(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("_id").slice(start, len(texts)),
                        batch.column("_key").slice(start, len(texts)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_key", "n", "digest", "signature"],
                )

    chosen = df.select(
        F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), text_key(F.col(text_col)).alias("_key")
    )
    return chosen.mapInArrow(run, "doc_id bigint, text_key binary, n bigint, digest binary, signature binary")


def _classes(profile: DataFrame) -> DataFrame:
    """``digest, least_id, text_key, doc``: each set with its smallest id, that id's least text and a number ``doc`` of its own.

    Numbers follow the smallest ids, so that the smallest number of a bucket is the class with the smallest id. Classes
    without an id come last, in the order of their digests.
    """
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("least_id"), F.col("text_key").alias("text_key")))
    found = profile.where("n > 0").groupBy("digest").agg(least.alias("least")).select("digest", "least.least_id", "least.text_key")
    order = [F.col("least_id").asc_nulls_last(), F.col("digest").asc()]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    return settle(ranged.withColumn("doc", F.monotonically_increasing_id()), "classes")


def _same_ids(rows: DataFrame) -> DataFrame:
    """``id, low, high, blank`` of ids whose rows belong to several classes, or to a class and to none."""
    ids = rows.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    seen = ids.agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.max(F.col("doc").isNull()).alias("blank"))
    return settle(seen.where("low < high OR (blank AND low IS NOT NULL)"), "same_ids")


def band_entries(representatives: DataFrame) -> DataFrame:
    """``key, doc``: one row for each band of each signature; equal keys mean equal bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(band_keys(_table(batch.column("signature"))).ravel()),
                    pa.array(np.repeat(batch.column("doc").to_numpy(zero_copy_only=False), BANDS)),
                ],
                names=["key", "doc"],
            )

    return representatives.select("doc", "signature").mapInArrow(run, "key bigint, doc bigint")


def band_keys(table: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each signature; the number of the band is part of it."""
    bands = table.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for i in range(ROWS):
        keys = _mixed(keys * _BASE + bands[:, :, i])
    return keys.view(np.int64)


def _texts_of(docs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc, text`` of some classes.

    Their ids alone are written first: few of them are broadcast, and only rows with such an id, or with such a text and
    no id, meet the keys of the texts.
    """
    wanted = settle(docs.distinct().join(classes.select("doc", "text_key", "least_id"), "doc"), "wanted")
    ids = settle(wanted.where("least_id IS NOT NULL").select(F.col("least_id").alias("id")).distinct(), "wanted_ids")
    unnamed = settle(wanted.where("least_id IS NULL").select("text_key"), "wanted_keys")
    near = texts.join(ids, "id", "left_semi").withColumn("text_key", text_key(F.col("text")))
    if not unnamed.isEmpty():
        others = texts.where("id IS NULL").withColumn("text_key", text_key(F.col("text")))
        near = near.unionByName(others.join(unnamed, "text_key", "left_semi").select("id", "text", "text_key"))
    found = near.join(wanted.drop("least_id"), "text_key").groupBy("doc").agg(F.max("text").alias("text"))
    return settle(found, "near_texts")


def _prune(pairs: DataFrame, representatives: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) that pass the sequential comparison of their signatures."""
    a = representatives.select(F.col("doc").alias("a"), F.col("signature").alias("sa"))
    b = representatives.select(F.col("doc").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive, _ = survivors(_table(batch.column("sa")), _table(batch.column("sb")), threshold)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def _verify(pairs: DataFrame, texts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose whole shingle sets reach the threshold.

    A document ``a`` with many partners is compared with them in blocks of about PARTNERS; its text travels once for each
    block, and a task holds its set and one partner at a time.
    """
    found = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc")), texts, classes)
    blocks = settle(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("blocks")), "near_blocks")
    partners = pairs.join(blocks, "a").select(
        "a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), F.lit(1).alias("role"), F.col("b").alias("doc")
    )
    heads = blocks.select(
        "a",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
        F.lit(0).alias("role"),
        F.col("a").alias("doc"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, head = WordHashes(), None, None
        for batch in batches:
            a, b = [], []
            for key, block, role, doc, text in zip(*(batch.column(i) for i in range(5))):
                own = shingle_set(text.as_py() or "", hashes)
                if role.as_py() == 0:
                    held, head = own, (key.as_py(), block.as_py())
                elif head == (key.as_py(), block.as_py()):
                    shared = len(np.intersect1d(held, own, assume_unique=True))
                    if shared and 100 * shared >= percent * (len(held) + len(own) - shared):
                        a.append(key.as_py())
                        b.append(doc.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["u", "v"])

    return (
        partners.unionByName(heads)
        .join(found, "doc")
        .select("a", "block", "role", "doc", "text")
        .repartition("a", "block")
        .sortWithinPartitions("a", "block", "role")
        .mapInArrow(run, "u bigint, v bigint")
    )


def _dealt(members: DataFrame, tile: int, wide: DataFrame) -> DataFrame:
    """Members (``key, doc, component, chars``) of each bucket dealt to blocks, with the columns of ``wide`` by ``doc``.

    A block has about ``tile`` members or TEXT_CHARS characters, and each pair (i, j) of blocks is one tile of its rows. The bucket's
    largest component has blocks of its own, which never meet each other: a member of it comes once for each block of the others,
    so a group that is joined already but for a few members is not copied for each of its blocks. ``wide`` is met before rows are copied.
    """

    def blocks(n: str, chars: str) -> Column:
        return F.ceil(F.greatest(F.col(n) / tile, F.col(chars) / TEXT_CHARS))

    sizes = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"))
    buckets = sizes.groupBy("key").agg(
        F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.max(F.struct("n", "component", "chars")).alias("main")
    )
    rests = buckets.select(
        "key",
        F.col("main.component").alias("main"),
        blocks("n", "chars").alias("all"),
        blocks("main.n", "main.chars").alias("mains"),
        (F.col("n") - F.col("main.n")).alias("n"),
        (F.col("chars") - F.col("main.chars")).alias("chars"),
    )
    one = F.col("all") <= 1
    counted = settle(
        rests.select(
            "key",
            "main",
            F.when(one, 0).otherwise(F.col("mains")).alias("mains"),
            F.when(one, 1).otherwise(F.greatest(blocks("n", "chars"), F.lit(1))).alias("rests"),
        ),
        "near_buckets",
    )
    apart, drawn = (F.col("component") == F.col("main")) & (F.col("mains") > 0), F.xxhash64("doc", "key")
    own = F.when(apart, F.col("rests") + F.pmod(drawn, F.col("mains"))).otherwise(F.pmod(drawn, F.col("rests")))
    met = F.when(apart, F.col("rests")).otherwise(F.col("rests") + F.col("mains"))
    placed = members.join(counted, "key").select("key", "doc", "component", own.alias("own"), met.alias("met"))
    copied = placed.join(wide, "doc").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("met") - 1)))
    return copied.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("met", "other")


def _surviving_pairs(
    table: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of row numbers that stay candidates batch after batch, and their matches; one batch of values is gathered at a time."""
    matches = np.zeros(len(a), dtype=np.int32)
    for n, least in least_matches(threshold).items():
        part = slice(n - BATCH, n)
        matches += (table[a, part] == table[b, part]).sum(axis=1, dtype=np.int32)
        alive = matches >= least
        a, b, matches = a[alive], b[alive], matches[alive]
    return a, b, matches


def _first_band_keys(table: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of the first band in which each pair of rows agrees; the pairs do agree in one."""
    keys = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), PAIR_BLOCK):
        x, y = table[a[at : at + PAIR_BLOCK]], table[b[at : at + PAIR_BLOCK]]
        first = (x == y).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1)
        keys[at : at + PAIR_BLOCK] = band_keys(x)[np.arange(len(x)), first]
    return keys


def _tile_pairs(rows: pa.Table, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers and matches of the pairs of a tile that lie in different components and pass the pruning.

    A pair that shares several buckets belongs to that of the first band in which it agrees. Pairs come in blocks of
    at most PAIRS, so a tile whose members all resemble each other needs no more memory than any other.
    """
    i, j, own, part = (rows[n].to_numpy() for n in ("i", "j", "own", "component"))
    table, key = _table(rows["signature"].combine_chunks()), np.int64(rows["key"][0].as_py())
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    least, within = least_matches(threshold)[BATCH], bool((i == j).all())
    across = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), across):
        some = left[at : at + across]
        same = np.zeros((len(some), len(right)), dtype=np.int16)
        for k in range(BATCH):
            same += table[some, k][:, None] == table[right, k][None, :]
        x, y = np.nonzero((same >= least) & (part[some][:, None] != part[right][None, :]))
        a, b = some[x], right[y]
        if within:
            a, b = a[a < b], b[a < b]
        a, b, matches = _surviving_pairs(table, a, b, threshold)
        here = _first_band_keys(table, a, b) == key
        yield a[here], b[here], matches[here]


def _by_tile(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on each tile. Rows of a tile arrive together, and a task holds one tile at a time."""
    names = ["key", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(n).to_numpy() for n in names], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if held and tuple(keys[start]) != current:
                    yield work(pa.Table.from_batches(held))
                    held = []
                current = tuple(keys[start])
                held.append(batch.slice(start, end - start))
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, schema)


def _undecided(members: DataFrame, representatives: DataFrame, threshold: float) -> DataFrame:
    """``key, doc, component`` of the members that have a candidate of another component in the bucket."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        met = np.zeros(rows.num_rows, dtype=bool)
        for a, b, _ in _tile_pairs(rows, threshold):
            met[a] = met[b] = True
        chosen = rows.select(["key", "doc", "component"]).take(np.flatnonzero(met)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.combine_chunks() for c in chosen.columns], names=chosen.column_names)

    rows = _dealt(members.withColumn("chars", F.lit(0)), TILE, representatives)
    return _by_tile(rows, work, "key bigint, doc bigint, component bigint").distinct()


def _tile_links(rows: pa.Table, threshold: float, percent: int, hashes: WordHashes) -> pa.RecordBatch:
    """Links that join components of a tile: closest candidates first, and none inside what is already joined."""
    none = np.zeros(0, dtype=np.int64)
    a, b, matches = (np.concatenate(parts) for parts in zip((none, none, none), *_tile_pairs(rows, threshold)))
    doc, part = rows["doc"].to_numpy(), rows["component"].to_numpy()
    used, place = np.unique(np.r_[a, b]), {}
    sets = [shingle_set(rows["text"][int(r)].as_py() or "", hashes) for r in used]
    sizes = [len(s) for s in sets]
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1] if sets else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(sizes).tolist()
    for r, end, n in zip(used.tolist(), ends, sizes):
        place[r] = numbers[end - n : end]
    marked = np.zeros(int(numbers.max()) + 1 if len(numbers) else 0, dtype=bool)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    u, v = [], []
    order = np.lexsort((b, a, -matches))
    last = None
    for x, y in zip(a[order].tolist(), b[order].tolist()):
        p, q = root(int(part[x])), root(int(part[y]))
        if p == q:
            continue
        if x != last:
            if last is not None:
                marked[place[last]] = False
            marked[place[x]] = True
            last = x
        shared = int(np.count_nonzero(marked[place[y]]))
        if 100 * shared >= percent * (len(place[x]) + len(place[y]) - shared):
            parent[max(p, q)] = min(p, q)
            u.append(int(doc[x]))
            v.append(int(doc[y]))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _links_between(
    undecided: DataFrame, representatives: DataFrame, texts: DataFrame, classes: DataFrame, threshold: float, percent: int
) -> DataFrame:
    """Links between components among undecided members, compared on whole sets inside their tiles."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        return _tile_links(rows, threshold, percent, WordHashes())

    found = _texts_of(undecided.select("doc"), texts, classes)
    sized = undecided.join(found.select("doc", F.length("text").alias("chars")), "doc")
    rows = _dealt(sized, TEXT_TILE, found.join(representatives, "doc"))
    return _by_tile(rows, work, "u bigint, v bigint")


def near_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row: components of documents similar to ``percent``."""
    return decisions(df, id_col, text_col, percent).drop("text_key")


def decisions(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = THRESHOLD
) -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` for every row: components of documents similar to ``percent``.

    1. Each text becomes the set of its word shingles, a digest of the set and a MinHash signature. Equal sets are one
       class with a number, a signature and a text of its own; further on only classes count.
    2. Signatures that agree in a band share a bucket. Candidates are compared batch by batch of signature values and
       dropped once similarity at the threshold has a posterior chance below MISS; survivors are compared on whole sets.
    3. Pairs of a bucket are never written. First every member is compared with the bucket's smallest number. A bucket inside
       one component needs no more. Where several are left, members of different components are compared in tiles of
       bounded size: signatures find the members that have such a candidate, and these meet again with their texts, so
       that a tile compares whole sets itself and only returns links that join components.

    Results do not depend on the order of the steps; a link is missed only where no band agrees (chance (1 - s^5)^24,
    3 in 10 million at s = 0.85) or by the pruning. Null, empty and blank texts have no shingle and link with nothing.
    Rows with one id are one document, whatever their texts: their classes are joined, a row without shingles goes with
    the others, and all or none of them are kept. Rows without an id are a document for each text: they link like all others, take the
    smallest id of their component and are not kept where there is one; of a component without any id the least text of the
    first class is kept. ``text_key`` tells such rows apart. No rows in, no rows out. Other columns are ignored.
    """
    threshold = percent / 100
    profile = settle(profiles(df, id_col, text_col), "profiles")
    classes = _classes(profile)
    signed = profile.where("n > 0").groupBy("digest").agg(F.first("signature").alias("signature"))
    representatives = settle(signed.join(classes, "digest").select("doc", "signature"), "representatives")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    least_text = (F.col("text_key") == F.col("least_key")).alias("least_text")
    placed = profile.select("doc_id", "text_key", "n", "digest").join(
        classes.withColumnRenamed("text_key", "least_key"), "digest", "left"
    )
    rows = settle(placed.select("doc_id", "text_key", "n", "doc", "least_id", least_text), "near_rows")
    repeated = _same_ids(rows)
    spark = df.sparkSession
    edges = spark.createDataFrame([], "u bigint, v bigint")
    if not repeated.isEmpty():
        several = rows.join(repeated, F.col("doc_id") == F.col("id")).where("doc > low")
        edges = settle(several.select(F.col("doc").alias("u"), F.col("low").alias("v")).distinct(), "same_id_edges")
        first = repeated.join(classes.select(F.col("doc").alias("low"), F.col("least_id").alias("low_id")), "low")
        rows = rows.join(first.where("blank"), F.col("doc_id") == F.col("id"), "left").select(
            "doc_id",
            "text_key",
            "n",
            F.coalesce("doc", "low").alias("doc"),
            F.coalesce("least_id", "low_id").alias("least_id"),
            "least_text",
        )
    entries = band_entries(representatives)
    shared = settle(entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key"), "shared_keys")
    buckets = settle(entries.join(shared, "key"), "buckets")
    labels = spark.createDataFrame([], "node bigint, component bigint")
    hubs = settle(buckets.groupBy("key").agg(F.min("doc").alias("a")), "hubs")
    pairs = buckets.join(hubs, "key").where("doc != a").select("a", F.col("doc").alias("b")).distinct()
    candidates = settle(_prune(pairs, representatives, threshold), "candidates")
    if not candidates.isEmpty():
        edges = edges.unionByName(_verify(candidates, texts, classes, percent))
    if not (candidates.isEmpty() and repeated.isEmpty()):
        labels = settle(components(edges), "labels")
    placed = buckets.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(
        "key", "doc", F.coalesce("component", "doc").alias("component")
    )
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    members = settle(placed.join(settle(mixed.where("low < high").select("key"), "open_keys"), "key"), "open_members")
    undecided = settle(_undecided(members, representatives, threshold), "undecided")
    if not undecided.isEmpty():
        links = _links_between(undecided, representatives, texts, classes, threshold, percent)
        known = labels.select(F.col("node").alias("u"), F.col("component").alias("v"))
        labels = settle(components(known.unionByName(links)), "labels")
    named = labels.withColumnRenamed("node", "doc").join(classes.select("doc", "least_id"), "doc")
    least = named.groupBy("component").agg(F.min("least_id").alias("joined_id"))
    joined = settle(labels.withColumnRenamed("node", "doc").join(least, "component"), "joined")
    component = F.coalesce("joined_id", "least_id", "doc_id")
    alone = F.col("doc").isNull() | (F.coalesce("component", "doc").eqNullSafe(F.col("doc")) & F.col("least_text"))
    return rows.join(joined, "doc", "left").select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.when(component.isNull(), alone).otherwise(F.col("doc_id").eqNullSafe(component)).alias("kept"),
    )
