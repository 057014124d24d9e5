import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from prefspark.llm import near_dedup
from prefspark.llm.components import components
from tests.llm.common import EDGES, documents

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = _WORD.findall((text or "").translate(_LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def expected(rows):
    sets = [shingles(text) for _, text, *_ in rows]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 85 * (len(sets[a]) + len(sets[b]) - shared):
                parent[root(a)] = root(b)
    least = {}
    for n, row in enumerate(rows):
        least[root(n)] = min(least.get(root(n), row[0]), row[0])
    return sorted((row[0], len(sets[n]), least[root(n)], row[0] == least[root(n)]) for n, row in enumerate(rows))


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def corpus(seed, families=6, members=14):
    """Families around an original, with edits from none to far below the threshold, and chains of small steps."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß", "Word"]
    rows, n = [], 0
    for family in range(families):
        original = rng.choices(vocabulary, k=rng.randint(60, 160))
        current = list(original)
        for _ in range(members):
            words = list(current)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if family % 2:
                current = words
            n += 1
            rows.append((n * 7 % 1009, (" " if n % 2 else "\n").join(words).upper() if n % 5 == 0 else " ".join(words)))
    return rows


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 4)
    monkeypatch.setattr(near_dedup, "TEXT_TILE", 3)
    monkeypatch.setattr(near_dedup, "PARTNERS", 2)
    for seed in (1, 2):
        rows = corpus(seed)
        assert found(near_dedup.near_dedup(documents(spark, rows, clashing=True))) == expected(rows)


def test_copies_around_an_original_that_is_not_the_smallest_id(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(150)]
    rows = [(900, " ".join(words))]
    for i in range(40):
        changed = list(words)
        for _ in range(2):
            changed[rng.randrange(len(words))] = f"x{rng.random()}"
        rows.append((i, " ".join(changed)))
    assert found(near_dedup.near_dedup(documents(spark, rows))) == expected(rows)


def near_copy(words, rng):
    changed = list(words)
    changed[rng.randrange(10, len(words) - 10)] = f"x{rng.random()}"
    return " ".join(changed)


def test_one_id_with_several_texts(spark):
    """Each text of an id finds its own near copies, and these are one component."""
    rng = random.Random(5)
    a, b, c, d = ([f"{name}{i}" for i in range(150)] for name in "abcd")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (20, near_copy(b, rng)), (30, near_copy(a, rng))]
    rows += [(41, " ".join(c)), (42, ""), (42, " ".join(c)), (43, " "), (43, None)]
    rows += [(61, " ".join(d)), (60, near_copy(d, rng)), (61, near_copy(c, rng))]
    for given in (rows, rows[::-1]):
        result = near_dedup.near_dedup(documents(spark, given)).collect()
        got = {(r.doc_id, r.component_id, r.kept) for r in result}
        assert len(result) == len(rows)
        assert got == {
            (5, 5, True), (20, 5, False), (30, 5, False), (41, 41, True), (42, 41, False), (43, 43, True),
            (60, 41, False), (61, 41, False),
        }


def test_edges(spark):
    rows = near_dedup.near_dedup(documents(spark, EDGES, clashing=True)).collect()
    assert len(rows) == len(EDGES)
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (1, 2, 3):
        assert by_id[i].n_shingles == 0 and by_id[i].kept
    assert by_id[51].component_id == 50 and not by_id[51].kept and by_id[50].kept
    assert [r.component_id for r in rows if r.doc_id is None] == [None, None]
    assert near_dedup.near_dedup(documents(spark, [])).count() == 0
    assert near_dedup.near_dedup(documents(spark, [(1, None), (2, "")])).count() == 2


def test_pruning_keeps_pairs_at_the_threshold():
    for n, least in near_dedup.least_matches(0.85).items():
        draws = np.random.default_rng(n).binomial(n, 0.85, 100_000)
        assert (draws < least).mean() < 1e-4 and least > 0.3 * n


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(10, 60)] + [(5, 5), (3, 60), (60, 3), (59, 60)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert all(found[i] == 100 for i in range(100, 161))
    assert all(found[i] == 3 for i in [7, *range(10, 61)])
    assert 5 not in found


def test_a_full_tile_of_similar_rows_stays_small():
    """Every pair of 2 x 1,024 rows is a candidate at first; pairs are handled in blocks and gathered batch by batch."""
    rng, size = np.random.default_rng(4), near_dedup.TILE
    common = rng.integers(0, 2**32, near_dedup.PERMUTATIONS, dtype=np.uint32)
    own = rng.integers(0, 2**32, (2 * size, near_dedup.PERMUTATIONS), dtype=np.uint32)
    table = np.where(rng.random(own.shape) < 0.88, common, own)
    table[:, : near_dedup.ROWS] = common[: near_dedup.ROWS]
    key = int(near_dedup.band_keys(table[:1])[0, 0])
    rows = pa.table({
        "key": pa.array([key] * len(table)), "i": pa.array([0] * len(table)), "j": pa.array([1] * len(table)),
        "own": pa.array([0] * size + [1] * size), "component": pa.array(range(len(table))),
        "signature": pa.array([r.tobytes() for r in table], pa.binary()),
    })
    tracemalloc.start()
    pairs = [(a, b, m) for a, b, m in near_dedup._tile_pairs(rows, 0.85)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    a, b, matches = (np.concatenate(p) for p in zip(*pairs))
    assert len(a) > 1_000 and max(len(p[0]) for p in pairs) <= near_dedup.PAIRS
    full = (table[:size, None, :64] == table[None, size:, :64]).sum(axis=2) + (
        table[:size, None, 64:] == table[None, size:, 64:]
    ).sum(axis=2)
    alive = np.ones((size, size), dtype=bool)
    for n, least in near_dedup.least_matches(0.85).items():
        agree = sum((table[:size, None, k] == table[None, size:, k]).astype(np.int32) for k in range(n))
        alive &= agree >= least
    assert {(x, y - size) for x, y in zip(a.tolist(), b.tolist())} == set(zip(*(v.tolist() for v in np.nonzero(alive))))
    assert (matches == full[a, b - size]).all()


def test_blocks_of_long_texts_are_bounded_by_characters(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TEXT_CHARS", 500)
    rows = corpus(3)
    assert found(near_dedup.near_dedup(documents(spark, rows))) == expected(rows)


def test_members_of_a_joined_group_are_not_copied_for_each_block_of_their_own_group(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", 16)
    dealt, whole = [], near_dedup._by_tile
    monkeypatch.setattr(near_dedup, "_by_tile", lambda rows, *a: dealt.append(rows.select("i", "j", "own", "doc", "component").collect()) or whole(rows, *a))
    signature = np.random.default_rng(2).integers(0, 2**32, near_dedup.PERMUTATIONS, dtype=np.uint32)
    key = int(near_dedup.band_keys(signature[None, :])[0, 0])
    for group, others in ((200, 3), (40, 40), (10, 5)):
        docs = range(group + others)
        representatives = spark.createDataFrame([(d, bytearray(signature.tobytes())) for d in docs], "doc bigint, signature binary")
        members = spark.createDataFrame([(key, d, max(0, d - group)) for d in docs], "key bigint, doc bigint, component bigint")
        # Every member has a candidate of another component.
        assert sorted(r.doc for r in near_dedup._undecided(members, representatives, 0.85).collect()) == [*docs]
        tiles = {}
        for r in dealt.pop():
            tiles.setdefault((r.i, r.j), []).append(r)
        met = [
            (min(a.doc, b.doc), max(a.doc, b.doc))
            for (i, j), rows in tiles.items()
            for a in rows
            for b in rows
            if a.own == i and b.own == j and a.component != b.component and (i < j or a.doc < b.doc)
        ]
        apart = {(a, b) for a in docs for b in docs if a < b and max(0, a - group) != max(0, b - group)}
        assert len(met) == len(apart) and {*met} == apart
        if others == 3:
            assert sum(map(len, tiles.values())) < 2 * len(docs)
