import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, entry int, key string, vector string, score int, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "k", "v", 3, 4) for i, v, label in rows], SCHEMA)


def found(spark, rows, every=10):
    mined = hn.mine(vectors(spark, rows), lambda i: F.pmod(i, F.lit(every)) == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in mined)


def expected(rows, every=10):
    kept = []
    for i, v, label in rows:
        if i is None or label is None or v is None or len(v) != 8 or None in v or not np.isfinite(v).all():
            continue
        row = (i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in kept:
            kept.append(row)
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b is not a)
        for p, positive, _ in [s for s in scored if s[2] == a[1]][:5]:
            inside = [(n, i) for n, i, label in scored if label != a[1] and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(a[0], positive, k + 1, i, -p, -n) for k, (n, i) in enumerate(inside[:5])]
    return sorted(out)


def corpus(n, labels=4, clusters=0, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters or 1, 8)) * (3 if clusters else 0)
    return [
        (i, [float(x) for x in np.float32(centres[i % len(centres)] + rng.normal(size=8) * (0.3 if clusters else 1))], int(rng.integers(labels)))
        for i in range(n)
    ]


@pytest.mark.parametrize("clusters", [0, 12])
def test_exact_in_several_rounds(spark, monkeypatch, clusters):
    for name, value in (("FIRST_READ", 30), ("GROWTH", 3), ("ENTRY_BLOCK", 40), ("ANCHOR_BLOCK", 7)):
        monkeypatch.setattr(hn, name, value)
    rows = corpus(700, clusters=clusters)
    assert found(spark, rows) == expected(rows)


def test_copies_ties_and_edges(spark, monkeypatch):
    monkeypatch.setattr(hn, "HOT_ANCHORS", 3)
    rows = corpus(150)
    rows += [(i, rows[0][1], rows[0][2]) for i in range(200, 290)] + [(i, rows[0][1], 1 + rows[0][2]) for i in range(300, 320)]
    rows += [(400, None, 1), (401, [0.0] * 8, 1), (410, [float("nan")] * 8, 1), (403, [1.0] * 7 + [None], 1), (404, [1.0] * 5, 1)]
    rows += [(None, rows[1][1], 2), (405, [float("inf")] * 8, 2), (420, rows[3][1], None), rows[3], rows[3], (30, rows[4][1], 2), (430, [], 3)]
    rows += [(440, [-x for x in rows[0][1]], 9), (450, rows[5][1], 8), (460, rows[5][1], 8)]
    assert found(spark, rows) == expected(rows)


def test_few_and_no_rows(spark):
    rows = corpus(12, labels=2)
    assert found(spark, rows, 1) == expected(rows, 1)
    assert found(spark, []) == [] and found(spark, [(0, None, 1)]) == [] and found(spark, corpus(1)) == []


def test_wide_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 9_000], i % 3) for i in range(60)]
    rows = [r for r in rows if max(map(abs, r[1])) < 2**15]
    assert found(spark, rows) == expected(rows)


def test_bounds_hold_and_cells_come_in_order():
    rng = np.random.default_rng(2)
    x = rng.integers(-40, 40, (300, 8)).astype(float)
    left, right = hn._codebook(x[:, :4], 6, rng), hn._codebook(x[:, 4:], 6, rng)
    a, b = hn._closest(x[:, :4], left), hn._closest(x[:, 4:], right)
    radii = [np.array([np.linalg.norm(part[own == c] - centres[c], axis=1).max(initial=-np.inf) for c in range(6)])
             for part, own, centres in ((x[:, :4], a, left), (x[:, 4:], b, right))]
    counts = np.zeros((6, 6), dtype=np.int64)
    np.add.at(counts, (a, b), 1)
    index = hn.Index(left, right, *radii, counts)
    for query in x[:20]:
        cells = list(hn.visit(query, index))
        assert [c[0] for c in cells] == sorted((c[0] for c in cells), reverse=True) and len(cells) == (counts > 0).sum()
        bound = {(i, j): u for u, i, j in cells}
        assert all(x[n] @ query <= bound[a[n], b[n]] for n in range(300))
