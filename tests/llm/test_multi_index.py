import numpy as np
from pyspark.sql import functions as F

from prefspark.llm import multi_index

SCHEMA = "vec_id bigint, embedding array<float>, label int, entry int, id int, vector string, query int, rank int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "v", 4, 5) for i, v in rows], SCHEMA)


def search(spark, rows, k=20):
    found = multi_index.nearest(vectors(spark, rows), lambda i: F.pmod(i, F.lit(20)) == 0, k=k)
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def expected(rows, k=20):
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v):
            valid[i] = np.array(v, dtype=np.float32).astype(np.float64)
    out = []
    for q in valid:
        if q % 20 == 0:
            scored = sorted((-float((valid[q] * x).sum()), i) for i, x in valid.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def corpus(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(n)]


def test_recall_and_scores(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "ENTRY_BLOCK", 40)
    monkeypatch.setattr(multi_index, "QUERY_BLOCK", 5)
    rows = corpus(1_200)
    found, true = search(spark, rows), expected(rows)
    assert len({(q, i) for q, _, i, _ in found} & {(q, i) for q, _, i, _ in true}) >= 0.9 * len(true)
    exact = dict(rows)
    for q, _, i, score in found:
        a, b = (np.array(exact[x], dtype=np.float32).astype(np.float64) for x in (q, i))
        assert abs(score - float((a * b).sum())) < 1e-12
    assert [n for _, n, _, _ in found] == [n for _, n, _, _ in true]


def test_all_cells_give_the_exact_answer_with_ties_and_edges(spark, monkeypatch):
    monkeypatch.setattr(multi_index, "AIM", 1.1)
    rows = corpus(150)
    rows += [(i, rows[0][1]) for i in range(200, 290)]
    rows += [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0] * 7 + [None]), (304, [1.0] * 5)]
    rows += [(None, rows[1][1]), (305, [float("inf")] * 8), (320, []), rows[3], rows[3]]
    assert [x[:3] for x in search(spark, rows)] == [x[:3] for x in expected(rows)]


def test_few_and_no_rows(spark):
    rows = corpus(3)
    assert [x[:3] for x in search(spark, rows)] == [x[:3] for x in expected(rows)]
    assert search(spark, []) == [] and search(spark, [(0, None)]) == [] and search(spark, corpus(1)) == []


def test_traversal_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    books = multi_index.Codebooks(rng.normal(size=(6, 4)), rng.normal(size=(6, 4)), 1.0)
    counts, query = rng.integers(0, 3, (6, 6)), rng.normal(size=8)
    order = multi_index.traverse(query, books, counts, counts.sum())
    far = [-(books.left[i] @ query[:4]) - (books.right[j] @ query[4:]) for i, j in order]
    assert far == sorted(far) and len(order) == (counts > 0).sum()
