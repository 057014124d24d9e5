import random
from collections import Counter, defaultdict

from prefspark.llm.mixing import mix, mixed_rows
from tests.llm.common import EDGES, documents


def corpus(seed=1):
    rng = random.Random(seed)
    shares = {"a": 400, "b": 150, "c": 20, "d": 30, None: 40}
    rows = [(source, " ".join(["w"] * rng.randint(0, 60))) for source, n in shares.items() for _ in range(n)]
    return [(i, text, "en", source) for i, (source, text) in enumerate(rows)]


def test_sources_come_near_their_targets(spark):
    account = mix(documents(spark, corpus(), clashing=True))[1].collect()
    rows = {i: (len(text.split()), source) for i, text, _, source in corpus()}
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in account:
        words, source = rows[r.doc_id]
        assert r["size"] == words and 0 <= r.taken <= 3 * words and (words == 0 or r.taken % words == 0)
        taken[source] += r.taken
        size[source] += words
        target[source] = r.target
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6
    for source in target:
        assert target[source] <= 3 * size[source] + 1e-9
        assert abs(taken[source] - target[source]) <= 60
    assert target["c"] == 3 * size["c"] or target["c"] / target["a"] < 1


def test_slices_do_not_change_the_mixture(spark):
    def taken(**sizes):
        return sorted((r.doc_id, r.taken) for r in mix(documents(spark, corpus(2)), **sizes)[1].collect())

    assert taken(slice_rows=7) == taken()


def test_items_run_in_order_up_to_the_budget(spark):
    items, account = mix(documents(spark, corpus(3)))
    items = sorted(items.collect(), key=lambda r: r.position)
    budget = sum(r["size"] for r in account.collect())
    assert [r.finish for r in items] == sorted(r.finish for r in items)
    assert items[-1].position <= budget and sum(r.words for r in items) == items[-1].position


def test_edges(spark):
    account = mix(documents(spark, EDGES, clashing=True))[1].collect()
    assert len(account) == len(EDGES)
    assert all(r.taken == 0 for r in account if r["size"] == 0)
    assert mix(documents(spark, []))[1].count() == 0
    assert [r.taken for r in mix(documents(spark, [(1, None), (2, " ")]))[1].collect()] == [0, 0]


def test_rows_are_repeated_as_the_account_says(spark):
    docs = documents(spark, corpus(4), clashing=True)
    rows = mixed_rows(docs)
    assert rows.columns == docs.columns
    times = {r.doc_id: r.taken // r["size"] for r in mix(docs)[1].collect() if r.taken}
    assert dict(Counter(r.doc_id for r in rows.collect())) == times
    assert mixed_rows(documents(spark, EDGES, clashing=True)).where("text IS NULL").count() == 0
    assert mixed_rows(documents(spark, [])).count() == 0
