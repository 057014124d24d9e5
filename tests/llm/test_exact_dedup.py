from collections import Counter

from pyspark.sql import functions as F

from prefspark.llm.exact_dedup import exact_dedup
from tests.llm.common import EDGES, documents


def expected(rows):
    ids, sizes = {}, Counter()
    for i, text, *_ in rows:
        text = text or ""
        sizes[text] += 1
        if i is not None:
            ids[text] = max(ids.get(text, i), i)
        ids.setdefault(text, None)
    out, seen = [], set()
    for i, text, *_ in rows:
        text = text or ""
        kept = i == ids[text] and (i, text) not in seen
        seen.add((i, text))
        out.append((i, ids[text], sizes[text], kept))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_edges_and_clashing_columns(spark):
    rows = EDGES + [(i, f"text {i % 7}") for i in range(100, 200)]
    assert found(exact_dedup(documents(spark, rows, clashing=True))) == expected(rows)


def test_a_shared_digest_does_not_join_texts(spark):
    rows = [(i, f"text {i % 7} {'!' * (i % 3)}") for i in range(60)]
    weak = exact_dedup(documents(spark, rows), digest=lambda text: F.length(text).cast("string"))
    assert found(weak) == expected(rows)


def test_empty_table(spark):
    assert exact_dedup(documents(spark, [])).count() == 0


def test_one_row_repeated_many_times_with_and_without_an_id(spark):
    """Rows that repeat id and text cost a row each, not an array, and one of them stays."""
    many = spark.range(2_000_000, numPartitions=8).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", "CASE WHEN id % 3 < 2 THEN 'again' ELSE concat('t', id) END AS text"
    )
    placed = exact_dedup(many)
    sums = placed.groupBy((F.col("group_size") > 1).alias("copies")).agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("kept"), F.max("keep_id").alias("keep"))
    found = {r.copies: r for r in sums.collect()}
    assert (found[True].n, found[True].kept, found[True].keep) == (1_333_334, 1, 7)
    assert (found[False].n, found[False].kept) == (666_666, 666_666)
    assert "explode(sequence" not in placed._jdf.queryExecution().toString()
