"""Ordering, splits, samples, best-of-n and chunks: ties, short groups, odd counts, hot groups."""

import random

import pytest
from pyspark.sql import functions as F

from prefspark.functions.ordering import counted_slots, key_at_rank, with_position
from prefspark.operators import curate, models, reshape, select


def test_with_position_matches_plain_ranks_in_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", k) for k in rng.sample(range(5000), 1500)]
    df = spark.createDataFrame(rows, "g string, k long").repartition(7)
    found = {(r.g, r.k): r.position for r in with_position(df, ["g"], ["k"], slot_rows=64).collect()}
    expected = {}
    for g in {g for g, _ in rows}:
        for i, k in enumerate(sorted(k for h, k in rows if h == g)):
            expected[(g, k)] = i + 1
    assert found == expected


@pytest.mark.parametrize("rank", [1, 2, 617, 2999, 3000])
def test_key_at_rank_narrows_to_the_exact_key(spark, rank):
    keys = random.Random(1).sample(range(10**6), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(5)
    assert key_at_rank(df, "k", rank, probes=200, final_rows=50) == sorted(keys)[rank - 1]


def test_key_at_rank_on_text_and_errors(spark):
    df = spark.createDataFrame([(f"k{i:05d}",) for i in range(2000)], "k string")
    assert key_at_rank(df, "k", 1500, probes=100, final_rows=20) == "k01499"
    with pytest.raises(ValueError):
        key_at_rank(df, "k", 2001)
    same = spark.createDataFrame([(1,)] * 500, "k long")
    with pytest.raises(ValueError):
        key_at_rank(same, "k", 250, probes=20, final_rows=10)


def test_half_split_gives_the_odd_row_to_test(spark):
    df = spark.createDataFrame([(i,) for i in (5, 3, 1, 9, 7)], "k long")
    assert {r.k: r.split for r in curate.half_split(df, "k").collect()} == {
        1: "train", 3: "train", 5: "test", 7: "test", 9: "test"
    }


def test_select_split_all_holds_out_the_last_rows(spark):
    df = spark.createDataFrame([(i, "train" if i % 2 else "test") for i in range(20)], "k long, split string")
    roles = {r.k: r.role for r in curate.select_split(df, "all", "k", holdout=3).collect()}
    assert sorted(k for k, role in roles.items() if role == "test") == [14, 16, 18]
    swapped = {r.k: r.role for r in curate.select_split(df, "test", "k").collect()}
    assert swapped[0] == "train" and swapped[1] == "test"


def test_sample_n_is_exact_stable_and_strict(spark):
    df = spark.createDataFrame([(i, "x") for i in range(500)], "k long, t string")
    once = {r.k for r in curate.sample_n(df, "k", 100, 42).collect()}
    again = {r.k for r in curate.sample_n(df.repartition(13), "k", 100, 42).collect()}
    assert len(once) == 100 and once == again
    assert once != {r.k for r in curate.sample_n(df, "k", 100, 43).collect()}
    assert curate.sample_n(df, "k", 900, 42, allow_fewer=True).count() == 500
    with pytest.raises(Exception, match="900 rows wanted"):
        curate.sample_n(df, "k", 900, 42).collect()


@pytest.mark.parametrize("shape", ["hashed", "one day"])
def test_slots_have_a_bounded_size_for_any_key(spark, shape):
    rng = random.Random(9)
    keys = [rng.getrandbits(63) if shape == "hashed" else 1_700_000_000 + i % 86_400 for i in range(4_000)]
    df = spark.createDataFrame([("one group", k) for k in keys], "g string, k long").repartition(6)
    sizes = df.select(counted_slots(df, "k", 100).alias("s")).groupBy("s").count().collect()
    assert len(sizes) >= 35 and max(r["count"] for r in sizes) < 250
    found = sorted((r.position, r.k) for r in with_position(df, ["g"], ["k"], slot_rows=100).collect())
    assert [k for _, k in found] == sorted(keys) and [p for p, _ in found] == list(range(1, 4_001))


@pytest.mark.parametrize("n", [10, 100_000])
def test_repeated_and_missing_keys_are_treated_alike_at_every_size(spark, n):
    keys = spark.range(n).select(F.col("id").alias("k"))
    with pytest.raises(ValueError, match="repeats"):
        curate.half_split(keys.unionByName(keys.where("k = 3")), "k")
    with pytest.raises(ValueError, match="repeats"):
        curate.sample_n(keys.unionByName(keys.where("k = 3")), "k", 5, 1)
    holed = keys.unionByName(spark.createDataFrame([(None,), (None,)], "k long"))
    split = {r.split: r.n for r in curate.half_split(holed, "k").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert split == {"train": (n + 2) // 2, "test": (n + 2) - (n + 2) // 2}
    assert curate.half_split(holed, "k").where("k IS NULL AND split = 'train'").count() == 0
    for size in (3, n // 2):
        drawn = curate.sample_n(holed, "k", size, 7)
        assert drawn.count() == size and drawn.where("k IS NULL").count() == 0
    with pytest.raises(ValueError, match="rows wanted"):
        curate.sample_n(holed, "k", n + 1, 7)
    assert curate.take_first(holed, "k", 4).count() == 4


def test_scores_that_are_not_numbers_never_win(spark):
    rows = [("p", 1, float("nan"), 1.0, "a"), ("p", 2, 0.5, 2.0, "b"), ("p", 3, None, 3.0, "c")]
    df = spark.createDataFrame(rows, "prompt string, sample_idx int, score_a double, score_b double, response string")
    assert [r.response for r in select.best_of_n(df, sizes=(3,)).collect()] == ["b"]
    assert select.bon_candidates(df, ["score_a"]).first().response == ["a", "b"]


def test_drop_incomplete_sees_null_and_nan(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, float("nan"), "a"), (3, None, "a"), (4, 1.0, None)], "k int, v double, t string")
    assert [r.k for r in curate.drop_incomplete(df).collect()] == [1]
    assert sorted(r.k for r in curate.drop_incomplete(df, ["v"]).collect()) == [1, 4]


def test_keep_first_deduplication(spark):
    df = spark.createDataFrame([("p", "r", 2, "b"), ("p", "r", 1, "a"), ("p", "s", 3, "c")], "prompt string, response string, i int, x string")
    kept = curate.drop_duplicates(df, ["prompt", "response"], ["i"])
    assert {(r.response, r.i, r.x) for r in kept.collect()} == {("r", 1, "a"), ("s", 3, "c")}


def best(rows, n):
    head = sorted(rows)[:n]
    top = max(score for _, score, _ in head)
    return next(r for r in head if r[1] == top)


def test_best_of_n_first_on_ties_and_short_groups(spark):
    rng = random.Random(5)
    groups = {f"p{i}": [(j, float(rng.randrange(4)), rng.random()) for j in range(1, size + 1)] for i, size in enumerate((1, 3, 16, 40))}
    flat = [(p, j, a, b, f"{p}/{j}") for p, rows in groups.items() for j, a, b in rows]
    df = spark.createDataFrame(flat, "prompt string, sample_idx int, score_a double, score_b double, response string").repartition(6)
    found = {(r.prompt, r.n): (r.best_score_a, r.best_score_b, r.response) for r in select.best_of_n(df).collect()}
    expected = {
        (p, n): (lambda r: (r[1], r[2], f"{p}/{r[0]}"))(best(rows, n)) for p, rows in groups.items() for n in (1, 2, 4, 8, 16)
    }
    assert found == expected
    curve = {r.n: r for r in select.bon_curve(select.best_of_n(df)).collect()}
    assert curve[1].prompts == 4 and curve[16].mean_a >= curve[1].mean_a


def test_large_sizes_use_salted_parts(spark, monkeypatch):
    rows = [("p", i, float((i * 37) % 101), f"r{i}") for i in range(1, 301)] + [("q", 1, 1.0, "s")]
    df = spark.createDataFrame(rows, "prompt string, sample_idx int, score_a double, response string").withColumn("score_b", F.lit(0.0))
    plain = sorted(map(tuple, select.best_of_n(df, sizes=(4, 50, 200)).collect()))
    monkeypatch.setattr(select, "GROUP_LIMIT_ROWS", 10)
    assert sorted(map(tuple, select.best_of_n(df, sizes=(4, 50, 200)).collect())) == plain


def test_best_of_n_limits_groups_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).cast("string").alias("prompt"), F.col("id").alias("sample_idx"), F.rand(1).alias("score_a"), F.rand(2).alias("score_b"), F.lit("r").alias("response"))
    plan = select.best_of_n(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") == 1


def test_bon_candidates_skip_nan_and_take_the_first(spark):
    rows = [("p", 1, float("nan"), "a"), ("p", 2, 3.0, "b"), ("p", 3, 3.0, "c"), ("q", 1, None, "d")]
    df = spark.createDataFrame(rows, "prompt string, sample_idx int, s double, response string")
    assert {(r.prompt, tuple(r.response)) for r in select.bon_candidates(df, ["s"]).collect()} == {("p", ("a", "b")), ("q", ("d", None))}


@pytest.mark.parametrize("size", [1, 7, 16, 17, 40, 96, 130])
def test_chunks_of_short_and_long_groups(spark, size):
    df = spark.createDataFrame([("p", i) for i in range(1, size + 1)], "prompt string, sample_idx int")
    found = {}
    for r in select.chunk_samples(df).collect():
        found.setdefault(r.chunk, []).append(r.sample_idx)
    for c in range(6):
        assert sorted(found[c]) == list(range(1, size + 1))[: (c + 1) * 16][-16:]


def test_samples_round_trip_in_pages(spark):
    rows = [("p", i, f"r{i}") for i in range(1, 11)] + [("q", 1, "s")]
    df = spark.createDataFrame(rows, "prompt string, sample_idx long, response string").repartition(4)
    nested = reshape.collect_samples(df, ["prompt"], "sample_idx", ["response"], page_rows=4)
    assert {(r.prompt, r.page, r.n) for r in nested.collect()} == {("p", 0, 4), ("p", 1, 4), ("p", 2, 2), ("q", 0, 1)}
    back = reshape.explode_samples(nested.drop("n"), ["response"])
    assert {(r.prompt, r.page * 4 + r.sample_idx, r.response) for r in back.collect()} == set(rows)


def test_index_samples_last_wins(spark):
    df = spark.createDataFrame([("c", "r", 1), ("c", "r", 9), ("c", "s", 4)], "context string, response string, i int")
    assert {(r.response, r.row_index) for r in reshape.index_samples(df, ["context", "response"], "i").collect()} == {("r", 9), ("s", 4)}


def test_unknown_features_are_errors(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0)], "labels int, x_a double, x_b double")
    with pytest.raises(ValueError):
        reshape.feature_array(df, ["y"], "a")
    with pytest.raises(ValueError):
        curate.prune_columns(df, ["y"])
    assert curate.select_features(["readability", "intent"], prefix="zeroshot_") == ["zeroshot_readability", "zeroshot_intent", "length"]
    assert curate.select_features(["readability", "intent"], subset=["intent"]) == ["intent"]


def test_the_resampled_band_holds_the_mean_and_leaves_out_nulls(spark):
    rows = [(n, float(i % 7), None if i == 3 else float(-i), "r", f"p{i}" if i else None) for i in range(60) for n in (1, 2)]
    bon = spark.createDataFrame(rows, "n int, best_score_a double, best_score_b double, response string, prompt string")
    band = {r.n: r for r in select.bon_band(bon, replicates=400).collect()}
    assert set(band) == {1, 2} and band[1].replicates == 400 and band[1].asDict() | {"n": 2} == band[2].asDict()
    scores = [float(i % 7) for i in range(60)]
    error = (sum((s - sum(scores) / 60) ** 2 for s in scores) / 60) ** 0.5 / 60**0.5
    assert band[1].low_a < band[1].mean_a < band[1].high_a
    assert abs((band[1].high_a - band[1].low_a) / (2 * 1.96 * error) - 1) < 0.2
    assert abs(band[1].mean_b - sum(-i for i in range(60) if i != 3) / 59) < 1e-9
    assert select.bon_band(bon.repartition(5), replicates=400).where("n = 1").first() == band[1]


def test_many_models_score_like_each_alone(spark):
    names = [models.RewardModel(f"m{i}", ("x", "y")[: 1 + i % 2], (0.5, 1.0)[: 1 + i % 2], (2.0, 3.0)[: 1 + i % 2], (i - 3.0, 1.0)[: 1 + i % 2]) for i in range(6)]
    rows = [(i, "train", i % 2, float(i), float(-i), float(i * i % 5), None if i == 4 else 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "pair_id long, split string, labels int, x_a double, x_b double, y_a double, y_b double")
    terms, _ = models.model_tables(spark, names)
    found = {(r.model, r.pair_id): (r.score_chosen, r.score_rejected) for r in models.score_models(df, terms).collect()}
    assert len(found) == 54
    for model in names:
        for r in models.pair_scores(df, model).collect():
            assert found[model.name, r.pair_id] == (r.score_chosen, r.score_rejected)
    with pytest.raises(ValueError, match="no model"):
        models.score_models(df, terms.where("1 = 0"))
    with pytest.raises(Exception, match="z"):
        models.score_models(df, terms.withColumn("feature", F.lit("z")))
