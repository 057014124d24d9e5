"""Labels, joins, moments and losses."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.operators import joins, judge, labels, models, reshape, stats


def test_sides_move_together_and_round_trip(spark):
    rows = [(i, f"good{i}", f"bad{i}", i * 1.0, -i * 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "pair_id long, chosen string, rejected string, x_chosen double, x_rejected double")
    sided = labels.randomize_sides(df, "pair_id", 1, ["x"])
    heads = sided.where("labels = 1").count()
    assert 70 < heads < 130
    back, held = labels.orient_by_label(sided, "labels", ["x"])
    assert held.count() == 0
    assert {tuple(r[c] for c in df.columns) for r in back.collect()} == set(rows)
    assert sided.exceptAll(labels.randomize_sides(df.repartition(9), "pair_id", 1, ["x"])).count() == 0


def test_orient_null_and_other_labels(spark):
    df = spark.createDataFrame([(1, 1, "a", "b"), (2, 0, "a", "b"), (3, 7, "a", "b"), (4, None, "a", "b")], "k int, labels int, response_a string, response_b string")
    good, held = labels.orient_by_label(df, "labels", [])
    assert {(r.k, r.chosen) for r in good.collect()} == {(1, "a"), (2, "b"), (3, "b")}
    assert [r.k for r in held.collect()] == [4]
    everything, _ = labels.orient_by_label(df, "labels", [], null_label="other")
    assert everything.count() == 4


def test_pseudo_labels_ties_nan_and_missing_scores(spark):
    pairs = spark.createDataFrame([(i, f"c{i}", f"r{i}") for i in range(5)], "pair_id int, chosen string, rejected string")
    scores = spark.createDataFrame([(0, 2.0, 1.0), (1, 1.0, 1.0), (2, float("nan"), 0.0), (3, 0.0, 1.0)], "pair_id int, score_chosen double, score_rejected double")
    good, held = labels.pseudo_label_swap(pairs, scores, "pair_id", [])
    assert {(r.pair_id, r.model_predict, r.chosen) for r in good.collect()} == {
        (0, "correct", "c0"), (1, "wrong", "r1"), (2, "wrong", "r2"), (3, "wrong", "r3")
    }
    assert [(r.pair_id, r.chosen) for r in held.collect()] == [(4, "c4")]


def test_pseudo_labels_by_label(spark):
    pairs = spark.createDataFrame([(0, 1, 1.0, 2.0), (1, 0, 1.0, 2.0), (2, 5, 1.0, 2.0), (3, 0, 1.0, 2.0)], "pair_id int, labels int, x_a double, x_b double")
    scores = spark.createDataFrame([(i, 1.0, 1.0 if i == 3 else 2.0) for i in range(4)], "pair_id int, score_a double, score_b double")
    good, held = labels.pseudo_label_swap(pairs, scores, "pair_id", ["x"], "labels", ("a", "b"), bare=False)
    assert {(r.pair_id, r.model_predict, r.x_a) for r in good.collect()} == {(0, "wrong", 2.0), (1, "correct", 1.0), (3, "wrong", 2.0)}
    assert [r.pair_id for r in held.collect()] == [2]


def test_option_of_label(spark):
    df = spark.createDataFrame([("1",), ("0",), ("A",), (None,)], "l string")
    assert [r[0] for r in df.select(labels.option_of_label("l")).collect()] == ["A", "B", "A", None]
    with pytest.raises(Exception, match="label without an option"):
        spark.createDataFrame([("x",)], "l string").select(labels.option_of_label("l")).collect()


def test_attach_scores_fan_out_and_null_keys(spark):
    samples = spark.createDataFrame([("p", "r"), ("p", None), ("q", "z")], "prompt string, response string")
    scores = spark.createDataFrame([("p", "r", 1.0), ("p", "r", 1.0), ("p", "r", 2.0), ("p", None, 3.0)], "prompt string, response string, score double")
    found = joins.attach_scores_inner(samples, scores).collect()
    assert sorted((r.prompt, str(r.response), r.score) for r in found) == [("p", "None", 3.0), ("p", "r", 1.0), ("p", "r", 2.0)]
    left = joins.attach_features_left(samples, scores, keep_first_by=["score"])
    assert sorted((r.prompt, str(r.response), str(r.score)) for r in left.collect()) == [
        ("p", "None", "3.0"), ("p", "r", "1.0"), ("q", "z", "None")
    ]


def test_attach_by_key_wants_one_to_one(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    assert joins.attach_by_key(left, spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string"), ["k"]).count() == 2
    for bad in ([(1, "a")], [(1, "a"), (2, "b"), (2, "c")], [(1, "a"), (2, "b"), (3, "c")]):
        with pytest.raises(joins.UnmatchedKeysError):
            joins.attach_by_key(left, spark.createDataFrame(bad, "k int, v string"), ["k"])


def test_concat_is_strict(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    with pytest.raises(Exception):
        reshape.concat_datasets([a, a.drop("y")]).collect()


def numbers(n=300):
    rng = np.random.default_rng(0)
    return rng.normal(5, 2, n), rng.normal(-1, 3, n)


def frame(spark, a, b):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))], "k int, x_a double, x_b double").withColumn("c_a", F.lit(4.0)).withColumn("c_b", F.lit(4.0))


def test_pooled_and_side_standardize(spark):
    a, b = numbers()
    both = np.concatenate([a, b])
    df = frame(spark, a, b)
    rows = stats.pooled_standardize(df, ["x", "c"]).orderBy("k").collect()
    assert np.allclose([r.x_b for r in rows], (b - both.mean()) / (both.std() + 1e-7))
    assert [r.c_a for r in rows] == [0.0] * len(rows)
    plain = stats.pooled_standardize(df, ["x", "c"], eps=0.0).orderBy("k").collect()
    assert np.allclose([r.x_a for r in plain], (a - both.mean()) / both.std()) and plain[0].c_a is None
    sides = stats.side_standardize(df, ["x_a", "c_a"]).orderBy("k").collect()
    assert np.allclose([r.x_a for r in sides], (a - a.mean()) / a.std()) and sides[0].c_a == 0.0


def test_pooled_moments_with_nulls_and_one_empty_side(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None)], "x double, y double")
    row = stats.pooled_moments(df, ["x", "y"]).first()
    assert (row["mean"], row["std"], row["n"]) == (2.0, 1.0, 2)


def test_two_standard_deviations(spark):
    a, b = numbers()
    df = frame(spark, a, b)
    assert np.allclose([r.x_a for r in stats.normalize_external(df, "x_a").orderBy("k").collect()], (a - a.mean()) / a.std())
    assert np.allclose([r.x_a for r in stats.normalize_reward(df, "x_a").orderBy("k").collect()], (a - a.mean()) / a.std(ddof=1))


def test_losses_and_accuracy(spark):
    a, b = numbers()
    df = frame(spark, a * 500, b * 500)
    loss = stats.pair_losses(df, "x_a", "x_b", targets=[("x_a", "c_a"), ("x_b", "c_b")]).first()
    assert math.isclose(loss.ranking_loss, np.logaddexp(0, 500 * (b - a)).mean(), rel_tol=1e-9)
    assert math.isclose(loss.squared_loss, ((500 * a - 4) ** 2).mean() + ((500 * b - 4) ** 2).mean(), rel_tol=1e-9)
    ties = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (float("nan"), 0.0)], "c double, r double")
    assert math.isclose(stats.pairwise_accuracy(ties, (), "c", "r").first().accuracy, 1 / 3)


def test_correlation_and_p_value(spark):
    a, b = numbers()
    row = stats.score_correlation(frame(spark, a, a + 5 * b), "x_a", "x_b").first()
    assert math.isclose(row.r, np.corrcoef(a, a + 5 * b)[0, 1], rel_tol=1e-9)
    # Two-sided p-values of a Pearson r from tables of the t distribution.
    assert math.isclose(stats.correlation_p_value(0.6319, 10), 0.05, abs_tol=1e-3)
    assert math.isclose(stats.correlation_p_value(0.7646, 10), 0.01, abs_tol=1e-3)
    assert stats.correlation_p_value(0.0, 50) == pytest.approx(1.0) and stats.correlation_p_value(1.0, 50) == 0.0


def test_debias_uses_the_train_mean(spark):
    rows = [("m", "train", 1, 3.0, 1.0), ("m", "train", 2, 2.0, 2.0), ("m", "test", 3, 10.0, 0.0)]
    df = spark.createDataFrame(rows, "model string, split string, pair_id int, score_chosen double, score_rejected double")
    shifted, summary = labels.debias_scores(df)
    assert {(r.pair_id, r.score_chosen, r.score_rejected) for r in shifted.collect()} == {(1, 1.0, -1.0), (2, 0.0, 0.0), (3, 8.0, -2.0)}
    test = {r.split: r for r in summary.collect()}
    assert test["test"]["mean"] == 5.0 and test["test"]["std"] == 5.0 and test["train"].accuracy == 0.5


def test_debiased_judging_cancels_a_constant_lean(spark):
    rows = [(1, "direct", 8.0, 6.0), (1, "swapped", 7.0, 7.0), (2, "direct", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "k int, order string, score1 double, score2 double")
    found = {r.k: (r.assistant1, r.assistant2) for r in judge.judge_debias(df, ["k"]).collect()}
    assert found == {1: (7.5, 6.5), 2: (None, None)}


def test_judging_needs_one_usable_reply_per_order(spark):
    rows = [
        (1, "direct", 8.0, 6.0, False), (1, "direct", 8.0, 6.0, False),
        (2, "direct", 0.0, 0.0, True), (2, "swapped", 3.0, 5.0, False),
        (3, "direct", 4.0, 6.0, False), (3, "swapped", 5.0, 5.0, False),
    ]
    df = spark.createDataFrame(rows, "k int, order string, score1 double, score2 double, parse_failed boolean")
    judged = judge.judge_debias(df.withColumn("model", F.lit("m")), ["model", "k"])
    assert {r.k: r.assistant1 for r in judged.collect()} == {1: None, 2: 2.5, 3: 4.5}
    rate = judge.preference_rate(judged, chunk=None).first()
    assert (rate.win, rate.tie, rate.loss, rate.n, rate.failed) == (1.0, 0.0, 0.0, 1, 2)
    merged = judge.preference_rate(judged, chunk=None, failed_as_tie=True).first()
    assert (merged.n, merged.failed, merged.loss) == (2, 1, 0.5)


def test_model_tables_round_trip(spark, tmp_path):
    model = models.RewardModel("m.pkl", ("biased", "length"), (1.0, 2.0), (0.5, 2.0), (3.0, -1.0), 0.1, 2.0, 0.7)
    models.save_model(spark, model, str(tmp_path / "m"))
    assert models.load_model(spark, str(tmp_path / "m")) == model
    with pytest.raises(Exception):
        models.save_model(spark, model, str(tmp_path / "m"))
    with pytest.raises(ValueError):
        models.RewardModel("z", ("x",), (0.0,), (0.0,), (1.0,))
    df = spark.createDataFrame([(2.0, 6.0)], "biased double, length double")
    assert models.score_samples(df, model, "s").first().s == pytest.approx((1 / 0.5) * 3 - (4 / 2))
