"""Fits against a plain numpy solver, the energy model against its golden rows, and determinism."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.operators import ebm, fit, models
from prefspark.operators.reshape import collect_samples
from prefspark.operators.ranker import text_pair_ranker
from prefspark.plans.registered import fitting

NAMES = ("x", "y", "z")


def table(spark, n=240, seed=2):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, 3)) * [1, 3, 0.2] + [0, 5, 1], rng.normal(size=(n, 3)) * [1, 3, 0.2] + [0, 5, 1]
    margin = (a - b) @ np.array([1.0, -0.4, 0.0]) + rng.logistic(size=n)
    y = (margin > 0).astype(int)
    rows = [(i, "train" if i % 3 else "test", int(y[i]), *map(float, a[i]), *map(float, b[i])) for i in range(n)]
    schema = "pair_id long, split string, labels int, x_a double, y_a double, z_a double, x_b double, y_b double, z_b double"
    return spark.createDataFrame(rows, schema), a, b, y


def scaled_difference(a, b):
    both = np.concatenate([a, b])
    return (a - b) / (both.std(0) + 1e-7)


def proximal_gradient(x, y, C, penalty, steps=200_000):
    """Slow and plain: gradient steps on Σ loss + penalty / C with the exact step size bound."""
    w, step = np.zeros(x.shape[1]), 1 / (0.25 * np.linalg.eigvalsh(x.T @ x).max() + (1 / C if penalty == "l2" else 0))
    for _ in range(steps):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) + (w / C if penalty == "l2" else 0)
        new = w - step * g
        if penalty == "l1":
            new = np.sign(new) * np.maximum(np.abs(new) - step / C, 0)
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return w


@pytest.mark.parametrize("C,penalty", [(0.01, "l1"), (0.01, "l2"), (1.0, "l1"), (30.0, "l2")])
def test_single_fit_matches_plain_solver(spark, C, penalty):
    df, a, b, y = table(spark)
    expected = proximal_gradient(scaled_difference(a, b), y, C, penalty)
    assert np.allclose(fit.pairwise_fit_diff(df, NAMES, C, penalty).coefs, expected, atol=2e-6)


def test_shared_passes_match_plain_solver(spark):
    df, a, b, y = table(spark)
    x = scaled_difference(a, b)
    rows = spark.createDataFrame([([float(v) for v in x[i]], int(y[i]), i % 4) for i in range(len(y))], "x array<double>, y int, fold int").repartition(5).persist()
    settings = [fit.Setting(c, p, f) for c in (0.01, 1.0, 1000.0) for p in ("l1", "l2") for f in (-1, 0, 3)]
    found = fit.fit_settings(rows, settings, 3, wide=True)
    fold = np.arange(len(y)) % 4
    for setting, weights in zip(settings, found):
        used = fold != setting.fold
        assert np.allclose(weights, proximal_gradient(x[used], y[used], setting.C, setting.penalty), atol=1e-6), setting
    rows.unpersist()


def test_grid_search_picks_the_first_best_and_reports_all(spark):
    df, a, b, y = table(spark)
    model, metrics = fit.grid_search_cv(df, NAMES, strengths=(1.0, 0.01, 100.0), folds=4)
    assert [(m["C"], m["penalty"]) for m in metrics] == [(c, p) for c in (0.01, 1.0, 100.0) for p in ("l1", "l2")]
    best = max(m["accuracy"] for m in metrics)
    first = next(m for m in metrics if m["accuracy"] >= best - 1e-12)
    assert first["best"] and math.isclose(model.acc, best)
    expected = proximal_gradient(scaled_difference(a, b), y, first["C"], first["penalty"])
    assert np.allclose(model.coefs, expected, atol=1e-6)


def test_folds_are_stratified(spark):
    df, *_ = table(spark)
    counts = fit.stratified_folds(df, "pair_id", "labels", 8).groupBy("labels").pivot("fold", list(range(8))).count().collect()
    for row in counts:
        sizes = [row[str(i)] for i in range(8)]
        assert max(sizes) - min(sizes) <= 1


def test_concatenated_form_folds_sides(spark):
    df, a, b, y = table(spark)
    x = np.concatenate([(a - a.mean(0)) / a.std(0), (b - b.mean(0)) / b.std(0)], axis=1)
    w = proximal_gradient(x, y, 1.0, "l2")
    model = fit.pairwise_fit_concat(df, NAMES, 1.0, "l2")
    assert np.allclose(model.coefs, (w[:3] - w[3:]) / 2, atol=2e-6)
    assert np.allclose(model.means, (a.mean(0) + b.mean(0)) / 2) and np.allclose(model.stds, (a.std(0) + b.std(0)) / 2)


def test_reward_statistics_come_from_the_fitted_split(spark):
    df, *_ = table(spark)
    model, _ = fit.fit_reward_model(df, NAMES, strengths=(1.0,), folds=3)
    scores = models.pair_scores(df.where("split = 'train'"), model).collect()
    both = np.array([s for r in scores for s in (r.score_chosen, r.score_rejected)])
    assert math.isclose(model.reward_mean, both.mean(), abs_tol=1e-9) and math.isclose(model.reward_std, both.std(), rel_tol=1e-9)


def test_fit_does_not_depend_on_partitions(spark):
    df, *_ = table(spark)
    one, _ = fit.grid_search_cv(df.coalesce(1), NAMES, strengths=(0.1, 1.0), folds=4)
    many, _ = fit.grid_search_cv(df.repartition(17), NAMES, strengths=(0.1, 1.0), folds=4)
    assert np.allclose(one.coefs, many.coefs, atol=1e-8) and one.acc == many.acc


def options(spark, rows):
    return spark.createDataFrame(rows, "log_score_a double, log_score_b double, features_a array<double>, features_b array<double>, preferred string")


GOLDEN = [
    ([(-207.0, -546.0, [9.0], [10.0], "B")], [345.90689385], [0.99986e-3]),
    ([(-207.0, -546.0, [9.0], [10.0], "B"), (-192.0, -226.0, [4.0], [8.0], "B")], [345.21271789], [0.99989e-3]),
    ([(-207.0, -546.0, [9.0, 5.0], [10.0, 8.0], "B")], [34.70063746, 104.10191478], [0.33322e-3, 0.99965e-3]),
]


@pytest.mark.parametrize("rows,coefficients,gap", GOLDEN)
def test_golden_moment_gaps(spark, rows, coefficients, gap):
    df = options(spark, rows)
    found = ebm.moment_gap(df, coefficients)
    assert np.allclose(found, gap, atol=1e-8)
    moments = [r.moment for r in ebm.ebm_moments(df, coefficients).orderBy("feature_pos").collect()]
    targets = [r.target for r in ebm.target_moments(df, len(coefficients)).orderBy("feature_pos").collect()]
    assert np.allclose(np.subtract(targets, moments), gap, atol=1e-8)
    assert ebm.option_accuracy(df, coefficients).first().accuracy == 1.0


def test_moment_ascent_follows_its_rule(spark):
    rows = [(-1.0, -2.0, [1.0], [3.0], "B"), (-2.0, -1.0, [2.0], [0.5], "B"), (0.0, 0.0, [1.0], [0.0], "A")]
    weights, steps, gap = ebm.moment_matching_fit(options(spark, rows), 1, lr=0.5, tol=1e-2)
    w, expected = 0.0, 0
    while True:
        expected += 1
        shares = [1 / (1 + math.exp((lb + w * fb[0]) - (la + w * fa[0]))) for la, lb, fa, fb, _ in rows]
        g = np.mean([(fa[0] if p == "A" else fb[0]) - s * fa[0] - (1 - s) * fb[0] for s, (_, _, fa, fb, p) in zip(shares, rows)])
        w += 0.5 * g
        if abs(g) < 1e-2:
            break
    assert steps == expected and math.isclose(weights[0], w, rel_tol=1e-9)
    direct = ebm.conditional_fit(options(spark, rows), 1)
    assert abs(ebm.moment_gap(options(spark, rows), direct)[0]) < 1e-6
    with pytest.raises(RuntimeError):
        ebm.moment_matching_fit(options(spark, rows), 1, max_steps=1)


def test_moment_ascent_leaves_out_incomplete_rows_and_starts_where_told(spark):
    rows = [(-1.0, -2.0, [1.0, 9.0], [3.0, 9.0], "B"), (-2.0, -1.0, [2.0, 9.0], [0.5, 9.0], "B"), (0.0, 0.0, [1.0, 9.0], [0.0, 9.0], "A")]
    holes = [(None, -2.0, [1.0], [3.0], "B"), (0.0, 0.0, [None], [3.0], "A"), (0.0, 0.0, [], [3.0], "A"), (0.0, 0.0, None, [3.0], "A")]
    near = [round(w, 1) for w in ebm.conditional_fit(options(spark, rows).withColumns({f"features_{s}": F.slice(f"features_{s}", 1, 1) for s in "ab"}), 1)]
    clean = ebm.moment_matching_fit(options(spark, rows), 1, start=near)
    weights, steps, gap = ebm.moment_matching_fit(options(spark, rows + holes).repartition(5), 1, start=near)
    assert steps == clean[1] and np.allclose([*weights, gap], [*clean[0], clean[2]])
    assert abs(ebm.moment_gap(options(spark, rows), clean[0])[0]) < ebm.TOLERANCE
    with pytest.raises(ValueError):
        ebm.moment_matching_fit(options(spark, holes), 1)


def test_likelihood_survives_underflow_and_ties_go_second(spark):
    df = options(spark, [(-5000.0, -5001.0, [0.0], [0.0], "A")])
    assert math.isclose(ebm.log_likelihood(df, [1.0]).first().log_likelihood, -math.log1p(math.exp(-1)), rel_tol=1e-9)
    tie = options(spark, [(0.0, 0.0, [1.0], [1.0], "A"), (0.0, 0.0, [1.0], [1.0], "B")])
    assert ebm.option_accuracy(tie, [1.0]).first().accuracy == 0.5


SEQUENCES = {
    1: ["a", "b", "E", "c"], 2: ["P", "a", "P", "b"], 3: ["E", "a"], 4: ["B", "P", "a", "E", "P"], 5: ["a"], 6: ["P"] * 3 + ["E"] * 2,
}


def masked_sum(tokens, forced=None):
    mask = [t != "P" for t in tokens]
    mask[0] = not (forced is not None and tokens[0] == forced)
    if "E" in tokens:
        end = tokens.index("E")
        mask = [m and i < end or i == end for i, m in enumerate(mask)]
    return -float(sum(i + 1 for i, m in enumerate(mask) if m))


@pytest.mark.parametrize("forced", [None, "B"])
@pytest.mark.parametrize("slot", [1, 2, 65_536])
def test_sequence_log_prob_forms_agree(spark, forced, slot):
    long = [(k, i, t, -float(i + 1)) for k, ts in SEQUENCES.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(long, "sample_id int, pos int, token string, logprob double").repartition(3)
    found = {r.sample_id: r.log_prob for r in ebm.sequence_log_prob(df, eos="E", pad="P", forced_bos=forced, slot_tokens=slot).collect()}
    expected = {k: masked_sum(ts, forced) for k, ts in SEQUENCES.items()}
    assert found == expected
    arrays = spark.createDataFrame([(k, ts, [-float(i + 1) for i in range(len(ts))]) for k, ts in SEQUENCES.items()], "k int, ids array<string>, lp array<double>")
    assert {r.k: r.log_prob for r in ebm.sequence_log_prob_arrays(arrays, "ids", "lp", "E", "P", forced).collect()} == expected


def test_text_ranker_learns_a_word(spark):
    rows = [(i, "train" if i % 4 else "test", f"plain good text {i}", f"plain bad text {i}") for i in range(120)]
    pairs = spark.createDataFrame(rows, "pair_id long, role string, chosen string, rejected string").withColumn("split", F.col("role"))
    ranker = text_pair_ranker(pairs, num_features=256, regs=(0.01, 1.0), max_iter=20)
    assert ranker.acc == 1.0
    scored = ranker.score(spark.createDataFrame([("good", "x"), ("bad", "x")], "response string, prompt string"))
    by_text = {r.response: r.score for r in scored.collect()}
    assert by_text["good"] > by_text["bad"] and scored.columns == ["response", "prompt", "score"]


def test_a_sequence_ends_once_whatever_its_pages(spark):
    rows = [(1, i, "end" if i == 5 else "w", -1.0) for i in range(3_000)]
    rows += [(2, 0, "pad", -1.0), (2, 1, None, -2.0), (2, 2, "pad", -4.0), (2, 3, "end", -8.0), (2, 4, "w", -16.0)]
    tokens = spark.createDataFrame(rows, "sample_id int, pos int, token string, logprob double")

    def of_slots(**marks):
        return {r.sample_id: r.log_prob for r in ebm.sequence_log_prob(tokens, eos="end", slot_tokens=1_024, **marks).collect()}

    def of_pages(**marks):
        pages = collect_samples(
            tokens.withColumn("position", F.col("pos") + 1), ["sample_id"], "position", ["token", "logprob"], 1_024
        )
        scored = ebm.sequence_log_prob_arrays(pages, "token", "logprob", "end", start=F.col("page") * 1_024, **marks)
        return {r.sample_id: r.log_prob for r in ebm.merge_pages(scored, ["sample_id"], "page").collect()}

    assert of_slots(pad="pad") == of_pages(pad="pad") == {1: -6.0, 2: -11.0}
    assert of_slots() == of_pages() == {1: -6.0, 2: -15.0}


def test_an_unsettled_fit_is_an_error(spark):
    df, a, b, y = table(spark)
    x = scaled_difference(a, b)
    rows = spark.createDataFrame([([float(v) for v in x[i]], int(y[i]), 0) for i in range(len(y))], "x array<double>, y int, fold int")
    with pytest.raises(RuntimeError, match="not settled"):
        fit.fit_settings(rows, [fit.Setting(1.0, "l2", -1)], 3, max_passes=1)


def test_registered_text_ranker_is_the_operator_at_its_defaults(spark, monkeypatch):
    called = []
    monkeypatch.setattr(fitting, "text_pair_ranker", lambda *a, **k: called.append((a[1:], k)) or text_pair_ranker(*a, **k))
    rows = fitting.text_ranker(spark, "/root/testdata/sf0.001").collect()
    assert called == [((), {})] and {r.split for r in rows} == {"train", "test"}
    assert len({(r.reg, r.settled) for r in rows}) == 1
    assert rows[0].reg in (0.01, 0.1) and rows[0].settled is not None
