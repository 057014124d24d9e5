"""Models learned from texts: the ranker and the rating regression against plain solvers, storing and sample scoring."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prefspark.operators import hashed_text, ranker, regressor

BUCKETS = 1 << 10


def pairs(spark, n=160):
    """What is good depends on the prompt: words alone cannot tell the sides apart."""
    rows = []
    for i in range(n):
        prompt, good, bad = ("be short", "brief", "long") if i % 2 else ("be wordy", "long", "brief")
        rows.append((i, "train" if i % 4 else "test", f"{prompt}", f"a {good} text {i % 7}", f"a {bad} text {i % 5}"))
    return spark.createDataFrame(rows, "pair_id long, role string, context string, chosen string, rejected string").withColumn("split", F.col("role"))


def matrix(df, sides, prompt, buckets, y=()):
    stored = hashed_text.hashed_rows(df, sides, prompt, buckets, list(y)).collect()
    x = np.zeros((len(stored), buckets))
    for i, row in enumerate(stored):
        x[i, row["index"]] = row["value"]
    return x, stored


def test_vectors_add_up_and_have_length_one(spark):
    texts = ["one two two", "", None, "Ünï one", "x " * 5_000]
    df = spark.createDataFrame([(i, t, p) for i, t in enumerate(texts) for p in ("p q", None)], "i int, t string, p string")
    x, _ = matrix(df, [("t", 1.0)], "p", 1 << 20)
    lengths = (x**2).sum(1)
    assert np.allclose(lengths, [2, 1, 0, 0, 0, 0, 2, 1, 2, 1])
    assert not matrix(df, [("t", 1.0), ("t", -1.0)], "p", 64)[0].any()


def test_ranker_reads_the_prompt_and_is_the_optimum(spark):
    df = pairs(spark)
    model = ranker.text_pair_ranker(df, num_features=BUCKETS, regs=(0.01, 1.0))
    assert model.settled and model.with_prompt and model.acc == 1.0 and model.reg == 0.01
    assert ranker.text_pair_ranker(df.drop("context"), num_features=BUCKETS).acc < 0.8
    x, _ = matrix(df.where("role = 'train'"), [("chosen", 1.0), ("rejected", -1.0)], "context", BUCKETS)
    w = np.zeros(BUCKETS)
    for _ in range(30):
        share = 1 / (1 + np.exp(x @ w))
        slope = -(x.T @ share) / len(x) + 0.01 * w
        w -= np.linalg.solve(x.T @ (x * (share * (1 - share))[:, None]) / len(x) + 0.01 * np.eye(BUCKETS), slope)
    assert np.abs(w - model.weights).max() < 1e-4
    found = ranker.ranker_slope(model, df.where("role = 'train'")).first()
    assert found.slope < 1e-6 and found.n == 120
    moved = ranker.TextPairRanker(model.weights * 1.05, model.reg, True)
    assert ranker.ranker_slope(moved, df.where("role = 'train'")).first().slope > 1e-4


def test_a_stored_ranker_scores_samples_alike(spark, tmp_path):
    model = ranker.text_pair_ranker(pairs(spark), num_features=BUCKETS)
    model.save(spark, str(tmp_path / "m"))
    again = ranker.load_ranker(spark, str(tmp_path / "m"))
    assert (again.weights == model.weights).all() and (again.reg, again.settled, again.acc) == (model.reg, True, model.acc)
    rows = [("be short", "a brief text", 1), ("be short", "a long text", 2), (None, "a brief text", 3), ("be wordy", None, 4), ("be short", "", 5)]
    samples = spark.createDataFrame(rows, "prompt string, response string, sample_idx int")
    scored = again.score(samples)
    score = {r.sample_idx: r.score for r in scored.collect()}
    assert scored.columns == ["prompt", "response", "sample_idx", "score"]
    assert score[1] > score[2] and score[4] == score[5] == 0.0
    assert score == {r.sample_idx: r.score for r in model.score(samples.repartition(4)).collect()}
    with pytest.raises(Exception, match="already exists"):
        model.save(spark, str(tmp_path / "m"))


def test_an_unsettled_ranker_says_so_and_no_pairs_give_no_weights(spark):
    assert not ranker.text_pair_ranker(pairs(spark), num_features=BUCKETS, max_iter=2).settled
    empty = ranker.text_pair_ranker(pairs(spark).where("1 = 0"), num_features=16)
    assert empty.settled and not empty.weights.any() and empty.acc == 0.0


def test_regression_is_the_ridge_solution_for_every_target(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40)]
    rows = []
    for i in range(200):
        text = " ".join(rng.choice(words, size=int(rng.integers(1, 30))))
        y = float(rng.normal())
        rows.append((i, f"p{i % 3}", text if i else None, float(text.count("w1")), None if i % 5 == 0 else y, None))
    df = spark.createDataFrame(rows, "id int, context string, response string, ones double, noise double, none double")
    targets = ("ones", "noise", "none")
    model = regressor.fit_ratings(df, targets, num_features=BUCKETS)
    x, stored = matrix(df, [("response", 1.0)], "context", BUCKETS, targets)
    for t, name in enumerate(targets):
        known = np.array([r[name] is not None for r in stored])
        y = np.array([r[name] or 0.0 for r in stored])[known]
        if not known.any():
            assert not model.weights[t].any() and model.means[t] == 0
            continue
        n = known.sum()
        w = np.linalg.solve(x[known].T @ x[known] / n + 0.01 * np.eye(BUCKETS), x[known].T @ (y - y.mean()) / n)
        assert np.abs(w - model.weights[t]).max() < 1e-4 and abs(model.means[t] - y.mean()) < 1e-12
    slopes = {r.target: (r.slope, r.n) for r in regressor.regression_slopes(model, df, "id").collect()}
    assert all(s < 1e-6 for s, _ in slopes.values()) and [slopes[t][1] for t in targets] == [200, 160, 0]
    model.save(spark, str(tmp_path / "r"))
    again = regressor.load_regressor(spark, str(tmp_path / "r"))
    predicted = again.predict(df).select("id", "ones_predicted", "noise_predicted", "none_predicted").collect()
    assert len(predicted) == 200 and predicted[0].noise_predicted == pytest.approx(model.means[1])
    error = np.mean([(p.ones_predicted - r[3]) ** 2 for p, r in zip(sorted(predicted), rows)])
    assert error < 0.5 * np.var([r[3] for r in rows])
    with pytest.raises(RuntimeError, match="not settled"):
        regressor.fit_ratings(df, targets, num_features=BUCKETS, max_passes=3)


def test_work_on_texts_is_bounded_by_entries_and_gives_the_same_vectors(spark, monkeypatch):
    """A batch of many texts is worked on in parts; a single text with more entries than a part is a part of its own."""
    words = pa.array([[1, 2, 3, 2], [], [4], list(range(50)), [5, 6], [7]], pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_arrays([pa.array([[8, 9]] * 6, pa.list_(pa.int64())), words], names=["k", "w"])
    monkeypatch.setattr(hashed_text, "ENTRIES", 15)
    parts = list(hashed_text._text_blocks(batch, "k", ["w"]))
    assert [p.num_rows for p in parts] == [3, 1, 2] and pa.Table.from_batches(parts).column("w").to_pylist() == words.to_pylist()
    whole = hashed_text.vectors(words, batch.column("k"), BUCKETS)
    found, first = [], 0
    for p in parts:
        row, index, value = hashed_text.vectors(p.column("w"), p.column("k"), BUCKETS)
        found += zip((row + first).tolist(), index.tolist(), value.tolist())
        first += p.num_rows
    assert sorted(found) == sorted(zip(*(v.tolist() for v in whole)))


@pytest.fixture
def largest(spark, monkeypatch):
    """The most entries (of one call of ``vectors``, of one block of a pass) and the text columns that Arrow functions got, run in this process."""
    seen, vectors, init = {"vectors": 0, "block": 0, "texts": set()}, hashed_text.vectors, hashed_text.Block.__init__

    def noted(words, keys, buckets):
        found = vectors(words, keys, buckets)
        seen["vectors"] = max(seen["vectors"], len(found[0]))
        return found

    def begun(self, batch):
        init(self, batch)
        seen["block"] = max(seen["block"], len(self.value))

    def here(df, func, schema):
        seen["texts"] |= {f.name for f in df.schema if f.dataType.simpleString() == "string"}
        got = list(func(iter(df.toArrow().combine_chunks().to_batches())))
        return spark.createDataFrame(pa.Table.from_batches(got), schema)

    monkeypatch.setattr(hashed_text, "ENTRIES", 400)
    monkeypatch.setattr(hashed_text, "vectors", noted)
    monkeypatch.setattr(hashed_text.Block, "__init__", begun)
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", here)
    return seen


def test_rows_and_passes_of_the_ranker_hold_bounded_parts(spark, largest):
    hashed_text.summed(hashed_text.hashed_rows(pairs(spark), [("chosen", 1.0), ("rejected", -1.0)], "context", BUCKETS, ["pair_id"]), lambda b, _: np.ones(1), 1)
    assert 0 < largest["vectors"] <= 400 and 0 < largest["block"] <= 400


def test_scores_of_pairs_hold_bounded_parts_and_take_no_texts_along(spark, largest):
    model = ranker.TextPairRanker(np.arange(BUCKETS) / BUCKETS, 0.1, True)
    scored = model.score_pairs(pairs(spark))
    assert scored.columns == ["model", "pair_id", "split", "score_chosen", "score_rejected"] and scored.count() == 160
    assert 0 < largest["vectors"] <= 400 and largest["texts"] == {"split"}


def test_passes_of_the_regression_hold_bounded_parts(spark, largest):
    rows = [(i, "p q", " ".join(f"w{(i * j) % 50}" for j in range(20)), float(i % 7), None if i % 3 else 1.0) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, context string, response string, a double, b double")
    assert np.isfinite(regressor.fit_ratings(df, ("a", "b"), num_features=64, max_passes=100).weights).all()
    assert 0 < largest["vectors"] <= 400 and 0 < largest["block"] <= 400


def rated(spark, n=300):
    rows = [(i, f"p{i % 3}", " ".join(f"w{(i * j) % 50}" for j in range(20)), float(i % 7), None if i % 3 else float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "id int, context string, response string, a double, b double").repartition(1)


def test_passes_get_batches_of_bounded_bytes_and_the_setting_of_the_session_comes_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(hashed_text, "BATCH_BYTES", 1 << 14, raising=False)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    rows = hashed_text.hashed_rows(rated(spark), [("response", 1.0)], "context", 64, ["a"])
    rows.write.parquet(path := str(tmp_path / "rows"))
    parts, seen, large = hashed_text.summed(
        spark.read.parquet(path), lambda _, batch: np.array([1.0, batch.num_rows, batch.nbytes > 3 << 14]), 3
    )
    assert seen == 300 and parts >= 5 and large == 0
    assert spark.conf.get(setting) == before and spark.conf.get(setting, None) is None
    try:
        spark.conf.set(setting, 1 << 30)
        assert hashed_text.summed(spark.read.parquet(path), lambda _, batch: np.ones(1), 1) == 1
        assert spark.conf.get(setting) == str(1 << 30)
    finally:
        spark.conf.unset(setting)


def test_passes_of_the_regression_read_the_written_rows_and_keep_no_copy_in_memory(spark, monkeypatch):
    kept, summed = [], regressor.summed

    def noted(rows, part, size):
        kept.append(rows.storageLevel.useMemory or rows.storageLevel.useDisk)
        return summed(rows, part, size)

    monkeypatch.setattr(regressor, "summed", noted)
    model = regressor.fit_ratings(rated(spark), ("a", "b"), num_features=64, max_passes=100)
    assert len(kept) == model.passes and not any(kept)


def test_slopes_move_rows_instead_of_their_entries(spark):
    df = rated(spark)
    model = regressor.fit_ratings(df, ("a", "b"), num_features=64, max_passes=100)
    moved = regressor.RatingRegressor(model.targets, model.means, model.weights * 1.2, model.reg, True, model.passes)
    found = regressor.regression_slopes(moved, df, "id")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Join Inner")
    x, stored = matrix(df, [("response", 1.0)], "context", 64, ("a", "b"))
    slopes = {r.target: r for r in found.collect()}
    for t, name in enumerate(model.targets):
        known = np.array([r[name] is not None for r in stored])
        y = np.array([r[name] or 0.0 for r in stored])[known]
        slope = x[known].T @ (x[known] @ moved.weights[t] + moved.means[t] - y) / known.sum() + moved.reg * moved.weights[t]
        assert slopes[name].n == known.sum() and slopes[name].slope == pytest.approx(np.abs(slope).max(), rel=1e-9) and slopes[name].slope > 1e-4
