"""Shared experiment grids against the single searches they stand for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prefspark.operators import fit
from prefspark.operators.rating import RUBRIC_FEATURES
from prefspark.plans import flows
from prefspark.plans.grid import Run, fit_grid, grid_checks, grid_rows, grid_table

PREFIX = "zeroshot_"
SMALL = {"strengths": (0.1, 10.0), "folds": 4}


def annotated(spark, n=150, seed=5):
    rng, rows = np.random.default_rng(seed), []
    names = [f"{p}{f}_{side}" for p in ("", PREFIX) for f in RUBRIC_FEATURES for side in ("chosen", "rejected")]
    for i in range(n):
        ratings = [int(v) for v in rng.integers(1, 11, len(names))]
        ratings[0] = min(10, ratings[0] + int(rng.integers(0, 5)))
        if i % 17 == 3:
            ratings[-2] = None
        rows.append((i, "train" if i % 5 else "test", "c", "w " * int(rng.integers(1, 9)), "w " * int(rng.integers(1, 9)), *ratings))
    schema = "pair_id long, split string, context string, chosen string, rejected string, " + ", ".join(f"`{c}` long" for c in names)
    return spark.createDataFrame(rows, schema)


def teacher(spark, n=150):
    rng = np.random.default_rng(8)
    rows = [(i, float(rng.normal()), float(rng.normal())) for i in range(n) if i % 11]
    return spark.createDataFrame(rows, "pair_id long, score_chosen double, score_rejected double")


def single(df, run, scores):
    """The same search by itself."""
    names = {f"{run.prefix}{f}_{side}": f"{f}_{side}" for f in RUBRIC_FEATURES for side in ("chosen", "rejected")}
    chosen = df.select("pair_id", "split", "context", "chosen", "rejected", *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return flows.fit_pairs(chosen, scores.get(run.scorer), subset=run.subset, short=run.short, **SMALL)


def test_every_run_equals_its_own_search(spark):
    df, scores = annotated(spark), {"teacher": teacher(spark)}
    runs = [Run(p, short, scorer, subset) for p in ("", PREFIX) for short in (True, False) for scorer in (None, "teacher") for subset in (60, None)]
    fits, rows = fit_grid(df, runs, scores, **SMALL)
    assert [f.run for f in fits] == runs
    for fit in (fits[0], fits[3], fits[6], fits[9], fits[12], fits[15]):
        model, metrics = single(df, fit.run, scores)
        assert np.allclose(fit.model.coefs, model.coefs, atol=1e-6) and np.allclose(fit.model.stds, model.stds) and np.allclose(fit.model.means, model.means)
        assert [(m["C"], m["penalty"], m["best"]) for m in fit.metrics] == [(m["C"], m["penalty"], m["best"]) for m in metrics]
        assert np.allclose([m["accuracy"] for m in fit.metrics], [m["accuracy"] for m in metrics]) and fit.model.acc == pytest.approx(model.acc)
        assert fit.model.reward_mean == pytest.approx(model.reward_mean, abs=1e-6) and fit.model.reward_std == pytest.approx(model.reward_std)
    _, stems = grid_rows(df, runs, scores, "train", 100, 4)
    checks = grid_checks(rows, fits, stems, list(scores)).collect()
    assert len(checks) == 16 and all(c.slope < 1e-6 and c.n == fits[c.run].n for c in checks)
    assert all(c.accuracy == pytest.approx(fits[c.run].model.acc) for c in checks)
    table = grid_table(spark, fits)
    assert table.count() == 16 * 4 and table.where("best").count() == 16


def test_too_few_rows_are_an_error_and_groups_agree(spark, monkeypatch):
    df = annotated(spark)
    with pytest.raises(ValueError, match="rows wanted"):
        fit_grid(df, [Run(subset=1_000)], **SMALL)
    runs = [Run(short=True), Run(short=True, subset=50), Run(PREFIX, short=True)]
    whole, _ = fit_grid(df, runs, **SMALL)
    monkeypatch.setattr("prefspark.plans.grid.RUNS_AT_ONCE", 2)
    parts, _ = fit_grid(df, runs, **SMALL)
    assert all(np.allclose(a.model.coefs, b.model.coefs, atol=1e-9) and a.n == b.n for a, b in zip(whole, parts))


def test_the_driver_receives_one_summary_of_a_pass_whatever_the_tasks(spark, monkeypatch):
    received, arrow = [], type(spark.range(1)).toArrow
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: received.append(arrow(df)) or received[-1])
    rows, size = spark.range(0, 200, 1, 20).select("id"), 5_000
    expected = np.arange(size) * 200.0 + np.arange(200).sum()
    for wide in (False, True):
        total = fit.sum_over(rows, lambda batch: (np.arange(size)[:, None] + batch.column("id").to_numpy()).sum(1), wide)
        assert np.allclose(total, expected)
    assert received[1].nbytes < 1.1 * 8 * size
    monkeypatch.undo()
    small = fit.sum_over(rows, lambda batch: np.array([batch.num_rows, 1.0]), True)
    assert small[0] == 200 and len(small) == 2
