"""Experiment grids whose runs share their passes: features x extractors x labels x data sizes over one table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.functions.features import add_features, registered_features
from prefspark.functions.ordering import keyed_draw, with_position
from prefspark.functions.rewards import beats, sigmoid
from prefspark.operators import curate
from prefspark.operators.fit import FOLDS, PENALTIES, SCALE_EPS, STRENGTHS, SUMMARIES, matrix_of, newton, setting_sums, sum_over, unpacked
from prefspark.operators.labels import randomize_sides
from prefspark.operators.models import RewardModel
from prefspark.operators.rating import RUBRIC_FEATURES
from prefspark.session import settle

#: Runs that share a pass. A task's summary and the driver's curvatures grow with runs x settings, not with rows.
RUNS_AT_ONCE = 32
ALL_ROWS = 2**62


@dataclass(frozen=True)
class Run:
    """One search: the extractor's column prefix, short or full features, the scorer whose labels are taken, the data size."""

    prefix: str = ""
    short: bool = False
    scorer: str | None = None
    subset: int | None = None

    def features(self) -> list[str]:
        return curate.select_features(RUBRIC_FEATURES, prefix=self.prefix, subset="short" if self.short else None)


@dataclass(frozen=True)
class GridFit:
    run: Run
    model: RewardModel
    n: int
    metrics: list[dict]

    @property
    def best(self) -> dict:
        return next(m for m in self.metrics if m["best"])


def grid_rows(
    annotated: DataFrame, runs: Sequence[Run], scorers: Mapping[str, DataFrame], split: str, seed: int, folds: int
) -> tuple[DataFrame, list[str]]:
    """``a, b, y, signs, folds`` of the fitted split, stored, and the stems of the features in ``a`` and ``b``.

    ``a`` and ``b`` hold the features of all runs. ``signs`` has a number per scorer (the first stands for the given labels): 1 where it agrees with the
    label, -1 where it does not, which swaps the sides, and 0 where it has no scores. ``folds`` has the row's fold in every run, -1 in those it does
    not belong to: it is the row's membership of all runs. Draws and folds are ranked for all runs together.
    """
    key = "pair_id"
    stems = list(dict.fromkeys(f for run in runs for f in run.features()))
    fitted = annotated.where((F.col("split") == split) & F.col(key).isNotNull())
    curate.require_unique(fitted, key)
    computed = {f: fn for f, fn in registered_features().items() if f in stems and f"{f}_chosen" not in fitted.columns}
    if computed:
        fitted = add_features(fitted, {"chosen": "chosen", "rejected": "rejected"}, "context", computed)
    columns = [f"{f}_{side}" for f in stems for side in ("chosen", "rejected")]
    fitted = fitted.select(key, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    signs = [F.lit(1)]
    for i, scores in enumerate(scorers.values()):
        given = scores.select(F.col(key).alias("_key"), F.col("score_chosen").alias(f"_w{i}"), F.col("score_rejected").alias(f"_l{i}"))
        fitted = fitted.join(given, F.col(key) == F.col("_key"), "left").drop("_key")
        known = F.col(f"_w{i}").isNotNull() & F.col(f"_l{i}").isNotNull()
        signs.append(F.when(known, F.when(beats(F.col(f"_w{i}"), F.col(f"_l{i}")), 1).otherwise(-1)).otherwise(0))
    drop = [f"_{side}{i}" for i in range(len(scorers)) for side in "wl"]
    sided = randomize_sides(fitted.withColumn("signs", F.array(*signs)).drop(*drop), key, seed, stems, response=None)
    stored = settle(
        sided.select(
            key,
            F.col("labels").alias("y"),
            "signs",
            *[F.array(*[F.col(f"`{f}_{side}`") for f in stems]).alias(side) for side in "ab"],
        ),
        "grid_sides",
    )
    sources = [None, *scorers]
    kinds = list(dict.fromkeys((run.prefix, run.short, run.scorer) for run in runs))

    def usable(prefix: str, short: bool, scorer: str | None):
        places = F.array(*[F.lit(stems.index(f)) for f in Run(prefix, short).features()])
        known = F.forall(places, lambda i: F.get("a", i).isNotNull() & ~F.isnan(F.get("a", i)) & F.get("b", i).isNotNull() & ~F.isnan(F.get("b", i)))
        return known & (F.get("signs", F.lit(sources.index(scorer))) != 0)

    draw = F.concat(keyed_draw(seed, key), F.lit(":"), F.col(key).cast("string")).alias("draw")
    flagged = stored.select(key, "y", draw, F.posexplode(F.array(*[usable(*kind) for kind in kinds])).alias("kind", "member"))
    drawn = with_position(flagged.where("member").drop("member"), ["kind"], ["draw"], "drawn")
    wanted = [
        F.struct(F.lit(r).alias("run"), F.lit(kinds.index((run.prefix, run.short, run.scorer))).alias("kind"), F.lit(run.subset or ALL_ROWS).cast("long").alias("upto"))
        for r, run in enumerate(runs)
    ]
    chosen = F.filter(F.array(*wanted), lambda w: (w.kind == F.col("kind")) & (F.col("drawn") <= w.upto))
    members = settle(drawn.select(key, "y", F.explode(F.transform(chosen, lambda w: w.run)).alias("run")), "grid_members")
    dealt = with_position(members, ["run", "y"], [key], "position")
    fold = F.struct("run", F.pmod(F.col("position") - 1, F.lit(folds)).cast("int").alias("fold"))
    own = dealt.groupBy(key).agg(F.map_from_entries(F.collect_list(fold)).alias("own"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(len(runs) - 1)), lambda r: F.coalesce(F.element_at("own", r), F.lit(-1)))
    return settle(stored.join(own, key).select(key, "y", "signs", "a", "b", spread.alias("folds")), "grid_rows"), stems


def _side_moments(rows: DataFrame, runs: int, k: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, and mean and spread per feature over both sides, of every run: two passes, one for sums and one around the means."""

    def members(batch: pa.RecordBatch) -> np.ndarray:
        return (matrix_of(batch, "folds") >= 0).astype(float)

    def sums(batch: pa.RecordBatch) -> np.ndarray:
        inside = members(batch)
        both = np.nan_to_num(matrix_of(batch, "a")) + np.nan_to_num(matrix_of(batch, "b"))
        return np.concatenate([inside.sum(0)[:, None], inside.T @ both], axis=1)

    first = sum_over(rows, sums, wide).reshape(runs, 1 + k)
    n = np.maximum(first[:, 0], 1.0)
    means = first[:, 1:] / (2 * n[:, None])

    def around(batch: pa.RecordBatch) -> np.ndarray:
        folds, out = matrix_of(batch, "folds"), np.zeros((runs, k))
        a, b = matrix_of(batch, "a"), matrix_of(batch, "b")
        for r in range(runs):
            inside = folds[:, r] >= 0
            for side in (a, b):
                out[r] += np.nan_to_num((side[inside] - means[r]) ** 2).sum(0)
        return out

    squares = sum_over(rows, around, wide).reshape(runs, k)
    return first[:, 0].astype(int), means, np.sqrt(squares / (2 * n[:, None])) + SCALE_EPS


def _fit_group(
    rows: DataFrame, first: int, runs: Sequence[Run], stems: Sequence[str], sources: Sequence[str | None], strengths, penalties, folds: int, name: str
) -> list[GridFit]:
    """All searches of a group of runs, by passes that evaluate every unfinished fit of every run."""
    wide = rows.rdd.getNumPartitions() > SUMMARIES
    here = rows.withColumn("folds", F.slice("folds", first + 1, len(runs)))
    n, means, stds = _side_moments(here, len(runs), len(stems), wide)
    for run, present in zip(runs, n):
        if not present or (run.subset and present < run.subset):
            raise ValueError(f"{run.subset or 'some'} rows wanted for {run}, only {present} present")
    places = [np.array([stems.index(f) for f in run.features()]) for run in runs]
    source = [sources.index(run.scorer) for run in runs]
    k = max(map(len, places))
    grid = [(c, p) for c in sorted(strengths) for p in sorted(penalties)]
    each = [(c, p, fold) for c, p in grid for fold in [*range(folds), -1]]
    owner = np.repeat(np.arange(len(runs)), len(each))
    left_out = np.array([fold for _ in runs for _, _, fold in each])

    def inputs(batch: pa.RecordBatch, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Standardized differences (columns past the run's own features are 0), labels and folds of a run's rows."""
        fold = matrix_of(batch, "folds")[:, r]
        inside = fold >= 0
        a, b = matrix_of(batch, "a")[inside][:, places[r]], matrix_of(batch, "b")[inside][:, places[r]]
        x = np.zeros((int(inside.sum()), k))
        x[:, : len(places[r])] = (a - b) / stds[r, places[r]] * matrix_of(batch, "signs")[inside][:, [source[r]]]
        return x, batch.column("y").to_numpy()[inside], fold[inside]

    def evaluate(active: np.ndarray, weights: np.ndarray):
        def part(batch: pa.RecordBatch) -> np.ndarray:
            out = np.zeros((len(active), 1 + k + k * (k + 1) // 2))
            for r in np.unique(owner[active]):
                mine = owner[active] == r
                x, y, fold = inputs(batch, r)
                out[mine] = setting_sums(x, y, fold[:, None] != left_out[active][mine][None, :], weights[mine])
            return out

        return unpacked(sum_over(here, part, wide).reshape(len(active), -1), k)

    c = np.array([c for _ in runs for c, _, _ in each])
    lasso = np.array([p == "l1" for _ in runs for _, p, _ in each])
    weights = newton(evaluate, c, lasso, k)

    def held_out(batch: pa.RecordBatch) -> np.ndarray:
        hits, held = np.zeros(len(owner)), np.zeros(len(owner))
        for r in range(len(runs)):
            x, y, fold = inputs(batch, r)
            inside = fold[:, None] == left_out[owner == r][None, :]
            hits[owner == r] = (((x @ weights[owner == r].T > 0) == (y[:, None] == 1)) & inside).sum(0)
            held[owner == r] = inside.sum(0)
        return np.concatenate([hits, held])

    hits, held = sum_over(here, held_out, wide).reshape(2, len(runs), len(grid), folds + 1)[..., :folds]
    accuracy = (hits / np.maximum(held, 1)).mean(2)
    winners = np.argmax(np.round(accuracy, 12), axis=1)
    refits = weights.reshape(len(runs), len(grid), folds + 1, k)[np.arange(len(runs)), winners, folds]

    def rewards(batch: pa.RecordBatch) -> np.ndarray:
        out, fold = np.zeros(len(runs)), matrix_of(batch, "folds")
        for r in range(len(runs)):
            inside, w = fold[:, r] >= 0, refits[r, : len(places[r])] / stds[r, places[r]]
            for side in "ab":
                out[r] += (((matrix_of(batch, side)[inside][:, places[r]] - means[r, places[r]]) @ w) ** 2).sum()
        return out

    # Standardized features have mean 0 over both sides, and so has the reward.
    spreads = np.sqrt(sum_over(here, rewards, wide) / (2 * n))
    found = []
    for r, run in enumerate(runs):
        metrics = [
            {"model": name, "C": c, "penalty": p, "accuracy": float(accuracy[r, i]), "best": i == winners[r]} for i, (c, p) in enumerate(grid)
        ]
        own = weights.reshape(len(runs), len(grid), folds + 1, k)[r, winners[r], :folds, : len(places[r])]
        metrics[winners[r]]["fold_weights"] = own.tolist()
        model = RewardModel(
            name,
            tuple(run.features()),
            tuple(float(m) for m in means[r, places[r]]),
            tuple(float(s) for s in stds[r, places[r]]),
            tuple(float(w) for w in refits[r, : len(places[r])]),
            0.0,
            float(spreads[r]),
            float(accuracy[r, winners[r]]),
        )
        found.append(GridFit(run, model, int(n[r]), metrics))
    return found


def fit_grid(
    annotated: DataFrame,
    runs: Sequence[Run],
    scorers: Mapping[str, DataFrame] | None = None,
    split: str = "train",
    seed: int = 100,
    strengths: Sequence[float] = STRENGTHS,
    penalties: Sequence[str] = PENALTIES,
    folds: int = FOLDS,
    name: str = "grid",
) -> tuple[list[GridFit], DataFrame]:
    """The cross-validated search of every run, as ``flows.fit_pairs`` makes it for one, and the rows they share.

    ``annotated`` has a rating column per side for every extractor's prefix. A run takes the rows complete in its features, with
    scores of its scorer where it names one, and of these the ``subset`` with the smallest draws. All runs read one table in
    which each row knows its fold in every run, so the whole grid takes about as many passes as one search.
    """
    scorers = scorers or {}
    rows, stems = grid_rows(annotated, runs, scorers, split, seed, folds)
    held, found = rows.drop("pair_id").persist(), []
    try:
        for first in range(0, len(runs), RUNS_AT_ONCE):
            group = runs[first : first + RUNS_AT_ONCE]
            found += _fit_group(held, first, group, stems, [None, *scorers], strengths, penalties, folds, name)
    finally:
        held.unpersist()
    return found, rows


def grid_table(spark: SparkSession, fits: Sequence[GridFit]) -> DataFrame:
    """One row per run, strength and penalty: the run's attributes, its rows and the mean held-out accuracy."""
    rows = [
        (f.run.prefix, f.run.short, f.run.scorer, f.run.subset, len(f.model.features), f.n, m["C"], m["penalty"], m["accuracy"], bool(m["best"]))
        for f in fits
        for m in f.metrics
    ]
    schema = "prefix string, short boolean, scorer string, subset long, features int, n long, C double, penalty string, accuracy double, best boolean"
    return spark.createDataFrame(rows, schema)


def grid_checks(rows: DataFrame, fits: Sequence[GridFit], stems: Sequence[str], scorers: Sequence[str] = ()) -> DataFrame:
    """``run, slope, accuracy, n`` by aggregates apart from the solver: the largest slope of each run's objective at its
    refit, and the mean held-out accuracy of its winner's folds."""
    sources = [None, *scorers]
    k = max(len(f.model.features) for f in fits)

    def padded(values, fill):
        return F.array(*[F.lit(v) for v in [*values, *[fill] * (k - len(values))]])

    about = [
        F.struct(
            F.lit(r).alias("run"),
            padded([stems.index(x) for x in f.model.features], 0).alias("at"),
            padded([float(s) for s in f.model.stds], float("inf")).alias("stds"),
            padded([float(w) for w in f.model.coefs], 0.0).alias("w"),
            F.lit(sources.index(f.run.scorer)).alias("source"),
            F.array(*[padded(w, 0.0) for w in f.best["fold_weights"]]).alias("by_fold"),
        )
        for r, f in enumerate(fits)
    ]
    each = rows.select("y", "signs", "a", "b", "folds", F.inline(F.filter(F.array(*about), lambda m: F.get("folds", m.run) >= 0)))
    difference = F.zip_with("at", "stds", lambda i, s: (F.get("a", i) - F.get("b", i)) / s * F.get("signs", F.col("source")))
    fold = F.get("folds", F.col("run"))
    scaled = each.select("run", "y", "w", fold.alias("fold"), F.get("by_fold", fold).alias("v"), difference.alias("x"))

    def product(weights: str):
        return F.aggregate(F.zip_with("x", weights, lambda x, w: x * w), F.lit(0.0), lambda total, v: total + v)

    error = sigmoid(F.col("margin")) - F.col("y")
    sums = [F.sum(error * F.get("x", F.lit(i))).alias(f"g{i}") for i in range(k)]
    hit = F.avg(((product("v") > 0) == (F.col("y") == 1)).cast("double")).alias("share")
    folds = max(len(f.best["fold_weights"]) for f in fits)
    shares = scaled.groupBy("run", "fold").agg(hit).groupBy(F.col("run").alias("_run")).agg((F.sum("share") / folds).alias("accuracy"))
    summed = scaled.withColumn("margin", product("w")).groupBy("run").agg(*sums, F.count(F.lit(1)).alias("n"))
    found = None
    for r, f in enumerate(fits):
        pull, left = 1.0 / f.best["C"], []
        for i, w in enumerate(f.model.coefs):
            g = F.col(f"g{i}")
            if f.best["penalty"] == "l2":
                left.append(F.abs(g + w * pull))
            elif w:
                left.append(F.abs(g + (pull if w > 0 else -pull)))
            else:
                left.append(F.greatest(F.abs(g) - pull, F.lit(0.0)))
        worst = F.greatest(*left, F.lit(0.0)) / F.col("n")
        found = F.when(F.col("run") == r, worst) if found is None else found.when(F.col("run") == r, worst)
    return summed.select("run", found.alias("slope"), "n").join(shares, F.col("run") == F.col("_run")).drop("_run")
