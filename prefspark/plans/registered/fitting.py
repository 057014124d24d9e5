"""Registered queries: fits, model tables, the text ranker, experiment grids and whole stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.operators import fit, models, stats
from prefspark.functions.features import add_features, add_lexical_signals, registered_features
from prefspark.operators.ranker import load_ranker, ranker_slope, text_pair_ranker
from prefspark.operators.rating import RUBRIC_FEATURES, lexical_ratings
from prefspark.operators.regressor import fit_ratings, regression_slopes
from prefspark.plans import flows, grid, inputs
from prefspark.plans.registered.common import FEATURES, MODEL_A, MODEL_B, PAIRS, Query, q6, r6, reward_sql, sided_pairs, sql
from prefspark.plans.registered.pairs import RATED_SAMPLES, _rated_samples
from prefspark.plans.registered.selection import _count_words, word_rating_sql
from prefspark.session import settle, work_path

SETTLED = 1e-6


def _settled(sided, model, C, penalty):
    """Per feature whether the objective is level at the model's weights, from an aggregate of its own."""
    x = fit.design(model.features, model.means, model.stds, "difference")
    found = fit.optimality(sided, x, model.coefs, C, penalty)
    name = F.element_at(F.array(*map(F.lit, model.features)), F.col("feature_pos") + 1)
    return found.select(F.lit(model.name).alias("model"), name.alias("feature"), (F.col("residual") < SETTLED).alias("settled"), "n")


def _best(metrics):
    return next((m["C"], m["penalty"]) for m in metrics if m["best"])


def pairwise_fit_diff(spark, sf_dir):
    sided = sided_pairs(spark, sf_dir).where(F.col("split") == "train")
    found = None
    for C, penalty in ((1.0, "l2"), (0.1, "l1")):
        model = fit.pairwise_fit_diff(sided, FEATURES, C, penalty, name=penalty)
        rows = _settled(sided, model, C, penalty)
        found = rows if found is None else found.unionByName(rows)
    return found


def pairwise_fit_concat(spark, sf_dir):
    """The slope is taken at the weights of both sides, of which the model is the antisymmetric part."""
    sided = sided_pairs(spark, sf_dir).where(F.col("split") == "train")
    means, stds, weights = fit.fit_weights(sided, FEATURES, 1.0, "l2", "labels", "concatenation")
    found = fit.optimality(sided, fit.design(FEATURES, means, stds, "concatenation"), weights, 1.0, "l2")
    model, k = fit.pairwise_fit_concat(sided, FEATURES, 1.0, "l2"), len(FEATURES)
    folded = all(abs(c - (weights[i] - weights[k + i]) / 2) < SETTLED for i, c in enumerate(model.coefs))
    return found.select("feature_pos", ((F.col("residual") < SETTLED) & F.lit(folded)).alias("settled"), "n")


def grid_search_cv(spark, sf_dir):
    """The full search: 12 strengths, 2 penalties, 8 folds; the refit of the best setting."""
    sided = sided_pairs(spark, sf_dir).where(F.col("split") == "train")
    model, metrics = fit.grid_search_cv(sided, FEATURES, name="search")
    folds = fit.stratified_folds(sided, "pair_id", "labels", fit.FOLDS)
    x, weights = fit.design(model.features, model.means, model.stds, "difference"), next(m for m in metrics if m["best"])["fold_weights"]
    recounted = fit.held_out_accuracy(folds, x, weights).first().accuracy
    checked = abs(recounted - model.acc) < SETTLED and model.acc > max(m["accuracy"] for m in metrics) - SETTLED
    settled = _settled(sided, model, *_best(metrics)).withColumn("settings", F.lit(len(metrics)))
    return settled.withColumn("winner_checked", F.lit(checked))


def save_model(spark, sf_dir):
    """A model stored, loaded again and used."""
    path = work_path(spark, "model")
    models.save_model(spark, MODEL_A, path)
    loaded = models.load_model(spark, path)
    scored = stats.normalize_reward(models.score_samples(_rated_samples(spark, sf_dir), loaded, "reward"), "reward", loaded)
    return scored.select("prompt", "sample_idx", r6("reward").alias("reward"))


def _ranked_pairs(spark, sf_dir):
    pairs = inputs.pairs(spark, sf_dir).withColumn("role", F.col("split"))
    return settle(pairs.select("pair_id", "split", "role", "context", "chosen", "rejected"), "ranked_pairs")


def text_ranker(spark, sf_dir):
    """The operator at its defaults, on prompts and both responses; ``settled`` says whether the fits of all strengths came to rest."""
    stored = _ranked_pairs(spark, sf_dir)
    ranker = text_pair_ranker(stored)
    accuracy = stats.pairwise_accuracy(ranker.score_pairs(stored))
    return accuracy.select("model", "split", F.lit(ranker.reg).alias("reg"), F.lit(ranker.settled).alias("settled"), r6("accuracy").alias("accuracy"), "n")


def text_ranker_slope(spark, sf_dir):
    """The ranker, stored and loaded again: whether the loss over the training pairs is level at its weights."""
    stored, path = _ranked_pairs(spark, sf_dir), work_path(spark, "ranker")
    text_pair_ranker(stored).save(spark, path)
    found = ranker_slope(load_ranker(spark, path), stored.where(F.col("role") == "train"))
    return found.select(F.lit("ranker").alias("model"), (F.col("slope") < SETTLED).alias("settled"), "n")


def rating_regression(spark, sf_dir):
    """All thirteen ratings regressed on the texts of documents: whether each target's objective is level at its weights."""
    texts = inputs.documents(spark, sf_dir, "doc_id", "source", "text")
    named = texts.select("doc_id", F.col("source").alias("context"), F.col("text").alias("response"))
    measured = add_lexical_signals(named, "response", "context")
    samples = settle(measured.withColumns(lexical_ratings("signals")).drop("signals"), "rated_documents")
    found = regression_slopes(fit_ratings(samples, RUBRIC_FEATURES), samples, "doc_id")
    return found.select("target", (F.col("slope") < SETTLED).alias("settled"), "n")


def experiment_grid(spark, sf_dir):
    """Data size against the short and the full feature list, each a full cross-validated search."""
    stored = settle(flows.annotate_pairs(inputs.pairs(spark, sf_dir)), "annotated")
    rows = stored.where(F.col("split") == "train").count()

    def step(run):
        sided, stems = flows.fit_rows(stored, subset=run["subset"], short=run["short"])
        model, metrics = fit.fit_reward_model(sided, stems, name="grid")
        settled = _settled(sided, model, *_best(metrics)).agg(F.bool_and("settled").alias("all"), F.max("n").alias("n")).first()
        yield {"features": len(stems), "settled": settled["all"], "n": settled.n, "settings": len(metrics)}

    runs = [{"short": short, "subset": subset} for short in (True, False) for subset in (rows // 2, rows)]
    return flows.experiment_grid(spark, runs, step)


def experiment_grid_shared(spark, sf_dir):
    """24 searches in shared passes: two extractors, short and full features, given and a scorer's labels, three data sizes.

    The second extractor rates the responses without their context. Slope and winner of each run come from aggregates of their own.
    """
    pairs = inputs.pairs(spark, sf_dir).select("pair_id", "split", "context", "chosen", "rejected")
    first = flows.annotate_pairs(pairs).withColumn("_context", F.col("context")).withColumn("context", F.lit(""))
    second = flows.annotate_pairs(first, prefix="zeroshot_").drop("context").withColumnRenamed("_context", "context")
    measured = add_features(second, {"chosen": "chosen", "rejected": "rejected"}, "context", {"length": registered_features()["length"]})
    stored = settle(measured.drop("chosen", "rejected"), "grid_annotated")
    scorers = {"teacher": settle(models.pair_scores(sided_pairs(spark, sf_dir), MODEL_B), "teacher_scores")}
    rows = stored.where(F.col("split") == "train").count()
    runs = [
        grid.Run(prefix, short, scorer, subset)
        for prefix in ("", "zeroshot_")
        for short in (True, False)
        for scorer in (None, "teacher")
        for subset in (rows // 4, rows // 2, None)
    ]
    fits, shared = grid.fit_grid(stored, runs, scorers)
    stems = list(dict.fromkeys(f for run in runs for f in run.features()))
    checks = {c.run: c for c in grid.grid_checks(shared, fits, stems, list(scorers)).collect()}
    table = [
        (
            f.run.prefix, f.run.short, f.run.scorer, f.run.subset, len(f.model.features), checks[r].slope < SETTLED,
            abs(checks[r].accuracy - f.model.acc) < SETTLED and f.model.acc > max(m["accuracy"] for m in f.metrics) - SETTLED, checks[r].n, len(f.metrics),
        )
        for r, f in enumerate(fits)
    ]
    schema = "prefix string, short boolean, scorer string, subset long, features int, settled boolean, winner_checked boolean, n long, settings int"
    return spark.createDataFrame(table, schema)


def fit_pairs(spark, sf_dir):
    """Annotate, re-label by a given scorer and fit: whether the new model is the optimum on the re-labelled rows."""
    annotated = settle(flows.annotate_pairs(inputs.pairs(spark, sf_dir)), "annotated")
    scores = settle(models.pair_scores(sided_pairs(spark, sf_dir), MODEL_B), "teacher_scores")
    model, metrics = flows.fit_pairs(annotated, scores, name="student")
    sided, _ = flows.fit_rows(annotated, scores)
    return _settled(sided, model, *_best(metrics)).withColumn("settings", F.lit(len(metrics)))


def compare_models(spark, sf_dir):
    """Samples scored by two reward models: the curve under the first model's choice."""
    rated = _rated_samples(spark, sf_dir).withColumn("response", F.col("doc_id").cast("string"))
    curve, _ = flows.compare_models(rated, MODEL_A, MODEL_B)
    return curve.select("n", *[r6(f"mean_{s}").alias(f"mean_{s}") for s in "ab"], "prompts")


def model_correlation(spark, sf_dir):
    scored = flows.score_both(_rated_samples(spark, sf_dir), MODEL_A, MODEL_B)
    return stats.score_correlation(scored, "score_a", "score_b").select(r6("r").alias("r"), "n")


def annotate_pairs(spark, sf_dir):
    """Annotation through the plug-in interface, back to one row per pair."""
    annotated = flows.annotate_pairs(inputs.pairs(spark, sf_dir), rater=_count_words)
    total = sum((F.col(f"`{f}_chosen`") - F.col(f"`{f}_rejected`") for f in RUBRIC_FEATURES[1:]), F.col("helpfulness_chosen") - F.col("helpfulness_rejected"))
    return annotated.select("pair_id", "helpfulness_chosen", "helpfulness_rejected", total.alias("lead"))


QUERIES: dict[str, Query] = {
    "pairwise_fit_diff": pairwise_fit_diff,
    "pairwise_fit_concat": pairwise_fit_concat,
    "grid_search_cv": grid_search_cv,
    "save_model": save_model,
    "text_pair_ranker": text_ranker,
    "text_ranker_slope": text_ranker_slope,
    "rating_regression": rating_regression,
    "experiment_grid": experiment_grid,
    "experiment_grid_shared": experiment_grid_shared,
    "fit_pairs": fit_pairs,
    "annotate_pairs": annotate_pairs,
    "compare_models": compare_models,
    "model_correlation": model_correlation,
}


def _normalized(model) -> str:
    return f"(({reward_sql(model)}) - {model.reward_mean}::double) / {model.reward_std}::double"


def _settled_sql(model: str, extra: str = "") -> str:
    names = ", ".join(f"'{f}'" for f in FEATURES)
    return f"SELECT '{model}' AS model, unnest([{names}]) AS feature, TRUE AS settled, (SELECT count(*) FROM pairs WHERE split = 'train') AS n{extra}"


ORACLES: dict[str, str] = {
    "pairwise_fit_diff": sql(PAIRS, body=f"{_settled_sql('l2')} UNION ALL {_settled_sql('l1')}"),
    "pairwise_fit_concat": sql(
        PAIRS, body="SELECT cast(unnest(range(28)) AS integer) AS feature_pos, TRUE AS settled, (SELECT count(*) FROM pairs WHERE split = 'train') AS n"
    ),
    "grid_search_cv": sql(PAIRS, body=_settled_sql("search", ", 24 AS settings, TRUE AS winner_checked")),
    "experiment_grid_shared": sql(
        PAIRS,
        "r AS (SELECT count(*) AS rows FROM pairs WHERE split = 'train')",
        "subsets AS (SELECT rows // 4 AS subset, rows FROM r UNION ALL SELECT rows // 2, rows FROM r UNION ALL SELECT NULL, rows FROM r)",
        body="SELECT prefix, short, scorer, subset, CASE WHEN short THEN 3 ELSE 14 END AS features, TRUE AS settled, TRUE AS winner_checked, "
        "coalesce(subset, rows) AS n, 24 AS settings FROM subsets, (SELECT unnest(['', 'zeroshot_']) AS prefix), "
        "(SELECT unnest([TRUE, FALSE]) AS short), (SELECT unnest([NULL, 'teacher']) AS scorer)",
    ),
    "fit_pairs": sql(PAIRS, body=_settled_sql("student", ", 24 AS settings")),
    "experiment_grid": sql(
        PAIRS,
        "r AS (SELECT count(*) AS n FROM pairs WHERE split = 'train')",
        body="SELECT short, n AS subset, CASE WHEN short THEN 3 ELSE 14 END AS features, TRUE AS settled, n, 24 AS settings "
        "FROM (SELECT unnest([TRUE, FALSE]) AS short), (SELECT n FROM r UNION ALL SELECT n // 2 FROM r)",
    ),
    "text_ranker_slope": sql(PAIRS, body="SELECT 'ranker' AS model, TRUE AS settled, count(*) AS n FROM pairs WHERE split = 'train'"),
    "rating_regression": f"SELECT unnest([{', '.join(repr(f) for f in RUBRIC_FEATURES)}]) AS target, TRUE AS settled, (SELECT count(text) FROM documents) AS n",
    "annotate_pairs": f"""WITH a AS ({word_rating_sql("response")}),
c AS (SELECT * FROM a WHERE side = 'chosen'), r AS (SELECT * FROM a WHERE side = 'rejected')
SELECT pair_id, max(CASE WHEN feature = 'helpfulness' THEN c.rating END) AS helpfulness_chosen,
max(CASE WHEN feature = 'helpfulness' THEN r.rating END) AS helpfulness_rejected, cast(sum(c.rating - r.rating) AS bigint) AS lead
FROM c JOIN r USING (pair_id, feature) GROUP BY pair_id""",
    "save_model": sql(RATED_SAMPLES, body=f"SELECT prompt, sample_idx, {q6(_normalized(MODEL_A))} AS reward FROM rated_samples"),
    "compare_models": sql(
        RATED_SAMPLES,
        f"s AS (SELECT prompt, sample_idx, {_normalized(MODEL_A)} AS a, {_normalized(MODEL_B)} AS b FROM rated_samples)",
        "b AS (SELECT n, prompt, a, b FROM s CROSS JOIN (SELECT unnest([1, 2, 4, 8, 16]) AS n) WHERE sample_idx <= n "
        "QUALIFY row_number() OVER (PARTITION BY prompt, n ORDER BY round(a, 9) DESC, sample_idx) = 1)",
        body=f"SELECT n, {q6('avg(a)')} AS mean_a, {q6('avg(b)')} AS mean_b, count(*) AS prompts FROM b GROUP BY n",
    ),
    "model_correlation": sql(
        RATED_SAMPLES,
        f"s AS (SELECT {_normalized(MODEL_A)} AS a, {_normalized(MODEL_B)} AS b FROM rated_samples)",
        body=f"SELECT {q6('corr(a, b)')} AS r, count(*) AS n FROM s",
    ),
}
