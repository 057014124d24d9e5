"""Registered queries: reshaping, sides and labels, joins, and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prefspark.functions.features import add_features, register_feature, registered_features
from prefspark.functions.text import token_count
from prefspark.operators import joins, labels, models, reshape, stats
from prefspark.operators.rating import rate_pairs_wide
from prefspark.plans import inputs
from prefspark.plans.registered.common import (
    FEATURES,
    MODEL_A,
    MODEL_B,
    PAIRS,
    SAMPLES,
    SAMPLES_NUM,
    SIDED,
    SIDE_SEED,
    Query,
    given_model,
    pair_scores_sql,
    q6,
    r6,
    ratings_sql,
    reward_sql,
    sided_pairs,
    sql,
)
from prefspark.session import settle

FEW = ("helpfulness", "repetetive", "length")


# --- reshaping ---------------------------------------------------------------------------------------------


def explode_samples(spark, sf_dir):
    nested = inputs.documents(spark, sf_dir, "doc_id", "text").select(
        "doc_id", F.split("text", "\n", -1).alias("response")
    )
    nested = nested.withColumn("chars", F.transform("response", F.length))
    flat = reshape.explode_samples(nested, ["response", "chars"])
    return flat.select("doc_id", "sample_idx", F.md5("response").alias("response_md5"), "chars")


def collect_samples(spark, sf_dir):
    nested = reshape.collect_samples(inputs.samples(spark, sf_dir), ["prompt"], "sample_idx", ["response", "doc_id"])
    return nested.select(
        "prompt", "page", "n", F.md5(F.array_join("response", "|")).alias("response_md5"),
        F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("doc_ids"),
    )


def flatten_batches(spark, sf_dir):
    batches = reshape.collect_samples(inputs.samples(spark, sf_dir), ["prompt"], "sample_idx", ["doc_id"], 64)
    nested = reshape.collect_samples(
        batches.withColumn("position", F.col("page") + 1).drop("page", "n"), ["prompt"], "position", ["doc_id"], 16
    )
    flat = reshape.flatten_batches(nested, "doc_id")
    return flat.select("prompt", "page", F.size("doc_id").alias("n"), F.array_join(F.col("doc_id").cast("array<string>"), ",").alias("doc_ids"))


def pairs_to_long(spark, sf_dir):
    pairs = inputs.pairs(spark, sf_dir).select("pair_id", "chosen", "rejected")
    long = reshape.pairs_to_long(pairs, ("chosen", "rejected"), [], bare=["response"])
    return long.select("pair_id", "side", F.md5("response").alias("response_md5"))


def long_to_pairs(spark, sf_dir):
    wide = sided_pairs(spark, sf_dir).select("pair_id", "labels", "length_a", "length_b", "intent_a", "intent_b")
    long = reshape.pairs_to_long(wide, ("a", "b"), ["length", "intent"])
    return reshape.long_to_pairs(long, ["pair_id", "labels"], ("a", "b"), ["length", "intent"])


def index_samples(spark, sf_dir):
    index = reshape.index_samples(inputs.samples(spark, sf_dir), ["prompt", "response"], "doc_id")
    return index.select("prompt", F.md5("response").alias("response_md5"), "row_index")


def feature_callbacks(spark, sf_dir):
    register_feature("token_length", token_count)
    features = {name: fn for name, fn in registered_features().items() if name in ("length", "token_length")}
    samples = inputs.samples(spark, sf_dir)
    added = add_features(samples, {"": "response"}, "prompt", features)
    return added.select("prompt", "sample_idx", r6("length").alias("length"), "token_length")


# --- sides and labels --------------------------------------------------------------------------------------


def randomize_sides(spark, sf_dir):
    pairs = inputs.pairs(spark, sf_dir).select(
        "pair_id", "chosen", "rejected", F.length("chosen").alias("chars_chosen"), F.length("rejected").alias("chars_rejected")
    )
    sided = labels.randomize_sides(pairs, "pair_id", SIDE_SEED, ["chars"])
    return sided.select(
        "pair_id", "labels", F.md5("response_a").alias("a_md5"), F.md5("response_b").alias("b_md5"), "chars_a", "chars_b"
    )


def orient_by_label(spark, sf_dir):
    """The test split counts as unlabelled here, so its rows are quarantined."""
    sided = sided_pairs(spark, sf_dir).select(
        "pair_id", F.when(F.col("split") == "train", F.col("labels")).alias("labels"), "length_a", "length_b"
    )
    good, held = labels.orient_by_label(sided, "labels", ["length"], response=None)
    none = F.lit(None).cast("double")
    return good.withColumn("held", F.lit(False)).unionByName(
        held.select("pair_id", "labels", none.alias("length_chosen"), none.alias("length_rejected"), F.lit(True).alias("held"))
    )


def option_of_label(spark, sf_dir):
    sided = sided_pairs(spark, sf_dir)
    return sided.select(
        "pair_id", labels.option_of_label("labels").alias("option"), labels.preference_option("labels").alias("preference")
    )


def _pair_model_scores(spark, sf_dir, model=MODEL_A):
    return models.pair_scores(sided_pairs(spark, sf_dir), model)


def pseudo_label_swap(spark, sf_dir):
    pairs = inputs.pairs(spark, sf_dir).select("pair_id", "chosen", "rejected")
    scores = _pair_model_scores(spark, sf_dir).where(F.col("split") == "train")
    good, held = labels.pseudo_label_swap(pairs, scores, "pair_id", [])
    kept = good.unionByName(held.withColumn("model_predict", F.lit("none")))
    return kept.select("pair_id", "model_predict", F.md5("chosen").alias("chosen_md5"), F.md5("rejected").alias("rejected_md5"))


def pseudo_label_swap_sides(spark, sf_dir):
    sided = sided_pairs(spark, sf_dir)
    scores = models.pair_scores(sided, MODEL_A)
    narrow = sided.select("pair_id", "labels", "length_a", "length_b")
    good, _ = labels.pseudo_label_swap(narrow, scores, "pair_id", ["length"], "labels", ("a", "b"), bare=False)
    return good


def adopt_pseudo_labels(spark, sf_dir):
    sided = models.pair_scores(sided_pairs(spark, sf_dir), MODEL_A, keep=("pair_id", "labels"))
    labelled = sided.select("pair_id", "labels", F.when(F.col("score_a") > F.col("score_b"), 1).otherwise(0).alias("pseudo_labels"), "score_a", "score_b")
    adopted = labels.adopt_pseudo_labels(labelled)
    oriented, _ = labels.orient_by_label(adopted, "labels", ["score"], response=None)
    return oriented.select("pair_id", "labels", r6("score_chosen").alias("score_chosen"), r6("score_rejected").alias("score_rejected"))


def label_agreement(spark, sf_dir):
    sided = models.pair_scores(sided_pairs(spark, sf_dir), MODEL_A, keep=("pair_id", "labels"))
    pseudo = sided.withColumn("pseudo_labels", F.when(F.col("score_a") > F.col("score_b"), 1).otherwise(0))
    return labels.label_agreement(pseudo, "labels", "pseudo_labels").select(r6("agreement").alias("agreement"), "n")


def _two_models(spark, sf_dir):
    sided = sided_pairs(spark, sf_dir)
    return reshape.concat_datasets([models.pair_scores(sided, m) for m in (MODEL_A, MODEL_B)])


def debias_scores(spark, sf_dir):
    shifted, _ = labels.debias_scores(_two_models(spark, sf_dir))
    return shifted.select("model", "split", "pair_id", r6("score_chosen").alias("score_chosen"), r6("score_rejected").alias("score_rejected"))


def debias_statistics(spark, sf_dir):
    _, summary = labels.debias_scores(_two_models(spark, sf_dir))
    return summary.select("model", "split", *[r6(c).alias(c) for c in ("mean", "std", "accuracy")])


def cross_fit_attach(spark, sf_dir):
    sided = sided_pairs(spark, sf_dir)
    scores = {m.name: models.pair_scores(sided, m) for m in (MODEL_A, MODEL_B)}
    attached = labels.cross_fit_attach(inputs.pair_keys(spark, sf_dir).select("pair_id", "split"), scores, "pair_id")
    sides = [f"{m}_{side}" for m in scores for side in ("chosen", "rejected")]
    return attached.select("pair_id", "split", *[r6(c).alias(c) for c in sides])


# --- joins -------------------------------------------------------------------------------------------------


def _score_table(spark, sf_dir):
    """Scores for all texts; repeated texts have several."""
    documents = inputs.documents(spark, sf_dir, "doc_id", "source", "text", "n_chars")
    return documents.select(
        F.col("source").alias("prompt"), F.col("text").alias("response"), (F.col("n_chars") / 10).alias("score"), "doc_id"
    )


def _edited_samples(spark, sf_dir):
    """Samples of which every fourth was edited since the scores were taken."""
    edited = F.when(F.col("doc_id") % 4 == 0, F.concat("response", F.lit(" (edited)"))).otherwise(F.col("response"))
    return inputs.samples(spark, sf_dir).withColumn("response", edited)


def attach_scores_inner(spark, sf_dir):
    scored = joins.attach_scores_inner(_edited_samples(spark, sf_dir), _score_table(spark, sf_dir).drop("doc_id"))
    return scored.select("prompt", "sample_idx", "score")


def attach_features_left(spark, sf_dir):
    joined = joins.attach_features_left(
        _edited_samples(spark, sf_dir), _score_table(spark, sf_dir), keep_first_by=["doc_id"], prefix="first_"
    )
    return joined.select("prompt", "sample_idx", "doc_id", "first_doc_id", "score")


def attach_by_key(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    return joins.attach_by_key(
        events.select("event_id", "event_type"), events.select("event_id", (F.col("value") * 2).alias("doubled")), ["event_id"]
    )


def concat_datasets(spark, sf_dir):
    pairs = inputs.pairs(spark, sf_dir).select("pair_id", "split", F.length("chosen").alias("chars"))
    train, test = (pairs.where(F.col("split") == s) for s in ("train", "test"))
    return reshape.concat_datasets([train, test.select("chars", "split", "pair_id")])


def add_original_fields(spark, sf_dir):
    nested = inputs.pairs(spark, sf_dir).select(
        "pair_id", F.col("context").alias("prompt"), F.array("chosen", "rejected").alias("response")
    )
    records = nested.select("pair_id", F.length(nested.response[0]).alias("assistant1"), F.length(nested.response[1]).alias("assistant2"))
    filled = joins.add_original_fields(records, nested, ["pair_id"], (1, 0))
    return filled.select(
        "pair_id", "assistant1", "assistant2", "original_prompt",
        F.md5("original_response1").alias("first_md5"), F.md5("original_response2").alias("second_md5"),
    )


# --- statistics --------------------------------------------------------------------------------------------


def pooled_standardize(spark, sf_dir):
    scaled = stats.pooled_standardize(sided_pairs(spark, sf_dir), FEW)
    return scaled.select("pair_id", *[r6(f"`{f}_{s}`").alias(f"{f}_{s}") for f in FEW for s in "ab"])


def side_standardize(spark, sf_dir):
    columns = [f"{f}_{s}" for f in FEW for s in "ab"]
    scaled = stats.side_standardize(sided_pairs(spark, sf_dir), columns)
    return scaled.select("pair_id", *[r6(f"`{c}`").alias(c) for c in columns])


def _rated_samples(spark, sf_dir):
    """Samples with ratings and length, rated where their text is read; only the numbers are then numbered and stored."""
    documents = inputs.documents(spark, sf_dir, "doc_id", "source", "text").withColumnsRenamed(
        {"source": "prompt", "text": "response"}
    )
    rated = rate_pairs_wide(documents, "prompt", ["response"])
    renamed = rated.withColumnsRenamed({f"{f}_response": f for f in FEATURES})
    measured = add_features(renamed, {"": "response"}, "prompt", {"length": registered_features()["length"]})
    return settle(inputs.numbered_documents(measured.drop("response")), "rated_samples")


def linear_reward(spark, sf_dir):
    scored = models.score_samples(_rated_samples(spark, sf_dir), MODEL_A, "reward")
    return scored.select("prompt", "sample_idx", r6("reward").alias("reward"))


def normalize_reward(spark, sf_dir):
    scored = models.score_samples(_rated_samples(spark, sf_dir), MODEL_A, "reward")
    both = stats.normalize_reward(scored.withColumn("reward_data", F.col("reward")), "reward", MODEL_A)
    both = stats.normalize_reward(both, "reward_data")
    return both.select("prompt", "sample_idx", r6("reward").alias("reward"), r6("reward_data").alias("reward_data"))


def normalize_external(spark, sf_dir):
    scored = stats.normalize_external(inputs.samples_num(spark, sf_dir), "score_b")
    return scored.select("event_id", r6("score_b").alias("score_b"))


def pair_scores(spark, sf_dir):
    scores = _pair_model_scores(spark, sf_dir)
    return scores.select("model", "pair_id", "split", *[r6(c).alias(c) for c in ("score_chosen", "score_rejected", "score_a", "score_b")])


#: As many models as a search has settings, given by rule.
GIVEN_MODELS = tuple(given_model(f"given_{i:02d}", -1.0 + i / 12) for i in range(24))


def score_models(spark, sf_dir):
    """24 models from their table, scored in one plan and ranked by accuracy."""
    terms, _ = models.model_tables(spark, GIVEN_MODELS)
    scored = models.score_models(sided_pairs(spark, sf_dir), terms)
    accuracy = stats.pairwise_accuracy(scored)
    best_first = Window.partitionBy("split").orderBy(F.desc(F.round("accuracy", 6)), "model")
    return accuracy.select("model", "split", r6("accuracy").alias("accuracy"), "n", F.row_number().over(best_first).alias("place"))


def pairwise_accuracy(spark, sf_dir):
    return stats.pairwise_accuracy(_two_models(spark, sf_dir)).select("model", "split", r6("accuracy").alias("accuracy"), "n")


def reward_stats(spark, sf_dir):
    summary = stats.reward_stats(_pair_model_scores(spark, sf_dir), "train")
    return summary.select(r6("reward_mean").alias("reward_mean"), r6("reward_std").alias("reward_std"), "n")


def pair_losses(spark, sf_dir):
    scores = _pair_model_scores(spark, sf_dir)
    losses = stats.pair_losses(scores, targets=[("score_chosen", "score_a"), ("score_rejected", "score_b")])
    return losses.select(r6("ranking_loss").alias("ranking_loss"), r6("squared_loss").alias("squared_loss"), "n")


def score_correlation(spark, sf_dir):
    table = stats.score_correlation(inputs.samples_num(spark, sf_dir), "score_a", "score_b")
    return table.select(r6("r").alias("r"), "n", r6("t").alias("t"), r6("p").alias("p"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        explode_samples, collect_samples, flatten_batches, pairs_to_long, long_to_pairs, index_samples, feature_callbacks,
        randomize_sides, orient_by_label, option_of_label, pseudo_label_swap, pseudo_label_swap_sides, adopt_pseudo_labels,
        label_agreement, debias_scores, debias_statistics, cross_fit_attach, attach_scores_inner, attach_features_left,
        attach_by_key, concat_datasets, add_original_fields, pooled_standardize, side_standardize, linear_reward,
        normalize_reward, normalize_external, pair_scores, score_models, pairwise_accuracy, reward_stats, pair_losses, score_correlation,
    )
}

_HEADS = f"substr(md5(concat('{SIDE_SEED}:', cast(pair_id AS string))), 1, 1) < '8'"
_SCORES_A = [SIDED, pair_scores_sql(MODEL_A)]
_TWO = [
    SIDED, pair_scores_sql(MODEL_A), pair_scores_sql(MODEL_B),
    "scores AS (SELECT * FROM model_a_scores UNION ALL SELECT * FROM model_b_scores)",
    "both_sides AS (SELECT model, split, score_chosen AS s FROM scores UNION ALL SELECT model, split, score_rejected FROM scores)",
]
RATED_SAMPLES = f"{SAMPLES},\n" + ratings_sql("rated_samples", "samples", "response", "prompt", "prompt, sample_idx")


def _pooled_sql(feature: str, side: str) -> str:
    pool = f'(SELECT avg(x) AS m, stddev_pop(x) AS s FROM (SELECT "{feature}_a"::double AS x FROM sided UNION ALL SELECT "{feature}_b" FROM sided))'
    return f'(SELECT {q6(f"""("{feature}_{side}" - m) / (s + 1e-7)""")} FROM {pool}) AS "{feature}_{side}"'


def _side_sql(column: str) -> str:
    spread = f'stddev_pop("{column}"::double) OVER ()'
    return f"""{q6(f'("{column}" - avg("{column}") OVER ()) / CASE WHEN {spread} = 0 THEN 1 ELSE {spread} END')} AS "{column}" """


_EDITED = """edited AS (SELECT prompt, sample_idx, doc_id, CASE WHEN doc_id % 4 = 0 THEN response || ' (edited)' ELSE response END AS response FROM samples)"""

# Student's density is integrated by Simpson's rule; the p-value is what lies outside of ±t.
_P_VALUE = """2 * (0.5 - (SELECT sum(h / 3 * CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
* exp(lgamma((n - 1) / 2.0) - lgamma((n - 2) / 2.0)) / sqrt((n - 2) * pi()) * pow(1 + i * h * i * h / (n - 2), -(n - 1) / 2.0))
FROM (SELECT unnest(range(4001)) AS i, abs(t) / 4000 AS h)))"""

_SOFTPLUS = "greatest(score_rejected - score_chosen, 0) + ln(1 + exp(-abs(score_rejected - score_chosen)))"

ORACLES: dict[str, str] = {
    "explode_samples": """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, unnest(generate_series(1, len(parts))) AS sample_idx, parts FROM d)
SELECT doc_id, sample_idx, md5(parts[sample_idx]) AS response_md5, cast(length(parts[sample_idx]) AS integer) AS chars FROM u""",
    "collect_samples": sql(
        SAMPLES,
        body="SELECT prompt, (sample_idx - 1) // 256 AS page, cast(count(*) AS integer) AS n, md5(string_agg(response, '|' ORDER BY sample_idx)) AS response_md5, "
        "string_agg(cast(doc_id AS string), ',' ORDER BY sample_idx) AS doc_ids FROM samples GROUP BY 1, 2",
    ),
    "flatten_batches": sql(
        SAMPLES,
        body="SELECT prompt, (sample_idx - 1) // 1024 AS page, cast(count(*) AS integer) AS n, "
        "string_agg(cast(doc_id AS string), ',' ORDER BY sample_idx) AS doc_ids FROM samples GROUP BY 1, 2",
    ),
    "pairs_to_long": sql(
        PAIRS,
        body="SELECT pair_id, 'chosen' AS side, md5(chosen) AS response_md5 FROM pairs UNION ALL SELECT pair_id, 'rejected', md5(rejected) FROM pairs",
    ),
    "long_to_pairs": sql(SIDED, body="SELECT pair_id, labels, length_a, length_b, intent_a, intent_b FROM sided"),
    "index_samples": sql(
        SAMPLES, body="SELECT prompt, md5(response) AS response_md5, max(doc_id) AS row_index FROM samples GROUP BY prompt, response"
    ),
    "feature_callbacks": sql(
        SAMPLES,
        body=r"SELECT prompt, sample_idx, round(length(response) / 100.0, 6) AS length, len(regexp_extract_all(response, '\S+'))::double AS token_length FROM samples",
    ),
    "randomize_sides": sql(
        PAIRS,
        body=f"""SELECT pair_id, CASE WHEN {_HEADS} THEN 1 ELSE 0 END AS labels, md5(CASE WHEN {_HEADS} THEN chosen ELSE rejected END) AS a_md5,
md5(CASE WHEN {_HEADS} THEN rejected ELSE chosen END) AS b_md5, cast(length(CASE WHEN {_HEADS} THEN chosen ELSE rejected END) AS integer) AS chars_a,
cast(length(CASE WHEN {_HEADS} THEN rejected ELSE chosen END) AS integer) AS chars_b FROM pairs""",
    ),
    "orient_by_label": sql(
        SIDED,
        body="""SELECT pair_id, labels, CASE WHEN labels = 1 THEN length_a ELSE length_b END AS length_chosen,
CASE WHEN labels = 1 THEN length_b ELSE length_a END AS length_rejected, false AS held FROM sided WHERE split = 'train'
UNION ALL SELECT pair_id, NULL, NULL, NULL, true FROM sided WHERE split = 'test'""",
    ),
    "option_of_label": sql(
        SIDED,
        body="SELECT pair_id, CASE labels WHEN 1 THEN 'A' WHEN 0 THEN 'B' END AS option, CASE WHEN labels = 1 THEN 'A' ELSE 'B' END AS preference FROM sided",
    ),
    "pseudo_label_swap": sql(
        *_SCORES_A,
        "s AS (SELECT * FROM model_a_scores WHERE split = 'train')",
        "m AS (SELECT p.pair_id, chosen, rejected, CASE WHEN s.pair_id IS NULL THEN 'none' WHEN score_chosen > score_rejected THEN 'correct' ELSE 'wrong' END AS model_predict "
        "FROM pairs p LEFT JOIN s ON p.pair_id = s.pair_id)",
        body="SELECT pair_id, model_predict, md5(CASE WHEN model_predict = 'wrong' THEN rejected ELSE chosen END) AS chosen_md5, "
        "md5(CASE WHEN model_predict = 'wrong' THEN chosen ELSE rejected END) AS rejected_md5 FROM m",
    ),
    "pseudo_label_swap_sides": sql(
        *_SCORES_A,
        "m AS (SELECT d.pair_id, labels, length_a, length_b, CASE WHEN (labels = 1 AND score_a > score_b) OR (labels = 0 AND score_a < score_b) THEN 'correct' ELSE 'wrong' END AS model_predict "
        "FROM sided d JOIN model_a_scores s ON d.pair_id = s.pair_id)",
        body="SELECT pair_id, labels, CASE WHEN model_predict = 'wrong' THEN length_b ELSE length_a END AS length_a, "
        "CASE WHEN model_predict = 'wrong' THEN length_a ELSE length_b END AS length_b, model_predict FROM m",
    ),
    "adopt_pseudo_labels": sql(
        *_SCORES_A,
        body=f"SELECT pair_id, CASE WHEN score_a > score_b THEN 1 ELSE 0 END AS labels, {q6('greatest(score_a, score_b)')} AS score_chosen, "
        f"{q6('least(score_a, score_b)')} AS score_rejected FROM model_a_scores",
    ),
    "label_agreement": sql(
        *_SCORES_A,
        body=f"SELECT {q6('avg(CASE WHEN labels = CASE WHEN score_a > score_b THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END)')} AS agreement, count(*) AS n FROM model_a_ab",
    ),
    "debias_scores": sql(
        *_TWO,
        "bias AS (SELECT model, avg(s) AS b FROM both_sides WHERE split = 'train' GROUP BY model)",
        body=f"SELECT model, split, pair_id, {q6('score_chosen - b')} AS score_chosen, {q6('score_rejected - b')} AS score_rejected FROM scores JOIN bias USING (model)",
    ),
    "debias_statistics": sql(
        *_TWO,
        "acc AS (SELECT model, split, avg(CASE WHEN score_chosen > score_rejected THEN 1.0 ELSE 0.0 END) AS accuracy FROM scores GROUP BY 1, 2)",
        "mom AS (SELECT model, split, avg(s) AS mean, stddev_pop(s) AS std FROM both_sides GROUP BY 1, 2)",
        body=f"SELECT model, split, {q6('mean')} AS mean, {q6('std')} AS std, {q6('accuracy')} AS accuracy FROM mom JOIN acc USING (model, split)",
    ),
    "cross_fit_attach": sql(
        SIDED, pair_scores_sql(MODEL_A), pair_scores_sql(MODEL_B),
        body="SELECT p.pair_id, p.split, "
        + ", ".join(
            f"{q6(f'{t}.score_{side}')} AS model_{t}_{side}" for t in "ab" for side in ("chosen", "rejected")
        )
        + " FROM pairs p JOIN model_a_scores a ON p.pair_id = a.pair_id JOIN model_b_scores b ON p.pair_id = b.pair_id",
    ),
    "attach_scores_inner": sql(
        SAMPLES, _EDITED,
        "sc AS (SELECT DISTINCT source AS prompt, text AS response, n_chars / 10 AS score FROM documents)",
        body="SELECT s.prompt, sample_idx, score FROM edited s JOIN sc ON s.prompt = sc.prompt AND s.response = sc.response",
    ),
    "attach_features_left": sql(
        SAMPLES, _EDITED,
        "f AS (SELECT source AS prompt, text AS response, doc_id, n_chars / 10 AS score FROM documents "
        "QUALIFY row_number() OVER (PARTITION BY source, text ORDER BY doc_id) = 1)",
        body="SELECT s.prompt, s.sample_idx, s.doc_id, f.doc_id AS first_doc_id, f.score "
        "FROM edited s LEFT JOIN f ON s.prompt = f.prompt AND s.response = f.response",
    ),
    "attach_by_key": "SELECT event_id, event_type, value * 2 AS doubled FROM events",
    "concat_datasets": sql(PAIRS, body="SELECT pair_id, split, cast(length(chosen) AS integer) AS chars FROM pairs"),
    "add_original_fields": sql(
        PAIRS,
        body="SELECT pair_id, cast(length(chosen) AS integer) AS assistant1, cast(length(rejected) AS integer) AS assistant2, context AS original_prompt, "
        "md5(rejected) AS first_md5, md5(chosen) AS second_md5 FROM pairs",
    ),
    "pooled_standardize": sql(SIDED, body="SELECT pair_id, " + ", ".join(_pooled_sql(f, s) for f in FEW for s in "ab") + " FROM sided"),
    "side_standardize": sql(SIDED, body="SELECT pair_id, " + ", ".join(_side_sql(f"{f}_{s}") for f in FEW for s in "ab") + " FROM sided"),
    "linear_reward": sql(
        RATED_SAMPLES, body=f"SELECT prompt, sample_idx, {q6(reward_sql(MODEL_A))} AS reward FROM rated_samples"
    ),
    "normalize_reward": sql(
        RATED_SAMPLES,
        f"r AS (SELECT prompt, sample_idx, {reward_sql(MODEL_A)} AS reward FROM rated_samples)",
        body=f"SELECT prompt, sample_idx, {q6('(reward - 0.25::double) / 1.5::double')} AS reward, {q6('(reward - avg(reward) OVER ()) / stddev_samp(reward) OVER ()')} AS reward_data FROM r",
    ),
    "normalize_external": sql(
        SAMPLES_NUM, body=f"SELECT event_id, {q6('(score_b - avg(score_b) OVER ()) / stddev_pop(score_b) OVER ()')} AS score_b FROM samples_num"
    ),
    "pair_scores": sql(
        *_SCORES_A,
        body="SELECT model, pair_id, split, " + ", ".join(f"{q6(c)} AS {c}" for c in ("score_chosen", "score_rejected", "score_a", "score_b")) + " FROM model_a_scores",
    ),
    "score_models": sql(
        SIDED,
        *[pair_scores_sql(m) for m in GIVEN_MODELS],
        "every AS (" + " UNION ALL ".join(f"SELECT model, split, score_chosen, score_rejected FROM {m.name}_scores" for m in GIVEN_MODELS) + ")",
        "rated_models AS (SELECT model, split, avg(CASE WHEN score_chosen > score_rejected THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM every GROUP BY 1, 2)",
        body=f"SELECT model, split, {q6('accuracy')} AS accuracy, n, "
        "row_number() OVER (PARTITION BY split ORDER BY round(accuracy, 6) DESC, model)::integer AS place FROM rated_models",
    ),
    "pairwise_accuracy": sql(
        *_TWO,
        body=f"SELECT model, split, {q6('avg(CASE WHEN score_chosen > score_rejected THEN 1.0 ELSE 0.0 END)')} AS accuracy, count(*) AS n FROM scores GROUP BY 1, 2",
    ),
    "reward_stats": sql(
        *_TWO,
        body=f"SELECT {q6('avg(s)')} AS reward_mean, {q6('stddev_pop(s)')} AS reward_std, count(*) AS n FROM both_sides WHERE model = 'model_a' AND split = 'train'",
    ),
    "pair_losses": sql(
        *_SCORES_A,
        body=f"SELECT {q6(f'avg({_SOFTPLUS})')} AS ranking_loss, {q6('avg(pow(score_chosen - score_a, 2)) + avg(pow(score_rejected - score_b, 2))')} AS squared_loss, count(*) AS n FROM model_a_scores",
    ),
    "score_correlation": sql(
        SAMPLES_NUM,
        "c AS (SELECT corr(score_a, score_b) AS r, count(*) AS n FROM samples_num)",
        "s AS (SELECT r, n, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c)",
        body=f"SELECT {q6('r')} AS r, n, {q6('t')} AS t, {q6(_P_VALUE)} AS p FROM s",
    ),
}
