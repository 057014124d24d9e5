"""Registered queries: sequence log-probabilities and the energy model over pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions.text import token_count
from prefspark.operators import ebm
from prefspark.operators.labels import preference_option, randomize_sides
from prefspark.operators.reshape import collect_samples
from prefspark.operators.stats import pooled_standardize
from prefspark.plans import inputs
from prefspark.plans.registered.common import PAIRS, SIDE_SEED, TOKENS, Query, q6, r6, sql
from prefspark.session import settle

COEFFICIENTS = (0.15, -0.05)
END, PAD = "purchase", "error"
PAGE_TOKENS = 7


def sequence_log_prob(spark, sf_dir):
    scored = ebm.sequence_log_prob(inputs.tokens(spark, sf_dir), eos=END, pad=PAD)
    return scored.select("sample_id", r6("log_prob").alias("log_prob"), "first_end")


def sequence_log_prob_arrays(spark, sf_dir):
    """Sequences in pages of seven tokens, so that most have several; pages know where they start and are merged."""
    pages = collect_samples(
        inputs.tokens(spark, sf_dir).withColumn("position", F.col("pos") + 1), ["sample_id"], "position", ["token", "logprob"], PAGE_TOKENS
    )
    scored = ebm.sequence_log_prob_arrays(pages, "token", "logprob", END, PAD, start=F.col("page") * PAGE_TOKENS)
    return ebm.merge_pages(scored, ["sample_id"], "page").select("sample_id", r6("log_prob").alias("log_prob"), "first_end")


def _options(spark, sf_dir):
    """Pairs with two features and a log score per side, stored because the fits read them repeatedly."""
    pairs = inputs.pairs(spark, sf_dir)
    measured = pairs.select(
        "pair_id",
        *[
            column
            for side in ("chosen", "rejected")
            for column in (
                F.array(F.length(side) / 100.0, token_count(side) / 10.0).alias(f"features_{side}"),
                (-F.length(side) / 200.0).alias(f"log_score_{side}"),
            )
        ],
    )
    sided = randomize_sides(measured, "pair_id", SIDE_SEED, ["features", "log_score"], response=None)
    return settle(sided.withColumn("preferred", preference_option("labels")), "options")


def ebm_scores(spark, sf_dir):
    scored = ebm.ebm_scores(_options(spark, sf_dir), COEFFICIENTS)
    names = ("ebm_log_a", "ebm_log_b", "ebm_share_a", "ebm_share_b")
    return scored.select("pair_id", *[r6(n).alias(n) for n in names])


def ebm_moments(spark, sf_dir):
    return ebm.ebm_moments(_options(spark, sf_dir), COEFFICIENTS).select("feature_pos", r6("moment").alias("moment"))


def target_moments(spark, sf_dir):
    return ebm.target_moments(_options(spark, sf_dir), 2).select("feature_pos", r6("target").alias("target"))


def log_likelihood(spark, sf_dir):
    return ebm.log_likelihood(_options(spark, sf_dir), COEFFICIENTS).select(r6("log_likelihood").alias("log_likelihood"), "n")


def option_accuracy(spark, sf_dir):
    return ebm.option_accuracy(_options(spark, sf_dir), COEFFICIENTS).select(r6("accuracy").alias("accuracy"), "n")


def moment_matching_fit(spark, sf_dir):
    """The likelihood's maximum: coefficients, and whether the moments match there."""
    options = _options(spark, sf_dir)
    weights = ebm.conditional_fit(options, 2)
    gaps = ebm.moment_gap(options, weights)
    return spark.createDataFrame(
        [(i, round(float(w), 4), abs(g) < ebm.TOLERANCE) for i, (w, g) in enumerate(zip(weights, gaps))],
        "feature_pos int, coefficient double, matched boolean",
    )


def moment_matching_ascent(spark, sf_dir):
    """The ascent at its own rate and tolerance: coefficients, steps, and whether the moments match at the end.

    It starts from the conditional fit's weights rounded to one digit, which leaves it 50 to 110 of several hundred steps.
    Features are the length and the characters a word, standardized; log scores are a hundredth of those of the other queries, so
    that no share is so close to 0 or 1 that a small rate stands still.
    """
    options = _options(spark, sf_dir)
    columns = {}
    for side in ("a", "b"):
        length, words = (F.get(f"features_{side}", F.lit(i)) for i in range(2))
        columns |= {f"x0_{side}": length, f"x1_{side}": length * 10.0 / F.greatest(words, F.lit(0.1))}
    scaled = pooled_standardize(options.withColumns(columns), ["x0", "x1"], eps=0.0)
    arrays = {f"features_{side}": F.array(f"x0_{side}", f"x1_{side}") for side in ("a", "b")}
    scores = {f"log_score_{side}": F.col(f"log_score_{side}") / 100.0 for side in ("a", "b")}
    stored = settle(scaled.withColumns({**arrays, **scores}).select(*arrays, *scores, "preferred"), "scaled_options")
    start = [round(w, 1) for w in ebm.conditional_fit(stored, 2)]
    weights, steps, gap = ebm.moment_matching_fit(stored, 2, start=start)
    return spark.createDataFrame(
        [(i, round(w, 6), steps, gap < ebm.TOLERANCE) for i, w in enumerate(weights)],
        "feature_pos int, coefficient double, steps int, matched boolean",
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        sequence_log_prob, sequence_log_prob_arrays, ebm_scores, ebm_moments, target_moments, log_likelihood, option_accuracy,
        moment_matching_fit, moment_matching_ascent,
    )
}

_HEADS = f"substr(md5(concat('{SIDE_SEED}:', cast(pair_id AS string))), 1, 1) < '8'"

_OPTIONS = rf"""opt AS (SELECT pair_id, CASE WHEN {_HEADS} THEN 'A' ELSE 'B' END AS preferred,
CASE WHEN {_HEADS} THEN chosen ELSE rejected END AS ta, CASE WHEN {_HEADS} THEN rejected ELSE chosen END AS tb FROM pairs),
feat AS (SELECT pair_id, preferred, length(ta) / 100.0 AS a0, len(regexp_extract_all(ta, '\S+')) / 10.0 AS a1, -length(ta) / 200.0 AS la,
length(tb) / 100.0 AS b0, len(regexp_extract_all(tb, '\S+')) / 10.0 AS b1, -length(tb) / 200.0 AS lb FROM opt),
sc AS (SELECT *, la + a0 * {COEFFICIENTS[0]}::double + a1 * {COEFFICIENTS[1]}::double AS ea, lb + b0 * {COEFFICIENTS[0]}::double + b1 * {COEFFICIENTS[1]}::double AS eb FROM feat),
sh AS (SELECT *, CASE WHEN ea >= eb THEN 1 / (1 + exp(eb - ea)) ELSE exp(ea - eb) / (1 + exp(ea - eb)) END AS pa FROM sc)"""

_TOKEN_ENDS = f"""{TOKENS},
ends AS (SELECT sample_id, min(pos) FILTER (token = '{END}') AS e FROM tokens GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "sequence_log_prob": sql(
        _TOKEN_ENDS,
        body=f"SELECT sample_id, {q6(f"sum(CASE WHEN (e IS NULL OR pos <= e) AND (pos = 0 OR token <> '{PAD}') THEN logprob ELSE 0 END)")} AS log_prob, "
        "coalesce(max(e), -1) AS first_end FROM tokens JOIN ends USING (sample_id) GROUP BY sample_id",
    ),
    "ebm_scores": sql(
        PAIRS, _OPTIONS,
        body=f"SELECT pair_id, {q6('ea')} AS ebm_log_a, {q6('eb')} AS ebm_log_b, {q6('pa')} AS ebm_share_a, {q6('1 - pa')} AS ebm_share_b FROM sh",
    ),
    "ebm_moments": sql(
        PAIRS, _OPTIONS,
        body=" UNION ALL ".join(f"SELECT {i} AS feature_pos, {q6(f'avg(pa * a{i} + (1 - pa) * b{i})')} AS moment FROM sh" for i in range(2)),
    ),
    "target_moments": sql(
        PAIRS, _OPTIONS,
        body=" UNION ALL ".join(
            f"SELECT {i} AS feature_pos, {q6(f"avg(CASE WHEN preferred = 'A' THEN a{i} ELSE b{i} END)")} AS target FROM sh" for i in range(2)
        ),
    ),
    "log_likelihood": sql(
        PAIRS, _OPTIONS,
        body=f"SELECT {q6("avg(CASE WHEN preferred = 'A' THEN ea ELSE eb END - (greatest(ea, eb) + ln(1 + exp(-abs(ea - eb)))))")} AS log_likelihood, count(*) AS n FROM sh",
    ),
    "option_accuracy": sql(
        PAIRS, _OPTIONS,
        body=f"SELECT {q6("avg(CASE WHEN preferred = CASE WHEN ea > eb THEN 'A' ELSE 'B' END THEN 1.0 ELSE 0.0 END)")} AS accuracy, count(*) AS n FROM sh",
    ),
}
ORACLES["sequence_log_prob_arrays"] = ORACLES["sequence_log_prob"]

# Newton's method on the two coefficients, from zero, with steps of bounded reach; every step reads all pairs.
_NEWTON = """x AS (SELECT CASE preferred WHEN 'A' THEN 1.0 ELSE 0.0 END AS y, a0 - b0 AS d0, a1 - b1 AS d1, la - lb AS o FROM feat),
step0 AS (SELECT 0.0::double AS w0, 0.0::double AS w1)"""
_STEPS, _REACH = 40, 0.05


def _newton_steps() -> str:
    parts = []
    for i in range(_STEPS):
        p = f"(1 / (1 + exp(-greatest(least(o + w0 * d0 + w1 * d1, 700), -700))))"
        parts.append(
            f"sum{i} AS MATERIALIZED (SELECT any_value(w0) AS w0, any_value(w1) AS w1, sum((y - {p}) * d0) AS g0, sum((y - {p}) * d1) AS g1, "
            f"sum({p} * (1 - {p}) * d0 * d0) AS h00, sum({p} * (1 - {p}) * d0 * d1) AS h01, sum({p} * (1 - {p}) * d1 * d1) AS h11 FROM x, step{i}),\n"
            f"move{i} AS (SELECT w0, w1, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS m0, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS m1 FROM sum{i}),\n"
            f"step{i + 1} AS MATERIALIZED (SELECT w0 + m0 * least(1, {_REACH} / greatest(abs(m0), abs(m1))) AS w0, "
            f"w1 + m1 * least(1, {_REACH} / greatest(abs(m0), abs(m1))) AS w1 FROM move{i})"
        )
    return ",\n".join(parts)


ORACLES["moment_matching_fit"] = sql(
    PAIRS, _OPTIONS, _NEWTON, _newton_steps(),
    body=f"SELECT 0 AS feature_pos, round(w0, 4) + 0.0 AS coefficient, TRUE AS matched FROM step{_STEPS} "
    f"UNION ALL SELECT 1, round(w1, 4) + 0.0, TRUE FROM step{_STEPS}",
)

# Newton's method from zero, and the ascent's own steps from its rounded result; every step reads all pairs.
_SHARE = "(0.5 * (1 + (1 - exp(-abs(o + w0 * d0 + w1 * d1))) / (1 + exp(-abs(o + w0 * d0 + w1 * d1))) * sign(o + w0 * d0 + w1 * d1)))"
ORACLES["moment_matching_ascent"] = sql(
    PAIRS, _OPTIONS,
    "worded AS (SELECT preferred, a0, a0 * 10 / greatest(a1, 0.1) AS a2, b0, b0 * 10 / greatest(b1, 0.1) AS b2, la, lb FROM feat)",
    "both_sides AS (SELECT a0 AS v0, a2 AS v1 FROM worded UNION ALL SELECT b0, b2 FROM worded)",
    "spread AS (SELECT stddev_pop(v0) AS s0, stddev_pop(v1) AS s1 FROM both_sides)",
    "x AS MATERIALIZED (SELECT CASE preferred WHEN 'A' THEN 1.0::double ELSE 0.0::double END AS y, "
    "(a0 - b0) / s0 AS d0, (a2 - b2) / s1 AS d1, (la - lb)::double / 100 AS o FROM worded, spread)",
    "newton AS (SELECT 0 AS step, 0.0::double AS w0, 0.0::double AS w1 UNION ALL SELECT step + 1, w0 + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), "
    f"w1 + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM (SELECT step, any_value(w0) AS w0, any_value(w1) AS w1, sum((y - {_SHARE}) * d0) AS g0, "
    f"sum((y - {_SHARE}) * d1) AS g1, sum({_SHARE} * (1 - {_SHARE}) * d0 * d0) AS h00, sum({_SHARE} * (1 - {_SHARE}) * d0 * d1) AS h01, "
    f"sum({_SHARE} * (1 - {_SHARE}) * d1 * d1) AS h11 FROM x, newton WHERE step < {_STEPS} GROUP BY step))",
    f"ascent AS (SELECT 0 AS step, round(w0, 1) AS w0, round(w1, 1) AS w1, 1e9::double AS gap FROM newton WHERE step = {_STEPS} UNION ALL "
    f"SELECT step + 1, any_value(w0) + {ebm.LEARNING_RATE}::double * avg((y - {_SHARE}) * d0), any_value(w1) + {ebm.LEARNING_RATE}::double * avg((y - {_SHARE}) * d1), "
    f"greatest(abs(avg((y - {_SHARE}) * d0)), abs(avg((y - {_SHARE}) * d1))) FROM x, ascent WHERE gap >= {ebm.TOLERANCE}::double GROUP BY step)",
    "final AS (SELECT * FROM ascent ORDER BY step DESC LIMIT 1)",
    body=f"SELECT 0 AS feature_pos, {q6('w0')} AS coefficient, step AS steps, gap < {ebm.TOLERANCE} AS matched FROM final "
    f"UNION ALL SELECT 1, {q6('w1')}, step, gap < {ebm.TOLERANCE} FROM final",
).replace("WITH ", "WITH RECURSIVE ", 1)
