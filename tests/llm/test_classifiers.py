import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from prefspark.llm import line_quality, toxicity
from prefspark.llm.labelled import labelled_sample, remainder
from tests.llm.common import EDGES, documents

SAMPLE = "doc_id bigint, text string, lang string, label bigint"


def prose(rng, n):
    return " ".join(rng.choice(["la", "mer", "est", "bleue", "the", "sea", "is", "blue"]) + "" for _ in range(n))


def toxic_rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        words = [f"{rng.choice('abcdefgh')}{rng.randint(0, 300)}" for _ in range(60)]
        lang = "en" if i % 3 else "fr"
        words += ["the", "of"] * 3 if lang == "en" else ["le", "du"] * 3
        if bad:
            words += [rng.choice(["vile", "nasty"]) if lang == "en" else f"affreu{rng.choice('xse')}" for _ in range(3)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), lang, int(bad)))
    return rows


def scores(df):
    return {r.doc_id: r.score for r in df.collect()}


def test_toxicity_learns_words_and_beginnings(spark):
    rows = toxic_rows(600)
    model = toxicity.fit(spark.createDataFrame(rows[:400], SAMPLE))
    tested = documents(spark, [(i, text, lang) for i, text, lang, _ in rows[400:]], clashing=True)
    found = scores(toxicity.score(tested, model))
    assert np.mean([(found[i] >= 0.5) == label for i, _, _, label in rows[400:]]) > 0.97
    kept = {r.doc_id for r in toxicity.drop_toxic(tested, model).collect()}
    assert kept == {i for i, s in found.items() if s < 0.5}
    assert toxicity.drop_toxic(tested, model).columns == tested.columns
    edges = toxicity.score(documents(spark, EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score < 0.5 for r in edges)
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_toxicity_scores_do_not_depend_on_neighbours(spark):
    model = toxicity.fit(spark.createDataFrame(toxic_rows(300), SAMPLE))
    encoder = toxicity._Encoder(model)
    texts = [toxicity.compress(encoder, t)[0] for _, t, _, _ in toxic_rows(40, 2)] + [toxicity.compress(encoder, "")[0]]
    together = toxicity.logits(model, texts)
    assert np.allclose(together, [toxicity.logits(model, [t])[0] for t in texts])


def test_toxicity_gradients():
    rng = np.random.default_rng(1)
    texts = [np.vstack([np.zeros((2, toxicity.SLOTS)), rng.integers(0, 5, (6, toxicity.SLOTS))]) for _ in range(5)]
    texts = [np.vstack([t, np.zeros((3, toxicity.SLOTS))]).astype(np.int32) for t in texts]
    labels = np.array([1.0, 0, 1, 0, 1])
    weights = toxicity.train(texts, labels, 5, epochs=1)
    weights["v"] = rng.normal(size=weights["v"].shape)

    def loss():
        lengths = np.array([len(t) for t in texts])
        logit = toxicity._forward(weights, np.concatenate(texts), np.cumsum(lengths) - lengths, lengths)[0]
        return np.mean(np.logaddexp(0, logit) - labels * logit)

    grads = toxicity._gradients(weights, texts, labels)
    for name in weights:
        for at in [tuple(rng.integers(0, n) for n in weights[name].shape) for _ in range(6)]:
            if name == "e" and at[0] == 0:
                continue
            kept, step = weights[name][at], 1e-6
            weights[name][at] = kept + step
            up = loss()
            weights[name][at] = kept - step
            down = loss()
            weights[name][at] = kept
            assert abs((up - down) / (2 * step) - grads[name][at]) < 1e-5


def test_one_label_only(spark):
    clean = [(i, t, lang, 0) for i, t, lang, _ in toxic_rows(20)]
    model = toxicity.fit(spark.createDataFrame(clean, SAMPLE))
    assert set(scores(toxicity.score(documents(spark, EDGES), model)).values()) == {0.0}
    good = line_quality.fit(spark.createDataFrame([(i, t, lang, 1) for i, t, lang, _ in toxic_rows(20)], SAMPLE))
    assert all(r.score > 0.99 for r in line_quality.score(documents(spark, EDGES), good).collect())
    assert line_quality.score(documents(spark, []), line_quality.fit(spark.createDataFrame([], SAMPLE))).count() == 0


def quality_rows(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lines = [prose(rng, rng.randint(3, 15)).capitalize() + "." for _ in range(rng.randint(1, 6))]
        bad = i % 3 == 0
        if bad:
            lines[rng.randrange(len(lines)) :] = [" | ".join(prose(rng, 12).split()), prose(rng, 9).upper() + "!!"]
        rows.append((i, "\n".join(lines), "en", 1 - bad))
    return rows


def test_quality_learns_lines(spark):
    rows = quality_rows(500)
    model = line_quality.fit(spark.createDataFrame(rows[:300], SAMPLE))
    tested = documents(spark, [(i, text) for i, text, _, _ in rows[300:]], clashing=True)
    found = scores(line_quality.score(tested, model))
    cut = line_quality.THRESHOLD
    assert np.mean([(found[i] >= cut) == label for i, _, _, label in rows[300:]]) > 0.95
    edges = line_quality.score(documents(spark, EDGES), model).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.score <= 1 for r in edges)


def test_marginals_against_all_labellings():
    rng = np.random.default_rng(5)
    moves, counts = rng.normal(size=(2, 2)), np.array([1, 4, 3])
    unary = rng.normal(size=counts.sum())
    forward, backward = line_quality._chain(unary, counts, moves)
    found, wanted, at = 1 / (1 + np.exp(-(forward + backward))), [], 0
    for n in counts:
        total, good = 0.0, np.zeros(n)
        for states in itertools.product((0, 1), repeat=int(n)):
            weight = np.exp(
                sum(unary[at + k] * s for k, s in enumerate(states)) + sum(moves[a, b] for a, b in zip(states, states[1:]))
            )
            total += weight
            good += weight * np.array(states)
        wanted.extend(good / total)
        at += n
    assert np.allclose(found, wanted)


def test_sample_leaves_out_rows_bounds_and_repeated_labels(spark):
    docs = documents(spark, [(i, f"text {i}", "en") for i in range(2_000)])
    rows = [(i, i % 2, None) for i in range(2_000)] + [(1, 1, None), (2, 1, None), (None, 1, None), (5_000, 1, None)]
    labels = spark.createDataFrame(rows, "doc_id bigint, toxic int, quality int")
    learn = remainder("doc_id", 5) != 0
    sample = labelled_sample(docs, labels, "toxic", learn, 500, "text")
    ids = [r.doc_id for r in sample.collect()]
    assert len(ids) == len(set(ids)) and 400 < len(ids) < 600
    assert sample.where(~learn).count() == 0
    assert labelled_sample(docs, labels, "toxic", F.lit(True), 5_000).where("doc_id = 2").first().label == 1
    assert labelled_sample(docs, labels, "quality", learn, 500, "text").count() == 0
