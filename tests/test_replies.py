"""Replies of plugged-in models: one call per task, kept across runs, bounded retries."""

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from prefspark.operators import judge, rating, replies
from prefspark.plans import flows

TASKS = "id int, task string, extra string"


def told(path, answer=lambda text: "3 4"):
    """A rater that notes every text it is asked for, in files that all tasks share."""

    def factory():
        def call(texts):
            with open(os.path.join(path, uuid.uuid4().hex), "w") as f:
                f.writelines(json.dumps(t) + "\n" for t in texts)
            return [answer(t) for t in texts]

        return call

    return factory


def asked(path):
    return sorted(json.loads(line) for name in os.listdir(path) for line in open(os.path.join(path, name)))


def test_equal_tasks_are_asked_once_and_a_rerun_asks_none(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    rows = [(i, f"task {i % 30}", "x") for i in range(200)] + [(900, None, "y"), (901, "", "y")]
    tasks = spark.createDataFrame(rows, TASKS).repartition(5)
    found = replies.replied(tasks, told(str(calls), lambda t: f"re {t}"), store, "m")
    assert found.columns == ["id", "task", "extra", "reply"]
    assert sorted((r.id, r.reply) for r in found.collect()) == sorted((i, None if t is None else f"re {t}") for i, t, _ in rows)
    assert asked(calls) == sorted([f"task {i}" for i in range(30)] + [""])
    again = replies.replied(tasks, told(str(calls), lambda t: "other"), store, "m")
    assert {r.reply for r in again.collect()} == {r.reply for r in found.collect()}
    assert len(asked(calls)) == 31
    more = tasks.union(spark.createDataFrame([(7, "new", "z")], TASKS))
    assert {r.reply for r in replies.replied(more, told(str(calls), lambda t: f"re {t}"), store, "m").where("id = 7").collect()} >= {"re new"}
    assert len(asked(calls)) == 32
    replies.replied(tasks.limit(1), told(str(calls)), store, "another rater").collect()
    assert len(asked(calls)) == 33


def test_tasks_without_a_reply_are_tried_a_bounded_number_of_times(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    tasks = spark.createDataFrame([(i, f"t{i}", "") for i in range(10)], TASKS)
    first = replies.replied(tasks, told(str(calls), lambda t: None if t == "t3" else "ok"), store, attempts=2)
    assert [r.reply for r in first.orderBy("id").collect()].count(None) == 1 and asked(calls).count("t3") == 2
    replies.replied(tasks, told(str(calls)), store, attempts=2).collect()
    assert asked(calls).count("t3") == 2 and asked(calls).count("t4") == 1
    assert replies.replied(tasks, told(str(calls)), store, attempts=3).where("reply IS NULL").isEmpty()


def test_a_run_that_dies_keeps_its_committed_waves(spark, tmp_path, monkeypatch):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    tasks = spark.createDataFrame([(i, f"t{i}", "") for i in range(60)], TASKS)
    made, whole = [], replies.rate_with

    def dying(*a, **k):
        made.append(1)
        if len(made) == 4:
            raise RuntimeError("lost")
        return whole(*a, **k)

    monkeypatch.setattr(replies, "rate_with", dying)
    with pytest.raises(RuntimeError):
        replies.replied(tasks, told(str(calls)), store)
    before = asked(calls)
    assert 0 < len(before) < 60
    assert replies.replied(tasks, told(str(calls)), store).where("reply = '3 4'").count() == 60
    assert asked(calls) == sorted(f"t{i}" for i in range(60))


def test_hot_tasks_meet_their_reply_in_parts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replies, "HOT_ROWS", 10)
    calls = tmp_path / "calls"
    calls.mkdir()
    tasks = spark.createDataFrame([(i, "same" if i % 3 else f"t{i}", "") for i in range(120)], TASKS)
    found = replies.replied(tasks, told(str(calls), lambda t: t.upper()))
    assert sorted((r.id, r.reply) for r in found.collect()) == [(i, "SAME" if i % 3 else f"T{i}") for i in range(120)]
    assert asked(calls).count("same") == 1


def test_a_judge_sees_each_task_once_and_a_random_one_loses_no_comparison(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    rows = [(f"p{i % 6}", i // 6 + 1, f"r{i} {'w ' * (i % 4)}", float(i * 7 % 11), float(i * 5 % 13)) for i in range(96)]
    samples = spark.createDataFrame(rows, "prompt string, sample_idx int, response string, score_a double, score_b double")
    answers = ["7 3", "no idea", "2 9\nthe second", "Assistant 1: 4"]
    rates = flows.judge_candidates(samples, ["score_a", "score_b"], judge_fn=told(str(calls), lambda t: random.choice(answers)))
    found = rates.collect()
    assert {r.model: r.n + r.failed for r in found} == {"score_a": 36, "score_b": 36}
    texts = asked(calls)
    assert len(texts) == len(set(texts)) > 0
    rates.collect()
    assert len(asked(calls)) == len(texts)


def test_ratings_of_a_plugged_in_rater_are_kept(spark, tmp_path):
    calls, store = tmp_path / "calls", str(tmp_path / "store")
    calls.mkdir()
    samples = spark.createDataFrame([(1, "c", "one"), (2, "c", "two"), (3, "c", "one")], "id int, context string, response string")
    for _ in range(2):
        rated = rating.rate_samples(samples, rater=told(str(calls), lambda t: "8"), store=store, name="r")
        assert rated.where(F.col("rating") == 8).count() == 3 * len(rating.RUBRIC)
    assert len(os.listdir(store)) > 0
    tasks = rating.render_rating_task(samples).select("task").distinct().count()
    assert spark.read.schema(replies.STORED).parquet(store).count() == tasks


def test_scored_replies_keep_every_row(spark):
    rows = [(1, "7 3"), (2, "1.2.3 4"), (3, "none"), (4, None), (5, "Assistant 1: 4"), (6, "0 0")]
    found = {r.id: r for r in judge.scored_replies(spark.createDataFrame(rows, "id int, reply string")).collect()}
    assert (found[1].score1, found[1].score2, found[1].parse_failed, found[1].reason) == (7.0, 3.0, False, None)
    assert found[2].reason == "not a number" and found[5].reason == "not two scores" and found[5].parse_failed
    assert found[3].parse_failed and found[3].score1 == 0.0 and found[4].parse_failed and not found[6].parse_failed
    good, held = judge.parse_replies(spark.createDataFrame(rows, "id int, reply string"))
    assert {r.id for r in good.collect()} | {r.id for r in held.collect()} == set(found)


def test_texts_of_rated_samples_are_written_and_moved_as_they_are_not_once_a_task(spark, tmp_path, monkeypatch):
    written, whole = [], replies.settle
    monkeypatch.setattr(replies, "settle", lambda df, label: written.append(whole(df, label)) or written[-1])
    rows = [(i, "c", f"text {i % 40} {'w ' * 200}{i % 40}" if i % 9 else None) for i in range(90)]
    samples = spark.createDataFrame(rows, "id int, context string, response string")
    rated = rating.rate_samples(samples, rater=lambda: lambda texts: [str(len(t)) for t in texts])
    task = rating.render_rating_task(samples, keep_texts=True).select("id", "feature", F.length("task").alias("n"))
    found = rated.join(task, ["id", "feature"])
    assert rated.columns == ["id", "feature_pos", "feature", "rating"]
    assert found.count() == 90 * len(rating.RUBRIC) and found.where("NOT (rating <=> n)").isEmpty()
    told = sum(r.n or 0 for df in written for c, t in df.dtypes if t == "string" for r in df.agg(F.sum(F.length(c)).alias("n")).collect())
    # The samples, those of them that are asked, and the names of the features.
    assert told < 3 * sum(len(r[2] or "") + len(r[1]) for r in rows) + 13 * 90 * 60


def test_sources_move_once_where_every_call_has_its_reply(spark, tmp_path, monkeypatch):
    labels, whole = [], replies.settle
    monkeypatch.setattr(replies, "settle", lambda df, label: labels.append(label) or whole(df, label))
    rows = [(1, "c", "one"), (2, "c", "two"), (3, "c", None)]
    samples = spark.createDataFrame(rows, "id int, context string, response string")
    store = str(tmp_path / "store")
    rated = rating.rate_samples(samples, rater=lambda: lambda texts: ["8"] * len(texts), store=store)
    assert rated.where("rating = 8").count() == 2 * len(rating.RUBRIC) and labels.count("open_tasks") == 1
    silent = rating.rate_samples(samples, rater=lambda: lambda texts: [None] * len(texts), store=store, name="silent")
    assert silent.where("rating IS NOT NULL").isEmpty() and labels.count("open_tasks") == 1 + replies.ATTEMPTS
