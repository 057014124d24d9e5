"""Text operators against short Python definitions, on the awkward cases."""

import re

import pytest
from pyspark.sql import functions as F

from prefspark.plans import inputs
from prefspark.functions import text
from prefspark.functions.features import add_features, add_lexical_signals, register_feature
from prefspark.operators import curate, judge, rating


def evaluate(spark, values, build):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(build(F.col("t")).alias("x")).collect()]


RATINGS = ["8", "10 out of", " 8", "x 8", "007", "", "8.5", "1" * 20, None, "9\n10", "100"]


def test_parse_rating(spark):
    assert evaluate(spark, RATINGS, text.parse_rating) == [8, 10, None, None, 7, None, 8, None, None, 9, 100]


JUDGED = [
    "8 7", "  9.5   3\nbecause", "8\n7", "Assistant 1: 8\nAssistant 2: 6", "Assistant 1: 8", "junk",
    "text\n7 6\nmore\n1 2", "8 7 extra", "8 7", "1 2 x", ". .",
    "Assistant 1: 1 Assistant 2: 2 Assistant 1: 3", "", "0 0",
]


def first_scores(reply):
    lines = re.findall(text.SCORE_LINE_PATTERN, reply, re.MULTILINE)
    if lines:
        return f"{lines[0][0]} {lines[0][1]}"
    return " ".join(re.findall(text.LABELLED_SCORE_PATTERN, reply)) or text.NO_SCORES


def test_parse_judge_scores(spark):
    assert evaluate(spark, JUDGED, text.parse_judge_scores) == [first_scores(r) for r in JUDGED]
    failed = evaluate(spark, JUDGED, lambda c: ~text.has_judge_scores(c))
    assert [r for r, f in zip(JUDGED, failed) if f] == ["junk", "8 7 extra", "1 2 x", ""]


def test_judge_scores_to_numbers(spark):
    rows = spark.createDataFrame([(r,) for r in JUDGED], "reply string")
    good, held = judge.parse_replies(rows)
    assert {(r.score1, r.score2) for r in good.collect()} == {(8, 7), (9.5, 3), (8, 6), (0, 0), (7, 6)}
    assert {(r.scores, r.reason) for r in held.collect()} == {
        ("8", "not two scores"), (". .", "not a number"), ("1 2 3", "not two scores")
    }


TRANSCRIPTS = [
    "\n\nHuman: a\n\nAssistant: b", "\n\nHuman: a\n\nAssistant: b\n\nHuman: c\n\nAssistant: d", "no header", "",
    "\n\nAssistant: ", "\nAssistant: only\nAssistant: x", "😀\n\nHuman: é\n\nAssistant: 😀😀",
]


def test_prompt_of_transcript(spark):
    header = text.PROMPT_HEADER
    expected = [header.join(t.split(header)[:-1]) + header for t in TRANSCRIPTS]
    assert evaluate(spark, TRANSCRIPTS, text.prompt_of_transcript) == expected


def test_single_round_filter_counts_literals(spark):
    rows = spark.createDataFrame([(i, t, TRANSCRIPTS[0]) for i, t in enumerate(TRANSCRIPTS)], "i int, chosen string, rejected string")
    kept = curate.single_round_filter(rows, ["chosen", "rejected"])
    assert sorted(r.i for r in kept.collect()) == [0, 6]


def test_split_prompt_response_quarantines(spark):
    rows = spark.createDataFrame([(i, t, r) for i, (t, r) in enumerate([
        (TRANSCRIPTS[0], TRANSCRIPTS[1]), (TRANSCRIPTS[1], TRANSCRIPTS[0]), (TRANSCRIPTS[0], "no header"), (None, TRANSCRIPTS[0]),
    ])], "i int, chosen string, rejected string")
    good, held = curate.split_prompt_response(rows)
    only = good.collect()
    assert [(r.i, r.prepend, r.chosen, r.rejected) for r in only] == [(0, "\n\nHuman: a\n\nAssistant: ", "b", "b\n\nHuman: c")]
    assert {(r.i, r.reason) for r in held.collect()} == {
        (1, "chosen has 3 parts"), (2, "rejected has no response"), (3, "chosen is null")
    }
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        curate.split_prompt_response(rows, strict=True)[0].collect()
    kept, _ = curate.split_prompt_response(rows, mode="plain")
    assert {(r.i, r.chosen) for r in kept.collect()} == {(0, TRANSCRIPTS[0]), (2, TRANSCRIPTS[0])}


def test_headers(spark):
    t = ["\n\nHuman: q\n\nAssistant: a"]
    assert evaluate(spark, t, lambda c: text.rewrite_role_headers(c, "shp")) == ["\n\nPOST: q\n\nResponse: a"]
    assert evaluate(spark, t, text.strip_role_headers) == ["qa"]
    assert evaluate(spark, t, lambda c: text.strip_role_headers(c, legacy_headers=True)) == ["q\n\nAssistant: a"]
    assert evaluate(spark, ["c"], lambda c: text.render_context(c, "hh-rlhf-and-shp")) == ["\n\nHuman: c\n\nAssistant: "]
    assert evaluate(spark, ["c"], lambda c: text.render_context(c, "plain")) == [""]


def test_lengths_count_code_points(spark):
    assert evaluate(spark, ["😀é", ""], text.response_length) == [0.02, 0.0]
    assert evaluate(spark, [" a  b\nc ", "", "x"], text.token_count) == [3, 0, 1]


def test_rating_task_keeps_braces_and_all_features(spark):
    rows = spark.createDataFrame([(1, "ctx {history}", "r {low}")], "id int, context string, response string")
    tasks = rating.render_rating_task(rows).orderBy("feature_pos").collect()
    assert [t.feature for t in tasks] == list(rating.RUBRIC_FEATURES)
    assert all("ctx {history}" in t.task and "r {low}" in t.task for t in tasks)
    assert rating.rubric_table(spark).count() == 13


def test_judge_task_orders_and_bad_index(spark):
    rows = spark.createDataFrame([(1, "\n\nHuman: q\n\nAssistant: ", ["x", "y"])], "id int, prompt string, response array<string>")
    tasks = {t.order: (t.answer1, t.answer2, t.task) for t in judge.render_judge_task(rows).collect()}
    assert tasks["direct"][:2] == ("x", "y") and tasks["swapped"][:2] == ("y", "x")
    assert "Human:" not in tasks["direct"][2]
    with pytest.raises(Exception, match="INVALID_ARRAY_INDEX"):
        judge.render_judge_task(rows, indices=(0, 2)).collect()
    with pytest.raises(ValueError):
        judge.render_judge_task(rows, indices=(0, 1, 2))


def test_plugged_rater_survives_errors(spark):
    def factory():
        def call(texts):
            if any("boom" in t for t in texts):
                raise RuntimeError("model down")
            return ["7 of 10"] * len(texts)

        return call

    rows = spark.createDataFrame([(1, "fine"), (2, "boom"), (3, "fine too")], "id int, task string").coalesce(1)
    replies = {r.id: r.reply for r in rating.rate_with(rows, factory).collect()}
    assert replies == {1: "7 of 10", 2: None, 3: "7 of 10"}


def test_features_must_be_columns(spark):
    with pytest.raises(Exception):
        register_feature("bad", lambda response, context: len("x"))
    rows = spark.createDataFrame([("ab", "c")], "response string, prompt string")
    added = add_features(rows, {"": "response"}, "prompt", {"length": text.response_length})
    assert added.first().length == 0.02


def test_a_dialogue_of_many_turns_stays_one_dialogue(spark, tmp_path):
    turns = [(7, i, "user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(258)]
    turns += [(8, 0, "user", "hello"), (8, 1, "assistant", "hi"), (8, 2, "system", "left out")]
    schema = "conv_id long, turn int, role string, text string"
    spark.createDataFrame(turns, schema).repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    told = {r.conv_id: r.t for r in inputs.transcripts(spark, str(tmp_path)).collect()}
    assert told[8] == "\n\nHuman: hello\n\nAssistant: hi" and told[7].count("turn ") == 258
    kept = curate.single_round_filter(inputs.transcripts(spark, str(tmp_path)), ["t"])
    assert [r.conv_id for r in kept.collect()] == [8]


def test_counts_of_both_sides_stay_out_of_generated_stage_code(spark):
    """With them the one method of the stage was too large for the JVM to compile, and ran several times slower."""
    rows = [(1, "a c", "One two! 3\nfour.", None), (2, "b", "", "b B b? 12"), (3, None, "x", "y")]
    pairs = spark.createDataFrame(rows, "pair_id int, context string, chosen string, rejected string")
    rated = rating.rate_pairs_wide(pairs)
    executed = rated._jdf.queryExecution().executedPlan().toString()
    held = [line for line in executed.split("\n") if "regexp_extract_all(" in line and "Project" in line]
    assert held and not any("*(" in line.split("Project")[0] for line in held)
    signals = {}
    for side in ("chosen", "rejected"):
        signals[side] = {r.pair_id: r.signals for r in add_lexical_signals(pairs, side, "context").collect()}
    assert signals["rejected"][1] is None and tuple(signals["rejected"][2]) == (9, 4, 3, 1, 1, 2, 1, 0, 0)
    assert tuple(signals["chosen"][1]) == (16, 4, 4, 2, 0, 1, 2, 1, 1) and signals["chosen"][2].words == 0
