"""Flows and providers: every call is made once, rows keep their own ratings, sessions end as they should."""

import pytest
from pyspark.sql import functions as F

from tessella import providers
from tessella.plans import episodes, flows
from tessella.sources import io

RUBRIC = [("be kind", 5, "style_tone", None, True, True)]


def samples(spark, ids):
    return spark.createDataFrame([(i, "adaptive", "Maths", "", [("user", f"hi {n}")], RUBRIC, False, []) for n, i in enumerate(ids)], io.SAMPLE)


def counting(path, reply):
    """A provider whose calls are lines of a file."""

    def call(system, messages):
        with open(path, "a") as f:
            f.write("call\n")
        return reply(messages)

    return call


def test_each_sample_is_answered_once_and_judged_as_stored(spark, tmp_path):
    import random

    model = counting(tmp_path / "model", lambda m: f"r{random.random()}")
    judge = counting(tmp_path / "judge", lambda m: "JUDGMENT: PASS\nEXPLANATION: " + m[-1]["content"].split("Response: ")[1])
    got = flows.evaluated(samples(spark, ["a", "b", "c"]), model, judge).collect()
    assert all(r.ratings[0].explanation == r.response for r in got)
    assert [(tmp_path / n).read_text().count("call") for n in ("model", "judge")] == [3, 3]


def test_repeated_ids_keep_their_own_ratings(spark):
    rows = samples(spark, ["s", "s", "s"])
    judge = lambda system, m: "JUDGMENT: PASS" if m[-1]["content"].endswith("hi 1") else "JUDGMENT: FAIL"
    got = flows.evaluated(rows, providers.echo, judge).collect()
    assert sorted((r.response, [x.passed for x in r.ratings]) for r in got) == [("[1] hi 0", [False]), ("[1] hi 1", [True]), ("[1] hi 2", [False])]


def test_failed_calls(spark):
    def broken(system, messages):
        raise ValueError("quota")

    got = flows.evaluated(samples(spark, ["a"]), providers.echo, broken).first()
    assert got.weighted_score == 0 and "quota" in got.ratings[0].explanation
    got = flows.evaluated(samples(spark, ["a"]), broken, None).first()
    assert (got.response, got.error) == ("", "ValueError: quota")


def test_revisions_are_made_once(spark, tmp_path):
    kind = io.RESPONSE + ", pos long"
    results = [("c", 5, "critical", False, False, "", None, None)]
    rows = [("s", "p", i, "x", "q", "", "", f"text number {i} of some words", "m", 0.1 * i, 0.5, 0.9, results, False, False, i) for i in range(4)]
    revise = counting(tmp_path / "revise", lambda m: "a revised answer entirely")
    kept, log = flows.curated(spark.createDataFrame(rows, kind), revise)
    assert "a revised answer entirely" in {r.response for r in kept.collect()}
    log.count()
    assert (tmp_path / "revise").read_text().count("call") == 1


def test_session_that_fails_ends(spark):
    rows = spark.createDataFrame([("s", "q", "2")], "session_id string, question string, ground_truth string")

    def silent(system, messages):
        raise TimeoutError

    got = episodes.played(rows, silent, lambda s, m: "FINAL: 2", lambda t, a: t == a).collect()
    assert [(r.pos, r.speaker, r.student_final_answer, r.judge_verdict) for r in got] == [(0, "student", "2", True)]
    assert episodes.played(rows, silent, silent, lambda t, a: True).count() == 0
    assert episodes.played(rows.limit(0), silent, silent, lambda t, a: True).count() == 0


def test_scores_that_cannot_be_read(spark):
    rows = spark.createDataFrame([([("user", "x")],), (None,)], "conversation array<struct<role:string,content:string>>")
    said = iter(["{}", "7", '{"score": 9}', "```json\n{\"score\": \"2\"}\n```"])
    got = episodes.conversation_judged(rows.limit(1), lambda what, m: {"question_depth": '{"score": 9}', "icap": '```json\n{"score": "2"}\n```'}.get(what, "{}")).first()
    assert (got.question_depth, got.icap, got[episodes.JUDGED[0]]) == (5, 2, 3) and said


@pytest.mark.parametrize("answer, by, ok", [("200.5", "numbers", True), ("", "empty", False), ("a slope", "judge", True)])
def test_equal_answers(spark, answer, by, ok):
    rows = spark.createDataFrame([(answer,)], "answer string").withColumn("ground_truth", F.lit("200"))
    got = episodes.answers_judged(rows, lambda s, m: "Correct.").first()
    assert (got.by, got.is_correct) == (by, ok)


def test_sessions_read_turns_as_the_columns_do(spark):
    from pyspark.sql import functions as F

    from tessella.functions import text

    said = ["Thought: t\nAction: success\nUtterance: 'well done'", "action: HINT\nutterance: \"go\"```", "Action: correct_misconception\nUtterance: no", "Action: END_STUCK", "Action: dance\nUtterance: x", "Utterance: only", "Action: ask\nUtterance:   two\nlines  "]
    rows = spark.createDataFrame([(x,) for x in said], "t string").select("t", text.teacher_turn(F.col("t")).alias("r")).collect()
    for r in rows:
        act, utterance = episodes.read_turn(r.t)
        known = r.r.action in text.ACTIONS
        assert act == (r.r.action if known else "GIVE_HINT")
        assert utterance == (r.r.utterance or r.t.strip() if known else r.t.strip())


def test_no_success_on_a_wrong_answer(spark):
    rows = spark.createDataFrame([("s", "q", "1")], "session_id string, question string, ground_truth string")
    turns = episodes.played(rows, lambda s, m: "Action: success\nUtterance: bye", lambda s, m: "FINAL: " + ("1" if len(m) > 1 else "2"), lambda truth, answer: truth == answer, 5)
    assert [(r.teacher_action, r.teacher_is_terminal) for r in turns.orderBy("pos").collect() if r.speaker == "teacher"] == [("CORRECT_ERROR", False), ("END_SUCCESS", True)]
