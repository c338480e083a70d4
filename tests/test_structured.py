import json

import pytest

from tessella.plans import structured

RUBRICS = "array<struct<criterion:string,severity:string>>"


def reply(passes, quality=4, **other):
    return json.dumps({"rubric_evaluations": [{"criteria": "c", "passes": p, "reasoning": "r"} for p in passes], "overall_quality_score": quality, "strengths": ["s"], "weaknesses": [], **other})


def test_replies_are_read_by_position(spark):
    crit, other = ("a", "critical"), ("b", "not_critical")
    rows = [
        ("ok", reply([True, False]), [crit, other]), ("short", reply([True]), [crit, crit]), ("long", reply([True] * 3), [crit]), ("ok", reply([]), []), ("long", reply([False]), None),
        ("broken", reply([True])[:-4], [crit]), ("broken", "", [crit]), ("broken", None, [crit]), ("broken", reply([True], 6), [crit]), ("broken", reply([None]), [crit]), ("broken", "[]", [crit]),
        ("broken", '{"rubric_evaluations": [], "overall_quality_score": 3}', []), ("broken", reply(["perhaps"]), [crit]), ("ok", reply([False]), [(None, None)]), ("ok", reply([True] * 5), [crit] * 5), ("short", reply([True] * 4), [crit] * 5),
    ]
    frame = spark.createDataFrame([(i, s, r, x, 1) for i, (s, r, x) in enumerate(rows)], f"id int, expected string, reply string, rubrics {RUBRICS}, keep_out int")
    got = {r.id: r for r in structured.read(frame).collect()}
    assert [got[i].status for i in range(len(rows))] == [s for s, _, _ in rows]
    rates = [got[i].critical_pass_rate for i in range(len(rows))]
    assert rates == [1.0, 0.5, 1.0, 1.0, 1.0, *[None] * 8, 1.0, 1.0, 0.8]
    assert [got[i].keep for i in range(len(rows))] == [x is not None and x > 0.8 for x in rates]
    assert {r.status: (r.n, r.n_kept) for r in structured.tally(structured.read(frame)).collect()} == {"ok": (4, 4), "short": (2, 0), "long": (2, 2), "broken": (8, 0)}
    assert structured.read(frame.limit(0)).count() == 0


def test_one_call_a_sample(spark, tmp_path):
    log = tmp_path / "calls"

    def judge(system, messages):
        import json

        text = messages[0]["content"]
        with log.open("a") as f:
            f.write("x")
        if "boom" in text:
            raise ValueError("no")
        return json.dumps({"rubric_evaluations": [{"passes": "good" in text}] * text.count("\n["), "overall_quality_score": 4, "strengths": [], "weaknesses": []})

    rows = [(1, "p {rubrics}", "good", [("a", "critical"), ("b", None)]), (2, "p", "bad", [("a", "critical")]), (3, "p", "boom", []), (4, None, None, None)]
    frame = spark.createDataFrame(rows, f"id int, prompt string, response string, rubrics {RUBRICS}")
    asked = {r.id: r.messages[0].content for r in structured.asked(frame, "s", "{context}|{response}|\n{rubrics}").collect()}
    assert asked[2] == "p|bad|\n[1] critical: a" and asked[4] == "||\n"
    good, tally = structured.evaluated(frame, judge, "s", "{context}|{response}|\n{rubrics}")
    assert sorted((r.id, r.response, r.status, r.keep, r.overall_quality_score) for r in good.collect()) == [(1, "good", "ok", True, 4), (2, "bad", "ok", False, 4), (4, None, "ok", True, 4)]
    assert {r.status: r.n for r in tally.collect()} == {"ok": 3, "broken": 1}
    assert len(log.read_text()) == 4


@pytest.mark.parametrize("threshold, kept", [(0.8, False), (0.79, True)])
def test_the_threshold_itself_is_not_kept(spark, threshold, kept):
    frame = spark.createDataFrame([(reply([True] * 4 + [False]), [("a", "critical")] * 5)], f"reply string, rubrics {RUBRICS}")
    assert structured.read(frame, threshold=threshold).first().keep is kept
