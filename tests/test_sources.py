"""Readers and writers over files of their own."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.sources import io

RUBRIC = {"criterion": "x", "weight": 5, "evaluation_dimension": "style_tone"}


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def test_json_array(spark, tmp_path):
    rows = [{"sample_id": "a", "messages": [{"role": "user", "content": "é\nx"}], "rubrics": [RUBRIC]}]
    got = io.samples(spark, put(tmp_path / "a.json", rows)).first()
    assert (got.system_prompt, got.is_multimodal, got.rubrics[0].is_objective, got.messages[0].content) == ("", False, True, "é\nx")
    bad = put(tmp_path / "b.json", [{"sample_id": "a", "rubrics": [RUBRIC | {"weight": 3}]}])
    with pytest.raises((PySparkException, Py4JJavaError)):
        io.samples(spark, bad).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        io.json_array(spark, put(tmp_path / "c.json", "[{broken")).collect()


def test_csv(spark, tmp_path):
    rubric = json.dumps([{"criteria": "Must not tell", "attributes": {"severity": "critical"}}]).replace('"', '""')
    path = put(tmp_path / "a.csv", f'PROMPT,SUBJECT,RUBRICS\n"two\nlines, ""quoted""",Maths,"{rubric}"\nplain,,\n')
    rows = io.csv(spark, path, "SUBJECT string, PROMPT string, RUBRICS string").withColumns({"pos": F.monotonically_increasing_id(), "UC1_INITIAL_EXPLANATION": F.lit("e"), "FOLLOW_UP_PROMPT": F.lit(None).cast("string")})
    got = io.csv_samples(rows).orderBy("pos").collect()
    assert [(r.sample_id, r.subject, len(r.messages), len(r.rubrics)) for r in got] == [("sample_0000", "Maths", 2, 1), ("sample_0001", "unknown", 2, 0)]
    assert got[0].messages[0].content == 'two\nlines, "quoted"' and io.csv_samples(rows, 1).count() == 1
    assert io.csv_samples(rows, subject="maths").count() == 1
    keyed = io.keyed_rubrics(rows).collect()
    assert [(r.sample_id, r.rubrics[0].weight) for r in keyed] == [("sample_0000", -5)]


def test_hosted(spark):
    raw = json.dumps([{"criteria": "x", "attributes": {"severity": "Critical"}}])
    rows = spark.createDataFrame([(0, "t0", "USE_CASE_2", "Maths", "p", None, raw, None), (1, None, "USE_CASE_3_MULTIMODAL", "Art", "p", "f", raw, "u"), (2, "t2", "", "Art", "p", "f", "{broken", None)], "pos long, TASK_ID string, BATCH string, SUBJECT string, PROMPT string, FOLLOW_UP_PROMPT string, RUBRICS string, IMAGE_URL string")
    assert [(r.sample_id, r.use_case, r.is_multimodal, len(r.images)) for r in io.hosted_samples(rows).orderBy("pos").collect()] == [("t0", "assessment", False, 0), ("sample_0001", "active_learning", True, 1)]
    assert [io.hosted_samples(rows, **k).count() for k in ({"text_only": True}, {"use_case": "active_learning"}, {"subject": "ART"}, {"max_samples": 1})] == [1, 1, 1, 1]


def test_jsonl(spark, tmp_path):
    path = put(tmp_path / "a.jsonl", '{"sample_id": "a", "persona_name": "p"}\n\n{broken\n{"sample_id": "a", "persona_name": "p"}\n')
    assert io.jsonl(spark, path).count() == 2 and io.line_count(spark, path) == 4
    with pytest.raises((PySparkException, Py4JJavaError)):
        io.jsonl(spark, path, strict=True).collect()
    assert [r.key for r in io.done_keys(spark, path, ["sample_id", "persona_name"]).collect()] == ["a_p"]
    assert io.done_keys(spark, str(tmp_path / "none"), ["sample_id"]).count() == 0


def test_conversations(spark, tmp_path):
    (tmp_path / "v1").mkdir()
    put(tmp_path / "v1" / "one.json", {"metadata": {}, "conversation": [{"role": "user", "content": "x"}]})
    put(tmp_path / "v1" / "two.json", {"metadata": {"name": "named"}, "conversation": [{"role": "user", "content": "x"}]})
    put(tmp_path / "v1" / "empty.json", {"metadata": {}, "conversation": []})
    assert sorted((r.name, r.variant) for r in io.conversations(spark, str(tmp_path / "*" / "*.json")).collect()) == [("named", "v1"), ("one", "v1")]


def test_dialogues_and_questions(spark, tmp_path):
    turn = lambda end=None: {"system": "s", "user": "u"} | ({"END": end} if end else {})
    tree = {"p": {"question": "q", "dialogues": {"0": [turn(), turn("yes")], "1": [turn()]}}}
    assert sorted((r.dialogue_id, r.pos) for r in io.dialogues(spark, put(tmp_path / "d.json", tree)).collect()) == [("p_0", 0), ("p_0", 1)]
    strata = {"maths": {"7": {"responses": [{"question": "q", "options": ["a"], "answer_index": 0}, {"question": "no"}]}, "8": {"responses": []}}}
    assert [(r.category, r.question_id, r.question) for r in io.stratified_questions(spark, put(tmp_path / "s.json", strata)).collect()] == [("maths", "7", "q")]


def test_splits_and_fallback(spark, tmp_path):
    path = put(tmp_path / "t.json", '{"a": 1}\n')
    assert io.splits(spark, {"train": path}, "a int", ["train"])["train"].first().a == 1
    with pytest.raises(ValueError):
        io.splits(spark, {"train": path}, "a int", ["train", "test"])
    assert io.first_that_exists(spark, str(tmp_path / "no"), path) == path
    with pytest.raises(FileNotFoundError):
        io.first_that_exists(spark, str(tmp_path / "no"))


def test_config(tmp_path):
    path = str(tmp_path / "c.json")
    io.save_config({"a": "é"}, path)
    assert io.config(path) == {"a": "é"} and io.config(str(tmp_path / "no.json"), {}) == {}
    with pytest.raises(FileNotFoundError):
        io.config(str(tmp_path / "no.json"))
    assert io.template(put(tmp_path / "t.txt", "hello {name}"), name="you") == "hello you"


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", None, 1), ("b", "x\ny", 2)], "sample_id string, response string, pos int")
    io.write_json(rows, str(tmp_path / "j"))
    lines = [json.loads(x) for x in spark.read.text(str(tmp_path / "j")).toPandas()["value"]]
    assert sorted(x["sample_id"] for x in lines) == ["a", "b"] and any(x["response"] is None for x in lines)
    io.write_csv(rows, str(tmp_path / "c"))
    assert sorted(r.response or "" for r in io.csv(spark, str(tmp_path / "c"), "sample_id string, response string, pos int").collect()) == ["", "x\ny"]
    io.write_by(rows, str(tmp_path / "b"), "sample_id")
    assert spark.read.json(str(tmp_path / "b")).where("sample_id = 'b'").first().pos == 2
    scored = spark.createDataFrame([("a", [("c", 5, True, "e")])], "sample_id string, ratings array<struct<criterion:string,weight:int,passed:boolean,explanation:string>>")
    io.write_results(scored, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().weighted_score == 1.0
    io.concatenate(spark, [str(tmp_path / "j"), str(tmp_path / "none")], str(tmp_path / "all"), "sample_id string, response string, pos int")
    io.concatenate(spark, [str(tmp_path / "j")], str(tmp_path / "all"), "sample_id string, response string, pos int", append=True)
    assert spark.read.json(str(tmp_path / "all")).count() == 4
    io.write_debug_log(rows.select("sample_id", "response"), rows.select("sample_id", "pos"), str(tmp_path / "log"))
    assert {r.sample_id: r.pos for r in spark.read.json(str(tmp_path / "log")).collect()} == {"a": 1, "b": 2}
    nested = spark.createDataFrame([("a", (1, 2))], "id string, m struct<x:int,y:int>")
    assert io.flattened(nested, {"m": "m_"}).columns == ["id", "m_x", "m_y"]
