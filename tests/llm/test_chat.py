import json

from tessella.llm import chat


def test_log(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", "first question"), (1, 2, "assistant", 'an "answer"\n'), (1, 3, "user", "second"), (1, 5, "user", ""), (1, 6, "assistant", None)]
    rows += [(2, 0, "assistant", "orphan"), (2, 1, "user", "twice"), (2, 1, "user", "twice"), (2, 2, "assistant", "x"), (None, None, None, None), (3, 1, "user", None), (4, 0, "user", "a b " * 1500), (4, 1, "user", "next")]
    log = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS status", "1 AS level")
    got = chat.formatted(log).collect()
    assert len(got) == len(rows)
    by = {(r.conv_id, r.turn): r for r in got}
    assert (by[1, 1].status, by[1, 1].level, by[1, 1].errors) == ("linked", 0, "")
    assert by[1, 1].canonical == '{"arguments":{"prompt":"first question","words":2},"id":"call:1:1","name":"ask","needs":[]}'
    assert (by[1, 3].status, by[1, 3].level) == ("missing", 1) and json.loads(by[1, 3].canonical)["needs"] == ["call:1:1"]
    assert (by[1, 5].level, by[1, 5].errors) == (2, "range of prompt; range of words")
    assert by[1, 2].canonical == '{"call_id":"call:1:1","content":"an \\"answer\\"\\n"}' and by[1, 6].status == "linked"
    assert by[2, 0].status == "orphan" and by[2, 1].status == by[2, 2].status == "ambiguous"
    assert by[None, None].kind == "message" and by[3, 1].errors.startswith("range")
    assert by[4, 0].errors == "range of prompt" and by[4, 1].level == 1
    assert chat.formatted(log.limit(0)).count() == 0


def test_linking(spark):
    calls = [("a", "f", '{"y":1.5,"x":2}', []), ("b", "f", '{"x":"two"}', ["a"]), ("c", "f", "{bad", ["a", "b", "z"]), ("d", "g", "{}", None), ("p", "f", '{"x":1}', ["q"]), ("q", "f", '{"x":-1}', ["p"]), (None, "f", None, ["a"])]
    schema = {"f": (chat.Field("x", "bigint", True, 0, 9), chat.Field("y", "double", False))}
    got, out = chat.linked(spark.createDataFrame(calls, "call_id string, name string, arguments string, needs array<string>"), spark.createDataFrame([("a", "ok"), ("zz", "no")], "call_id string, content string"), schema)
    by = {r.call_id: r for r in got.collect()}
    assert {k: r.level for k, r in by.items()} == {"a": 0, "b": 1, "c": 2, "d": 0, "p": None, "q": None, None: None}
    assert {k: r.errors for k, r in by.items()} == {"a": [], "b": ["type of x"], "c": ["not JSON", "no call z"], "d": ["unknown tool"], "p": [], "q": ["range of x"], None: ["not JSON"]}
    assert by["a"].canonical == '{"arguments":{"x":2,"y":1.5},"id":"a","name":"f","needs":[]}' and by["a"].status == "linked" and by["b"].status == "missing"
    assert {r.call_id: r.status for r in out.collect()} == {"a": "linked", "zz": "orphan"}


def test_levels_agree(spark):
    """A chain by doubling, and the same chain by peeling once a second dependency is there."""
    nodes = spark.range(37).selectExpr("cast(id as string) AS call_id")
    chain = spark.range(1, 37).selectExpr("cast(id as string) AS call_id", "cast(id - 1 as string) AS needs")
    assert {int(r.call_id): r.level for r in chat.levels(nodes, chain).collect()} == {i: i for i in range(37)}
    short = chain.where("int(call_id) < 6").union(spark.sql("SELECT '5' AS call_id, '1' AS needs"))
    assert {int(r.call_id): r.level for r in chat.levels(nodes.where("int(call_id) < 6"), short).collect()} == {i: i for i in range(6)}
