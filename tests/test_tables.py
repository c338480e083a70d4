import threading

import pytest

from tessella import providers
from tessella.sources import io, manifest, tables

KIND = "k string, n long, at int"


def rows(spark, *values):
    return spark.createDataFrame(values, KIND)


def content(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def buckets(spark, path, version):
    return manifest.read(spark, path, version)["files"]


def test_upsert_writes_only_its_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.read(spark, path, KIND).count() == 0
    with pytest.raises(FileNotFoundError):
        tables.read(spark, path)
    first = spark.range(500).selectExpr("cast(id AS string) AS k", "id AS n", "1 AS at")
    assert tables.upsert(spark, path, first, ["k"], buckets=16) == 1
    assert tables.upsert(spark, path, rows(spark, ("7", 70, 2), ("7", 71, 3), ("x", 1, 1), (None, 5, 1)), ["k"], "at") == 2
    before, after = buckets(spark, path, 1), buckets(spark, path, 2)
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(before) == 16 and 1 <= len(changed) <= 3
    assert content(tables.read(spark, path)) == sorted([(str(i), i, 1) for i in range(500) if i != 7] + [("7", 71, 3), ("x", 1, 1), (None, 5, 1)], key=str)
    assert content(tables.read(spark, path, key={"k": "7"})) == [("7", 71, 3)] and content(tables.read(spark, path, key={"k": None})) == [(None, 5, 1)]
    assert tables.upsert(spark, path, rows(spark, (None, 6, 1)), ["k"]) == 3 and content(tables.read(spark, path, key={"k": None})) == [(None, 6, 1)]
    assert tables.upsert(spark, path, first.limit(0), ["k"]) == 3
    # Columns by name: others are left out, missing ones are null.
    tables.upsert(spark, path, spark.createDataFrame([("x", "y")], "k string, other string"), ["k"])
    assert content(tables.read(spark, path, key={"k": "x"})) == [("x", None, None)]


def test_readers_keep_their_version_until_it_is_vacuumed(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.upsert(spark, path, rows(spark, ("a", 1, 1), ("b", 2, 1)), ["k"], buckets=4)
    old = tables.read(spark, path)
    tables.upsert(spark, path, rows(spark, ("a", 9, 2)), ["k"])
    assert tables.clear(spark, path) == 3
    assert content(old) == [("a", 1, 1), ("b", 2, 1)] and tables.read(spark, path).count() == 0
    tables.upsert(spark, path, rows(spark, ("c", 3, 1)), ["k"])
    assert content(tables.read(spark, path)) == [("c", 3, 1)]
    assert tables.vacuum(spark, path, 1) >= 2 and content(tables.read(spark, path)) == [("c", 3, 1)]
    assert manifest.numbers(spark, path) == [4]


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    """One commits while the other writes: the second begins anew on what the first left."""
    path = str(tmp_path / "t")
    tables.upsert(spark, path, rows(spark, ("a", 1, 1)), ["k"], buckets=2)
    inner, state = manifest.commit, {"first": True}

    def late(s, folder, number, what):
        if state.pop("first", False):
            other = threading.Thread(target=lambda: tables.upsert(spark, path, rows(spark, ("b", 2, 1)), ["k"]))
            other.start()
            other.join()
        return inner(s, folder, number, what)

    monkeypatch.setattr(manifest, "commit", late)
    assert tables.upsert(spark, path, rows(spark, ("c", 3, 1)), ["k"]) == 3
    assert content(tables.read(spark, path)) == [("a", 1, 1), ("b", 2, 1), ("c", 3, 1)]


def test_a_dead_writer_leaves_nothing_to_see(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    tables.upsert(spark, path, rows(spark, ("a", 1, 1)), ["k"])

    def die(*args):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(manifest, "commit", die)
        with pytest.raises(OSError):
            tables.upsert(spark, path, rows(spark, ("a", 2, 1)), ["k"])
    assert content(tables.read(spark, path)) == [("a", 1, 1)]
    assert tables.vacuum(spark, path) == 1 and content(tables.read(spark, path)) == [("a", 1, 1)]


def test_calls_are_cached(spark, tmp_path):
    path, log = str(tmp_path / "cache"), tmp_path / "calls"

    def model(system, messages):
        with log.open("a") as f:
            f.write("x")
        if messages[0]["content"] == "bad":
            raise ValueError
        return messages[0]["content"].upper()

    ask = lambda *said: spark.createDataFrame([(s, "", [("user", s)]) for s in said], f"cache_key string, system_prompt string, messages array<{io.MESSAGE}>")
    call = lambda frame: providers.respond(frame, model)
    got = tables.answered(ask("a", "b", "b", "bad"), path, call, io.CACHE)
    assert sorted((r.cache_key, r.response) for r in got.collect()) == [("a", "A"), ("b", "B"), ("b", "B"), ("bad", None)]
    assert len(log.read_text()) == 3
    got = tables.answered(ask("b", "c"), path, call, io.CACHE)
    assert sorted((r.cache_key, r.response) for r in got.collect()) == [("b", "B"), ("c", "C")] and len(log.read_text()) == 4
    tables.clear(spark, path)
    assert tables.answered(ask("b"), path, call, io.CACHE).first().response == "B" and len(log.read_text()) == 5


def test_leaderboard_rows_are_replaced_by_run(spark, tmp_path):
    path = str(tmp_path / "board")
    run = lambda *r: spark.createDataFrame([r], "run_id string, overall_score double")
    for r in (("a", 0.5), ("b", 0.7), ("a", 0.9)):
        tables.upsert(spark, path, run(*r), ["run_id"], buckets=1)
    assert [tuple(r) for r in tables.read(spark, path).orderBy("run_id").collect()] == [("a", 0.9), ("b", 0.7)]
