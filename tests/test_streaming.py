import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessella.sources import io, manifest, tables
from tessella.streaming import ledger, watch

ROW = "sample_id string, persona_name string, variation_idx int, weighted_score double, prompt string, response string"


def put(spark, path, *rows):
    spark.createDataFrame([(s, "p", 0, w, "q", r) for s, w, r in rows], ROW).coalesce(1).write.mode("append").json(path)


def answers(spark, out):
    return sorted(r.messages[-1].content for r in watch.exported(spark, out).collect())


@pytest.fixture
def places(tmp_path):
    return [str(tmp_path / x) for x in ("graded", "revised", "out", "ck")]


def run(spark, graded, revised, out, ck):
    watch.export(watch.growing(spark, graded), watch.growing(spark, revised), "system", out, ck).awaitTermination()


def test_two_growing_inputs_are_exported_once(spark, places):
    """Over restarts: each key once, a graded row before a revised one, scores below the threshold never."""
    graded, revised, out, ck = places
    put(spark, graded, ("a", 0.9, "a1"), ("b", 0.1, "b1"), (None, 0.9, "x"), ("d", 0.7, "low"), ("d", 0.8, "best"))
    put(spark, revised, ("a", 0.99, "a2"), ("c", 0.7, "c1"))
    run(spark, *places)
    assert answers(spark, out) == ["a1", "best", "c1"]
    put(spark, graded, ("c", 0.9, "c2"), ("e", 1.0, "e1"))
    put(spark, revised, ("b", 0.8, "b2"))
    run(spark, *places)
    assert answers(spark, out) == ["a1", "b2", "best", "c1", "e1"]
    run(spark, *places)
    assert answers(spark, out) == ["a1", "b2", "best", "c1", "e1"]
    assert sorted(r._key for r in tables.read(spark, f"{out}/keys").collect()) == sorted(r._key for r in watch.passing(spark.read.schema(io.RESPONSE).json(graded)).select("_key").union(watch.passing(spark.read.schema(io.RESPONSE).json(revised)).select("_key")).distinct().collect())
    once = watch.export_once(spark.read.schema(io.RESPONSE).json(graded), None, "system")
    assert sorted(r.messages[-1].content for r in once.collect()) == ["a1", "best", "c2", "e1", "low"]


@pytest.mark.parametrize("where", ["rows", "keys", "entry"])
def test_a_crash_anywhere_in_a_batch_loses_and_repeats_nothing(spark, places, monkeypatch, where):
    graded, revised, out, ck = places
    put(spark, graded, ("a", 0.9, "a1"))
    put(spark, revised, ("b", 0.9, "b1"))
    run(spark, *places)
    put(spark, graded, ("b", 0.9, "b2"), ("c", 0.9, "c1"))

    def die(*args, **kwargs):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        if where == "rows":
            m.setattr(ledger, "add", die)
        elif where == "keys":
            m.setattr(tables, "upsert", die)
        else:
            m.setattr(ledger, "enter", die)
        with pytest.raises(Exception, match="killed"):
            run(spark, *places)
    assert answers(spark, out) == ["a1", "b1"]
    run(spark, *places)
    assert answers(spark, out) == ["a1", "b1", "c1"]


def test_a_stage_counts_each_batch_once(spark, tmp_path, monkeypatch):
    """A job dies after it wrote a batch's rows and before its entry, and again after the entry and before Spark knew: all rows are there once."""
    source, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    kind = "k int, doubled int"

    def stage():
        rows = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).json(source)
        ledger.staged(rows, lambda b: b.withColumn("doubled", F.col("k") * 2), out, ck).awaitTermination()

    def more(*ks):
        spark.createDataFrame([(k,) for k in ks], "k int").coalesce(1).write.mode("append").json(source)

    more(1, 2)
    stage()
    more(3)
    inner = ledger.enter
    for after in (False, True):

        def die(*args, after=after):
            if after:
                inner(*args)
            raise RuntimeError("killed")

        with monkeypatch.context() as m:
            m.setattr(ledger, "enter", die)
            with pytest.raises(Exception, match="killed"):
                stage()
        assert sorted(r.k for r in ledger.committed(spark, out, kind).collect()) == ([1, 2, 3] if after else [1, 2])
    more(4)
    stage()
    assert sorted(map(tuple, ledger.committed(spark, out, kind).collect())) == [(1, 2), (2, 4), (3, 6), (4, 8)]


def test_folded_ledgers_name_all_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "FOLDED", 4)
    out = str(tmp_path / "out")
    assert ledger.committed(spark, out, "k int").count() == 0 and not ledger.has(spark, out, 0)
    for n in range(10):
        assert ledger.enter(spark, out, n, f"data/{n}")
    assert not ledger.enter(spark, out, 9, "data/other")
    assert ledger.folders(spark, out) == [f"data/{n}" for n in range(10)] and ledger.has(spark, out, 9)
    opened = []
    inner = manifest.read
    monkeypatch.setattr(manifest, "read", lambda *a: opened.append(a) or inner(*a))
    ledger.folders(spark, out)
    assert len(opened) == 3


TURN = "session_id string, at timestamp, turn_number int, teacher_action string, teacher_is_terminal boolean, student_final_answer string, judge_verdict boolean"


def minute(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)


def live(spark, tmp_path, batches, **limits):
    """The outcomes after each batch."""
    source, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    for rows in batches:
        spark.createDataFrame([(s, minute(m), *r) for s, m, *r in rows], TURN).coalesce(1).write.mode("append").json(source)
        stream = watch.sessions(spark.readStream.schema(TURN).json(source), **limits)
        stream.writeStream.format("json").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        rows = spark.read.schema(watch.OUTPUT.replace("ended_at long", "ended_at timestamp")).json(out).collect()
        seen.append(sorted(((r.session_id, r.total_turns, r.final_answer, r.initial_judge_verdict, r.final_judge_verdict, r.final_action, r.ended, round((r.ended_at - minute(0)).total_seconds() / 60)) for r in rows), key=str))
    return seen


def test_live_sessions(spark, tmp_path):
    """Ends by themselves, by force and by time, over restarts; turns behind an end are ignored while it is remembered, later ones begin anew."""
    first = [("a", 0, 0, None, False, "1", False), ("b", 0, 0, None, False, None, None), ("b", 1, 3, "GIVE_HINT", False, "7", True), ("i", 2, 0, "ASK", False, None, None), ("", 3, 0, None, False, None, None)]
    second = [("a", 2, 1, "END", True, None, None), ("a", 3, 2, "GIVE_HINT", False, "9", True), ("b", 4, 4, None, True, "8", None)]
    third = [("z", 200, 0, None, True, None, None)]
    fourth = [("a", 201, 0, "AGAIN", True, "new", True), ("i", 202, 0, None, True, None, None)]
    seen = live(spark, tmp_path, [first, second, third, fourth], max_turns=3, idle=1800, keep=3600)
    b, a = ("b", 3, "7", None, True, "GIVE_HINT", "forced", 1), ("a", 1, "1", False, False, "END", "natural", 2)
    assert seen[0] == [b] and seen[1] == [a, b]
    idle = [("", 0, None, None, None, None, "idle", 33), ("i", 0, None, None, None, "ASK", "idle", 32)]
    assert seen[2] == sorted([a, b, *idle, ("z", 0, None, None, None, None, "natural", 200)], key=str)
    assert seen[3] == sorted([*seen[2], ("a", 0, "new", True, True, "AGAIN", "natural", 201), ("i", 0, None, None, None, None, "natural", 202)], key=str)


def test_one_batch_or_many_give_the_same_sessions(spark, tmp_path):
    """Gaps within a batch end sessions as the passing of time between batches does."""
    turns = [("s", m, n, None, False, None, None) for n, m in enumerate((0, 10, 20, 70, 200, 210))] + [("s", 211, 0, None, True, None, None)]
    whole = live(spark, tmp_path / "whole", [turns], max_turns=99, idle=1800, keep=3600)[-1]
    parts = live(spark, tmp_path / "parts", [[t] for t in turns], max_turns=99, idle=1800, keep=3600)[-1]
    assert whole == parts == [("s", 2, None, None, None, None, "idle", 50), ("s", 5, None, None, None, None, "natural", 211)]
