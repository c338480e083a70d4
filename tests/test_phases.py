import time

import pytest
from pyspark.sql import functions as F

from tessella import providers
from tessella.plans import phases
from tessella.sources import io, tables

ASK = f"id int, system_prompt string, messages array<{io.MESSAGE}>"


def steps(*names):
    def user(i):
        return lambda rows: F.col(names[i - 1]) if i else F.col("prompt")

    return [phases.Phase(n, lambda rows, n=n: F.lit(n), user(i)) for i, n in enumerate(names)]


def test_runs_go_on_where_one_stopped(spark, tmp_path):
    """A phase that fails or says nothing ends its task; the next run asks for what is missing only."""
    log, path = tmp_path / "calls", str(tmp_path / "phases")
    well = tmp_path / "well"

    def model(system, messages):
        with log.open("a") as f:
            f.write(f"{system} {messages[0]['content']}\n")
        if messages[0]["content"] == "one:b" and not well.exists():
            raise ValueError("down")
        return "" if messages[0]["content"] == "c" else f"{system}:{messages[0]['content'][-1]}"

    tasks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("c", 3)], "prompt string, n int")
    run = lambda: sorted(tuple(r) for r in phases.generated(tasks, steps("one", "two", "three"), model, path, ["n"]).select("n", F.coalesce("one", F.lit("-")), F.coalesce("two", F.lit("-")), F.coalesce("response", F.lit("-"))).collect())
    assert run() == [(1, "one:a", "two:a", "three:a"), (2, "one:b", "-", "-"), (3, "-", "-", "-"), (3, "-", "-", "-")]
    assert sorted(log.read_text().split("\n")[:-1]) == ["one a", "one b", "one c", "three two:a", "two one:a", "two one:b"]
    well.touch()
    log.write_text("")
    assert run()[:2] == [(1, "one:a", "two:a", "three:a"), (2, "one:b", "two:b", "three:b")]
    assert sorted(log.read_text().split("\n")[:-1]) == ["one c", "three two:b", "two one:b"]
    assert {(r.key, r.phase) for r in tables.read(spark, path).collect()} == {(k, p) for k in "12" for p in ("one", "two", "three")}
    assert phases.generated(tasks.limit(0), steps("one"), model, path, ["n"]).count() == 0


def test_analysis_asks_once_a_sample(spark, tmp_path):
    log = tmp_path / "calls"

    def model(system, messages):
        with log.open("a") as f:
            f.write("x")
        if messages[0]["content"] == "q2":
            raise ValueError
        return "STUDENT_METHOD: chain rule\nSTUDENT_METHOD_DESCRIPTION: d\nALTERNATIVE_METHODS: parts\nSHOULD_BRANCH: yes"

    rows = [("s1", "Calculus", "q1")] * 3 + [("s2", "Physics", "q2"), ("s3", "History", "q3")]
    got = phases.analysed(spark.createDataFrame(rows, "sample_id string, subject string, prompt string"), model, "s", F.col("prompt")).collect()
    assert sorted((r.sample_id, r.student_method, r.should_branch) for r in got if r.sample_id != "s1") == [("s2", None, False), ("s3", None, False)]
    assert [(r.student_method, r.alternative_methods, r.should_branch) for r in got if r.sample_id == "s1"] == [("chain rule", ["parts"], True)] * 3
    assert len(log.read_text()) == 2


@pytest.mark.parametrize("kind", ["threads", "coroutines"])
@pytest.mark.parametrize("lanes", [2, 4, 8])
def test_a_rate_holds_for_the_job(spark, kind, lanes):
    """30 calls at 20 a second, through fewer, as many and more lanes than tasks that run: never faster, and with no lane waiting for a task not much slower."""

    def plain(system, messages):
        return str(time.time())

    async def waiting(system, messages):
        return str(time.time())

    frame = spark.createDataFrame([(i, "", [("user", str(i))]) for i in range(30)], ASK)
    said = sorted(float(r.response) for r in providers.respond(frame, plain if kind == "threads" else waiting, rate=20, lanes=lanes).collect())
    assert len(said) == 30
    for i in range(30):
        assert sum(said[i] <= t < said[i] + 1 for t in said) <= 20 + lanes  # each lane may begin with a call
    if lanes <= 4:
        assert said[-1] - said[0] < 6


def test_calls_of_a_task_run_at_once(spark):
    def slow(system, messages):
        time.sleep(0.2)
        return "x"

    frame = spark.createDataFrame([(i, "", [("user", str(i))]) for i in range(32)], ASK).coalesce(1)
    began = time.time()
    assert providers.respond(frame, slow, concurrency=16).count() == 32
    assert time.time() - began < 4


def test_a_key_keeps_its_lane(spark):
    frame = spark.createDataFrame([(i % 3, "", [("user", str(i))]) for i in range(30)], ASK)
    out = providers.respond(frame, providers.echo, rate=1000, lanes=4, by="id").withColumn("lane", F.spark_partition_id())
    assert out.groupBy("id").agg(F.countDistinct("lane").alias("n")).where("n > 1").count() == 0
