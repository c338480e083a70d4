import time

import pytest
from pyspark.sql import functions as F

from tessella import providers
from tessella.plans import flows
from tessella.sources import io

ASK = f"id int, system_prompt string, messages array<{io.MESSAGE}>"


def test_providers_by_name(monkeypatch):
    assert providers.provider("echo")("s", [{"role": "user", "content": "x"}]) == "[1] x"
    with pytest.raises(KeyError, match="unknown provider 'none'"):
        providers.provider("none")
    monkeypatch.setitem(providers.REGISTRY, "loud", lambda mark="!": lambda system, messages: system + mark)
    assert providers.provider("loud", mark="?")("s", []) == "s?"


def test_retries_wait_longer_and_quotas_end_them():
    waits, calls = [], []

    def failing(text):
        def call(system, messages):
            calls.append(text)
            raise RuntimeError(text)

        return providers.with_retry(call, tries=4, base=1.0, cap=3.0, sleep=waits.append)

    with pytest.raises(RuntimeError, match="busy"):
        failing("busy")("", [])
    assert len(calls) == 4 and [int(w) for w in waits] == [1, 2, 3]
    with pytest.raises(RuntimeError):
        failing("quota is used up")("", [])
    assert calls.count("quota is used up") == 1


def test_a_bucket_fills_at_its_rate():
    limiter = providers.Limiter(50.0)
    began = time.monotonic()
    for _ in range(11):
        limiter.wait()
    assert 0.19 < time.monotonic() - began < 0.6
    assert limiter.due() > 0


def test_rows_come_back_with_all_columns_in_small_batches(spark, monkeypatch):
    """More rows than are handed on at a time; odd prompts, clashing names, failed calls and coroutines."""
    monkeypatch.setattr(providers, "FLUSH", 7)
    rows = [(i, None if i % 3 else "s", None if i % 5 == 0 else [("user", str(i))]) for i in range(40)]
    frame = spark.createDataFrame(rows, ASK).withColumn("error_code", F.lit(1))

    async def call(system, messages):
        if not messages:
            raise ValueError("nothing")
        return system + messages[0]["content"]

    got = {r.id: (r.response, r.error, r.error_code) for r in providers.respond(frame, call).collect()}
    assert got == {i: ("", "ValueError: nothing", 1) if i % 5 == 0 else (("" if i % 3 else "s") + str(i), None, 1) for i in range(40)}
    assert providers.respond(frame.limit(0), call).count() == 0


def test_grading_needs_rubrics(spark):
    rubric = "array<struct<criterion:string,weight:int,evaluation_dimension:string,tutoring_skill:string>>"
    responses = spark.createDataFrame([("a", "r", None), ("b", "r", None), ("c", "r", None)], "sample_id string, response string, error string")
    keyed = spark.createDataFrame([("a", [("x", 5, "style_tone", None), ("y", 1, "style_tone", None)]), ("b", [])], f"sample_id string, rubrics {rubric}")
    got = flows.graded(responses, keyed, lambda s, m: "JUDGMENT: PASS" if "Criterion: x" in m[0]["content"] else "JUDGMENT: FAIL").collect()
    assert [(r.sample_id, round(r.weighted_score, 4), r.critical_pass_rate, r.is_high_quality) for r in got] == [("a", 0.8333, 1.0, True)]
    assert [r.passed for r in flows.graded(responses, keyed).first().ratings] == [True, True]


def test_catalogues(spark):
    assert [tuple(r) for r in io.catalogue(spark, [("p", 1)], "persona_name string, n int").collect()] == [("p", 1)]
