"""Model calls as injectable providers, run over Arrow batches inside tasks.

A provider is a plain function (system prompt, messages) -> text, sync or async. A rate holds for a whole job: its calls go through
a fixed number of lanes, each with its share. Retries happen in the provider, not by Spark's task retry, and the
output of a call should be written before two branches read it.
"""

from __future__ import annotations

import asyncio
import inspect
import random
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Call = Callable[[str, list[dict]], str]
FATAL = ("quota", "credit", "billing")


class Pipeline(Protocol):
    """What turns a sample's prompt and messages into a response."""

    def __call__(self, system: str, messages: list[dict]) -> str: ...


def echo(system: str, messages: list[dict]) -> str:
    """The deterministic default: says the last message back."""
    return f"[{len(messages)}] {messages[-1]['content'] if messages else system}"


REGISTRY: dict[str, Callable[..., Call]] = {"echo": lambda **_: echo}


def provider(name: str, **options) -> Call:
    if name not in REGISTRY:
        raise KeyError(f"unknown provider {name!r}; known: {sorted(REGISTRY)}")
    return REGISTRY[name](**options)


@dataclass
class Limiter:
    """Token bucket of one lane."""

    per_second: float
    burst: float = 1.0
    level: float = field(default=1.0, init=False)
    at: float = field(default_factory=time.monotonic, init=False)

    def due(self) -> float:
        """Takes the next call and tells how long to wait for it."""
        now = time.monotonic()
        self.level = min(self.burst, self.level + (now - self.at) * self.per_second) - 1
        self.at = now
        return max(0.0, -self.level / self.per_second)

    def wait(self) -> None:
        time.sleep(self.due())


def with_retry(call: Call, tries: int = 5, base: float = 2.0, cap: float = 120.0, sleep: Callable[[float], None] = time.sleep) -> Call:
    """Doubling waits with jitter; errors about quota fail at once; the last failure is raised."""

    def run(system: str, messages: list[dict]) -> str:
        for k in range(tries):
            try:
                return call(system, messages)
            except Exception as e:
                if k == tries - 1 or any(w in str(e).lower() for w in FATAL):
                    raise
                sleep(min(cap, base * 2**k + random.random()))
        raise AssertionError

    return run


#: Lanes of a job's calls where a rate is asked for, and how many rows a lane answers before it hands them on.
LANES, FLUSH = 8, 64


def respond(samples: DataFrame, call: Call, rate: float | None = None, concurrency: int = 8, lanes: int = LANES, by: str | None = None) -> DataFrame:
    """Adds ``response`` and ``error`` to rows with system_prompt and messages. A failed row stays, with an empty response.

    ``rate``: calls a second of the whole job. Its rows then go through ``lanes`` partitions, each of which makes its share of the calls a second, so that the rate holds
    whatever number of tasks run at a time; with fewer than there are lanes it isn't reached. ``by`` (an API key, say) keeps a key's rows in one lane. Up to ``concurrency`` calls
    of a task run at once, as coroutines or threads.
    """
    share = rate / lanes if rate else None
    schema = samples.select("*", F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error")).schema
    if rate:
        samples = samples.repartition(lanes, by) if by else samples.repartition(lanes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limiter = Limiter(share) if share else None
        turn = threading.Lock()

        def one(row: dict) -> tuple[str, str | None]:
            if limiter:
                with turn:
                    limiter.wait()
            try:
                return call(row["system_prompt"] or "", row["messages"] or []), None
            except Exception as e:
                return "", f"{type(e).__name__}: {e}"

        async def each(rows: list[dict]) -> list[tuple[str, str | None]]:
            gate, order = asyncio.Semaphore(concurrency), asyncio.Lock()

            async def own(row: dict) -> tuple[str, str | None]:
                async with gate:
                    if limiter:
                        async with order:
                            await asyncio.sleep(limiter.due())
                    try:
                        return await call(row["system_prompt"] or "", row["messages"] or []), None
                    except Exception as e:
                        return "", f"{type(e).__name__}: {e}"

            return list(await asyncio.gather(*map(own, rows)))

        with ThreadPoolExecutor(concurrency) as pool:
            for whole in batches:
                for at in range(0, len(whole), FLUSH):
                    b = whole.slice(at, FLUSH)
                    rows = b.select(["system_prompt", "messages"]).to_pylist()
                    out = asyncio.run(each(rows)) if inspect.iscoroutinefunction(call) else list(pool.map(one, rows))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string())], [*b.schema.names, "response", "error"])

    return samples.mapInArrow(run, schema)


def judged(responses: DataFrame, judge: Call | None) -> DataFrame:
    """``ratings``: the rubrics of each row with passed and explanation; without a judge all pass, a failed call fails the rubric.

    Rows are rated each on their own, whatever ids they repeat. The responses are written before they are judged, and the verdicts before
    they are gathered, so that a response is judged as it stays and every call is made once.
    """
    from .functions import text
    from .operators.staging import staged

    responses = staged(responses.withColumn("_row", F.monotonically_increasing_id()), "responses")
    exploded = responses.select("*", F.posexplode("rubrics").alias("_i", "_r"))
    if judge is None:
        rated = exploded.withColumn("_v", F.struct(F.lit(True).alias("passed"), F.lit("mock").alias("explanation")))
    else:
        asked = exploded.withColumns({"system_prompt": F.lit(""), "messages": F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Criterion: "), "_r.criterion", F.lit("\nResponse: "), "response").alias("content")))}).drop("error").withColumnRenamed("response", "_response")
        said = staged(respond(asked, judge), "verdicts")
        rated = said.withColumn("_v", F.when(F.col("error").isNull(), text.judgement(F.col("response"))).otherwise(F.struct(F.lit(False).alias("passed"), F.col("error").alias("explanation"))))
    item = F.struct("_i", F.col("_r.criterion").alias("criterion"), F.col("_r.weight").alias("weight"), F.col("_r.evaluation_dimension").alias("evaluation_dimension"), F.col("_r.tutoring_skill").alias("tutoring_skill"), F.col("_v.passed").alias("passed"), F.col("_v.explanation").alias("explanation"))
    grouped = rated.groupBy("_row").agg(F.array_sort(F.collect_list(item)).alias("ratings"))
    return responses.join(grouped, "_row", "left").drop("_row")


def best_of(call: Call, select: Callable[[list[str]], int], n: int) -> Call:
    """Generates n responses and returns the selected one."""

    def run(system: str, messages: list[dict]) -> str:
        texts = [call(f"{system}\n(candidate {i + 1})", messages) for i in range(n)]
        return texts[max(0, min(n - 1, select(texts)))]

    return run


def chain(call: Call, stages: list[str]) -> Call:
    """Stages that each see the outputs before; the last one's output is the response, an empty one ends the chain with nothing."""

    def run(system: str, messages: list[dict]) -> str:
        said: list[str] = []
        for s in stages:
            out = call(f"{system}\n{s}", [*messages, *({"role": "assistant", "content": t} for t in said)])
            if not out:
                return ""
            said.append(out)
        return said[-1] if said else ""

    return run


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Calls, failed ones, and characters sent and received, of rows that ``respond`` gave."""
    sent = F.length(F.coalesce("system_prompt", F.lit(""))) + F.coalesce(F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(F.coalesce(m["content"], F.lit("")))), F.lit(0))
    return calls.groupBy(*keys).agg(F.count("*").alias("n_calls"), F.count("error").alias("n_failed"), F.sum(sent).alias("chars_sent"), F.sum(F.length("response")).alias("chars_received"))


def single_or_chain(samples: DataFrame, single: Call, stages: Call) -> DataFrame:
    """Both responses of each sample: ``single``, ``chained`` and which one is longer."""
    one = respond(samples, single).withColumnRenamed("response", "single").withColumnRenamed("error", "single_error")
    both = respond(one, stages).withColumnRenamed("response", "chained").withColumnRenamed("error", "chained_error")
    return both.withColumn("longer", F.when(F.length("chained") > F.length("single"), "chained").otherwise("single"))
