"""Generation in phases that are kept: what each phase said is a row of a table, and a run goes on where the one before stopped.

Each phase is a stage over all tasks: those that have the phases before it and not yet this one are asked, and their answers put into the table before
the next phase begins. A phase that gives nothing ends its task for this run.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..functions import text
from ..operators import curation
from ..operators.staging import discarded, staged
from ..sources import tables

#: What a table of phases holds: the task's key, the phase, and what it said.
KEPT = "key string, phase string, said string"


@dataclass
class Phase:
    """``system`` and ``user`` make the prompts of a task's row, which has a column for each phase before this one."""

    name: str
    system: Callable[[DataFrame], Column]
    user: Callable[[DataFrame], Column]


def kept(tasks: DataFrame, path: str, names: list[str], key: list[str]) -> DataFrame:
    """The tasks with ``_key`` and a column for each phase, null where it hasn't said anything."""
    said = tables.read(tasks.sparkSession, path, KEPT).where(F.col("phase").isin(names)).groupBy("key").pivot("phase", names).agg(F.first("said"))
    return tasks.withColumn("_key", text.key(*key)).join(said.withColumnRenamed("key", "_key"), "_key", "left")


def generated(tasks: DataFrame, phases: list[Phase], call: providers.Call, path: str, key: list[str] = curation.FULL_KEY, buckets: int = 64, **limits) -> DataFrame:
    """The tasks with a column for each phase, and ``response``, what the last one said; null from the phase on that gave nothing.

    ``path``: the table of phases. A second run asks only for what is missing, so nothing is generated twice; tasks with one key are asked
    once. ``limits``: as of ``providers.respond``.
    """
    spark, names = tasks.sparkSession, [p.name for p in phases]
    for i, p in enumerate(phases):
        rows = kept(tasks, path, names[: i + 1], key)
        ready = rows.where(F.col(p.name).isNull()).where(" AND ".join(f"`{n}` IS NOT NULL" for n in names[:i]) or "true").dropDuplicates(["_key"])
        asked = ready.select("_key", p.system(ready).alias("system_prompt"), F.array(F.struct(F.lit("user").alias("role"), p.user(ready).alias("content"))).alias("messages"))
        said = staged(providers.respond(asked, call, **limits).select(F.col("_key").alias("key"), F.lit(p.name).alias("phase"), F.col("response").alias("said")), "phase")
        tables.upsert(spark, path, said.where("length(said) > 0"), ["key", "phase"], buckets=buckets)
        discarded(said)
    return kept(tasks, path, names, key).drop("_key").withColumn("response", F.col(names[-1]))


def analysed(tasks: DataFrame, call: providers.Call, system: str, user: Column, subjects: list[str] = curation.BRANCHING_SUBJECTS, **limits) -> DataFrame:
    """The tasks with student_method, student_method_description, alternative_methods and should_branch of their sample.

    Each sample of the subjects is asked once, however many tasks it has; a call that fails or can't be read gives no method and no branch. Samples of other subjects aren't asked.
    """
    samples = curation.branching(tasks, subjects).withColumn("_user", user).groupBy("sample_id").agg(F.min("_user").alias("_user"))
    asked = samples.select("sample_id", F.lit(system).alias("system_prompt"), F.array(F.struct(F.lit("user").alias("role"), F.col("_user").alias("content"))).alias("messages"))
    said = staged(providers.respond(asked, call, **limits).select("sample_id", F.when(F.col("error").isNull(), text.method_analysis(F.col("response"))).alias("_m")), "analysed")
    found = said.select("sample_id", "_m.*")
    out = tasks.join(found, "sample_id", "left")
    return out.withColumn("should_branch", F.coalesce("should_branch", F.lit(False)))
