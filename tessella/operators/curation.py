"""Curation of generated responses: grids, filters, shortfalls, unions, training rows, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import quantiles
from .staging import dealt, staged

# Thresholds, histogram edges, the score of ungraded revisions, subjects with methods to branch on.
CRITICAL, OVERALL, MIN_PASS, UNGRADED = 0.70, 0.70, 0.25, 0.80
#: Upper edges of the score histogram; a score falls to the first edge that is not below it.
EDGES = [0.80, 0.85, 0.90, 0.95, 1.00]
BRANCHING_SUBJECTS = ["Calculus", "Physics"]
#: Rows of a catalogue that is sent to every task, at most.
CATALOGUE = 10_000
LEGACY_KEY = ["sample_id", "persona_name"]
FULL_KEY = [*LEGACY_KEY, "variation_idx"]


def grid(samples: DataFrame, personas: DataFrame, variations: int) -> DataFrame:
    """Every sample with every persona and variation. Personas are a catalogue that goes to every task: one of over CATALOGUE rows is an error."""
    if personas.limit(CATALOGUE + 1).count() > CATALOGUE:
        raise ValueError(f"more than {CATALOGUE} personas")
    return samples.crossJoin(F.broadcast(personas)).withColumn("variation_idx", F.explode(F.sequence(F.lit(0), F.lit(variations - 1))))


def branched_grid(samples: DataFrame, personas: DataFrame, methods: DataFrame, variations: int, own: list[str], alternative: str) -> DataFrame:
    """The grid with a method per persona: ``own`` personas keep the student's, ``alternative`` takes the first other one."""
    tasks = grid(samples, personas, variations).join(methods, "sample_id", "left")
    branch, other = F.coalesce("should_branch", F.lit(False)), F.get("alternative_methods", F.lit(0))
    constraint = F.when(branch & F.col("persona_name").isin(own), F.col("student_method")).when(branch & (F.col("persona_name") == alternative) & (F.size("alternative_methods") > 0), other)
    described = F.when(F.col("persona_name").isin(own), F.coalesce(F.nullif("student_method_description", F.lit("")), constraint)).otherwise(constraint)
    out = tasks.withColumns({"method_constraint": constraint})
    return out.withColumn("method_description", F.when(F.col("method_constraint").isNotNull(), described)).drop("student_method", "alternative_methods", "should_branch", "student_method_description")


def branching(samples: DataFrame, subjects: list[str] = BRANCHING_SUBJECTS) -> DataFrame:
    """Samples of subjects whose methods are analysed for alternatives."""
    return samples.where(F.col("subject").isin(subjects))


def resumed(tasks: DataFrame, done: DataFrame, key: list[str] = FULL_KEY) -> DataFrame:
    return tasks.join(done.select(*key).distinct(), key, "left_anti")


def passes(critical: float = CRITICAL, overall: float = OVERALL) -> tuple[Column, Column]:
    return F.coalesce("critical_pass_rate", F.lit(0.0)) >= critical, F.coalesce("weighted_score", F.lit(0.0)) >= overall


def filtered(responses: DataFrame, critical: float = CRITICAL, overall: float = OVERALL) -> DataFrame:
    a, b = passes(critical, overall)
    return responses.where(a & b)


def attrition(responses: DataFrame, *keys: str, critical: float = CRITICAL, overall: float = OVERALL) -> DataFrame:
    """Counts of the two-tier filter; a row that fails both counts as failing the critical tier."""
    a, b = passes(critical, overall)
    return responses.groupBy(*keys).agg(F.count("*").alias("n_input"), F.count_if(~a).alias("failed_critical"), F.count_if(a & ~b).alias("failed_overall"), F.count_if(a & b).alias("passed"))


def rejected(responses: DataFrame, kept: DataFrame, key: list[str] = FULL_KEY, critical: float = CRITICAL, overall: float = OVERALL) -> DataFrame:
    a, b = passes(critical, overall)
    reason = F.when(~a, "failed_critical").when(~b, "failed_overall").otherwise("diversity_filtered")
    return responses.join(kept.select(*key).distinct(), key, "left_anti").withColumn("rejection_reason", reason)


def best_of(responses: DataFrame, k: int = 1, key: list[str] = LEGACY_KEY) -> DataFrame:
    """The k best of each group by score, ties by position."""
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("weighted_score"), "pos"))
    return responses.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def shortfall(responses: DataFrame, critical: float = CRITICAL, overall: float = OVERALL, min_pass: float = MIN_PASS) -> DataFrame:
    """The best failing rows of each sample, as many as it lacks of max(1, floor(min_pass * rows)) passing ones.

    Counts come from a partial aggregation, so a large sample is not a task's window; they also say over how many tasks the failing rows are sorted.
    """
    a, b = passes(critical, overall)
    counts = staged(responses.groupBy("sample_id").agg(F.greatest(F.lit(1), F.floor(F.count("*") * F.lit(min_pass))).alias("_need"), F.count_if(a & b).alias("_ok"), F.count("*").alias("_all")), "counts")
    failing = counts.agg(F.sum(F.col("_all") - F.col("_ok"))).first()[0] or 0
    lacking = counts.where("_need > _ok").select("sample_id", (F.col("_need") - F.col("_ok")).alias("shortfall"))
    order = Window.partitionBy("sample_id").orderBy(F.desc(F.coalesce("weighted_score", F.lit(0.0))), F.desc(F.coalesce("critical_pass_rate", F.lit(0.0))), "pos")
    # Ranked before they are joined, so that a task sorts its rows once: the join takes them in the ranks' order.
    ranked = dealt(responses.where(~(a & b)), failing, "sample_id").withColumn("revision_rank", F.row_number().over(order))
    return ranked.join(lacking, "sample_id").where("revision_rank <= shortfall").select(*responses.columns, "shortfall", "revision_rank")


def failed_criteria(results: Column, missing_passes: bool = True) -> Column:
    """Failed ones of an array of rubric results; a missing outcome counts as passed, or else as failed."""
    kept = F.filter(results, lambda r: ~F.coalesce(r["passed"], F.lit(missing_passes)))
    return F.transform(kept, lambda r: F.struct(r["criterion"].alias("criterion"), r["weight"].alias("weight"), r["severity"].alias("severity"), r["explanation"].alias("explanation")))


def revision_tasks(responses: DataFrame, **limits) -> DataFrame:
    rows = shortfall(responses, **limits).withColumn("failed_criteria", failed_criteria(F.col("rubric_results")))
    return rows.where(F.size("failed_criteria") > 0).withColumn("failed_criteria_count", F.size("failed_criteria"))


def combined(graded: DataFrame, revised: DataFrame) -> DataFrame:
    """Originals and revisions; revisions carry placeholder scores, as they are not graded again."""
    marks = {"weighted_score": F.lit(UNGRADED), "pass_rate": F.lit(UNGRADED), "critical_pass_rate": F.lit(UNGRADED), "is_high_quality": F.lit(True), "is_revision": F.lit(True)}
    return graded.unionByName(revised.withColumns(marks), allowMissingColumns=True)


def chat_row(system: str, user: Column, answer: Column) -> Column:
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user), turn("assistant", answer))


def student_view() -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("Question: "), "prompt"), F.concat(F.lit("Previous Explanation: "), "initial_explanation"), F.concat(F.lit("Student's Follow-up: "), "follow_up"))


def training_rows(responses: DataFrame, system: str, metadata: bool = False) -> DataFrame:
    extra = [F.struct("sample_id", "persona_name", "subject", "weighted_score", "critical_pass_rate").alias("metadata")] if metadata else []
    return responses.select(chat_row(system, student_view(), F.col("response")).alias("messages"), *extra)


def explained(responses: DataFrame) -> DataFrame:
    """``explanation``: scores of a good row, or scores and up to three failed critical criteria of a bad one."""
    failed = F.slice(F.filter(F.coalesce("rubric_results", F.array().cast("array<struct<criterion:string,weight:int,passed:boolean>>")), lambda r: ~F.coalesce(r["passed"], F.lit(False)) & (F.abs(r["weight"]) == 5)), 1, 3)
    listed = F.nullif(F.array_join(F.transform(failed, lambda r: r["criterion"]), "; "), F.lit(""))
    a, b = passes()
    scores = [F.concat(F.lit("score "), text.percent(F.col("weighted_score"))), F.concat(F.lit("critical "), text.percent(F.col("critical_pass_rate")))]
    return responses.withColumn("explanation", F.concat_ws("; ", *scores, F.when(~(a & b), F.concat(F.lit("failed: "), listed))))


def histogram(scores: DataFrame, column: str = "weighted_score", edges: list[float] = EDGES) -> DataFrame:
    """Counts for every edge, empty ones too; scores over the last edge are left out."""
    edge = F.coalesce(*[F.when(F.col(column) <= e, F.lit(e)) for e in edges])
    every = scores.sparkSession.createDataFrame([(e,) for e in edges], "edge double")
    return every.join(scores.groupBy(edge.alias("edge")).count(), "edge", "left").select("edge", F.coalesce("count", F.lit(0)).alias("n"))


def top_failures(results: DataFrame, k: int = 20) -> DataFrame:
    """Commonest failed criteria by their first 100 characters, ties by text, over exploded rubric results."""
    return results.where(~F.coalesce("passed", F.lit(False))).groupBy(F.substring("criterion", 1, 100).alias("criterion")).count().orderBy(F.desc("count"), "criterion").limit(k)


def quality_report(good: DataFrame, *keys: str) -> DataFrame:
    s = F.col("weighted_score")
    aggregates = [F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg("critical_pass_rate").alias("critical_pass_rate")]
    return quantiles.summarised(good.select(*keys, "weighted_score", "critical_pass_rate"), list(keys), "weighted_score", *aggregates)


def filter_statistics(evaluated: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Kept share (strictly above the threshold), quality histogram over 1 to 5, and the first ten strengths in order."""
    ok = F.col("critical_pass_rate") > threshold
    marks = [F.count_if(F.col("overall_quality_score") == q).alias(f"quality_{q}") for q in range(1, 6)]
    strengths = evaluated.select(F.explode("strengths").alias("s")).distinct().orderBy("s").limit(10).agg(F.array_sort(F.collect_list("s")).alias("common_strengths"))
    one = evaluated.agg(F.count("*").alias("n_total"), F.count_if(ok).alias("n_kept"), (F.count_if(ok) / F.nullif(F.count("*"), F.lit(0))).alias("keep_rate"), F.avg("critical_pass_rate").alias("mean_critical"), F.avg("overall_quality_score").alias("mean_quality"), *marks)
    return one.join(strengths)  # one row each


def leaderboard(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows replaced by run_id or appended, best first."""
    return existing.join(new.select("run_id").distinct(), "run_id", "left_anti").unionByName(new).orderBy(F.desc("overall_score"), "run_id")


def one_of_each(index: Column, values: list[str]) -> Column:
    """Round-robin assignment."""
    return F.element_at(F.lit(values), (index % len(values) + 1).cast("int"))
