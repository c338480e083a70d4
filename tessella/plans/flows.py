"""The three flows end to end: rubric evaluation, curation, ablation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import providers
from ..operators import curation, dedup, dialogue, rubrics
from ..operators.staging import staged


def evaluated(samples: DataFrame, call: providers.Call, judge: providers.Call | None = None) -> DataFrame:
    """Samples with response, ratings and scores. Failed responses stay with score 0. The model is called once for each sample."""
    said = providers.respond(samples, call)
    empty = {"weighted_score": 0.0, "pass_rate": 0.0, "critical_pass_rate": 1.0}
    scores = {k: F.coalesce(c, F.lit(empty[k])) for k, c in rubrics.array_scores(F.col("ratings")).items()}
    return providers.judged(said, judge).withColumns(scores).withColumn("n_rubrics", F.coalesce(F.greatest(F.size("ratings"), F.lit(0)), F.lit(0)))


def report(results: DataFrame) -> DataFrame:
    """Overall and by modality, use case and subject, from one scan."""
    return rubrics.breakdowns(results.withColumn("modality", F.when(F.col("is_multimodal"), "multimodal").otherwise("text")), ["modality", "use_case", "subject"])


def rating_report(results: DataFrame) -> dict[str, DataFrame]:
    ratings = results.select(F.explode("ratings").alias("r")).select("r.*")
    return {"dimension": rubrics.dense_rates(ratings, "evaluation_dimension", rubrics.DIMENSIONS), "skill": rubrics.dense_rates(ratings, "tutoring_skill", rubrics.SKILLS)}


def multi_run(reports: DataFrame) -> DataFrame:
    """Reports of several runs (run_id, breakdown, key, overall_score, ...) with intervals per key."""
    return rubrics.over_runs(reports, "breakdown", "key", value="overall_score")


def comparison(baseline: DataFrame, variant: DataFrame, multi: bool) -> DataFrame:
    """By key of both sides; over runs also a t-test's p-value."""
    if not multi:
        return rubrics.compared(baseline.where("n_rubrics > 0"), variant, ["breakdown", "key"], "overall_score")
    both = baseline.withColumn("arm", F.lit("baseline")).unionByName(variant.withColumn("arm", F.lit("variant")))
    means = [rubrics.over_runs(d, "breakdown", "key", value="overall_score") for d in (baseline, variant)]
    return rubrics.compared(*means, ["breakdown", "key"], "mean").join(rubrics.t_test(both, "arm", "overall_score", "variant", "baseline", "breakdown", "key").select("breakdown", "key", "p_value", "significant"), ["breakdown", "key"])


def graded(responses: DataFrame, keyed_rubrics: DataFrame, judge: providers.Call | None = None) -> DataFrame:
    """Responses whose sample has rubrics, with ratings, scores and threshold flags."""
    ready = responses.join(keyed_rubrics, "sample_id").where(F.size("rubrics") > 0)
    scored = providers.judged(ready, judge).withColumns(rubrics.array_scores(F.col("ratings")))
    a, b = curation.passes()
    return scored.withColumns({"passes_critical_threshold": a, "passes_overall_threshold": b, "is_high_quality": a & b})


def curated(graded_rows: DataFrame, revise: providers.Call | None = None, threshold: float = 0.90) -> tuple[DataFrame, DataFrame]:
    """Filter, revise the shortfall, unite, remove near-duplicates: kept rows and the duplicate log. Rows carry ``pos``.

    Revisions are written before they are compared, so that each is generated once and the kept text is the one compared."""
    kept = curation.filtered(graded_rows)
    if revise is not None:
        tasks = curation.revision_tasks(graded_rows).withColumns({"system_prompt": F.lit("revise"), "messages": F.array(F.struct(F.lit("user").alias("role"), F.col("response").alias("content")))}).withColumnRenamed("response", "original_response")
        revised = staged(providers.respond(tasks, revise), "revised").where(F.length("response") > 0).drop("system_prompt", "messages", "error")
        kept = curation.combined(kept, revised.select(*[c for c in revised.columns if c in graded_rows.columns or c == "original_response"]).withColumn("pos", F.col("pos") + F.lit(1 << 40)))
    return dedup.deduplicated(kept, threshold, "response")


def ablation(sessions: DataFrame) -> DataFrame:
    """Statistics of each variant, ranked by accuracy and by improvement; ``pos`` is the order of the variants."""
    stats = dialogue.session_stats(sessions, "variant", "pos")
    by_gain = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("improvement"), "pos"))
    return dialogue.ranked(stats, "accuracy").withColumnRenamed("rank", "accuracy_rank").withColumn("improvement_rank", by_gain)
