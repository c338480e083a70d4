"""Rubric normalising, weighted scores, breakdowns over closed domains, runs and comparisons."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats, text
from . import quantiles

# The closed domains.
DIMENSIONS = ["instruction_following", "truthfulness", "conciseness_relevance", "style_tone", "visual_perception", "visual_reasoning", "student_level_calibration", "emotional_component"]
SKILLS = ["asking_guiding_questions", "identifying_core_difficulty", "identifying_correct_steps", "identifying_incorrect_steps", "including_examples", "providing_alternative_solutions", "stating_knowledge", "step_by_step_help"]
SKILL_NAMES = {
    "asking guiding questions": "asking_guiding_questions", "asks questions to guide": "asking_guiding_questions",
    "identifying core difficulty": "identifying_core_difficulty", "identifying core difficulty/ misconception attribution": "identifying_core_difficulty",
    "identifying correct steps": "identifying_correct_steps", "identifying correct steps by student": "identifying_correct_steps",
    "identifying incorrect steps": "identifying_incorrect_steps", "identifying incorrect steps by student": "identifying_incorrect_steps",
    "includes examples/analogy": "including_examples", "including examples": "including_examples",
    "providing alternative solutions": "providing_alternative_solutions", "stating knowledge": "stating_knowledge",
    "step by step help": "step_by_step_help", "step by step help/ analysis": "step_by_step_help",
}
RAW = "array<struct<criteria:string,attributes:struct<severity:string,eval_dimension:string,tutoring_skill:string,explicitness:string,objectivity:string>>>"


def parsed(raw: Column, flavour: str = "grading") -> Column:
    """Rubrics of a JSON column; unreadable JSON gives an empty array.

    ``evaluation``: weights 5 and 1, severity in any case, skills by keyword, unknown dimension truthfulness.
    ``grading``: also -5 for critical prohibitions, severity as written, skills by name, unknown dimension instruction_following.
    """
    grading = flavour == "grading"

    def one(r: Column) -> Column:
        a = r["attributes"]
        severity = F.coalesce(a["severity"], F.lit("not_critical"))
        critical = (severity if grading else F.lower(severity)) == "critical"
        weight = F.when(critical & F.lit(grading) & text.is_negative_criterion(r["criteria"]), -5).when(critical, 5).otherwise(1)
        first = F.replace(F.lower(text.strip(F.split_part(a["eval_dimension"], F.lit(","), F.lit(1)))), F.lit(" "), F.lit("_"))
        dimension = F.when(first.isin(DIMENSIONS), first).otherwise("instruction_following" if grading else "truthfulness")
        named = F.create_map(*[F.lit(x) for kv in SKILL_NAMES.items() for x in kv])
        skill = F.try_element_at(named, text.strip(F.lower(F.coalesce(a["tutoring_skill"], F.lit(""))))) if grading else text.skill_by_keyword(a["tutoring_skill"])
        flag = lambda c, word: F.coalesce(c if grading else F.lower(c), F.lit(word)) == word
        return F.struct(
            F.coalesce(r["criteria"], F.lit("")).alias("criterion"), weight.alias("weight"), dimension.alias("evaluation_dimension"), skill.alias("tutoring_skill"),
            flag(a["objectivity"], "objective").alias("is_objective"), flag(a["explicitness"], "explicit").alias("is_explicit"),
        )

    return F.transform(F.coalesce(F.from_json(raw, RAW), F.array().cast(RAW)), one)


def weighted_score(weight: Column, passed: Column) -> Column:
    """Aggregate: passed weights over positive weights, held to [0, 1]; 0 without a positive weight."""
    total = F.sum(F.when(weight > 0, weight).otherwise(0))
    got = F.sum(F.when(passed, weight).otherwise(0))
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), got / F.nullif(total, F.lit(0)))))


def pass_rate(passed: Column) -> Column:
    return F.coalesce(F.avg(passed.cast("double")), F.lit(0.0))


def critical_pass_rate(weight: Column, passed: Column) -> Column:
    return F.coalesce(F.avg(F.when(F.abs(weight) == 5, passed.cast("double"))), F.lit(1.0))


def array_scores(ratings: Column) -> dict[str, Column]:
    """The three scores over an array of struct(weight, passed), without exploding it."""
    total = lambda f: F.aggregate(ratings, F.lit(0), lambda a, r: a + f(r))
    positive, got = total(lambda r: F.when(r["weight"] > 0, r["weight"]).otherwise(0)), total(lambda r: F.when(r["passed"], r["weight"]).otherwise(0))
    n, ok = F.size(ratings), total(lambda r: F.when(r["passed"], 1).otherwise(0))
    crit, crit_ok = total(lambda r: F.when(F.abs(r["weight"]) == 5, 1).otherwise(0)), total(lambda r: F.when((F.abs(r["weight"]) == 5) & r["passed"], 1).otherwise(0))
    return {
        "weighted_score": F.when(positive == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), got / F.nullif(positive, F.lit(0))))),
        "pass_rate": F.when(n <= 0, 0.0).otherwise(ok / F.nullif(n, F.lit(0))),
        "critical_pass_rate": F.when(crit == 0, 1.0).otherwise(crit_ok / F.nullif(crit, F.lit(0))),
    }


def has_critical(rubrics: Column) -> Column:
    return F.exists(rubrics, lambda r: F.abs(r["weight"]) == 5)


def scored(ratings: DataFrame, *keys: str) -> DataFrame:
    """One row per key of exploded ratings (weight, passed): score, rates and number of rubrics."""
    w, p = F.col("weight"), F.col("passed")
    return ratings.groupBy(*keys).agg(weighted_score(w, p).alias("weighted_score"), pass_rate(p).alias("pass_rate"), critical_pass_rate(w, p).alias("critical_pass_rate"), F.count("*").alias("n_rubrics"))


def run_summary(results: DataFrame, *keys: str, spread: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Score, spread, exact median, pass rate and counts of each group; ``spread`` multiplies the rows, once they are computed."""
    s = F.col("weighted_score")
    return quantiles.summarised(
        results, list(keys), "weighted_score",
        F.coalesce(F.avg(s), F.lit(0.0)).alias("overall_score"), F.stddev_pop(s).alias("std"),
        F.avg("pass_rate").alias("pass_rate"), F.count("*").alias("n_samples"), F.coalesce(F.sum("n_rubrics"), F.lit(0)).alias("n_rubrics"), spread=spread,
    )


def dense_rates(ratings: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """Pass rate for every value of a closed domain; values without ratings have rate 0. Nulls and other values are left out."""
    spark = ratings.sparkSession
    every = spark.createDataFrame([(v,) for v in domain], "key string")
    found = ratings.where(F.col(column).isin(domain)).groupBy(F.col(column).alias("key")).agg(F.avg(F.col("passed").cast("double")).alias("r"), F.count("*").alias("n"))
    return every.join(found, "key", "left").select("key", F.coalesce("r", F.lit(0.0)).alias("pass_rate"), F.coalesce("n", F.lit(0)).alias("n_rubrics"))


def breakdowns(results: DataFrame, keys: list[str]) -> DataFrame:
    """The same aggregates overall and by each key, in long form (breakdown, key, ...), over rows that are computed once.

    Rows whose key is null count overall and are left out of that key's breakdown.
    """
    groups = F.explode(F.array(F.struct(F.lit("overall").alias("breakdown"), F.lit("all").alias("key")), *[F.struct(F.lit(k).alias("breakdown"), F.col(k).cast("string").alias("key")) for k in keys]))
    several = lambda rows: rows.select("weighted_score", "pass_rate", "n_rubrics", groups.alias("b")).where("b.key IS NOT NULL").select("b.*", "weighted_score", "pass_rate", "n_rubrics")
    return run_summary(results.select("weighted_score", "pass_rate", "n_rubrics", *keys), "breakdown", "key", spread=several)


def ordered(report: DataFrame, value: str, *keys: str) -> DataFrame:
    """The rows of a report (a row for each key) with ``place``: by falling value, ties by key."""
    return report.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(value), *keys)))


def worst(results: DataFrame, k: int = 5, score: str = "weighted_score", pos: str = "sample_id") -> DataFrame:
    """The k lowest scores, ties by position."""
    return results.orderBy(score, pos).limit(k)


def summary_page(report: DataFrame, k: int = 5) -> DataFrame:
    """(breakdown, page): the lines of a run's summary, best first, of a report as ``breakdowns`` gives it."""
    line = F.format_string("%s: %.2f%% over %d samples", F.col("key"), F.col("overall_score") * 100, F.col("n_samples"))
    rows = report.groupBy("breakdown").agg(F.array_sort(F.collect_list(F.struct((-F.col("overall_score")).alias("o"), F.col("key"), line.alias("line")))).alias("l"))  # closed sets of keys
    return rows.select("breakdown", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("page"))


def comparison_page(comparison: DataFrame) -> DataFrame:
    """(breakdown, page): a line for each key of a comparison, the largest gains first; with a p-value, its stars."""
    line = F.format_string("%s: %s -> %s (%s)", F.col("key"), text.percent(F.col("baseline")), text.percent(F.col("variant")), text.signed_percent(F.col("delta")))
    line = F.concat(line, F.coalesce(F.concat(F.lit(" "), F.nullif(text.stars(F.col("p_value")), F.lit(""))), F.lit(""))) if "p_value" in comparison.columns else line
    rows = comparison.groupBy("breakdown").agg(F.array_sort(F.collect_list(F.struct((-F.col("delta")).alias("d"), F.col("key"), line.alias("line")))).alias("l"))  # closed sets of keys
    return rows.select("breakdown", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("page"))


def with_metadata(results: DataFrame, samples: DataFrame, how: str = "left") -> DataFrame:
    """Results with their sample's columns; of repeated sample ids the last row (by ``pos``) counts."""
    last = samples.groupBy("sample_id").agg(F.max_by(F.struct(*[c for c in samples.columns if c != "sample_id"]), "pos").alias("_s")).select("sample_id", "_s.*")
    return results.join(last.drop("pos"), "sample_id", how)


def over_runs(values: DataFrame, *keys: str, value: str = "value", confidence: float = 0.95) -> DataFrame:
    """Mean, confidence margin, spread and the collected values over runs; a key missing in a run has fewer values."""
    v = F.col(value)
    one = values.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("_sd"), F.stddev_pop(v).alias("std"), F.median(v).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), F.count(v).alias("n_runs"), F.sort_array(F.collect_list(v)).alias("values"))
    return one.withColumn("ci_margin", stats.margin(F.col("n_runs"), F.coalesce("_sd", F.lit(0.0)), confidence)).drop("_sd")


def t_test(values: DataFrame, arm: str, value: str, a, b, *keys: str, alpha: float = 0.05) -> DataFrame:
    """Pooled two-sample t-test of two arms; fewer than two values on a side give a null p-value."""
    v, side = F.col(value), F.col(arm)
    agg = [f(F.when(side == x, v)).alias(f"{n}_{s}") for x, s in ((a, "a"), (b, "b")) for f, n in ((F.avg, "mean"), (F.var_samp, "var"), (F.count, "n"))]
    one = values.groupBy(*keys).agg(*agg)
    df = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / F.nullif(df, F.lit(0))
    t = (F.col("mean_a") - F.col("mean_b")) / F.nullif(F.sqrt(pooled * (1 / F.nullif(F.col("n_a"), F.lit(0)) + 1 / F.nullif(F.col("n_b"), F.lit(0)))), F.lit(0.0))
    enough = (F.col("n_a") >= 2) & (F.col("n_b") >= 2)
    out = one.withColumn("t", F.when(enough, t)).withColumn("p_value", stats.p_value(F.col("t"), df.cast("double")))
    return out.withColumn("significant", F.coalesce(F.col("p_value") < alpha, F.lit(False))).select(*keys, "mean_a", "mean_b", "n_a", "n_b", "t", "p_value", "significant")


def improvement(base: Column, variant: Column) -> Column:
    """Change in percent; from 0, infinite if the variant is above it, else 0."""
    return F.when(base == 0, F.when(variant > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise((variant - base) / F.nullif(base, F.lit(0.0)) * 100)


def compared(base: DataFrame, variant: DataFrame, on: list[str], value: str) -> DataFrame:
    """Baseline and variant on the keys of both, with delta and improvement."""
    joined = base.select(*on, F.col(value).alias("baseline")).join(variant.select(*on, F.col(value).alias("variant")), on)
    return joined.withColumns({"delta": F.col("variant") - F.col("baseline"), "improvement_pct": improvement(F.col("baseline"), F.col("variant"))})


def by_position(samples: DataFrame, rubrics: str = "rubrics", evaluations: str = "rubric_evaluations") -> DataFrame:
    """Share of critical rubrics passed where evaluations align with rubrics by position; a missing one has not passed, no critical one gives 1."""
    got = F.transform(rubrics, lambda r, i: F.struct((F.abs(r["weight"]) == 5).alias("critical"), F.coalesce(F.get(F.col(evaluations), i)["passes"], F.lit(False)).alias("ok")))
    n, ok = F.size(F.filter(got, lambda x: x["critical"])), F.size(F.filter(got, lambda x: x["critical"] & x["ok"]))
    return samples.withColumn("critical_pass_rate", F.when(n == 0, 1.0).otherwise(ok / F.nullif(n, F.lit(0))))
