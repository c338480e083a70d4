"""Evaluation of a whole sample by one structured reply: a verdict for each rubric, a quality mark, strengths and weaknesses."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import providers
from ..operators.staging import staged

#: What a reply must hold; what can't be read so is kept beside it.
REPLY = "rubric_evaluations array<struct<criteria:string,passes:boolean,reasoning:string>>, overall_quality_score int, strengths array<string>, weaknesses array<string>, _unread string"
# Fixed value: a sample stays if more than this share of its critical rubrics pass.
THRESHOLD = 0.80


def asked(samples: DataFrame, system: str, task: str) -> DataFrame:
    """``samples`` (prompt, response, rubrics of struct(criterion, severity, ...)) with system_prompt and messages for one call each.

    ``task``: a text with the slots {context}, {response} and {rubrics}; the rubrics are listed with a number, severity and criterion.
    """
    lines = F.transform("rubrics", lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(r["severity"], F.lit("unknown")), F.lit(": "), F.coalesce(r["criterion"], F.lit("N/A"))))
    value = {"context": F.col("prompt"), "response": F.col("response"), "rubrics": F.array_join(lines, "\n")}
    pieces = re.split(r"\{(context|response|rubrics)\}", task)  # every second one is a slot; what fills one is not searched for others
    said = F.concat(*[F.coalesce(value[x], F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(pieces)])
    return samples.withColumns({"system_prompt": F.lit(system), "messages": F.array(F.struct(F.lit("user").alias("role"), said.alias("content")))})


def status(reply: Column, rubrics: Column) -> Column:
    """``broken`` where a reply can't be read, lacks a part or has a mark beside 1 to 5; ``short`` or ``long`` where its verdicts are fewer or more than the rubrics; or ``ok``."""
    whole = reply["_unread"].isNull() & reply["strengths"].isNotNull() & reply["weaknesses"].isNotNull() & reply["overall_quality_score"].between(1, 5) & F.forall(reply["rubric_evaluations"], lambda e: e["passes"].isNotNull())
    n, wanted = F.size(reply["rubric_evaluations"]), F.greatest(F.size(rubrics), F.lit(0))
    return F.when(~F.coalesce(whole, F.lit(False)), "broken").when(n < wanted, "short").when(n > wanted, "long").otherwise("ok")


def read(replies: DataFrame, reply: str = "reply", threshold: float = THRESHOLD) -> DataFrame:
    """``replies`` (``reply``, rubrics) with status, evaluation, critical_pass_rate and keep.

    Verdicts belong to rubrics by position. A critical rubric without a verdict has not passed; without critical rubrics the rate is 1; verdicts beyond the rubrics are
    ignored. Broken replies have null rates and are not kept.
    """
    rows = replies.withColumn("evaluation", F.from_json(F.coalesce(reply, F.lit("")), REPLY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"}))
    rows = rows.withColumn("status", status(F.col("evaluation"), F.col("rubrics")))
    verdicts = F.col("evaluation.rubric_evaluations")
    met = F.transform("rubrics", lambda r, i: F.when(F.coalesce(r["severity"], F.lit("")) == "critical", F.coalesce(F.get(verdicts, i)["passes"], F.lit(False))))
    critical = F.filter(met, lambda x: x.isNotNull())
    n = F.size(critical)
    rate = F.when(F.coalesce(n, F.lit(0)) <= 0, 1.0).otherwise(F.size(F.filter(critical, lambda x: x)) / F.nullif(n, F.lit(0)))
    good = F.col("status") != "broken"
    return rows.withColumn("critical_pass_rate", F.when(good, rate)).withColumn("keep", F.coalesce(F.col("critical_pass_rate") > threshold, F.lit(False)))


def tally(rows: DataFrame) -> DataFrame:
    """status, n, n_kept: one row for each status that occurs."""
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count_if("keep").alias("n_kept"))


def evaluated(samples: DataFrame, call: providers.Call, system: str, task: str, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The samples whose evaluation could be read, and the tally of all. A call is made once for each sample, and its reply written before it is read; a failed call is a broken reply."""
    said = providers.respond(asked(samples, system, task).withColumnRenamed("response", "_response"), call)
    replies = staged(said.withColumnsRenamed({"response": "reply", "_response": "response"}).drop("system_prompt", "messages"), "structured")
    rows = read(replies, threshold=threshold)
    flat = rows.select("*", F.col("evaluation.overall_quality_score").alias("overall_quality_score"), F.col("evaluation.strengths").alias("strengths"), F.col("evaluation.weaknesses").alias("weaknesses"))
    return flat.where("status <> 'broken'"), tally(rows)
