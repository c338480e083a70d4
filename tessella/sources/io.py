"""Readers and writers with declared schemas. Malformed lines are skipped, refused or counted as asked."""

from __future__ import annotations

import dataclasses
import json
import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import rubrics, sampling

RUBRIC = "struct<criterion:string,weight:int,evaluation_dimension:string,tutoring_skill:string,is_objective:boolean,is_explicit:boolean>"
MESSAGE = "struct<role:string,content:string>"
SAMPLE = f"sample_id string, use_case string, subject string, system_prompt string, messages array<{MESSAGE}>, rubrics array<{RUBRIC}>, is_multimodal boolean, images array<string>"
RESULTS = "array<struct<criterion:string,weight:int,severity:string,is_negative:boolean,passed:boolean,explanation:string,eval_dimension:string,tutoring_skill:string>>"
RESPONSE = f"sample_id string, persona_name string, variation_idx int, subject string, prompt string, initial_explanation string, follow_up string, response string, model string, weighted_score double, pass_rate double, critical_pass_rate double, rubric_results {RESULTS}, is_high_quality boolean, is_revision boolean"
CONVERSATION = f"metadata struct<name:string,description:string,expected_pes_range:string,domain:string,topic:string>, conversation array<{MESSAGE}>"
QUESTION = "question_id string, question string, options array<string>, answer_index int, category string, cot_content string"
DIALOGUES = "map<string,struct<question:string,analysis:string,answer:string,steps:array<string>,dialogues:map<string,array<struct<system:string,user:string,END:string>>>>>"
CACHE = "cache_key string, response string, model string, temperature double, created_at double"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_array(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    """A file that is one JSON array; unreadable files fail the load."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples with defaults filled; a rubric without criterion or weight, or with a weight beside -5, 1 and 5, fails."""
    filled = json_array(spark, path).withColumns({
        "system_prompt": F.coalesce("system_prompt", F.lit("")), "is_multimodal": F.coalesce("is_multimodal", F.lit(False)),
        "rubrics": F.transform("rubrics", lambda r: r.withField("is_objective", F.coalesce(r["is_objective"], F.lit(True))).withField("is_explicit", F.coalesce(r["is_explicit"], F.lit(True)))),
    })
    good = F.forall("rubrics", lambda r: r["criterion"].isNotNull() & r["weight"].isin(-5, 1, 5) & r["evaluation_dimension"].isin(rubrics.DIMENSIONS))
    return filled.withColumn("rubrics", F.when(good, F.col("rubrics")).otherwise(F.raise_error(F.lit("rubric without criterion, allowed weight or known dimension"))))


def csv(spark: SparkSession, path: str, schema: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """CSV with quoted, multi-line cells; columns by name, in any order; others are left out. Missing columns and empty cells are null, or what ``defaults`` has."""
    raw = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    wanted = T.StructType.fromDDL(schema)
    own = lambda f: (F.col(f"`{f.name}`") if f.name in raw.columns else F.lit(None)).cast(f.dataType)
    return raw.select(*[(F.coalesce(own(f), F.lit(defaults[f.name])) if f.name in (defaults or {}) else own(f)).alias(f.name) for f in wanted])


RAW_CSV = "SUBJECT string, PROMPT string, UC1_INITIAL_EXPLANATION string, FOLLOW_UP_PROMPT string, RUBRICS string, bloom_taxonomy string"


def messages(*pairs) -> F.Column:
    return F.filter(F.array(*[F.struct(F.lit(role).alias("role"), F.coalesce(c, F.lit("")).alias("content")) for role, c in pairs]), lambda m: m["content"] != "")


def csv_samples(rows: DataFrame, max_samples: int = 0, subject: str | None = None, flavour: str = "evaluation") -> DataFrame:
    """Samples of raw CSV rows with a ``pos``; ids count all rows, the limit counts those that pass, 0 is no limit."""
    talk = messages(("user", F.col("PROMPT")), ("assistant", F.col("UC1_INITIAL_EXPLANATION")), ("user", F.col("FOLLOW_UP_PROMPT")))
    out = rows.select("pos", F.format_string("sample_%04d", "pos").alias("sample_id"), F.lit("adaptive").alias("use_case"), F.coalesce("SUBJECT", F.lit("unknown")).alias("subject"), talk.alias("messages"), rubrics.parsed(F.col("RUBRICS"), flavour).alias("rubrics"), F.lit(False).alias("is_multimodal"))
    return limited(out if subject is None else out.where(F.lower("subject") == subject.lower()), max_samples)


def hosted_samples(rows: DataFrame, max_samples: int = 0, text_only: bool = False, use_case: str | None = None, subject: str | None = None) -> DataFrame:
    """Samples of raw dataset rows with a ``pos``; rows with unreadable rubrics are dropped, filters come after conversion."""
    out = rows.where(F.try_parse_json("RUBRICS").isNotNull()).select(
        "pos", F.coalesce("TASK_ID", F.format_string("sample_%04d", "pos")).alias("sample_id"), text.use_case(F.col("BATCH")).alias("use_case"), F.col("SUBJECT").alias("subject"),
        messages(("user", F.col("PROMPT")), ("user", F.col("FOLLOW_UP_PROMPT"))).alias("messages"), rubrics.parsed(F.col("RUBRICS"), "evaluation").alias("rubrics"),
        F.coalesce(F.contains(F.upper("BATCH"), F.lit("MULTIMODAL")), F.lit(False)).alias("is_multimodal"), F.array_compact(F.array("IMAGE_URL")).alias("images"),
    )
    for keep, condition in ((text_only, ~F.col("is_multimodal")), (use_case, F.col("use_case") == use_case), (subject, F.lower("subject") == (subject or "").lower())):
        out = out.where(condition) if keep else out
    return limited(out, max_samples)


def limited(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy("pos").limit(n) if n else rows


def keyed_rubrics(rows: DataFrame) -> DataFrame:
    return csv_samples(rows, flavour="grading").where(F.size("rubrics") > 0).select("sample_id", "rubrics")


def seeds(rows: DataFrame, key: str, n: int) -> DataFrame:
    return sampling.seeded_take(rows, key, n)


def jsonl(spark: SparkSession, path: str, schema: str = RESPONSE, strict: bool = False) -> DataFrame:
    """One object a line; undecodable and blank lines are skipped, or refused if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def done_keys(spark: SparkSession, path: str, key: list[str]) -> DataFrame:
    """Keys that a stage's output has; none if there is no output yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in key)).select(text.key(*key).alias("key"))
    return jsonl(spark, path).select(text.key(*key).alias("key")).distinct()


def conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversation files, one object each; the name is the metadata's or the file's, the variant its folder."""
    rows = spark.read.schema(CONVERSATION).option("multiLine", True).json(path).withColumn("_f", F.col("_metadata.file_path"))
    return rows.where(F.size("conversation") > 0).select(F.coalesce("metadata.name", F.regexp_extract("_f", r"([^/]+)\.json$", 1)).alias("name"), F.regexp_extract("_f", r"([^/]+)/[^/]+$", 1).alias("variant"), "conversation")


def dialogues(spark: SparkSession, path: str) -> DataFrame:
    """Turns of finished dialogues in a nested problem map: dialogue_id, pos, problem, system, user."""
    raw = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", DIALOGUES)).alias("problem_id", "p"))
    each = raw.select("problem_id", F.col("p.question").alias("problem"), F.explode("p.dialogues").alias("dialogue", "turns"))
    each = each.where(F.try_element_at("turns", F.lit(-1))["END"].isNotNull())
    return each.select(F.concat_ws("_", "problem_id", "dialogue").alias("dialogue_id"), "problem", F.posexplode("turns").alias("pos", "t")).select("dialogue_id", "pos", "problem", "t.system", "t.user")


def splits(spark: SparkSession, paths: dict[str, str], schema: str, required: list[str]) -> dict[str, DataFrame]:
    if missing := [r for r in required if r not in paths]:
        raise ValueError(f"missing splits: {missing}")
    return {k: spark.read.schema(schema).json(p) for k, p in paths.items()}


def questions(rows: DataFrame, categories: list[str]) -> DataFrame:
    """Open questions: options "N/A" go before the answer is looked up by its index, an index beyond gives null."""
    left = rows.where(F.col("category").isin(categories)).withColumn("options", F.filter("options", lambda o: o != "N/A")).where(F.size("options") > 0)
    return left.withColumns({"ground_truth": F.get("options", F.col("answer_index")), "question": text.open_question(F.col("question"))})


def stratified_questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of category -> id -> {responses: [{question, options, answer_index}]}; the first response counts."""
    kind = "map<string,map<string,struct<responses:array<struct<question:string,options:array<string>,answer_index:int>>>>>"
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", kind)).alias("category", "q")).select("category", F.explode("q").alias("question_id", "r"))
    first = rows.select("category", "question_id", F.get("r.responses", F.lit(0)).alias("f")).select("category", "question_id", "f.*")
    return first.where((F.length("question") > 0) & (F.size("options") > 0))


def first_that_exists(spark: SparkSession, *paths: str) -> str:
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def config(path: str, default: dict | None = None) -> dict:
    """A YAML or JSON configuration on the driver; the default where the file is optional and missing."""
    if not os.path.exists(path) and default is not None:
        return default
    with open(path, encoding="utf-8") as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(f)
        return json.load(f)


def typed(path: str, kind: type, default: dict | None = None):
    """A configuration as a dataclass, whose own checks apply; names that it doesn't have are an error."""
    values = config(path, default)
    if unknown := sorted(set(values) - {f.name for f in dataclasses.fields(kind)}):
        raise ValueError(f"{kind.__name__} has no {', '.join(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def weights(**values: float) -> dict[str, float]:
    """Weights that add up to 1, within a hundredth."""
    if not math.isclose(sum(values.values()), 1.0, rel_tol=0.01):
        raise ValueError(f"weights add up to {sum(values.values())}, not 1")
    return values


def save_config(values: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(values, f, indent=2, ensure_ascii=False)


def catalogue(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def template(path: str, **slots: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read().format(**slots)


def line_count(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).count()


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines that keep null fields."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_splits(rows: DataFrame, path: str, csv_too: bool = False) -> None:
    """A folder for each ``split``, JSON lines or CSV with a header."""
    writer = rows.write.mode("overwrite").partitionBy("split")
    (writer.option("header", True).option("escape", '"').csv if csv_too else writer.option("ignoreNullFields", False).json)(path)


def write_text(rows: DataFrame, path: str, text: str = "report", *keys: str) -> None:
    """One text column; a folder for each value of the keys, if any are given."""
    writer = rows.select(*keys, text).write.mode("overwrite").option("lineSep", "\n\n")
    (writer.partitionBy(*keys) if keys else writer).text(path)


def write_results(results: DataFrame, path: str) -> None:
    kept = F.transform("ratings", lambda r: F.struct(r["criterion"].alias("criterion"), r["weight"].alias("weight"), r["passed"].alias("passed"), r["explanation"].alias("explanation")))
    write_json(results.withColumn("ratings", kept).withColumns(rubrics.array_scores(F.col("ratings"))), path)


def write_by(rows: DataFrame, path: str, *keys: str) -> None:
    rows.write.mode("overwrite").partitionBy(*keys).json(path)


def flattened(rows: DataFrame, maps: dict[str, str]) -> DataFrame:
    """Struct columns spread with a prefix."""
    plain = [c for c in rows.columns if c not in maps]
    return rows.select(*plain, *[F.col(f"{c}.{f.name}").alias(f"{p}{f.name}") for c, p in maps.items() for f in rows.schema[c].dataType.fields])


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``existing`` whose key is not in ``new``, and ``new``; of a repeated key the last written (created_at) counts."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), "created_at").alias("_r")).select(key, "_r.*")
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


def cached(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests answered by the cache, and those to be made; an empty response is a miss."""
    good = cache.where(F.length("response") > 0).select("cache_key", "response")
    return requests.join(good, "cache_key"), requests.join(good, "cache_key", "left_anti")


def write_debug_log(outputs: DataFrame, results: DataFrame, path: str, key: str = "sample_id") -> None:
    """A record for each sample of what a pipeline's stages put out, with its scores; joined by key, not by place."""
    write_json(outputs.join(results, key, "left"), path)


def concatenate(spark: SparkSession, paths: list[str], path: str, schema: str = RESPONSE, append: bool = False) -> None:
    """Chunks' outputs as one table of JSON lines; appended to what is there, or in its place."""
    write_json(spark.read.schema(schema).json([p for p in paths if exists(spark, p)]), path, "append" if append else "overwrite")
