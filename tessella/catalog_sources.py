"""Queries of readers and writers: the tables' rows are written by a sink and read back by the source that goes with it.

As in ``catalog``, each has the SQL it is checked against. Malformed lines, missing columns and the like are put between the rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, rounded, table
from .catalog_domain import parts, talks
from .operators.staging import scratch
from .sources import io

c = F.col


def orders(spark, d):
    return table(spark, d, "orders").select(
        c("o_custkey").cast("string").alias("sample_id"), c("o_orderpriority").alias("persona_name"), (c("o_orderkey") % 3).cast("int").alias("variation_idx"), F.when(c("o_orderkey") % 4 != 0, c("o_orderstatus")).alias("subject"),
        F.concat(F.lit('line "1"\nline 2 é '), c("o_orderkey").cast("string")).alias("response"), (c("o_orderkey") * 7919 % 1000 / 1000.0).alias("weighted_score"),
    )


ORDERS = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS sample_id, o_orderpriority AS persona_name, CAST(o_orderkey % 3 AS INT) AS variation_idx, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS subject,
  'line "1"' || chr(10) || 'line 2 é ' || o_orderkey AS response, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS weighted_score FROM orders)"""
FIELDS = ["sample_id", "persona_name", "variation_idx", "subject", "response", "weighted_score"]


@query(f"WITH {ORDERS} SELECT sample_id, persona_name, variation_idx, subject, response, weighted_score FROM o")
def tolerant_lines(spark, d):
    """JSON lines, with lines among them that can't be read or are blank; nulls stay null."""
    path = scratch(spark, "lines")
    io.write_json(orders(spark, d), path)
    table(spark, d, "nation").select(F.when(c("n_nationkey") % 2 == 0, F.lit("{broken")).otherwise("  ").alias("value")).write.mode("append").text(path)
    return io.jsonl(spark, path).select(*FIELDS)


@query(f"WITH {ORDERS} SELECT DISTINCT sample_id || '_' || persona_name || '_' || variation_idx AS key FROM o")
def done_keys(spark, d):
    path = scratch(spark, "done")
    io.write_json(orders(spark, d), path)
    return io.done_keys(spark, path, ["sample_id", "persona_name", "variation_idx"])


@query(f"WITH {ORDERS} SELECT sample_id, persona_name, CASE WHEN variation_idx = 1 THEN 'none' ELSE coalesce(subject, 'none') END AS subject, response, variation_idx FROM o")
def projected_csv(spark, d):
    """CSV with cells of several lines; a column that some files lack, and one that all do."""
    path, rows = scratch(spark, "csv"), orders(spark, d)
    io.write_csv(rows.where("variation_idx <> 1").drop("weighted_score"), path)
    other = scratch(spark, "csv")
    io.write_csv(rows.where("variation_idx = 1").drop("weighted_score", "subject"), other)
    kind = "sample_id string, persona_name string, subject string, response string, variation_idx int"
    return io.csv(spark, path, kind, {"subject": "none"}).unionByName(io.csv(spark, other, kind, {"subject": "none"}))


@query("SELECT CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' ELSE 'test' END AS split, c_custkey, c_name FROM customer")
def split_files(spark, d):
    """A folder for each split, and a loader of all three."""
    path = scratch(spark, "splits")
    name = F.when(c("c_custkey") % 3 == 0, "train").when(c("c_custkey") % 3 == 1, "valid").otherwise("test")
    io.write_splits(table(spark, d, "customer").select("c_custkey", "c_name", name.alias("split")), path)
    found = io.splits(spark, {s: f"{path}/split={s}" for s in ("train", "valid", "test")}, "c_custkey long, c_name string", ["train", "test"])
    return found["train"].withColumn("split", F.lit("train")).unionByName(found["valid"].withColumn("split", F.lit("valid"))).unionByName(found["test"].withColumn("split", F.lit("test")))


@query("SELECT p_partkey, p_size AS score_size, p_brand AS score_brand, p_name AS meta_name FROM part")
def flattened_parts(spark, d):
    """Nested columns spread with a prefix, through CSV."""
    path = scratch(spark, "flat")
    nested = table(spark, d, "part").select("p_partkey", F.struct(c("p_size").alias("size"), c("p_brand").alias("brand")).alias("scores"), F.struct(c("p_name").alias("name")).alias("metadata"))
    io.write_csv(io.flattened(nested, {"scores": "score_", "metadata": "meta_"}), path)
    return io.csv(spark, path, "p_partkey long, score_size int, score_brand string, meta_name string")


@query(f"WITH {ORDERS} SELECT persona_name, count(*) AS n, count(subject) AS n_subject, round(sum(weighted_score), 4) AS total FROM (SELECT * FROM o UNION ALL SELECT * FROM o WHERE variation_idx = 2) GROUP BY 1")
def concatenated_files(spark, d):
    """The outputs of three workers as one, to which one of them is added again."""
    paths = [scratch(spark, "chunk") for _ in range(4)]
    for k in range(3):
        io.write_json(orders(spark, d).where(f"variation_idx = {k}"), paths[k])
    io.concatenate(spark, [*paths[:3], f"{paths[3]}-none"], paths[3])
    io.concatenate(spark, [paths[2]], paths[3], append=True)
    out = io.jsonl(spark, paths[3], strict=True).groupBy("persona_name").agg(F.count("*").alias("n"), F.count("subject").alias("n_subject"), F.sum("weighted_score").alias("total"))
    return rounded(out, "total", places=4)


@query("SELECT c_custkey, 'said ' || c_name AS said, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 100) / 100.0::DOUBLE END AS score FROM customer")
def debug_log(spark, d):
    """What the stages put out, beside scores that some samples lack."""
    path, rows = scratch(spark, "log"), table(spark, d, "customer")
    io.write_debug_log(rows.select("c_custkey", F.concat(F.lit("said "), "c_name").alias("said")), rows.where("c_custkey % 5 <> 0").select("c_custkey", (c("c_custkey") % 100 / 100.0).alias("score")), path, "c_custkey")
    return spark.read.schema("c_custkey long, said string, score double").json(path)


@query("SELECT CASE WHEN c_nationkey < 10 THEN 'low' ELSE 'high' END AS file, count(*) AS n FROM customer GROUP BY 1")
def line_counts(spark, d):
    path = scratch(spark, "counted")
    table(spark, d, "customer").select(c("c_name").alias("value"), F.when(c("c_nationkey") < 10, "low").otherwise("high").alias("file")).write.partitionBy("file").text(path)
    return spark.createDataFrame([(f, io.line_count(spark, f"{path}/file={f}")) for f in ("low", "high")], "file string, n long")


@query("""SELECT 'dialogue' || conv_id || '_0' AS dialogue_id, CAST(turn AS INT) AS pos, md5(text) AS system_md5 FROM conversations c WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) % 2 = 0)
  AND turn = (SELECT count(*) FROM conversations e WHERE e.conv_id = c.conv_id AND e.turn < c.turn)""")
def dialogue_map(spark, d):
    """Nested maps of problems, fifty conversations a file; only dialogues whose last turn ends them count, here those of an even number of turns."""
    path = scratch(spark, "dialogues")
    last = lambda i: F.when((i == F.size("messages") - 1) & (F.size("messages") % 2 == 0), "yes")
    each = talks(spark, d).withColumn("t", F.transform("messages", lambda m, i: F.struct(m["content"].alias("system"), F.lit("u").alias("user"), last(i).alias("END"))))
    none = F.lit(None).cast("string")
    problem = F.struct(F.concat(F.lit("q"), c("conv_id").cast("string")).alias("question"), none.alias("analysis"), none.alias("answer"), F.create_map(F.lit("0"), c("t")).alias("dialogues"))
    keyed = each.select(F.concat(F.lit("dialogue"), c("conv_id").cast("string")).alias("k"), problem.alias("p"), F.floor(c("conv_id") / 50).alias("file"))
    keyed.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "p")))).alias("value")).write.partitionBy("file").text(path)
    return io.dialogues(spark, path).select("dialogue_id", c("pos").cast("int").alias("pos"), F.md5(c("system").cast("binary")).alias("system_md5"))


@query("""SELECT c_mktsegment AS category, CAST(c_custkey AS VARCHAR) AS question_id, c_name AS question, CAST(c_custkey % 2 AS INT) AS answer_index FROM customer WHERE c_custkey % 4 <> 3""")
def stratified_map(spark, d):
    """Maps of categories and questions, two hundred a file; the first response counts, questions without one are left out."""
    path = scratch(spark, "strata")
    response = lambda name: F.struct(name.alias("question"), F.array(F.lit("a"), F.lit("b")).alias("options"), (c("c_custkey") % 2).alias("answer_index"))
    both = F.when(c("c_custkey") % 4 == 3, F.array(response(F.lit(""))).cast("array<struct<question:string,options:array<string>,answer_index:bigint>>")).otherwise(F.array(response(c("c_name")), response(F.lit("second"))))
    rows = table(spark, d, "customer").select("c_mktsegment", c("c_custkey").cast("string").alias("k"), F.struct(both.alias("responses")).alias("r"), F.floor(c("c_custkey") / 200).alias("file"))
    maps = rows.groupBy("file", "c_mktsegment").agg(F.map_from_entries(F.collect_list(F.struct("k", "r"))).alias("m"))
    maps.groupBy("file").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("c_mktsegment", "m")))).alias("value")).write.partitionBy("file").text(path)
    return io.stratified_questions(spark, path).select("category", "question_id", "question", c("answer_index").cast("int").alias("answer_index"))


@query("""SELECT CASE WHEN p_partkey % 6 = 0 THEN format('sample_{:04d}', p_partkey) ELSE 'task' || p_partkey END AS sample_id, ['adaptive', 'assessment', 'active_learning', 'adaptive'][p_partkey % 4 + 1] AS use_case, p_brand AS subject,
  1 + CASE WHEN p_partkey % 5 <> 0 THEN 1 ELSE 0 END AS n_messages FROM part WHERE p_partkey % 7 <> 0 AND p_partkey % 2 = 0 AND p_partkey % 4 = 2""")
def hosted_rows(spark, d):
    """Raw dataset rows: unreadable rubrics go, then all but text samples of one use case."""
    rows = parts(
        spark, d, pos="p_partkey", TASK_ID="CASE WHEN p_partkey % 6 <> 0 THEN 'task' || p_partkey END", BATCH="'use_case_' || (p_partkey % 4 + 1) || CASE WHEN p_partkey % 2 = 1 THEN '_MULTIMODAL' ELSE '' END", SUBJECT="p_brand", PROMPT="p_name",
        FOLLOW_UP_PROMPT="CASE WHEN p_partkey % 5 <> 0 THEN p_type END", RUBRICS="CASE WHEN p_partkey % 7 = 0 THEN '{broken' ELSE '[{\"criteria\":\"x\"}]' END", IMAGE_URL="CAST(NULL AS string)",
    )
    out = io.hosted_samples(rows, text_only=True, use_case="active_learning")
    return out.select("sample_id", "use_case", "subject", F.size("messages").alias("n_messages"))


@query("""SELECT format('sample_{:04d}', p_partkey) AS sample_id, CASE WHEN p_partkey % 3 = 0 AND p_size % 2 = 0 THEN -5 WHEN p_partkey % 3 = 0 THEN 5 ELSE 1 END AS weight,
  ['style_tone', 'instruction_following', 'truthfulness'][p_size % 3 + 1] AS dimension, CASE WHEN p_partkey % 2 = 0 THEN 'step_by_step_help' END AS skill FROM part WHERE p_partkey % 5 <> 0""")
def keyed_rubrics(spark, d):
    """Rubrics for grading: critical prohibitions weigh -5, an unknown dimension is instruction_following, skills go by name."""
    attributes = """'"severity":"' || CASE WHEN p_partkey % 3 = 0 THEN 'critical' ELSE 'not_critical' END || '","eval_dimension":"' || element_at(array('Style Tone, other', 'Unheard of', 'truthfulness'), CAST(p_size % 3 AS int) + 1) || '","tutoring_skill":"' || CASE WHEN p_partkey % 2 = 0 THEN 'Step by step help' ELSE 'dancing' END || '"'"""
    rubric = f"""'[{{"criteria":"The answer ' || CASE WHEN p_size % 2 = 0 THEN 'must not' ELSE 'must' END || ' x","attributes":{{' || {attributes} || '}}}}]'"""
    rows = parts(spark, d, pos="p_partkey", SUBJECT="p_brand", PROMPT="p_name", UC1_INITIAL_EXPLANATION="p_type", FOLLOW_UP_PROMPT="p_type", RUBRICS=f"CASE WHEN p_partkey % 5 = 0 THEN '[]' ELSE {rubric} END")
    first = F.get("rubrics", F.lit(0))
    return io.keyed_rubrics(rows).select("sample_id", first["weight"].alias("weight"), first["evaluation_dimension"].alias("dimension"), first["tutoring_skill"].alias("skill"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS sample_id, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS system_prompt, p_name AS asked, [5, 1, -5][p_partkey % 3 + 1] AS weight, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 4 = 0 END, true) AS is_objective, p_partkey % 5 = 0 AS is_multimodal FROM part""")
def array_samples(spark, d):
    """Samples in files that are one JSON array each, a hundred a file; absent fields get their defaults, rubrics are checked."""
    path, k = scratch(spark, "arrays"), c("p_partkey")
    rubric = F.struct(F.lit("c").alias("criterion"), F.element_at(F.lit([5, 1, -5]), (k % 3 + 1).cast("int")).alias("weight"), F.lit("style_tone").alias("evaluation_dimension"), F.when(k % 2 == 0, k % 4 == 0).alias("is_objective"))
    sample = F.struct(k.cast("string").alias("sample_id"), F.when(k % 3 == 0, c("p_brand")).alias("system_prompt"), F.array(F.struct(F.lit("user").alias("role"), c("p_name").alias("content"))).alias("messages"), F.array(rubric).alias("rubrics"), F.when(k % 5 == 0, True).alias("is_multimodal"))
    files = table(spark, d, "part").select(F.floor(k / 100).alias("file"), sample.alias("s")).groupBy("file").agg(F.to_json(F.collect_list("s")).alias("value"))
    files.write.partitionBy("file").text(path)
    out = io.samples(spark, path)
    return out.select("sample_id", "system_prompt", c("messages")[0]["content"].alias("asked"), c("rubrics")[0]["weight"].alias("weight"), c("rubrics")[0]["is_objective"].alias("is_objective"), "is_multimodal")
