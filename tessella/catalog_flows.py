"""Queries of whole flows: grids with methods, grading, reports over runs, comparisons, plans of samples.

As in ``catalog``, each has the SQL it is checked against.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import providers
from .catalog import META, O, PES, PESV, R, RUNS, S, T, TIERS, judged_parts, query, ratings, responses, results, rounded, runs, table, turns
from .catalog_domain import asked, stub_judge, talks
from .operators import curation, dialogue, rubrics, sampling, tuning
from .plans import episodes, flows

c = F.col


@query("""WITH s AS (SELECT p_partkey AS sample_id, p_partkey % 3 <> 0 AS branch, CASE WHEN p_partkey % 7 <> 0 THEN 'way ' || p_size END AS own, CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN NULL ELSE 'told ' || p_size END AS told,
  CASE p_partkey % 4 WHEN 0 THEN [] WHEN 1 THEN NULL ELSE ['other ' || p_size, 'third'] END AS others FROM part WHERE p_partkey % 6 <> 5),
p AS (SELECT p.p_partkey AS sample_id, s.* EXCLUDE (sample_id) FROM part p LEFT JOIN s ON s.sample_id = p.p_partkey),
g AS (SELECT * FROM p, (VALUES ('a'), ('b'), ('c')) n(persona_name), range(2) v(variation_idx)),
m AS (SELECT *, CASE WHEN coalesce(branch, false) AND persona_name IN ('a') THEN own WHEN coalesce(branch, false) AND persona_name = 'b' AND len(others) > 0 THEN others[1] END AS method_constraint FROM g)
SELECT sample_id, persona_name, CAST(variation_idx AS INT) AS variation_idx, method_constraint, CASE WHEN method_constraint IS NOT NULL THEN CASE WHEN persona_name IN ('a') THEN coalesce(nullif(told, ''), method_constraint) ELSE method_constraint END END AS method_description FROM m""")
def branched_tasks(spark, d):
    """Two variations for each of three personas: one keeps the student's method, one takes another, one has none."""
    part = table(spark, d, "part")
    size = c("p_size").cast("string")
    others = F.when(c("p_partkey") % 4 == 0, F.array().cast("array<string>")).when(c("p_partkey") % 4 > 1, F.array(F.concat(F.lit("other "), size), F.lit("third")))
    methods = part.where("p_partkey % 6 <> 5").select(
        c("p_partkey").alias("sample_id"), (c("p_partkey") % 3 != 0).alias("should_branch"), F.when(c("p_partkey") % 7 != 0, F.concat(F.lit("way "), size)).alias("student_method"),
        F.when(c("p_partkey") % 5 == 0, "").when(c("p_partkey") % 5 > 1, F.concat(F.lit("told "), size)).alias("student_method_description"), others.alias("alternative_methods"),
    )
    personas = spark.createDataFrame([("a",), ("b",), ("c",)], "persona_name string")
    return curation.branched_grid(part.select(c("p_partkey").alias("sample_id")), personas, methods, 2, ["a"], "b").select("sample_id", "persona_name", "variation_idx", "method_constraint", "method_description")


@query("WITH n AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_custkey || '/7'), c_custkey) AS n FROM customer) SELECT c_nationkey, c_custkey FROM n WHERE n <= 4")
def four_of_each(spark, d):
    return sampling.take_per(table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 4, 7)


@query("""WITH k AS (SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND c_mktsegment <> 'FURNITURE'),
n AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(c_custkey || '/3'), c_custkey) AS n, count(*) OVER (PARTITION BY c_mktsegment) AS a FROM k)
SELECT c_mktsegment, c_custkey FROM n WHERE n <= greatest(1, floor(a * 0.13::DOUBLE))""")
def planned_sample(spark, d):
    plan = sampling.Plan(percentage=0.13, include=("BUILDING", "MACHINERY", "FURNITURE"), exclude=("FURNITURE",), seed=3)
    return sampling.planned(table(spark, d, "customer").select("c_mktsegment", "c_custkey"), "c_mktsegment", "c_custkey", plan)


@query(f"""WITH {R}, {S}, m AS (SELECT l_orderkey AS sample_id, arg_max(l_shipdate, l_linenumber) AS shipped, max(l_linenumber) AS line FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1)
SELECT sample_id, round(weighted_score, 6) AS weighted_score, CAST(line AS INT) AS line FROM s LEFT JOIN m USING (sample_id)""")
def results_with_metadata(spark, d):
    """Scores beside columns of the last of a sample's rows; samples without any keep theirs."""
    samples = table(spark, d, "lineitem").where("l_orderkey % 5 <> 0").select(c("l_orderkey").alias("sample_id"), c("l_linenumber").alias("pos"), c("l_linenumber").cast("int").alias("line"))
    return rounded(rubrics.with_metadata(rubrics.scored(ratings(spark, d), "sample_id").select("sample_id", "weighted_score"), samples), "weighted_score")


ARMS = f"""{RUNS}, g AS (SELECT dimension AS key, CASE WHEN run_id <= 3 THEN 'baseline' ELSE 'variant' END AS arm, avg(v) AS mean FROM w GROUP BY 1, 2),
b AS (SELECT key, max(mean) FILTER (arm = 'baseline') AS baseline, max(mean) FILTER (arm = 'variant') AS variant FROM g GROUP BY 1)"""


@query(f"""WITH {R}, {ARMS} SELECT 'dimension' AS breakdown, key, round(baseline, 6) AS baseline, round(variant, 6) AS variant, round(variant - baseline, 6) AS delta,
  round(CASE WHEN baseline = 0 THEN CASE WHEN variant > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE (variant - baseline) / baseline * 100 END, 4) AS improvement_pct FROM b WHERE baseline IS NOT NULL AND variant IS NOT NULL""")
def run_comparison(spark, d):
    """Two arms of several runs each, by dimension; the t-test beside it has a query of its own."""
    rows = runs(spark, d).select(F.lit("dimension").alias("breakdown"), c("dimension").alias("key"), "run_id", c("value").alias("overall_score"))
    out = flows.comparison(rows.where("run_id <= 3").drop("run_id"), rows.where("run_id > 3").drop("run_id"), True)
    return rounded(rounded(out.select("breakdown", "key", "baseline", "variant", "delta", "improvement_pct"), "baseline", "variant", "delta"), "improvement_pct", places=4)


@query(f"""WITH {R}, {S}, {META}, l AS (SELECT *, CASE WHEN sample_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM j),
o AS (SELECT run, 'overall' AS breakdown, 'all' AS key, avg(weighted_score) AS v FROM l GROUP BY 1 UNION ALL SELECT run, 'subject', subject, avg(weighted_score) FROM l WHERE subject IS NOT NULL GROUP BY 1, 3)
SELECT breakdown, key, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n_runs FROM o GROUP BY 1, 2""")
def reports_over_runs(spark, d):
    """The reports of two runs, of even and of odd samples, put together key by key."""
    rows = results(spark, d)
    each = [rubrics.breakdowns(rows.where(f"sample_id % 2 = {k}"), ["subject"]).withColumn("run_id", F.lit(k)) for k in (0, 1)]
    out = flows.multi_run(each[0].unionByName(each[1]))
    return rounded(out.select("breakdown", "key", "mean", "min", "max", "n_runs"), "mean", "min", "max")


ASKED = "a AS (SELECT conv_id || '_' || turn AS sample_id, turn, text FROM conversations WHERE role = 'user')"


@query(f"""WITH {ASKED}, e AS (SELECT *, (length(text) + 4) % 2 = 0 AS ok FROM a) SELECT sample_id, 'r' || turn AS response, CASE WHEN (1 + length(CAST(turn AS VARCHAR))) % 2 = 0 THEN 1.0 ELSE round(1 / 6.0::DOUBLE, 6) END::DOUBLE AS weighted_score,
  CASE WHEN (1 + length(CAST(turn AS VARCHAR))) % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS critical_pass_rate, (1 + length(CAST(turn AS VARCHAR))) % 2 = 0 AS is_high_quality FROM e WHERE turn % 4 <> 2""")
def graded_responses(spark, d):
    """Responses joined to their samples' rubrics and judged; those of every fourth turn have none and are left out."""
    samples = asked(spark, d)
    keyed = samples.where("NOT endswith(sample_id, '_2') AND NOT endswith(sample_id, '_6')").select("sample_id", "rubrics")
    responses = samples.select("sample_id", F.concat(F.lit("r"), F.element_at(F.split("sample_id", "_"), -1)).alias("response"), F.lit(None).cast("string").alias("error"))
    out = flows.graded(responses, keyed, stub_judge)
    return rounded(out.select("sample_id", "response", "weighted_score", "critical_pass_rate", "is_high_quality"), "weighted_score", "critical_pass_rate")


@query(f"""WITH {ASKED}, e AS (SELECT (1.0 + CASE WHEN (length(text) + 4) % 2 = 0 THEN 1 ELSE 0 END) / 2 AS rate FROM a)
SELECT k AS key, round(CASE k WHEN 'style_tone' THEN (SELECT avg(rate) FROM e) ELSE 0 END, 6)::DOUBLE AS pass_rate, CASE k WHEN 'style_tone' THEN (SELECT 2 * count(*) FROM e) ELSE 0 END AS n_rubrics FROM (SELECT unnest({list(rubrics.DIMENSIONS)}) AS k)""")
def rating_dimensions(spark, d):
    """The report by dimension of the judged samples, whose rubrics are all of one; the others are there with nothing."""
    return rounded(flows.rating_report(flows.evaluated(asked(spark, d), providers.echo, stub_judge))["dimension"], "pass_rate")


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS sample_id, md5('system|s|user|Question: ' || o_orderpriority || chr(10) || chr(10) || 'Previous Explanation: ' || o_orderstatus || chr(10) || chr(10) || 'Student''s Follow-up: ' || o_orderkey || '|assistant|' || o_totalprice::DECIMAL(12, 2)) AS messages_md5,
  o_orderpriority AS persona_name, round((o_orderkey * 7919 % 1000) / 1000.0::DOUBLE, 6) AS weighted_score FROM orders""")
def training_metadata(spark, d):
    rows = table(spark, d, "orders").select(
        c("o_orderkey").cast("string").alias("sample_id"), c("o_orderpriority").alias("persona_name"), c("o_orderstatus").alias("subject"), (c("o_orderkey") * 7919 % 1000 / 1000.0).alias("weighted_score"), F.lit(1.0).alias("critical_pass_rate"),
        c("o_orderpriority").alias("prompt"), c("o_orderstatus").alias("initial_explanation"), c("o_orderkey").cast("string").alias("follow_up"), c("o_totalprice").cast("decimal(12,2)").cast("string").alias("response"),
    )
    out = curation.training_rows(rows, "s", metadata=True)
    said = F.array_join(F.flatten(F.transform("messages", lambda m: F.array(m["role"], m["content"]))), "|")
    return rounded(out.select("metadata.sample_id", F.md5(said.cast("binary")).alias("messages_md5"), "metadata.persona_name", "metadata.weighted_score"), "weighted_score")


TENTH = {n: i for i, n in enumerate(episodes.JUDGED)}


def scoring_judge(what: str, messages: list[dict]) -> str:
    """A score by what is judged and how long the last message is: bare, fenced, out of range, as a text, or none."""
    n = len(messages[-1]["content"]) if messages else 0
    if what == "summary":
        return f"{len(messages)} turns, {n} letters"
    k = TENTH[what]
    score = (n * (k + 1)) % 8 - 1
    return [f'{{"score": {score}}}', f'Well:\n```json\n{{"score": {score}, "why": "x"}}\n```', f'{{"score": "{score}"}}', "no score", f'{{"score": {score}.7}}'][(n + k) % 5]


SCORED = ", ".join(f"CASE WHEN (n + {k}) % 5 = 3 THEN 3 ELSE least(5, greatest(1, n * {k + 1} % 8 - 1)) END::INT AS {name}" for name, k in TENTH.items())


@query(f"WITH m AS (SELECT conv_id, count(*) AS turns, length(arg_max(text, turn)) AS n FROM conversations GROUP BY 1) SELECT conv_id, {SCORED}, turns || ' turns, ' || n || ' letters' AS summary FROM m")
def judged_conversations(spark, d):
    """Ten scores and a summary of each conversation, by eleven replies in five shapes."""
    return episodes.conversation_judged(talks(spark, d).withColumnRenamed("messages", "conversation"), scoring_judge).drop("conversation")


# ---- whole rows where other queries count ------------------------------------------------------------------------------


@query(f"WITH {PES}, {PESV} SELECT name, pes_score, pes_category FROM c WHERE name % 10 <> 0")
def valid_evaluation_rows(spark, d):
    rows = dialogue.pes(judged_parts(spark, d)).withColumn("pes_category", F.when(c("name") % 10 == 0, "Error").otherwise(c("pes_category")))
    return dialogue.judged_well(rows).select("name", "pes_score", "pes_category")


@query(f"""WITH {T} SELECT conv_id, md5(string_agg(turn_index || '|' || speaker || '|' || utterance || '|' || action_type, '|' ORDER BY turn_index)) AS turns_md5, 'agent' || conv_id % 3 AS agent_type,
  (conv_id * 37 % 101) / 100.0::DOUBLE AS pre_quiz_score, round((conv_id * 53 % 101) / 100.0::DOUBLE - (conv_id * 37 % 101) / 100.0::DOUBLE, 6) AS learning_gain FROM t GROUP BY conv_id""")
def episode_texts(spark, d):
    """Episode records with all their turns, scores and kind of agent."""
    rows, k = turns(spark, d), c("conv_id")
    pre, post = k * 37 % 101 / 100.0, k * 53 % 101 / 100.0
    own = rows.select("conv_id").distinct().withColumns({"agent_type": F.concat(F.lit("agent"), (k % 3).cast("string")), "student_persona": F.lit("p"), "task_id": k.cast("string"), "metrics": F.create_map(F.lit("m"), F.lit(1.0)), "pre_quiz_score": pre, "post_quiz_score": post, "learning_gain": post - pre})
    out = dialogue.episode_record(own, rows, "conv_id")
    said = F.array_join(F.transform("turns", lambda t: F.concat_ws("|", t["turn_index"].cast("string"), t["speaker"], t["utterance"], t["action_type"])), "|")
    return rounded(out.select("conv_id", F.md5(said.cast("binary")).alias("turns_md5"), c("agent.type").alias("agent_type"), c("quiz.pre").alias("pre_quiz_score"), c("quiz.learning_gain").alias("learning_gain")), "learning_gain")


@query("""SELECT 0 AS part, c_custkey AS id, c_name AS name, NULL::DOUBLE AS price FROM customer UNION ALL SELECT 1, o_orderkey, NULL, round(CAST(o_totalprice AS DOUBLE), 2) FROM orders""")
def concatenated_rows(spark, d):
    """Two tables of different columns as one."""
    out = tuning.concatenated(table(spark, d, "customer").select(c("c_custkey").alias("id"), c("c_name").alias("name")), table(spark, d, "orders").select(c("o_orderkey").alias("id"), c("o_totalprice").cast("double").alias("price")))
    return rounded(out.select("part", "id", "name", "price"), "price", places=2)


CHANGE = "printf('%s: %.2f%% -> %.2f%% (%s%.2f%%)', key, 100 * baseline, 100 * variant, CASE WHEN variant > baseline THEN '+' ELSE '' END, 100 * (variant - baseline))"


@query(f"WITH {R}, {ARMS}, k AS (SELECT * FROM b WHERE baseline IS NOT NULL AND variant IS NOT NULL) SELECT 'dimension' AS breakdown, string_agg({CHANGE}, chr(10) ORDER BY variant - baseline DESC, key) AS page FROM k")
def comparison_pages(spark, d):
    """A comparison as text, the largest gains first."""
    rows = runs(spark, d).select(F.lit("dimension").alias("breakdown"), c("dimension").alias("key"), "run_id", c("value").alias("overall_score"))
    out = flows.comparison(rows.where("run_id <= 3").drop("run_id"), rows.where("run_id > 3").drop("run_id"), True)
    return rubrics.comparison_page(out.drop("significant", "p_value"))


# ---- curation ----------------------------------------------------------------------------------------------------------


def with_ratings(spark, d):
    """Responses with three rubric results each; some have not failed any."""
    k = c("pos")
    one = lambda i, ok: F.struct(F.concat(F.lit(f"c{i} "), k.cast("string")).alias("criterion"), F.lit([5, 1, -5][i]).alias("weight"), F.lit("critical").alias("severity"), ok.alias("passed"), F.lit("why").alias("explanation"))
    return responses(spark, d).withColumn("rubric_results", F.array(one(0, k % 3 != 0), one(1, F.when(k % 5 != 0, k % 2 == 0)), one(2, k % 7 != 0)))


FAILED = "list_filter([CASE WHEN pos % 3 = 0 THEN 'c0 ' || pos END, CASE WHEN pos % 5 <> 0 AND pos % 2 <> 0 THEN 'c1 ' || pos END, CASE WHEN pos % 7 = 0 THEN 'c2 ' || pos END], lambda x: x IS NOT NULL)"


@query(f"""WITH {O}, x AS (SELECT *, {TIERS} FROM o), n AS (SELECT sample_id, greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) - count(*) FILTER (a AND b) AS shortfall FROM x GROUP BY 1),
r AS (SELECT x.sample_id, pos, row_number() OVER (PARTITION BY x.sample_id ORDER BY weighted_score DESC, critical_pass_rate DESC, pos) AS revision_rank FROM x JOIN n USING (sample_id) WHERE shortfall > 0 AND NOT (a AND b) QUALIFY revision_rank <= shortfall)
SELECT sample_id, pos, array_to_string({FAILED}, '|') AS failed, len({FAILED}) AS failed_criteria_count FROM r WHERE len({FAILED}) > 0""")
def revision_tasks(spark, d):
    """The best failing responses of samples that lack passing ones, with the criteria they failed; those that failed none are left out."""
    rows = curation.revision_tasks(with_ratings(spark, d))
    return rows.select("sample_id", "pos", F.array_join(F.transform("failed_criteria", lambda f: f["criterion"]), "|").alias("failed"), c("failed_criteria_count").cast("long").alias("failed_criteria_count"))


@query(f"""WITH {O}, x AS (SELECT *, {TIERS} FROM o), n AS (SELECT sample_id, greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) - count(*) FILTER (a AND b) AS shortfall FROM x GROUP BY 1),
r AS (SELECT x.*, row_number() OVER (PARTITION BY x.sample_id ORDER BY weighted_score DESC, critical_pass_rate DESC, pos) AS revision_rank FROM x JOIN n USING (sample_id) WHERE shortfall > 0 AND NOT (a AND b) QUALIFY revision_rank <= shortfall),
u AS (SELECT pos, 100 + pos % 997 AS n, 'text ' || (100 + pos % 997) AS response FROM x WHERE a AND b UNION ALL SELECT pos + 1099511627776, 100 + pos % 997, '[1] text ' || (100 + pos % 997) FROM r WHERE len({FAILED}) > 0)
SELECT min(pos) AS pos, arg_min(response, pos) AS response FROM u GROUP BY n""")
def curated_rows(spark, d):
    """Passing responses and revisions of failing ones, of texts with one number, which have the same words, the first; other numbers make them unlike each other."""
    graded = with_ratings(spark, d).withColumn("response", F.concat(F.lit("text "), (c("pos") % 997 + 100).cast("string")))
    kept, _ = flows.curated(graded, providers.echo)
    return kept.select("pos", "response")
