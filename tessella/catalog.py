"""The engine's queries over the driver tables, each with the SQL it is checked against.

Driver tables stand in for the domain's: line items for rubric ratings, orders for generated responses,
conversations for dialogue turns, events for sessions, parts for judged conversations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import overlap, prompts, stats, text
from .operators import curation, dedup, dialogue, rubrics, sampling, tuning
from .operators.staging import staged

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "report_breakdowns"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


# ---- stand-ins -------------------------------------------------------------------------------------------------


def ratings(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, c, n: F.get(F.lit(values), (F.col(c) % n).cast("int"))
    weight = F.when(F.col("l_linenumber") % 3 == 0, 5).when(F.col("l_linenumber") % 3 == 1, 1).otherwise(-5)
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("run_id"), weight.alias("weight"), (F.col("l_discount") < 0.05).alias("passed"),
        pick(rubrics.DIMENSIONS, "l_suppkey", 8).alias("dimension"), pick(rubrics.SKILLS, "l_partkey", 9).alias("skill"), F.col("l_partkey").alias("part"),
    )


R = f"""r AS (SELECT l_orderkey AS sample_id, l_linenumber AS run_id, CASE l_linenumber % 3 WHEN 0 THEN 5 WHEN 1 THEN 1 ELSE -5 END AS weight,
  l_discount < 0.05 AS passed, {quoted(rubrics.DIMENSIONS)}[l_suppkey % 8 + 1] AS dimension, {quoted(rubrics.SKILLS)}[l_partkey % 9 + 1] AS skill, l_partkey AS part FROM lineitem)"""
SCORES = """CASE WHEN coalesce(sum(weight) FILTER (weight > 0), 0) = 0 THEN 0.0
  ELSE least(1.0, greatest(0.0, coalesce(sum(weight) FILTER (passed), 0) / CAST(sum(weight) FILTER (weight > 0) AS DOUBLE))) END"""
S = f"""s AS (SELECT sample_id, {SCORES} AS weighted_score, avg(CAST(passed AS INT)) AS pass_rate,
  coalesce(avg(CAST(passed AS INT)) FILTER (abs(weight) = 5), 1.0) AS critical_pass_rate, count(*) AS n_rubrics FROM r GROUP BY sample_id)"""


def responses(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("persona_name"), (k % 3).cast("int").alias("variation_idx"), F.col("o_orderstatus").alias("subject"),
        k.alias("pos"), (k * 7919 % 1000 / 1000.0).alias("weighted_score"), (k * 104729 % 1000 / 1000.0).alias("critical_pass_rate"),
    )


O = """o AS (SELECT CAST(o_custkey AS VARCHAR) AS sample_id, o_orderpriority AS persona_name, CAST(o_orderkey % 3 AS INT) AS variation_idx, o_orderstatus AS subject,
  o_orderkey AS pos, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS weighted_score, (o_orderkey * 104729 % 1000) / 1000.0::DOUBLE AS critical_pass_rate FROM orders)"""


def turns(spark: SparkSession, d: str) -> DataFrame:
    acts = F.lit(["Ask_Background", "Ask_Check_Understanding", "Give_Step_By_Step_Explanation", "Summarize_And_Wrap_Up"])
    speaker = F.when(F.col("role") == "user", "student").when(F.col("role") == "assistant", "tutor").otherwise("system")
    return table(spark, d, "conversations").select("conv_id", F.col("turn").alias("turn_index"), speaker.alias("speaker"), F.col("text").alias("utterance"), F.get(acts, (F.col("turn") % 4).cast("int")).alias("action_type"))


T = """t AS (SELECT conv_id, turn AS turn_index, CASE role WHEN 'user' THEN 'student' WHEN 'assistant' THEN 'tutor' ELSE 'system' END AS speaker, text AS utterance,
  ['Ask_Background', 'Ask_Check_Understanding', 'Give_Step_By_Step_Explanation', 'Summarize_And_Wrap_Up'][turn % 4 + 1] AS action_type FROM conversations)"""
STARTS = "|".join(text.QUESTION_STARTS)
QUESTION = f"(contains(utterance, '?') OR regexp_matches(regexp_replace(lower(utterance), '^\\s+', ''), '^({STARTS})'))"
WORDS = "len(list_filter(regexp_split_to_array(utterance, '\\s+'), lambda w: w <> ''))"


def sessions(spark: SparkSession, d: str) -> DataFrame:
    v, k = F.col("value"), F.col("event_id")
    return table(spark, d, "events").select(
        F.col("event_type").alias("variant"), F.length("event_type").alias("pos"), k.alias("session_id"),
        F.when(k % 5 != 0, v > 40).alias("initial_judge_verdict"), F.when(k % 7 != 0, v > 20).alias("final_judge_verdict"),
        (k % 9).alias("total_turns"), (k % 2 == 0).alias("terminated_naturally"), (k % 2 == 1).alias("forced_termination"), v.alias("duration_seconds"),
    )


E = """e AS (SELECT event_type AS variant, length(event_type) AS pos, CASE WHEN event_id % 5 <> 0 THEN value > 40 END AS ini, CASE WHEN event_id % 7 <> 0 THEN value > 20 END AS fin,
  event_id % 9 AS total_turns, event_id % 2 = 0 AS nat, event_id % 2 = 1 AS forced, value FROM events)"""
STATS = """st AS (SELECT variant, pos, count(*) AS n_sessions, count(*) FILTER (ini) AS initial_correct, count(*) FILTER (fin) AS final_correct,
  count(*) FILTER (fin) - count(*) FILTER (ini) AS improvement, count(*) FILTER (fin) / CAST(count(*) AS DOUBLE) AS accuracy, avg(total_turns) AS avg_turns,
  count(*) FILTER (nat) AS natural_endings, count(*) FILTER (forced) AS forced_endings, sum(value) AS duration_seconds FROM e GROUP BY variant, pos)"""


def judged_parts(spark: SparkSession, d: str) -> DataFrame:
    names = [*dialogue.PES_DIMENSIONS, "question_depth", "icap"]
    return table(spark, d, "part").select(F.col("p_partkey").alias("name"), *[((F.col("p_partkey") * (2 * i + 3) + i) % 5 + 1).cast("int").alias(c) for i, c in enumerate(names)])


PES = "p AS (SELECT p_partkey AS name, " + ", ".join(f"CAST((p_partkey * {2 * i + 3} + {i}) % 5 + 1 AS INT) AS {c}" for i, c in enumerate([*dialogue.PES_DIMENSIONS, "question_depth", "icap"])) + " FROM part)"
LAYER1 = "(" + " + ".join(f"({c} - 1) / 4.0::DOUBLE" for c in dialogue.PES_DIMENSIONS) + ") / 8"
PESV = f"v AS (SELECT *, round(({LAYER1} * 0.8::DOUBLE + (question_depth - 1) / 4.0::DOUBLE * 0.1::DOUBLE + (icap - 1) / 4.0::DOUBLE * 0.1::DOUBLE) * 100, 2) AS pes_score FROM p), c AS (SELECT *, CASE WHEN pes_score >= 85 THEN 'Excellent' WHEN pes_score >= 70 THEN 'Good' WHEN pes_score >= 55 THEN 'Fair' WHEN pes_score >= 40 THEN 'Poor' ELSE 'Very Poor' END AS pes_category FROM v)"


def results(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("modality"), F.col("o_orderpriority").alias("use_case"), F.col("c_mktsegment").alias("subject"))
    return rubrics.scored(ratings(spark, d), "sample_id").join(meta, "sample_id")


META = "m AS (SELECT o_orderkey AS sample_id, o_orderstatus AS modality, o_orderpriority AS use_case, c_mktsegment AS subject FROM orders JOIN customer ON o_custkey = c_custkey), j AS (SELECT * FROM s JOIN m USING (sample_id))"
SUMMARY = "round(avg(weighted_score), 6) AS overall_score, round(stddev_pop(weighted_score), 6) AS std, round(median(weighted_score), 6) AS median, round(avg(pass_rate), 6) AS pass_rate, count(*) AS n_samples, CAST(sum(n_rubrics) AS BIGINT) AS n_rubrics"


# ---- rubric evaluation -----------------------------------------------------------------------------------------


@query(f"WITH {R}, {S} SELECT sample_id, round(weighted_score, 6) AS weighted_score, round(pass_rate, 6) AS pass_rate, round(critical_pass_rate, 6) AS critical_pass_rate, n_rubrics FROM s")
def rubric_scores(spark, d):
    return rounded(rubrics.scored(ratings(spark, d), "sample_id"), "weighted_score", "pass_rate", "critical_pass_rate")


@query(f"WITH {R}, {S} SELECT sample_id, round(weighted_score, 6) AS weighted_score, round(pass_rate, 6) AS pass_rate, round(critical_pass_rate, 6) AS critical_pass_rate, critical_pass_rate IS NOT NULL AND EXISTS (SELECT 1 FROM r WHERE r.sample_id = s.sample_id AND abs(weight) = 5) AS has_critical FROM s")
def rubric_scores_nested(spark, d):
    nested = ratings(spark, d).groupBy("sample_id").agg(F.collect_list(F.struct("weight", "passed")).alias("ratings"))
    out = nested.select("sample_id", *[F.round(c, 6).alias(n) for n, c in rubrics.array_scores(F.col("ratings")).items()], rubrics.has_critical(F.col("ratings")).alias("has_critical"))
    return out


@query(f"WITH {R}, {S} SELECT {SUMMARY} FROM s")
def run_summary(spark, d):
    return rounded(rubrics.run_summary(rubrics.scored(ratings(spark, d), "sample_id")), "overall_score", "std", "median", "pass_rate")


def _dense(column: str, domain: list[str]) -> str:
    return f"WITH {R} SELECT k AS key, round(coalesce(avg(CAST(passed AS INT)), 0), 6) AS pass_rate, count(passed) AS n_rubrics FROM unnest({quoted(domain)}) AS x(k) LEFT JOIN r ON r.{column} = k GROUP BY k"


@query(_dense("dimension", rubrics.DIMENSIONS))
def rates_by_dimension(spark, d):
    return rounded(rubrics.dense_rates(ratings(spark, d), "dimension", rubrics.DIMENSIONS), "pass_rate")


@query(_dense("skill", rubrics.SKILLS))
def rates_by_skill(spark, d):
    return rounded(rubrics.dense_rates(ratings(spark, d), "skill", rubrics.SKILLS), "pass_rate")


@query(f"WITH {R}, {S}, {META} SELECT 'overall' AS breakdown, 'all' AS key, {SUMMARY} FROM j" + "".join(f" UNION ALL SELECT '{k}', {k}, {SUMMARY} FROM j WHERE {k} IS NOT NULL GROUP BY {k}" for k in ("modality", "use_case", "subject")))
def report_breakdowns(spark, d):
    return rounded(rubrics.breakdowns(results(spark, d), ["modality", "use_case", "subject"]), "overall_score", "std", "median", "pass_rate")


RUNS = "w AS (SELECT run_id, dimension, avg(CAST(passed AS INT)) AS v FROM r GROUP BY ALL)"
TABLE = "[" + ", ".join(repr(stats.critical(n)) for n in range(1, 12)) + "]"


def runs(spark, d):
    return ratings(spark, d).groupBy("run_id", "dimension").agg(F.avg(F.col("passed").cast("double")).alias("value"))


@query(f"WITH {R}, {RUNS} SELECT dimension, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max, count(*) AS n_runs, round(CASE WHEN count(*) < 2 THEN 0 ELSE {TABLE}[greatest(count(*) - 1, 1)] * stddev_samp(v) / sqrt(count(*)) END, 6) AS ci_margin FROM w GROUP BY dimension")
def runs_with_interval(spark, d):
    return rounded(rubrics.over_runs(runs(spark, d), "dimension").drop("values"), "mean", "std", "median", "min", "max", "ci_margin")


@query(f"""WITH {R}, {RUNS}, g AS (SELECT dimension, avg(v) FILTER (run_id <= 3) AS ma, avg(v) FILTER (run_id > 3) AS mb, var_samp(v) FILTER (run_id <= 3) AS va, var_samp(v) FILTER (run_id > 3) AS vb,
  count(*) FILTER (run_id <= 3) AS na, count(*) FILTER (run_id > 3) AS nb FROM w GROUP BY dimension)
SELECT dimension, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, na AS n_a, nb AS n_b, CASE WHEN na > 1 AND nb > 1 THEN round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 5) END AS t FROM g""")
def t_test(spark, d):
    arms = runs(spark, d).withColumn("arm", F.when(F.col("run_id") <= 3, "a").otherwise("b"))
    return rubrics.t_test(arms, "arm", "value", "a", "b", "dimension").select("dimension", F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"), "n_a", "n_b", F.round("t", 5).alias("t"))


# The two-sided p-value of Student's t is a finite sum in the angle atan(|t| / sqrt(df)), of odd or even powers of its cosine.
SERIES = "list_sum(list_transform(range({last} + 1), lambda k: pow(c2, k) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: {ratio})), 1)))"


@query(f"""WITH {R}, {RUNS}, g AS (SELECT dimension, avg(v) FILTER (run_id <= 3) AS ma, avg(v) FILTER (run_id > 3) AS mb, var_samp(v) FILTER (run_id <= 3) AS va, var_samp(v) FILTER (run_id > 3) AS vb,
  count(*) FILTER (run_id <= 3) AS na, count(*) FILTER (run_id > 3) AS nb FROM w GROUP BY dimension),
t AS (SELECT *, na + nb - 2 AS df, CASE WHEN na > 1 AND nb > 1 THEN (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)) END AS t FROM g),
c AS (SELECT *, atan(abs(t) / sqrt(df)) AS th, 1 / (1 + t * t / df) AS c2 FROM t),
p AS (SELECT *, CASE WHEN t IS NULL THEN NULL WHEN df % 2 = 0 THEN 1 - sin(th) * {SERIES.format(last="(df - 2) // 2", ratio="(2.0::DOUBLE * j - 1) / (2 * j)")}
  ELSE 1 - 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * cos(th) * {SERIES.format(last="(df - 3) // 2", ratio="2.0::DOUBLE * j / (2 * j + 1)")} ELSE 0 END) END AS p FROM c)
SELECT dimension, round(ma, 6) AS mean_a, round(mb, 6) AS mean_b, na AS n_a, nb AS n_b, round(t, 5) AS t, round(p, 7) AS p_value, coalesce(p < 0.05, false) AS significant,
  CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM p""")
def t_test_p_value(spark, d):
    arms = runs(spark, d).withColumn("arm", F.when(F.col("run_id") <= 3, "a").otherwise("b"))
    out = rubrics.t_test(arms, "arm", "value", "a", "b", "dimension").withColumn("stars", text.stars(F.col("p_value")))
    return rounded(rounded(rounded(out, "mean_a", "mean_b"), "t", places=5), "p_value", places=7)


@query(f"""WITH {R}, b AS (SELECT dimension, avg(CAST(passed AS INT)) AS v FROM r WHERE run_id = 1 GROUP BY 1), c AS (SELECT dimension, avg(CAST(passed AS INT)) AS v FROM r WHERE run_id = 2 GROUP BY 1)
SELECT dimension, round(b.v, 6) AS baseline, round(c.v, 6) AS variant, round(c.v - b.v, 6) AS delta, round(CASE WHEN b.v = 0 THEN CASE WHEN c.v > 0 THEN 'inf'::DOUBLE ELSE 0 END ELSE (c.v - b.v) / b.v * 100 END, 5) AS improvement_pct FROM b JOIN c USING (dimension)""")
def comparison(spark, d):
    w = runs(spark, d)
    out = rubrics.compared(w.where("run_id = 1"), w.where("run_id = 2"), ["dimension"], "value")
    return rounded(rounded(out, "baseline", "variant", "delta"), "improvement_pct", places=5)


@query(f"WITH {R}, x AS (SELECT run_id, round(avg(CAST(passed AS INT)), 6) AS overall_score FROM r GROUP BY run_id) SELECT run_id, CASE WHEN run_id <= 2 THEN 0.5 ELSE overall_score END AS overall_score FROM x")
def leaderboard(spark, d):
    old = ratings(spark, d).groupBy("run_id").agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("overall_score"))
    return curation.leaderboard(old, old.where("run_id <= 2").withColumn("overall_score", F.lit(0.5)))


# ---- curation ----------------------------------------------------------------------------------------------------

TIERS = "critical_pass_rate >= 0.7 AS a, weighted_score >= 0.7 AS b"


@query(f"WITH {O}, x AS (SELECT *, {TIERS} FROM o) SELECT subject, count(*) AS n_input, count(*) FILTER (NOT a) AS failed_critical, count(*) FILTER (a AND NOT b) AS failed_overall, count(*) FILTER (a AND b) AS passed FROM x GROUP BY subject")
def filter_attrition(spark, d):
    return curation.attrition(responses(spark, d), "subject")


@query(f"WITH {O}, x AS (SELECT *, {TIERS} FROM o) SELECT sample_id, persona_name, variation_idx, subject, pos, weighted_score, critical_pass_rate, CASE WHEN NOT a THEN 'failed_critical' WHEN NOT b THEN 'failed_overall' ELSE 'diversity_filtered' END AS rejection_reason FROM x WHERE NOT EXISTS (SELECT 1 FROM x y WHERE y.a AND y.b AND y.sample_id = x.sample_id AND y.persona_name = x.persona_name AND y.variation_idx = x.variation_idx)")
def rejected_rows(spark, d):
    rows = responses(spark, d)
    return curation.rejected(rows, curation.filtered(rows))


@query(f"WITH {O} SELECT sample_id, persona_name, variation_idx, subject, pos, weighted_score, critical_pass_rate FROM o QUALIFY row_number() OVER (PARTITION BY sample_id, persona_name ORDER BY weighted_score DESC, pos) <= 1")
def best_per_persona(spark, d):
    return curation.best_of(responses(spark, d))


@query(f"""WITH {O}, x AS (SELECT *, {TIERS} FROM o), n AS (SELECT sample_id, greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) - count(*) FILTER (a AND b) AS shortfall FROM x GROUP BY 1)
SELECT x.sample_id, pos, shortfall, row_number() OVER (PARTITION BY x.sample_id ORDER BY weighted_score DESC, critical_pass_rate DESC, pos) AS revision_rank FROM x JOIN n USING (sample_id) WHERE shortfall > 0 AND NOT (a AND b) QUALIFY revision_rank <= shortfall""")
def revision_shortfall(spark, d):
    return curation.shortfall(responses(spark, d)).select("sample_id", "pos", "shortfall", "revision_rank")


@query(f"WITH {O} SELECT e AS edge, count(pos) AS n FROM unnest([0.8, 0.85, 0.9, 0.95, 1.0]) AS x(e) LEFT JOIN o ON CAST(e AS DOUBLE) = CASE WHEN weighted_score <= 0.8 THEN 0.8 WHEN weighted_score <= 0.85 THEN 0.85 WHEN weighted_score <= 0.9 THEN 0.9 WHEN weighted_score <= 0.95 THEN 0.95 WHEN weighted_score <= 1 THEN 1.0 END::DOUBLE GROUP BY e".replace("SELECT e AS", "SELECT CAST(e AS DOUBLE) AS"))
def score_histogram(spark, d):
    return curation.histogram(responses(spark, d))


@query(f"WITH {O}, x AS (SELECT *, {TIERS} FROM o) SELECT persona_name, count(*) AS n, round(avg(weighted_score), 6) AS mean, round(stddev_pop(weighted_score), 6) AS std, min(weighted_score) AS min, max(weighted_score) AS max, median(weighted_score) AS median, round(avg(critical_pass_rate), 6) AS critical_pass_rate FROM x WHERE a AND b GROUP BY 1")
def quality_report(spark, d):
    return rounded(curation.quality_report(curation.filtered(responses(spark, d)), "persona_name"), "mean", "std", "critical_pass_rate")


@query(f"WITH {R} SELECT substr(p_type, 1, 100) AS criterion, count(*) AS count FROM r JOIN part ON part = p_partkey WHERE NOT passed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_failed_criteria(spark, d):
    named = ratings(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_type").alias("criterion")), "part")
    return curation.top_failures(named)


@query("SELECT c_custkey AS sample_id, r_name AS persona_name, CAST(v AS INT) AS variation_idx FROM customer, region, range(3) AS x(v) WHERE (c_custkey + v) % 2 = 0")
def task_grid_resumed(spark, d):
    grid = curation.grid(table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id")), table(spark, d, "region").select(F.col("r_name").alias("persona_name")), 3)
    return curation.resumed(grid, grid.where((F.col("sample_id") + F.col("variation_idx")) % 2 == 1))


@query(f"WITH {O} SELECT CAST(floor(CASE WHEN p < n % 7 * (n // 7 + 1) THEN p // (n // 7 + 1) ELSE n % 7 + (p - n % 7 * (n // 7 + 1)) // (n // 7) END) AS INT) AS chunk, count(*) AS n, min(pos) AS first FROM (SELECT pos, row_number() OVER (ORDER BY pos) - 1 AS p, count(*) OVER () AS n FROM o) GROUP BY 1")
def chunked_rows(spark, d):
    rows = sampling.numbered(responses(spark, d).select(F.col("pos").alias("key")), "key")
    return sampling.chunks(rows, "pos", 7).groupBy("chunk").agg(F.count("*").alias("n"), F.min("key").alias("first"))


DOCS_TF = """w AS (SELECT doc_id AS pos, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_\\x{200c}\\x{200d}]{2,}'), lambda x: NOT list_contains(STOPS, x)) AS w FROM documents),
g AS (SELECT pos, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w),
tf AS (SELECT pos, term, count(*) AS tf FROM g GROUP BY ALL),
st AS (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY 1 ORDER BY total DESC, term LIMIT 5000),
x AS (SELECT pos, term, tf * (ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS x FROM tf JOIN st USING (term)),
n AS (SELECT pos, sqrt(sum(x * x)) AS n FROM x GROUP BY 1), u AS (SELECT pos, term, x / n AS w FROM x JOIN n USING (pos))""".replace("STOPS", quoted(dedup.STOP_WORDS))


@query(f"WITH {DOCS_TF} SELECT a.pos AS i, b.pos AS j, round(sum(a.w * b.w), 5) AS similarity FROM u a JOIN u b ON a.term = b.term AND b.pos < a.pos GROUP BY ALL HAVING sum(a.w * b.w) >= 0.9")
def tfidf_pairs(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return rounded(dedup.similar_pairs(staged(dedup.vectors(docs), "tfidf")), "similarity", places=5)


@query(f"""WITH RECURSIVE {DOCS_TF}, p AS (SELECT a.pos AS i, b.pos AS j FROM u a JOIN u b ON a.term = b.term AND b.pos < a.pos GROUP BY ALL HAVING sum(a.w * b.w) >= 0.9),
n AS (SELECT i, list(j) AS js, row_number() OVER (ORDER BY i) AS k FROM p GROUP BY i), f AS (SELECT list(j) AS js FROM p WHERE j NOT IN (SELECT i FROM p)),
s AS (SELECT 0::BIGINT AS k, js AS kept FROM f UNION ALL SELECT n.k, CASE WHEN list_has_any(kept, n.js) THEN kept ELSE list_append(kept, n.i) END FROM s JOIN n ON n.k = s.k + 1),
e AS (SELECT unnest(kept) AS i FROM s WHERE k = (SELECT max(k) FROM s)) SELECT doc_id AS pos FROM documents WHERE doc_id NOT IN (SELECT i FROM p) OR doc_id IN (SELECT i FROM e)""".replace(", n AS (SELECT pos, sqrt", ", nn AS (SELECT pos, sqrt").replace("n AS (SELECT pos, sqrt(sum(x * x)) AS n FROM x GROUP BY 1)", "nn AS (SELECT pos, sqrt(sum(x * x)) AS n FROM x GROUP BY 1)").replace("FROM x JOIN n USING (pos)", "FROM x JOIN nn USING (pos)"))
def tfidf_deduplicated(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("pos"), "text")
    return dedup.deduplicated(docs)[0].select("pos")


# ---- dialogues -----------------------------------------------------------------------------------------------------

METRICS = f"""m AS (SELECT conv_id, coalesce(sum({WORDS}) FILTER (speaker = 'student') / CAST(nullif(sum({WORDS}) FILTER (speaker <> 'system'), 0) AS DOUBLE), 0) AS student_talk_ratio, count(*) AS session_step,
  count(*) FILTER (speaker = 'tutor' AND {QUESTION}) AS num_questions_asked, bool_or(speaker = 'tutor' AND action_type = 'Ask_Background') AS asked_background,
  coalesce(min(turn_index) FILTER (speaker = 'tutor' AND action_type = 'Ask_Background'), -1) AS background_asked_at_turn,
  count(*) FILTER (speaker = 'tutor' AND action_type = 'Ask_Check_Understanding' AND rk <= 5) AS checks_of_understanding_last_k_turns,
  bool_or(speaker = 'tutor' AND action_type = 'Give_Step_By_Step_Explanation') AS gave_explanation, bool_or(speaker = 'tutor' AND action_type = 'Assign_Practice_Problem') AS assigned_practice,
  count(*) FILTER (speaker = 'student' AND regexp_matches(lower(utterance), '{"|".join(text.CONFUSION).replace("'", "''")}')) AS student_confusion_count,
  bool_or(speaker = 'tutor' AND action_type = 'Summarize_And_Wrap_Up') AS wrapped_up
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY turn_index DESC) AS rk FROM t) GROUP BY conv_id)"""


@query(f"WITH {T}, {METRICS} SELECT * REPLACE (round(student_talk_ratio, 6) AS student_talk_ratio) FROM m")
def dialogue_metrics(spark, d):
    return rounded(dialogue.metrics(turns(spark, d)), "student_talk_ratio")


@query(f"""WITH {T}, {METRICS} SELECT conv_id, round(greatest(0, 1 - 4 * pow(greatest(0.5 - student_talk_ratio, student_talk_ratio - 0.8, 0), 2)), 6) AS ratio_score, round(least(1, num_questions_asked / greatest(session_step / 10.0 * 5, 1)), 6) AS questions_score,
  round(CASE WHEN background_asked_at_turn < 0 THEN 0 WHEN background_asked_at_turn <= 3 THEN 1 ELSE greatest(0, 1 - (background_asked_at_turn - 3) * 0.1) END, 6)::DOUBLE AS background_score, round(least(1, checks_of_understanding_last_k_turns / 3.0), 6) AS checks_score FROM m""")
def dialogue_target_scores(spark, d):
    return rounded(dialogue.target_scores(dialogue.metrics(turns(spark, d))), "ratio_score", "questions_score", "background_score", "checks_score")


@query("WITH x AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role <> 'system') SELECT conv_id, arg_min(role, turn) = 'user' AS starts_with_user, min(turn) FILTER (p = role) AS first_repeat FROM x GROUP BY 1")
def role_alternation(spark, d):
    return dialogue.alternation(table(spark, d, "conversations"))


@query(f"WITH {T} SELECT conv_id, turn_index, md5(array_to_string(list(speaker || ': ' || utterance) OVER (PARTITION BY conv_id ORDER BY turn_index ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), chr(10))) AS context_md5 FROM t")
def context_windows(spark, d):
    return dialogue.context(turns(spark, d)).select("conv_id", "turn_index", F.md5(F.col("context").cast("binary")).alias("context_md5"))


@query(f"WITH {T} SELECT conv_id, turn_index, md5(last_value(CASE WHEN speaker = 'tutor' THEN utterance END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS last_tutor, count(*) FILTER (speaker = 'tutor') OVER (PARTITION BY conv_id ORDER BY turn_index) AS tutor_turns FROM t")
def tutor_so_far(spark, d):
    return dialogue.so_far(turns(spark, d)).select("conv_id", "turn_index", F.md5(F.col("last_tutor").cast("binary")).alias("last_tutor"), "tutor_turns")


@query(f"WITH {T}, x AS (SELECT *, trim(lower(utterance)) AS a, lag(trim(lower(utterance))) OVER (PARTITION BY conv_id, speaker ORDER BY turn_index) AS b FROM t) SELECT conv_id, turn_index, coalesce(a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)), false) AS is_repetitive FROM x")
def repeated_utterances(spark, d):
    return dialogue.repetition(turns(spark, d)).select("conv_id", "turn_index", "is_repetitive")


@query(f"WITH {T} SELECT conv_id, turn_index, {WORDS} AS words, {QUESTION} AS asks FROM t")
def utterance_features(spark, d):
    u = F.col("utterance")
    return turns(spark, d).select("conv_id", "turn_index", text.word_count(u).alias("words"), text.is_question(u).alias("asks"))


@query(f"WITH {PES}, {PESV} SELECT name, pes_score, pes_category FROM c")
def pes_scores(spark, d):
    return dialogue.pes(judged_parts(spark, d)).select("name", "pes_score", "pes_category")


@query(f"WITH {PES}, {PESV} SELECT pes_category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM c), 6) AS share, round((SELECT avg(pes_score) FROM c), 6) AS avg_pes, (SELECT min(pes_score) FROM c) AS min_pes, (SELECT max(pes_score) FROM c) AS max_pes FROM c GROUP BY 1")
def pes_summary(spark, d):
    return rounded(dialogue.pes_summary(dialogue.pes(judged_parts(spark, d))), "share", "avg_pes")


@query(f"WITH {PES} SELECT name, dimension, score, (score - 1) / 4.0::DOUBLE AS normalized FROM (UNPIVOT p ON {', '.join(dialogue.PES_DIMENSIONS)} INTO NAME dimension VALUE score)".replace("WITH p", "WITH p"))
def pes_dimensions(spark, d):
    return dialogue.dimension_rows(judged_parts(spark, d))


@query(f"WITH {E}, {STATS} SELECT variant, n_sessions, initial_correct, final_correct, improvement, round(accuracy, 6) AS accuracy, round(avg_turns, 6) AS avg_turns, natural_endings, forced_endings, round(duration_seconds, 2) AS duration_seconds FROM st")
def session_statistics(spark, d):
    return rounded(rounded(dialogue.session_stats(sessions(spark, d), "variant"), "accuracy", "avg_turns"), "duration_seconds", places=2)


@query(f"WITH {E}, {STATS} SELECT variant, row_number() OVER (ORDER BY accuracy DESC, pos, variant) AS accuracy_rank, row_number() OVER (ORDER BY improvement DESC, pos, variant) AS improvement_rank FROM st")
def variant_ranking(spark, d):
    st = dialogue.session_stats(sessions(spark, d), "variant", "pos").withColumn("pos", F.struct("pos", "variant"))
    one = dialogue.ranked(st, "accuracy").withColumnRenamed("rank", "accuracy_rank")
    return dialogue.ranked(one, "improvement").select("variant", "accuracy_rank", F.col("rank").alias("improvement_rank"))


@query("WITH x AS (SELECT c_custkey, (c_custkey % 100) / 100.0::DOUBLE AS pre, (c_custkey * 37 % 101) / 100.0::DOUBLE AS post FROM customer), y AS (SELECT *, CASE WHEN pre >= 0.99 THEN 0 ELSE greatest(0, (post - pre) / (1 - pre)) END AS g FROM x) SELECT c_custkey, round(g, 6)::DOUBLE AS learning_gain, round(CASE WHEN g >= 0.3 THEN 1 WHEN g >= 0.1 THEN 0.5 + 0.5 * (g - 0.1) / 0.2 ELSE 0.5 * g / 0.1 END, 6)::DOUBLE AS gain_score FROM y")
def learning_gains(spark, d):
    x = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 100 / 100.0).alias("pre"), (F.col("c_custkey") * 37 % 101 / 100.0).alias("post"))
    return rounded(x.select("c_custkey", dialogue.learning_gain(F.col("pre"), F.col("post")).alias("learning_gain")).withColumn("gain_score", dialogue.gain_score(F.col("learning_gain"))), "learning_gain", "gain_score")


# ---- sampling --------------------------------------------------------------------------------------------------------


@query("WITH c AS (SELECT c_mktsegment AS category, count(*) AS available FROM customer GROUP BY 1) SELECT category, available, 'fixed' AS mode, CAST(least(10, available) AS BIGINT) AS target FROM c UNION ALL SELECT category, available, 'percentage', CAST(greatest(1, floor(available * 0.1::DOUBLE)) AS BIGINT) FROM c UNION ALL SELECT category, available, 'cap', CAST(least(floor(77 / count(*) OVER ()), available) AS BIGINT) FROM c")
def sample_sizes(spark, d):
    counts = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("available"))
    parts = [sampling.sizes(counts, m, a).withColumn("mode", F.lit(m)) for m, a in (("fixed", 10), ("percentage", 0.1), ("cap", 77))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


RATE = " ".join(f"WHEN '{a}' THEN {r}" for a, r in dialogue.RATES["struggling"].items())


@query(f"WITH {T}, r AS (SELECT conv_id, turn_index, CAST(CASE action_type {RATE} ELSE 0.03 END AS DOUBLE) AS r FROM t WHERE speaker = 'tutor') SELECT conv_id, round(list_reduce(list(r ORDER BY turn_index), lambda s, x: least(1.0::DOUBLE, greatest(0.0::DOUBLE, s + x * (1 - s * 0.5::DOUBLE))), 0.2::DOUBLE), 6) AS mastery FROM r GROUP BY 1")
def mastery_fold(spark, d):
    acts = turns(spark, d).where("speaker = 'tutor'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "action_type"))), lambda x: x["action_type"]).alias("actions"))
    return acts.select("conv_id", F.round(dialogue.mastery_fold(F.col("actions"), F.lit(0.2), F.lit("struggling")), 6).alias("mastery"))


# ---- fine-tuning rows and overlap ------------------------------------------------------------------------------------

PAIRS = "q AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)"
IDS = "i AS (SELECT conv_id, turn, list_transform(string_split(text, ''), lambda c: unicode(c)) AS a, list_transform(string_split(answer, ''), lambda c: unicode(c)) AS b FROM q WHERE text <> '' AND answer <> '')"
MASKED = f"""{PAIRS}, {IDS}, k AS (SELECT conv_id, turn, a[1:1024] AS a, list_concat(b[1:256], [2]) AS b FROM i), z AS (SELECT *, list_transform(range(1281 - len(a) - len(b)), lambda x: 0) AS fill FROM k),
tr AS (SELECT conv_id, turn, list_concat(list_concat(a, b), fill) AS input_ids, list_concat(list_concat(list_transform(a, lambda x: -100), b), list_transform(fill, lambda x: -100)) AS labels, len(a) + len(b) AS n FROM z)"""
JOINED = "md5(array_to_string({0}, ' '))"


def answered(spark: SparkSession, d: str) -> DataFrame:
    following = F.lead("text").over(dialogue.Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").withColumn("answer", following)


def code_points(c: str):
    return F.transform(F.split(c, ""), lambda x: F.ascii(x))


def training(spark: SparkSession, d: str, max_source: int = 1024, max_target: int = 256) -> DataFrame:
    ids, labels = tuning.training_ids(code_points("text"), code_points("answer"), 2, 0, max_source, max_target)
    return answered(spark, d).where(tuning.usable(F.col("text"), F.col("answer"))).select("conv_id", "turn", ids.alias("input_ids"), labels.alias("labels"))


def digest(c):
    return F.md5(F.array_join(c.cast("array<string>"), " ").cast("binary"))


@query(f"WITH {MASKED} SELECT conv_id, turn, {JOINED.format('input_ids')} AS input_ids, {JOINED.format('labels')} AS labels FROM tr")
def masked_training_rows(spark, d):
    return training(spark, d).select("conv_id", "turn", digest(F.col("input_ids")).alias("input_ids"), digest(F.col("labels")).alias("labels"))


@query(f"WITH {MASKED}, m AS (SELECT *, max(n) OVER (PARTITION BY conv_id) AS most FROM tr) SELECT conv_id, turn, CAST(len(input_ids[1:most]) AS INT) AS width, {JOINED.format('input_ids[1:most]')} AS input_ids, {JOINED.format('labels[1:most]')} AS labels FROM m".replace("max(n)", "max(list_position(input_ids[1:n], list_max(input_ids)) - 1 + list_position(list_concat(input_ids[list_position(input_ids, list_max(input_ids)):], [0]), 0) - 1)"))
def collated_rows(spark, d):
    out = tuning.collated(training(spark, d), "conv_id", 0)
    return out.select("conv_id", "turn", F.size("input_ids").alias("width"), digest(F.col("input_ids")).alias("input_ids"), digest(F.col("labels")).alias("labels"))


@query(f"WITH {PAIRS}, {IDS}, k AS (SELECT conv_id, turn, a, CAST(ceil(max(len(a)) OVER (PARTITION BY conv_id) / 16.0) AS INT) * 16 - len(a) AS gap FROM i) SELECT conv_id, turn, md5(repeat('0 ', gap) || array_to_string(a, ' ')) AS input_ids, md5(repeat('0 ', gap) || array_to_string(list_transform(a, lambda x: 1), ' ')) AS attention_mask, md5(repeat('0 ', gap) || array_to_string(range(len(a)), ' ')) AS position_ids FROM k")
def left_padded_rows(spark, d):
    """Whole texts, padded to the longest of their conversation, rounded up to 16."""
    rows = answered(spark, d).where(tuning.usable(F.col("text"), F.col("answer"))).withColumn("ids", code_points("text"))
    longest = F.max(F.size("ids")).over(dialogue.Window.partitionBy("conv_id"))
    padded = rows.withColumn("longest", longest).select("conv_id", "turn", tuning.left_padded(F.col("ids"), F.col("longest"), 0, 16).alias("p"))
    return padded.select("conv_id", "turn", *[digest(F.col(f"p.{c}")).alias(c) for c in ("input_ids", "attention_mask", "position_ids")])


@query(f"""WITH {PAIRS}, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM q WHERE answer IS NOT NULL)
SELECT conv_id, md5(string_agg('[Round ' || k || ']\n\n问：' || text || '\n\n答：' || answer || '\n\n', '' ORDER BY k) || '[Round ' || count(*) + 1 || ']\n\n问：' || 'next' || '\n\n答：') AS prompt_md5 FROM n GROUP BY conv_id""")
def round_prompts(spark, d):
    past = answered(spark, d).where("answer IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("query"), F.col("answer").alias("response")))).alias("history"))
    return past.select("conv_id", F.md5(prompts.round_prompt(F.lit("next"), F.col("history")).cast("binary")).alias("prompt_md5"))


def _rouge_sql() -> str:
    cut = "list_filter(regexp_split_to_array({0}, '[\\s.]+'), lambda w: w <> '')"
    f = "round(2 * p{0} * r{0} / (p{0} + r{0} + 1e-8) * 100, 4) AS rouge_{0}"
    return f"""WITH {PAIRS}, w AS (SELECT conv_id, turn, {cut.format("text")} AS a, {cut.format("answer")} AS b FROM q WHERE answer IS NOT NULL),
g AS (SELECT conv_id, turn, list_distinct(a) AS a1, list_distinct(b) AS b1, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS a2, list_distinct(list_transform(range(1, len(b)), lambda i: b[i] || ' ' || b[i + 1])) AS b2 FROM w WHERE len(a) > 0 AND len(b) > 0),
h AS (SELECT conv_id, turn, {", ".join(f"coalesce(len(list_intersect(a{n}, b{n})) / CAST(nullif(len(a{n}), 0) AS DOUBLE), 0) AS p{n}, coalesce(len(list_intersect(a{n}, b{n})) / CAST(nullif(len(b{n}), 0) AS DOUBLE), 0) AS r{n}" for n in (1, 2))} FROM g)
SELECT conv_id, turn, {f.format(1)}, {f.format(2)} FROM h"""


@query(_rouge_sql())
def overlap_by_ngrams(spark, d):
    a, b = F.col("a"), F.col("b")
    rows = overlap.cut(answered(spark, d).where("answer IS NOT NULL"), a=F.col("text"), b=F.col("answer")).where("size(a) > 0 AND size(b) > 0")
    return rows.select("conv_id", "turn", overlap.rouge_n(a, b, 1).alias("rouge_1"), overlap.rouge_n(a, b, 2).alias("rouge_2"))


@query()
def overlap_means(spark, d):
    return overlap.means(overlap.overlaps(answered(spark, d).where("answer IS NOT NULL"), "text", "answer"), "role")


_LAYERS = ", ".join(f"printf('  {k} (weight {w}): %.4f', {x})" for k, w, x in (("layer1", 0.8, LAYER1), ("layer2", 0.1, "(question_depth - 1) / 4.0::DOUBLE"), ("layer3", 0.1, "(icap - 1) / 4.0::DOUBLE")))
_SCORES = ", ".join(f"'  {k}: ' || {k} || '/5'" for k in [*dialogue.PES_DIMENSIONS, "question_depth", "icap"])


@query(f"WITH {PES}, {PESV} SELECT name, md5(concat_ws(chr(10), 'Evaluation of ' || name, printf('PES %.2f: %s', pes_score, pes_category), 'Layers', {_LAYERS}, 'Dimensions', {_SCORES})) AS report_md5 FROM c")
def pes_reports(spark, d):
    """Digests of whole reports."""
    pages = dialogue.pes_report(dialogue.pes(judged_parts(spark, d)))
    return pages.select("name", F.md5(F.col("report").cast("binary")).alias("report_md5"))
