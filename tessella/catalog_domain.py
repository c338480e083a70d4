"""More queries of the engine over the driver tables: text parsers, prompts, joins, sampling rows, provider stubs.

As in ``catalog``, each has the SQL it is checked against. Replies that a model would give are built from table columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import providers
from .catalog import O, PES, PESV, R, S, SUMMARY, T, META, judged_parts, query, ratings, responses, results, rounded, table, turns
from .functions import prompts, stats, text
from .operators import curation, dedup, dialogue, rubrics, sampling, tuning
from .plans import episodes, flows
from .sources import io

c = F.col


def parts(spark, d, **columns):
    return table(spark, d, "part").select("p_partkey", *[F.expr(v).alias(k) for k, v in columns.items()])


# ---- parsers -------------------------------------------------------------------------------------------------------

NUMBER = "CASE p_partkey % 6 WHEN 0 THEN p_size || '%' WHEN 1 THEN p_size || 'π' WHEN 2 THEN p_size || ' × 10^-2' WHEN 3 THEN '1,' || lpad(CAST(p_size AS {0}), 3, '0') || ' kg' WHEN 4 THEN 'about ' || p_size ELSE '-' || p_size END"


@query("SELECT p_partkey, round(CASE p_partkey % 6 WHEN 0 THEN p_size / 100.0 WHEN 1 THEN p_size * pi() WHEN 2 THEN p_size * 0.01 WHEN 3 THEN 1000 + p_size WHEN 4 THEN NULL ELSE -p_size END, 6)::DOUBLE AS value FROM part")
def parsed_numbers(spark, d):
    return rounded(parts(spark, d, t=NUMBER.format("string")).select("p_partkey", text.number(c("t")).alias("value")), "value")


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN NULL ELSE p_partkey % 21 < 10 END AS agrees FROM part")
def compared_numbers(spark, d):
    rows = parts(spark, d, truth="'1000'", answer="CASE WHEN p_partkey % 7 = 6 THEN 'none' ELSE CAST(1000 + p_partkey % 21 AS string) || ' kg' END")
    return rows.select("p_partkey", text.numbers_agree(c("truth"), c("answer")).alias("agrees"))


@query("SELECT p_partkey, p_name AS last, p_brand AS first FROM part")
def final_answers(spark, d):
    rows = parts(spark, d, t="'So\nFINAL: ' || p_brand || '.\nNo, final: ' || p_name || ';.'")
    return rows.select("p_partkey", text.last_final(c("t")).alias("last"), text.first_final(c("t")).alias("first"))


@query("SELECT p_partkey, ['low', 'high', 'medium', 'low'][p_partkey % 4 + 1] AS confidence FROM part")
def answer_confidence(spark, d):
    rows = parts(spark, d, t="element_at(array('maybe ', 'Certainly ', 'so ', 'I am not sure but definitely '), CAST(p_partkey % 4 AS int) + 1) || p_name")
    return rows.select("p_partkey", text.confidence(c("t")).alias("confidence"))


@query("SELECT c_custkey, c_custkey % 4 < 2 AS strict, c_custkey % 4 < 3 AS flexible, CASE WHEN c_custkey % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS choice FROM customer")
def answer_checks(spark, d):
    said = F.when(c("c_custkey") % 4 == 0, F.concat(F.lit("The answer is "), c("c_mktsegment"), F.lit("."))).when(c("c_custkey") % 4 == 1, F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit("!"))).when(c("c_custkey") % 4 == 2, F.concat(F.lit("it would be "), c("c_mktsegment"), F.lit(" then"))).otherwise(F.lit("no idea"))
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", said.alias("said"), F.when(c("c_custkey") % 2 == 0, " b ").otherwise("c").alias("letter"))
    return rows.select("c_custkey", text.answer_matches(c("c_mktsegment"), c("said"), True).alias("strict"), text.answer_matches(c("c_mktsegment"), c("said")).alias("flexible"), text.choice_score(F.lit("B"), c("letter")).alias("choice"))


WORDSET = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda w: w <> ''))"
PAIRED = "q AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)"


@query(f"WITH {PAIRED}, k AS (SELECT conv_id, turn, list_filter({WORDSET.format('text')}, lambda w: length(w) > 3) AS key, {WORDSET.format('answer')} AS a FROM q WHERE answer IS NOT NULL) SELECT conv_id, turn, round(CASE WHEN len(key) = 0 THEN 0.5 ELSE len(list_intersect(key, a)) / CAST(len(key) AS DOUBLE) END, 6) AS score FROM k")
def short_answer_scores(spark, d):
    following = F.lead("text").over(dialogue.Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, d, "conversations").withColumn("answer", following).where("answer IS NOT NULL")
    return rounded(rows.select("conv_id", "turn", text.short_answer_score(c("text"), c("answer")).alias("score")), "score")


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS negative FROM part")
def negative_criteria(spark, d):
    rows = parts(spark, d, t="element_at(array('Must  NOT name ', 'the tutor should avoid ', 'names '), CAST(p_partkey % 3 AS int) + 1) || p_name")
    return rows.select("p_partkey", text.is_negative_criterion(c("t")).alias("negative"))


def _any(words, of="lower(utterance)"):
    return "(" + " OR ".join("contains({}, '{}')".format(of, w.replace("'", "''")) for w in words) + ")"


@query(f"""WITH {T} SELECT conv_id, turn_index, CASE WHEN contains(utterance, '?') THEN CASE WHEN {_any(text.CHECKS)} THEN 'Ask_Check_Understanding' WHEN {_any(text.BACKGROUND)} THEN 'Ask_Background' ELSE 'Ask_Open_Question' END
  WHEN {_any(text.EXPLANATION)} THEN 'Give_Step_By_Step_Explanation' WHEN {_any(text.PRACTICE)} THEN 'Assign_Practice_Problem' WHEN {_any(text.WRAP_UP)} THEN 'Summarize_And_Wrap_Up' ELSE 'Give_Step_By_Step_Explanation' END AS action
FROM (SELECT conv_id, turn_index, utterance || CASE turn_index % 4 WHEN 0 THEN ' do you understand?' WHEN 1 THEN ' Practice problem' WHEN 2 THEN ' what?' ELSE ' in summary' END AS utterance FROM t)""")
def inferred_actions(spark, d):
    tail = F.element_at(F.lit([" do you understand?", " Practice problem", " what?", " in summary"]), (c("turn_index") % 4 + 1).cast("int"))
    return turns(spark, d).select("conv_id", "turn_index", text.inferred_action(F.concat("utterance", tail)).alias("action"))


@query("SELECT p_partkey, ['asking_guiding_questions', 'identifying_core_difficulty', 'identifying_correct_steps', 'identifying_correct_steps', 'including_examples', NULL, 'step_by_step_help'][p_partkey % 7 + 1] AS skill FROM part")
def skills_by_keyword(spark, d):
    rows = parts(spark, d, t="element_at(array('Asks a question', ' Core misconception ', 'correct steps', 'incorrect steps', 'An analogy', 'Not applicable', 'help, step by step'), CAST(p_partkey % 7 AS int) + 1)")
    return rows.select("p_partkey", text.skill_by_keyword(c("t")).alias("skill"))


@query("SELECT p_partkey, p_name AS thought, CASE p_partkey % 3 WHEN 0 THEN 'GIVE_HINT' WHEN 1 THEN 'END_SUCCESS' ELSE 'ASK_QUESTION' END AS action, 'Look at ' || p_brand AS utterance, true AS is_valid, p_partkey % 3 = 1 AS is_terminal FROM part")
def teacher_turns(spark, d):
    act = "element_at(array('hint', 'end_success', 'Ask_Guiding_Question'), CAST(p_partkey % 3 AS int) + 1)"
    rows = parts(spark, d, t=f"'Thought: ' || p_name || '\nAction: ' || {act} || '\nUtterance: \"Look at ' || p_brand || '\"'")
    return rows.select("p_partkey", text.teacher_turn(c("t")).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, 'END_STUCK' AS action, 'We stop at ' || p_brand AS utterance, true AS is_valid FROM part")
def repaired_turns(spark, d):
    rows = parts(spark, d, t="'END_STUCK it is\naction: zzz\nWe stop at ' || p_brand")
    return rows.select("p_partkey", text.repaired_turn(c("t"), text.teacher_turn(c("t"))).alias("x")).select("p_partkey", "x.action", "x.utterance", "x.is_valid")


@query("SELECT p_partkey, p_partkey % 3 = 0 AS passed, CASE WHEN p_partkey % 3 = 2 THEN substr(repeat(p_name || ' ', 30), 1, 200) ELSE 'about ' || p_brand END AS explanation FROM part")
def judge_verdicts(spark, d):
    rows = parts(spark, d, t="CASE p_partkey % 3 WHEN 0 THEN 'judgment: fail\nJUDGMENT: Pass\nEXPLANATION: about ' || p_brand WHEN 1 THEN 'EXPLANATION: about ' || p_brand || '\nJUDGMENT: FAIL' ELSE repeat(p_name || ' ', 30) END")
    return rows.select("p_partkey", text.judgement(c("t")).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN 0 ELSE least(greatest(p_size - 1, 0), 9) END AS choice FROM part")
def selections(spark, d):
    rows = parts(spark, d, t="CASE WHEN p_partkey % 5 = 4 THEN 'none' ELSE 'I take\nSelected: number ' || p_size || ' of them' END")
    return rows.select("p_partkey", text.selection(c("t"), 10).alias("choice"))


@query("SELECT p_partkey, p_name AS student_method, p_partkey % 2 = 0 AS should_branch, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand || '|' || p_type END AS others FROM part")
def method_analyses(spark, d):
    rows = parts(spark, d, t="'STUDENT_METHOD: ' || p_name || '\nALTERNATIVE_METHODS: ' || CASE WHEN p_partkey % 3 = 0 THEN 'None' ELSE p_brand || ', ' || p_type END || '\nSHOULD_BRANCH: ' || CASE WHEN p_partkey % 2 = 0 THEN 'YES' ELSE 'no' END")
    x = text.method_analysis(c("t"))
    return rows.select("p_partkey", x.alias("x")).select("p_partkey", "x.student_method", "x.should_branch", F.array_join("x.alternative_methods", "|").alias("others"))


@query("SELECT p_partkey, 'Ask' AS name, p_name || ' (' || p_brand || ')' AS argument FROM part")
def legacy_actions(spark, d):
    rows = parts(spark, d, t="'Well. Action: Ask(\"' || p_name || ' (' || p_brand || ')\")'")
    return rows.select("p_partkey", text.legacy_action(c("t")).alias("x")).select("p_partkey", "x.*")


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'hint' WHEN 1 THEN 'explain' ELSE 'hint' END AS choice FROM part")
def fuzzy_choices(spark, d):
    rows = parts(spark, d, t="element_at(array('a small clue', 'EXPLAIN the step', 'nothing'), CAST(p_partkey % 3 AS int) + 1)")
    return rows.select("p_partkey", text.fuzzy_choice(c("t"), {"hint": ["hint", "clue"], "explain": ["explain", "step"]}).alias("choice"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def fenced_objects(spark, d):
    rows = table(spark, d, "events").select("event_id", F.concat(F.lit("see ```json\n"), "props", F.lit("\n``` done")).alias("t"))
    return rows.select("event_id", text.fenced_json(c("t"), "k int").getField("k").alias("k"))


@query("SELECT p_partkey, 'We look at ' || p_name || ' now' AS utterance FROM part")
def salvaged_utterances(spark, d):
    rows = parts(spark, d, t="'Action: GIVE_HINT\nshort\nWe look at ' || p_name || ' now\nand more of it'")
    return rows.select("p_partkey", text.salvaged_utterance(c("t")).alias("utterance"))


@query("SELECT p_partkey, 'What is ' || p_name || ' (x) or ' || p_brand AS question FROM part")
def open_questions(spark, d):
    rows = parts(spark, d, t="'What is which of the following ' || p_name || ' (x) or (B) ' || p_brand || ' '")
    return rows.select("p_partkey", text.open_question(c("t")).alias("question"))


# ---- formatting ------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, printf('%.2f%%', c_custkey % 1000 / 10.0) AS percent, CASE WHEN c_custkey % 3 = 0 THEN printf('%.2f%%', -(c_custkey % 50) / 1.0) WHEN c_custkey % 50 = 0 THEN '0.00%' ELSE printf('+%.2f%%', (c_custkey % 50) / 1.0) END AS delta,
  CASE WHEN c_custkey % 10 < 3 THEN 'very limited' WHEN c_custkey % 10 < 5 THEN 'basic' WHEN c_custkey % 10 < 7 THEN 'partial' WHEN c_custkey % 10 < 9 THEN 'good' ELSE 'strong' END AS mastery,
  'a_b_' || c_custkey || '_' || c_mktsegment AS key, ['x', 'y', 'z'][c_custkey % 3 + 1] AS assigned, 7 + 1000 * c_custkey AS seed, sha256('m|' || c_mktsegment || '|0.5|' || c_custkey) AS cache_key, replace(replace(c_mktsegment || '/a:b', '/', '_'), ':', '_') AS safe,
  ['openai', 'anthropic', 'hosted', 'local'][c_custkey % 4 + 1] AS provider, ['fatal', 'retry', 'other'][c_custkey % 3 + 1] AS error_kind FROM customer""")
def formatted_values(spark, d):
    k = c("c_custkey")
    pick = lambda values, n: F.element_at(F.lit(values), (k % n + 1).cast("int"))
    delta = F.when(k % 3 == 0, -(k % 50) / 100.0).otherwise(k % 50 / 100.0)
    return table(spark, d, "customer").withColumns({"a": F.lit("a"), "b": F.lit("b")}).select(
        "c_custkey", text.percent(k % 1000 / 1000.0).alias("percent"), text.signed_percent(delta).alias("delta"), text.mastery_label(k % 10 / 10.0 + 0.0001).alias("mastery"),
        text.key("a", "b", "c_custkey", "c_mktsegment").alias("key"), curation.one_of_each(k, ["x", "y", "z"]).alias("assigned"), sampling.episode_seed(F.lit(7), k).alias("seed"),
        text.cache_key(F.lit("m"), c("c_mktsegment"), F.lit(0.5), k.cast("string")).alias("cache_key"), text.safe_name(F.concat("c_mktsegment", F.lit("/a:b"))).alias("safe"),
        text.provider_of(pick(["GPT-x", "claude-y", "org/model", "tiny"], 4)).alias("provider"), text.error_kind(pick(["Quota exceeded", "HTTP 429", "boom"], 3)).alias("error_kind"),
    )


NAMED = "string_agg(CASE speaker WHEN 'student' THEN 'Student: ' ELSE 'Tutor: ' END || utterance, chr(10) ORDER BY turn_index) FILTER (speaker <> 'system')"


def talks(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    return rows.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


@query(f"WITH {T} SELECT conv_id, md5(coalesce({NAMED}, '')) AS marked, md5(string_agg('Turn ' || k || ' [' || CASE speaker WHEN 'student' THEN 'USER' WHEN 'tutor' THEN 'ASSISTANT' ELSE 'SYSTEM' END || ']: ' || utterance, chr(10) || chr(10) ORDER BY turn_index)) AS numbered FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) AS k FROM t) GROUP BY 1")
def rendered_conversations(spark, d):
    md5 = lambda x: F.md5(x.cast("binary"))
    return talks(spark, d).select("conv_id", md5(text.mark_turns(c("messages"), {"user": "Student", "assistant": "Tutor"})).alias("marked"), md5(text.numbered_turns(c("messages"))).alias("numbered"))


@query("WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user' AND text <> '') SELECT conv_id, md5(coalesce(max(text) FILTER (k = 1), '')) AS question, md5(coalesce(string_agg(chr(10) || text, '' ORDER BY k) FILTER (k > 1), '')) AS student_work FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN u USING (conv_id) GROUP BY 1")
def questions_and_work(spark, d):
    x = talks(spark, d).select("conv_id", text.question_and_work(c("messages")).alias("x"))
    return x.select("conv_id", *[F.md5(F.col(f"x.{k}").cast("binary")).alias(k) for k in ("question", "student_work")])


@query("SELECT conv_id, md5(coalesce(string_agg(CASE role WHEN 'user' THEN 'Student: ' ELSE 'Initial Response: ' END || text, chr(10) ORDER BY turn) FILTER (role IN ('user', 'assistant')), '')) AS context FROM conversations GROUP BY 1")
def judge_contexts(spark, d):
    return talks(spark, d).select("conv_id", F.md5(prompts.judge_context(c("messages")).cast("binary")).alias("context"))


@query("SELECT p_partkey, 'Question: ' || p_name || chr(10) || 'Answer: ' || chr(10) || 'Let''s think step by step.' || chr(10) AS prompt, CASE p_partkey % 3 WHEN 0 THEN 'look' WHEN 1 THEN 'read' ELSE 'else' END AS system FROM part")
def question_prompts(spark, d):
    case = F.element_at(F.lit(["adaptive", "assessment", "other"]), (c("p_partkey") % 3 + 1).cast("int"))
    system = prompts.system_prompt(case, c("p_partkey") % 3 == 0, {("adaptive", True): "look", ("assessment", False): "read"}, "else")
    return table(spark, d, "part").select("p_partkey", prompts.question_prompt(c("p_name")).alias("prompt"), system.alias("system"))


# ---- results ---------------------------------------------------------------------------------------------------------


@query(f"WITH {R}, {S} SELECT sample_id, round(weighted_score, 6) AS weighted_score FROM s ORDER BY s.weighted_score, sample_id LIMIT 5")
def bottom_samples(spark, d):
    return rounded(rubrics.worst(rubrics.scored(ratings(spark, d), "sample_id")).select("sample_id", "weighted_score"), "weighted_score")


@query(f"WITH {R}, {S}, {META}, b AS (SELECT subject AS key, {SUMMARY} FROM j GROUP BY 1) SELECT key, overall_score, n_samples, row_number() OVER (ORDER BY overall_score DESC, key) AS place FROM b")
def ordered_breakdown(spark, d):
    report = rounded(rubrics.breakdowns(results(spark, d), ["subject"]).where("breakdown = 'subject'"), "overall_score")
    return rubrics.ordered(report, "overall_score", "key").select("key", "overall_score", "n_samples", "place")


@query(f"WITH {R}, {S}, {META}, b AS (SELECT 'subject' AS breakdown, subject AS key, avg(weighted_score) AS v, count(*) AS n FROM j GROUP BY 2) SELECT breakdown, string_agg(key || ': ' || printf('%.2f%%', v * 100) || ' over ' || n || ' samples', chr(10) ORDER BY v DESC, key) AS page FROM b GROUP BY 1")
def summary_pages(spark, d):
    return rubrics.summary_page(rubrics.breakdowns(results(spark, d), ["subject"]).where("breakdown = 'subject'"))


@query(f"WITH {R} SELECT sample_id, count(*) FILTER (NOT passed) AS n_failed, coalesce(sum(abs(weight)) FILTER (NOT passed), 0)::BIGINT AS weight FROM r GROUP BY 1")
def failed_criteria(spark, d):
    item = F.struct(F.col("part").cast("string").alias("criterion"), "weight", F.lit("critical").alias("severity"), F.lit("").alias("explanation"), "passed")
    nested = ratings(spark, d).groupBy("sample_id").agg(F.collect_list(item).alias("r")).withColumn("f", curation.failed_criteria(c("r")))
    return nested.select("sample_id", F.size("f").cast("long").alias("n_failed"), F.aggregate("f", F.lit(0).cast("long"), lambda a, x: a + F.abs(x["weight"])).alias("weight"))


@query(f"WITH {R} SELECT sample_id, round(CASE WHEN count(*) FILTER (abs(weight) = 5) = 0 THEN 1 ELSE count(*) FILTER (abs(weight) = 5 AND passed AND run_id <= 3) / CAST(count(*) FILTER (abs(weight) = 5) AS DOUBLE) END, 6)::DOUBLE AS critical_pass_rate FROM r GROUP BY 1")
def aligned_critical_rates(spark, d):
    """Evaluations that are fewer than the rubrics: those beyond the third run are missing."""
    both = ratings(spark, d).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("run_id", "weight", "passed"))).alias("x"))
    rows = both.select("sample_id", F.transform("x", lambda r: F.struct(r["weight"].alias("weight"))).alias("rubrics"), F.transform(F.filter("x", lambda r: r["run_id"] <= 3), lambda r: F.struct(r["passed"].alias("passes"))).alias("rubric_evaluations"))
    return rounded(rubrics.by_position(rows).select("sample_id", "critical_pass_rate"), "critical_pass_rate")


@query(f"WITH {O} SELECT pos, weighted_score, critical_pass_rate, CAST(NULL AS BOOLEAN) AS is_revision FROM o UNION ALL SELECT pos + 1000000000, 0.8, 0.8, true FROM o WHERE weighted_score < 0.5")
def united_revisions(spark, d):
    rows = responses(spark, d)
    revised = rows.where("weighted_score < 0.5").withColumn("pos", c("pos") + 1_000_000_000)
    return curation.combined(rows, revised).select("pos", "weighted_score", "critical_pass_rate", "is_revision")


@query(f"WITH {O} SELECT pos, 'score ' || printf('%.2f%%', weighted_score * 100) || '; critical ' || printf('%.2f%%', critical_pass_rate * 100) || CASE WHEN weighted_score >= 0.7 AND critical_pass_rate >= 0.7 THEN '' WHEN pos % 2 = 0 THEN '; failed: a' || pos || '; b' ELSE '' END AS explanation FROM o")
def explained_rows(spark, d):
    kind = "array<struct<criterion:string,weight:int,passed:boolean>>"
    item = lambda name, w, ok: F.struct(name.alias("criterion"), F.lit(w).alias("weight"), F.lit(ok).alias("passed"))
    failed = F.array(item(F.concat(F.lit("a"), "pos"), 5, False), item(F.lit("x"), 1, False), item(F.lit("b"), -5, None), item(F.lit("y"), 5, True)).cast(kind)
    rows = responses(spark, d).withColumn("rubric_results", F.when(c("pos") % 2 == 0, failed))
    return curation.explained(rows).select("pos", "explanation")


@query(f"WITH {O} SELECT pos, 'system' AS role0, 'Question: q' || pos || chr(10) || chr(10) || 'Student''s Follow-up: f' || sample_id AS user, 'r' || pos AS answer FROM o")
def chat_rows(spark, d):
    rows = responses(spark, d).select("pos", "sample_id", F.concat(F.lit("q"), "pos").alias("prompt"), F.lit(None).cast("string").alias("initial_explanation"), F.concat(F.lit("f"), "sample_id").alias("follow_up"), F.concat(F.lit("r"), "pos").alias("response"))
    m = curation.chat_row("be kind", curation.student_view(), c("response"))
    return rows.select("pos", m.alias("m")).select("pos", F.col("m")[0]["role"].alias("role0"), F.col("m")[1]["content"].alias("user"), F.col("m")[2]["content"].alias("answer"))


@query(f"WITH {O}, l AS (SELECT a.pos AS removed, b.pos AS kept, 0.9::DOUBLE + (a.pos % 100) / 1000.0::DOUBLE AS similarity, a.sample_id = b.sample_id AS same FROM o a JOIN o b ON b.pos = a.pos - 1) SELECT count(*) AS n_pairs, count(*) FILTER (same) AS same_sample, count(*) FILTER (NOT same) AS cross_sample, round(min(similarity), 6) AS min, round(max(similarity), 6) AS max, round(avg(similarity), 6) AS mean, round(median(similarity), 6) AS median FROM l")
def duplicate_statistics(spark, d):
    rows = responses(spark, d).withColumn("text", c("subject"))
    log = rows.select(c("pos").alias("removed"), (0.9 + c("pos") % 100 / 1000.0).alias("similarity")).join(rows.select(c("pos").alias("kept")), F.expr("kept = removed - 1"))
    return rounded(dedup.duplicate_statistics(dedup.duplicate_details(rows, log)), "min", "max", "mean", "median")


@query("SELECT count(*) AS n_total, count(*) FILTER (p_size % 11 / 10.0 > 0.8) AS n_kept, round(count(*) FILTER (p_size % 11 / 10.0 > 0.8) / CAST(count(*) AS DOUBLE), 6) AS keep_rate, round(avg(p_size % 11 / 10.0), 6) AS mean_critical, round(avg(p_size % 5 + 1), 6) AS mean_quality, " + ", ".join(f"count(*) FILTER (p_size % 5 + 1 = {q}) AS quality_{q}" for q in range(1, 6)) + ", (SELECT string_agg(s, '|' ORDER BY s) FROM (SELECT DISTINCT unnest([p_brand, p_type]) AS s FROM part ORDER BY s LIMIT 10)) AS common_strengths FROM part")
def filter_run_statistics(spark, d):
    rows = parts(spark, d, critical_pass_rate="CAST(p_size % 11 AS double) / 10.0", overall_quality_score="p_size % 5 + 1", strengths="array(p_brand, p_type)")
    return rounded(curation.filter_statistics(rows), "keep_rate", "mean_critical", "mean_quality").withColumn("common_strengths", F.array_join("common_strengths", "|"))


@query(f"WITH {PES}, {PESV} SELECT count(*) AS n FROM c WHERE name % 10 <> 0")
def valid_evaluations(spark, d):
    rows = dialogue.pes(judged_parts(spark, d)).withColumn("pes_category", F.when(c("name") % 10 == 0, "Error").otherwise(c("pes_category")))
    return dialogue.judged_well(rows).agg(F.count("*").alias("n"))


@query(f"WITH {PES}, {PESV}, l AS (SELECT name, {'(' + ' + '.join(f'({k} - 1) / 4.0::DOUBLE' for k in dialogue.PES_DIMENSIONS) + ') / 8'} AS layer1, (question_depth - 1) / 4.0::DOUBLE AS layer2, (icap - 1) / 4.0::DOUBLE AS layer3 FROM c) SELECT name, 'layer1' AS layer, round(layer1 * 80, 6) AS contribution FROM l UNION ALL SELECT name, 'layer2', round(layer2 * 10, 6) FROM l UNION ALL SELECT name, 'layer3', round(layer3 * 10, 6) FROM l")
def pes_layers(spark, d):
    return rounded(dialogue.layer_rows(dialogue.pes(judged_parts(spark, d))).select("name", "layer", "contribution"), "contribution")


# ---- episodes and quizzes ----------------------------------------------------------------------------------------------


@query("SELECT c_nationkey, round(avg(CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END ELSE CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0.5 END END), 6)::DOUBLE AS quiz_score FROM customer GROUP BY 1")
def quiz_scores(spark, d):
    k = c("c_custkey")
    rows = table(spark, d, "customer").select(
        "c_nationkey", F.when(k % 2 == 0, "multiple_choice").otherwise("short").alias("question_type"), F.when(k % 2 == 0, "a").otherwise("slope is constant").alias("correct_answer"),
        F.when(k % 2 == 0, F.when(k % 4 == 0, " A").otherwise("b")).otherwise(F.when(k % 3 == 0, "a constant slope").otherwise("the slope")).alias("student_answer"),
    )
    return rounded(dialogue.quiz_score(rows, "c_nationkey"), "quiz_score")


EPISODE = """e AS (SELECT c_custkey, (c_custkey % 10) / 10.0::DOUBLE AS student_talk_ratio, c_custkey % 8 AS q, c_custkey % 5 AS k, c_custkey % 7 - 1 AS b, (c_custkey % 4) / 10.0::DOUBLE AS g FROM customer),
f AS (SELECT *, (greatest(0, 1 - 4 * pow(greatest(0.5 - student_talk_ratio, student_talk_ratio - 0.8, 0), 2)) + least(1, q / 5.0) + CASE WHEN b < 0 THEN 0 WHEN b <= 3 THEN 1 ELSE greatest(0, 1 - (b - 3) * 0.1) END + least(1, k / 3.0)) / 4 AS p,
  0.6 * CASE WHEN g >= 0.3 THEN 1 WHEN g >= 0.1 THEN 0.5 + 0.5 * (g - 0.1) / 0.2 ELSE 0.5 * g / 0.1 END + 0.4 * (0.2 + 0.6) / 2 AS l, CASE WHEN c_custkey % 2 = 0 THEN 0.5 * 0.9 + 0.3 * 0.5 + 0.2 ELSE 0.6 END AS u FROM e)"""


def episodes_of(spark, d):
    k = c("c_custkey")
    one = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    return table(spark, d, "customer").select(
        "c_custkey", c("c_mktsegment").alias("agent_type"), (k % 10 / 10.0).alias("student_talk_ratio"), (k % 8).alias("num_questions_asked"), (k % 5).alias("checks_of_understanding_last_k_turns"),
        (k % 7 - 1).alias("background_asked_at_turn"), (k % 4 / 10.0).alias("learning_gain"), one("a", 0.2, "b", 0.6).alias("knowledge"), F.when(k % 2 == 0, one("pedagogical_usefulness", 0.9)).otherwise(one("other", 0.1)).alias("quality"),
    )


@query(f"WITH {EPISODE} SELECT c_custkey, round(p, 6)::DOUBLE AS pedagogy_score, round(l, 6)::DOUBLE AS learning_score, round(u, 6)::DOUBLE AS quality_score, round(0.4 * p + 0.4 * l + 0.2 * u, 6)::DOUBLE AS total_score FROM f")
def episode_scores(spark, d):
    names = ["pedagogy_score", "learning_score", "quality_score", "total_score"]
    return rounded(dialogue.episode_scores(episodes_of(spark, d)).select("c_custkey", *names), *names)


@query(f"WITH {EPISODE} SELECT c_mktsegment AS agent_type, count(*) AS n, round(avg(p), 6)::DOUBLE AS mean, round(stddev_pop(p), 6)::DOUBLE AS std, round(median(p), 6)::DOUBLE AS median, round(avg(g), 6) AS mean_gain, round(avg(0.4 * p + 0.4 * l + 0.2 * u), 6)::DOUBLE AS mean_total FROM f JOIN customer USING (c_custkey) GROUP BY 1")
def agent_summary(spark, d):
    return rounded(dialogue.episode_summary(dialogue.episode_scores(episodes_of(spark, d))), "mean", "std", "median", "mean_gain", "mean_total")


@query("SELECT c_custkey, round(CASE c_custkey % 3 WHEN 0 THEN 100.0 / 3 WHEN 1 THEN 200.0 / 3 ELSE 0 END, 2)::DOUBLE AS matched, round((c_custkey % 5 + 3) / 20.0, 6)::DOUBLE AS mastery FROM customer")
def matched_maps(spark, d):
    k = c("c_custkey")
    actual = F.when(k % 3 == 0, F.create_map(F.lit("a"), F.lit(5), F.lit("b"), F.lit(3))).when(k % 3 == 1, F.create_map(F.lit("a"), F.lit(5), F.lit("b"), F.lit(4)))
    desired = F.create_map(F.lit("a"), F.lit(5), F.lit("b"), F.lit(4), F.lit("c"), F.lit(1))
    mastery = F.create_map(F.lit("x"), k % 5 / 10.0, F.lit("y"), F.lit(0.3))
    return table(spark, d, "customer").select("c_custkey", dialogue.damr(F.coalesce(actual, F.create_map().cast("map<string,int>")), desired).alias("matched"), F.round(dialogue.mean_of_map(mastery), 6).alias("mastery"))


@query(f"WITH {T} SELECT conv_id, CAST(count(*) AS INT) AS n, md5(string_agg(CASE speaker WHEN 'student' THEN 'student' ELSE 'tutor' END || utterance, '|' ORDER BY turn_index)) AS said FROM t WHERE speaker <> 'system' AND utterance <> '' GROUP BY 1")
def judge_conversations(spark, d):
    rows = turns(spark, d).where("speaker <> 'system'").select("conv_id", c("turn_index").alias("pos"), F.when(c("speaker") == "tutor", "teacher").otherwise("student").alias("speaker"), F.when(c("speaker") == "tutor", c("utterance")).alias("teacher_utterance"), F.when(c("speaker") == "student", c("utterance")).alias("student_text"))
    out = dialogue.judge_conversations(rows, "conv_id")
    return out.select("conv_id", F.size("conversation").alias("n"), F.md5(F.array_join(F.transform("conversation", lambda m: F.concat(m["role"], m["content"])), "|").cast("binary")).alias("said"))


@query(f"WITH {T} SELECT conv_id, count(*) AS n_turns, string_agg(speaker, ',' ORDER BY turn_index) AS speakers FROM t GROUP BY 1")
def episode_records(spark, d):
    rows = turns(spark, d)
    own = rows.select("conv_id").distinct().withColumns({"agent_type": F.lit("x"), "student_persona": F.lit("y"), "task_id": F.lit("z"), "metrics": F.create_map(F.lit("m"), F.lit(1.0)), "pre_quiz_score": F.lit(0.1), "post_quiz_score": F.lit(0.5), "learning_gain": F.lit(0.4)})
    out = dialogue.episode_record(own, rows, "conv_id")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: t["speaker"]), ",").alias("speakers"))


# ---- joins with a cache, unions, sampling rows -------------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'new' || c_custkey WHEN c_custkey % 3 = 0 THEN 'old' || c_custkey END AS response FROM customer")
def cache_lookup(spark, d):
    keyed = table(spark, d, "customer").select("c_custkey", c("c_custkey").cast("string").alias("cache_key"))
    entry_of = lambda word, at: keyed.select("cache_key", F.concat(F.lit(word), "cache_key").alias("response"), F.lit("m").alias("model"), F.lit(0.0).alias("temperature"), F.lit(at).alias("created_at"))
    cache = io.upserted(entry_of("old", 1.0).where("cache_key % 3 = 0"), entry_of("new", 2.0).where("cache_key % 6 = 0"), "cache_key")
    hit, missed = io.cached(keyed, cache)
    return hit.select("c_custkey", "response").unionByName(missed.select("c_custkey", F.lit(None).cast("string").alias("response")))


@query("SELECT part, n, n_null FROM (SELECT 0 AS part, count(*) AS n, count(*) AS n_null FROM customer UNION ALL SELECT 1, count(*), 0 FROM orders)")
def concatenated_tables(spark, d):
    out = tuning.concatenated(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select("o_orderkey"))
    return out.groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderkey").isNull()).alias("n_null"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def branching_samples(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment").withColumn("subject", c("c_mktsegment"))
    return curation.branching(rows, ["BUILDING", "MACHINERY"]).drop("subject")


HASHED = "md5(CAST({0} AS VARCHAR) || '/42')"


@query(f"SELECT c_mktsegment, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY {HASHED.format('c_custkey')}, c_custkey) <= 10")
def balanced_sample(spark, d):
    return sampling.balanced(table(spark, d, "customer"), "c_mktsegment", "c_custkey", "fixed", 10).select("c_mktsegment", "c_custkey")


@query(f"""WITH c AS (SELECT c_mktsegment AS s, count(*) AS n, sum(count(*)) OVER () AS total FROM customer GROUP BY 1), q AS (SELECT s, n, CAST(floor(n * 100 / CAST(total AS DOUBLE)) AS BIGINT) AS q, n * 100 / CAST(total AS DOUBLE) - floor(n * 100 / CAST(total AS DOUBLE)) AS f FROM c),
k AS (SELECT s, q + CASE WHEN row_number() OVER (ORDER BY f DESC, s) <= 100 - sum(q) OVER () THEN 1 ELSE 0 END AS t FROM q)
SELECT c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY {HASHED.format('c_custkey')}, c_custkey) <= t THEN 'test' ELSE 'train' END AS split FROM customer JOIN k ON s = c_mktsegment""")
def stratified_split(spark, d):
    return sampling.stratified_split(table(spark, d, "customer"), "c_mktsegment", "c_custkey", 100).select("c_custkey", "split")


@query(f"""WITH o AS (SELECT 'o_' || o_custkey || '_p_' || o_orderkey AS key FROM orders), n AS (SELECT key, row_number() OVER (ORDER BY {HASHED.format('key')}, key) - 1 AS p FROM o),
x AS (SELECT key, CASE WHEN p < 100 THEN 'test' WHEN p >= 1000 AND p < 2000 THEN 'valid' WHEN p < 2000 THEN 'unused' ELSE 'train' END AS split, string_split(key, '_')[2] AS customer FROM n)
SELECT key, split FROM x WHERE split IN ('test', 'valid') OR (split = 'train' AND customer NOT IN (SELECT customer FROM x WHERE split IN ('test', 'valid')))""")
def positional_split(spark, d):
    rows = table(spark, d, "orders").select(F.concat_ws("_", F.lit("o"), "o_custkey", F.lit("p"), "o_orderkey").alias("key"))
    return sampling.positional_split(rows, "key").select("key", "split")


@query(f"SELECT c_custkey FROM customer ORDER BY {HASHED.format('c_custkey')}, c_custkey LIMIT 50")
def seeded_rows(spark, d):
    return io.seeds(table(spark, d, "customer").select("c_custkey"), "c_custkey", 50)


# ---- sources from raw rows ---------------------------------------------------------------------------------------------


@query("SELECT format('sample_{:04d}', p_partkey) AS sample_id, p_brand AS subject, 2 AS n_messages, CASE WHEN p_partkey % 4 = 3 THEN 0 ELSE 2 END AS n_rubrics, CASE WHEN p_partkey % 4 = 3 THEN NULL WHEN p_partkey % 2 = 0 THEN 5 ELSE 1 END AS weight FROM part")
def raw_csv_samples(spark, d):
    raw = "'[{\"criteria\":\"Must not ' || p_size || '\",\"attributes\":{\"severity\":\"' || CASE WHEN p_partkey % 2 = 0 THEN 'Critical' ELSE 'no' END || '\"}},{\"criteria\":\"b\"}]'"
    rows = parts(spark, d, pos="p_partkey", SUBJECT="p_brand", PROMPT="p_name", UC1_INITIAL_EXPLANATION="CAST(NULL AS string)", FOLLOW_UP_PROMPT="p_type", RUBRICS=f"CASE WHEN p_partkey % 4 = 3 THEN '[broken' ELSE {raw} END")
    out = io.csv_samples(rows)
    return out.select("sample_id", "subject", F.size("messages").alias("n_messages"), F.size("rubrics").alias("n_rubrics"), F.get("rubrics", F.lit(0))["weight"].alias("weight"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_brand END AS ground_truth, len(['a', p_brand]) - 0 AS n_options FROM part WHERE p_partkey % 2 = 0")
def open_question_rows(spark, d):
    rows = parts(spark, d, question="p_name", options="array('N/A', 'a', p_brand)", answer_index="CASE WHEN p_partkey % 3 = 0 THEN 5 ELSE 1 END", category="CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE 'y' END")
    return io.questions(rows, ["x"]).select("p_partkey", "ground_truth", F.size("options").cast("long").alias("n_options"))


# ---- provider stubs ----------------------------------------------------------------------------------------------------

RUBRIC = [("short", 5), ("kind", 1)]


def asked(spark, d):
    """A sample for each user turn, with two rubrics."""
    rubric = F.array(*[F.struct(F.lit(n).alias("criterion"), F.lit(w).alias("weight"), F.lit("style_tone").alias("evaluation_dimension"), F.lit(None).cast("string").alias("tutoring_skill")) for n, w in RUBRIC])
    rows = table(spark, d, "conversations").where("role = 'user'")
    return rows.select(F.concat_ws("_", "conv_id", "turn").alias("sample_id"), F.lit("").alias("system_prompt"), F.array(F.struct(c("role"), c("text").alias("content"))).alias("messages"), rubric.alias("rubrics"), F.lit(False).alias("is_multimodal"))


def stub_judge(system: str, messages: list[dict]) -> str:
    """Passes "kind" always, and "short" if the response has an even number of characters."""
    said = messages[-1]["content"]
    return "JUDGMENT: " + ("PASS" if said.startswith("Criterion: kind") or len(said.split("Response: ", 1)[1]) % 2 == 0 else "FAIL")


ASKED = "a AS (SELECT conv_id || '_' || turn AS sample_id, text FROM conversations WHERE role = 'user')"


@query(f"WITH {ASKED} SELECT sample_id, '[1] ' || text AS response, CASE WHEN (length(text) + 4) % 2 = 0 THEN 1.0 ELSE round(1 / 6.0::DOUBLE, 6) END::DOUBLE AS weighted_score, CASE WHEN (length(text) + 4) % 2 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS pass_rate FROM a")
def judge_stub(spark, d):
    out = flows.evaluated(asked(spark, d), providers.echo, stub_judge)
    return rounded(out.select("sample_id", "response", "weighted_score", "pass_rate"), "weighted_score", "pass_rate")


def longest(texts: list[str]) -> int:
    return max(range(len(texts)), key=lambda i: (len(texts[i]), -i))


@query(f"WITH {ASKED} SELECT sample_id, 's' || chr(10) || '(candidate 1)' AS response FROM a")
def best_of_stub(spark, d):
    rows = asked(spark, d).withColumn("system_prompt", F.lit("s"))
    return providers.respond(rows, providers.best_of(lambda system, messages: system, longest, 3)).select("sample_id", "response")


@query(f"WITH {ASKED} SELECT sample_id, '[2] [1] ' || text AS chained, '[1] ' || text AS single, 'chained' AS longer FROM a")
def chain_stub(spark, d):
    out = providers.single_or_chain(asked(spark, d), providers.echo, providers.chain(providers.echo, ["plan", "answer"]))
    return out.select("sample_id", "chained", "single", "longer")


@query(f"WITH {ASKED} SELECT count(*) AS n_calls, count(*) FILTER (length(text) % 3 = 0) AS n_failed, sum(length(text))::BIGINT AS chars_sent, coalesce(sum(length(text) + 4) FILTER (length(text) % 3 <> 0), 0)::BIGINT AS chars_received FROM a")
def usage_counters(spark, d):
    def call(system, messages):
        if len(messages[-1]["content"]) % 3 == 0:
            raise TimeoutError("503")
        return providers.echo(system, messages)

    return providers.usage(providers.respond(asked(spark, d), call))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN p_partkey % 3 = 0 ELSE false END AS is_correct, CASE p_partkey % 4 WHEN 2 THEN 'judge' WHEN 3 THEN 'empty' ELSE 'numbers' END AS by FROM part")
def answers_judged(spark, d):
    rows = parts(spark, d, ground_truth="CASE WHEN p_partkey % 4 = 2 THEN 'a slope' ELSE '200' END", answer="element_at(array('200.5', '300', 'slope ' || CAST(p_partkey AS string), ''), CAST(p_partkey % 4 AS int) + 1)")
    say = lambda system, messages: " correct, yes" if int(messages[-1]["content"].split()[-1]) % 3 == 0 else "INCORRECT"
    return episodes.answers_judged(rows, say).select("p_partkey", "is_correct", "by")


@query("SELECT conv_id, CAST(count(*) % 5 + 1 AS INT) AS clarity_like, 3 AS missing_like, 's' || count(*) AS summary FROM conversations GROUP BY 1")
def conversation_scores(spark, d):
    """The first of the judged names scores by the number of messages, others have no readable answer."""
    first = episodes.JUDGED[0]

    def judge(what, messages):
        return f"s{len(messages)}" if what == "summary" else f'```json\n{{"score": {len(messages) % 5 + 1}}}\n```' if what == first else "no score"

    rows = talks(spark, d).withColumnRenamed("messages", "conversation")
    return episodes.conversation_judged(rows, judge).select("conv_id", c(first).alias("clarity_like"), c("icap").alias("missing_like"), "summary")


@query("""WITH v AS (SELECT unnest(['ends', 'goes_on']) AS variant), q AS (SELECT variant, CAST(c_custkey AS VARCHAR) AS session_id, c_custkey % 4 AS k FROM customer CROSS JOIN v),
n AS (SELECT *, variant = 'ends' AND k < 3 AS "natural" FROM q)
SELECT variant, session_id, CASE WHEN "natural" THEN 3 ELSE 4 END AS total_turns, "natural" AS terminated_naturally, NOT "natural" AS forced_termination,
  CASE WHEN "natural" THEN '2' ELSE '4' END AS final_answer, "natural" AS final_judge_verdict FROM n""")
def simulated_sessions(spark, d):
    """The student counts its answers; one teacher ends after as many turns as the question says, which counts once the answer is right, one never does."""
    number = lambda m: sum(x["role"] == "student" for x in m)
    student = lambda system, m: f"I think\nFINAL: {number(m)}."
    ends = lambda system, m: "Thought: x\nAction: END_SUCCESS\nUtterance: done" if number(m) > int(system) else "Action: GIVE_HINT\nUtterance: go on"
    goes_on = lambda system, m: "Action: GIVE_HINT\nUtterance: go on"
    rows = table(spark, d, "customer").select(c("c_custkey").cast("string").alias("session_id"), (c("c_custkey") % 4).cast("string").alias("question"), F.lit("2").alias("ground_truth"))
    _, out = episodes.experiment(rows, {"ends": (ends, student), "goes_on": (goes_on, student)}, lambda truth, answer: truth == answer, 5)
    return out.select("variant", "session_id", "total_turns", "terminated_naturally", "forced_termination", "final_answer", "final_judge_verdict")


@query("""WITH t(n, t) AS (VALUES (2, 12.7062047), (3, 4.3026527), (4, 3.1824463), (5, 2.7764451), (6, 2.5705818), (7, 2.4469119), (8, 2.3646243)),
g AS (SELECT l_orderkey, count(*) AS n, stddev_samp(l_quantity) AS sd FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(g.n AS INT) AS n, round(t.t, 4)::DOUBLE AS t, round(coalesce(t.t * sd / sqrt(g.n), 0), 2)::DOUBLE AS margin FROM g LEFT JOIN t ON t.n = g.n WHERE g.n < 9""")
def critical_values(spark, d):
    """Critical values and margins for the mean quantity of each order's lines, beside published quantiles."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.stddev_samp("l_quantity").alias("sd")).where("n < 9")
    return rounded(rounded(rows.select("l_orderkey", "n", stats.t_critical(c("n")).alias("t"), stats.margin(c("n"), F.coalesce("sd", F.lit(0.0))).alias("margin")), "t", places=4), "margin", places=2)
