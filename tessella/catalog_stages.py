"""Queries of the staged parts: structured evaluation, row positions, generation in phases, ledgers and live tables.

As in ``catalog``, each has the SQL it is checked against; model replies are built from the tables' own texts.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import RATE, T, query, rounded, table, turns
from .functions import cutter
from .operators import dialogue
from .operators.staging import scratch
from .plans import phases, structured
from .sources import positions, tables
from .streaming import watch

c = F.col

# ---- structured evaluation -------------------------------------------------------------------------------------------

MARKED = "CASE WHEN n % 13 = 0 THEN 7 ELSE 1 + n % 5 END"
VERDICTS = "1 + n % 5 + CASE n % 7 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END"


def structured_replies(spark, d):
    """Assistant turns with one to five rubrics and a reply with a verdict for each, by the lengths of the turn's words; some replies are cut, some have a verdict too few or too many."""
    rows = table(spark, d, "conversations").where("role = 'assistant' AND text IS NOT NULL").select("conv_id", "turn", F.length("text").alias("n"), F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)").alias("w"))
    rows = rows.withColumn("rubrics", F.expr("transform(sequence(0, n % 5), i -> named_struct('criterion', concat('c', i), 'severity', if((n + i) % 3 = 0, 'critical', 'not_critical')))"))
    item = """concat('{"criteria":"c', i, '","passes":', if(coalesce(length(get(w, i)), 1) % 2 = 0, 'true', 'false'), ',"reasoning":"', coalesce(get(w, i), ''), '"}')"""
    whole = f"""concat('{{"rubric_evaluations":[', if({VERDICTS} = 0, '', array_join(transform(sequence(0, greatest({VERDICTS}, 1) - 1), i -> {item}), ',')), '],"overall_quality_score":', {MARKED}, ',"strengths":["', coalesce(get(w, 0), ''), '"],"weaknesses":[]}}')"""
    return rows.withColumn("_all", F.expr(whole)).withColumn("reply", F.expr("if(n % 11 = 0, substring(_all, 1, length(_all) - 3), _all)")).select("conv_id", "turn", "rubrics", "reply")


STRUCTURED = f"""
b AS (SELECT conv_id, turn, length(text) AS n, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations WHERE role = 'assistant' AND text IS NOT NULL),
a AS (SELECT conv_id, turn, n, '{{"rubric_evaluations":[' || array_to_string(list_transform(range({VERDICTS}), lambda i: '{{"criteria":"c' || i || '","passes":' || CASE WHEN coalesce(length(w[i + 1]), 1) % 2 = 0 THEN 'true' ELSE 'false' END
    || ',"reasoning":"' || coalesce(w[i + 1], '') || '"}}'), ',') || '],"overall_quality_score":' || {MARKED} || ',"strengths":["' || coalesce(w[1], '') || '"],"weaknesses":[]}}' AS whole FROM b),
r AS (SELECT conv_id, turn, n, CASE WHEN n % 11 = 0 THEN left(whole, length(whole) - 3) ELSE whole END AS reply FROM a),
j AS (SELECT *, json_valid(reply) AS ok, CASE WHEN json_valid(reply) THEN CAST(json_extract(reply, '$.rubric_evaluations[*].passes') AS BOOLEAN[]) END AS v,
  CASE WHEN json_valid(reply) THEN CAST(json_extract(reply, '$.overall_quality_score') AS INT) END AS q FROM r),
s AS (SELECT conv_id, turn, CASE WHEN NOT ok OR q NOT BETWEEN 1 AND 5 THEN 'broken' WHEN len(v) < 1 + n % 5 THEN 'short' WHEN len(v) > 1 + n % 5 THEN 'long' ELSE 'ok' END AS status, q, v,
  list_filter(range(1 + n % 5), lambda i: (n + i) % 3 = 0) AS critical FROM j),
e AS (SELECT conv_id, turn, status, CASE WHEN status = 'broken' THEN NULL WHEN len(critical) = 0 THEN 1.0 ELSE len(list_filter(critical, lambda i: coalesce(v[i + 1], false))) / CAST(len(critical) AS DOUBLE) END AS rate FROM s)"""


@query(f"WITH {STRUCTURED} SELECT conv_id, turn, status, round(rate, 6) AS critical_pass_rate, coalesce(rate > 0.8, false) AS keep FROM e")
def structured_evaluations(spark, d):
    return rounded(structured.read(structured_replies(spark, d)).select("conv_id", "turn", "status", "critical_pass_rate", "keep"), "critical_pass_rate")


@query(f"WITH {STRUCTURED} SELECT status, count(*) AS n, count(*) FILTER (rate > 0.8) AS n_kept FROM e GROUP BY status")
def structured_tally(spark, d):
    return structured.tally(structured.read(structured_replies(spark, d)))


# ---- tables and streams ----------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 1 WHEN o_custkey % 3 = 0 THEN 2 END AS version FROM orders),
l AS (SELECT o_custkey, max(version) AS version FROM v WHERE version IS NOT NULL GROUP BY 1)
SELECT o_custkey, l.version, max(o_orderkey) AS o_orderkey, round(arg_max(o_totalprice, o_orderkey), 2) AS o_totalprice FROM l JOIN v USING (o_custkey, version) GROUP BY 1, 2""")
def upserted_orders(spark, d):
    """Last orders by customer: first of even order numbers, then an upsert of odd ones for every third customer."""
    path, orders = scratch(spark, "upserted"), table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    tables.upsert(spark, path, orders.where("o_orderkey % 2 = 0").withColumn("version", F.lit(1)), ["o_custkey"], "o_orderkey", 16)
    tables.upsert(spark, path, orders.where("o_orderkey % 2 = 1 AND o_custkey % 3 = 0").withColumn("version", F.lit(2)), ["o_custkey"], "o_orderkey")
    return rounded(tables.read(spark, path), "o_totalprice", places=2)


def event_stream(spark, d):
    return spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]")


@query("""WITH p AS (SELECT event_id, user_id, event_type, event_id % 2 AS source, (event_id * 7919 % 1000003) / 1000003.0::DOUBLE AS score FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY source, score DESC) AS n FROM p WHERE score >= 0.7)
SELECT user_id, event_type, event_id FROM k WHERE n = 1""")
def exported_events(spark, d):
    """A stream of graded rows (even events) and one of revised rows (odd ones): the exported row of each user and kind of event."""
    text = lambda column: F.col(column).cast("string")
    rows = event_stream(spark, d).select(
        "event_id", text("user_id").alias("sample_id"), F.col("event_type").alias("persona_name"), F.lit(0).alias("variation_idx"), (F.col("event_id") * 7919 % 1000003 / 1000003.0).alias("weighted_score"),
        text("user_id").alias("prompt"), F.col("event_type").alias("initial_explanation"), F.lit("-").alias("follow_up"), text("event_id").alias("response"),
    )
    out = scratch(spark, "exported")
    watch.export(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "system", out, scratch(spark, "exported-state")).awaitTermination()
    said = F.split(F.col("messages")[1]["content"], "\n\n")
    part = lambda i, name: F.element_at(F.split(said[i], ": "), -1).alias(name)
    return watch.exported(spark, out).select(part(0, "user_id").cast("long").alias("user_id"), part(1, "event_type"), F.col("messages")[2]["content"].cast("long").alias("event_id"))


IDLE, KEEP, DELAY = 6 * 3600, 3 * 3600, 600
REPLAY = f"""
WITH RECURSIVE t AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id % 7) AS i, epoch_us(ts) AS tm, CAST(event_id % 7 AS INT) AS turn,
    event_type AS action, event_type = 'purchase' AS terminal, CASE WHEN event_id % 3 = 0 THEN props END AS answer, CASE WHEN event_id % 5 <> 0 THEN value > 40 END AS verdict FROM events),
s AS (
  SELECT u, CAST(0 AS BIGINT) AS i, 0 AS n, CAST(NULL AS VARCHAR) AS answer, CAST(NULL AS BOOLEAN) AS ini, CAST(NULL AS BOOLEAN) AS fin, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS BIGINT) AS seen, CAST(NULL AS BIGINT) AS ended,
    false AS idled, CAST(NULL AS STRUCT(n INT, answer VARCHAR, ini BOOLEAN, fin BOOLEAN, action VARCHAR, cause VARCHAR, tm BIGINT)) AS e1, CAST(NULL AS STRUCT(n INT, answer VARCHAR, ini BOOLEAN, fin BOOLEAN, action VARCHAR, cause VARCHAR, tm BIGINT)) AS e2
  FROM (SELECT DISTINCT u FROM t)
  UNION ALL
  SELECT u, i, CASE WHEN skip OR closed THEN 0 ELSE n2 END, CASE WHEN NOT (skip OR closed) THEN answer2 END, CASE WHEN NOT (skip OR closed) THEN ini2 END, CASE WHEN NOT (skip OR closed) THEN fin2 END, CASE WHEN NOT (skip OR closed) THEN action2 END,
    CASE WHEN NOT (skip OR closed) THEN tm END, CASE WHEN skip THEN ended2 WHEN closed THEN tm END, idled,
    CASE WHEN idled THEN {{'n': n, 'answer': answer, 'ini': ini, 'fin': fin, 'action': action, 'cause': 'idle', 'tm': seen + {IDLE}000000}} END,
    CASE WHEN closed THEN {{'n': n2, 'answer': answer2, 'ini': ini2, 'fin': fin2, 'action': action2, 'cause': CASE WHEN terminal THEN 'natural' ELSE 'forced' END, 'tm': tm}} END
  FROM (SELECT *, NOT skip AND (terminal OR n2 >= 6) AS closed FROM (
    SELECT s.u, t.i, t.tm, t.terminal, s.n, s.answer, s.ini, s.fin, s.action, s.seen, idle.x AS idled, gone.y AS ended2, gone.y IS NOT NULL AS skip,
      greatest(CASE WHEN idle.x THEN 0 ELSE s.n END, t.turn) AS n2, coalesce(t.answer, CASE WHEN NOT idle.x THEN s.answer END) AS answer2,
      CASE WHEN t.verdict IS NOT NULL AND t.turn = 0 THEN t.verdict WHEN NOT idle.x THEN s.ini END AS ini2, coalesce(t.verdict, CASE WHEN NOT idle.x THEN s.fin END) AS fin2, coalesce(t.action, CASE WHEN NOT idle.x THEN s.action END) AS action2
    FROM s JOIN t ON t.u = s.u AND t.i = s.i + 1,
      LATERAL (SELECT coalesce(t.tm > s.seen + {IDLE}000000, false) AS x) idle,
      LATERAL (SELECT CASE WHEN t.tm > (CASE WHEN idle.x THEN s.seen + {IDLE}000000 ELSE s.ended END) + {KEEP}000000 THEN NULL WHEN idle.x THEN s.seen + {IDLE}000000 ELSE s.ended END AS y) gone))),
o AS (
  SELECT u, unnest(list_filter([e1, e2], lambda e: e IS NOT NULL)) AS e FROM s
  UNION ALL
  SELECT u, {{'n': n, 'answer': answer, 'ini': ini, 'fin': fin, 'action': action, 'cause': 'idle', 'tm': seen + {IDLE}000000}} FROM s
  WHERE i = (SELECT max(i) FROM t WHERE t.u = s.u) AND seen + {IDLE}000000 < (SELECT max(tm) FROM t) - {DELAY}000000)
SELECT u AS user_id, e.n AS total_turns, e.answer AS final_answer, e.ini AS initial_judge_verdict, e.fin AS final_judge_verdict, e.action AS final_action, e.cause AS ended, e.tm AS ended_at FROM o"""


@query(REPLAY)
def live_sessions(spark, d):
    """Each user's events as turns of sessions: outcomes by the stream's state and timers, beside a replay of the whole table."""
    k = F.col("event_id")
    turns = event_stream(spark, d).select(
        F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("at"), (k % 7).cast("int").alias("turn_number"), F.col("event_type").alias("teacher_action"), (F.col("event_type") == "purchase").alias("teacher_is_terminal"),
        F.when(k % 3 == 0, F.col("props")).alias("student_final_answer"), F.when(k % 5 != 0, F.col("value") > 40).alias("judge_verdict"),
    )
    out = scratch(spark, "sessions")
    stream = watch.sessions(turns, 6, IDLE, KEEP, f"{DELAY} seconds")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "sessions-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).select(F.col("session_id").cast("long").alias("user_id"), *[c for c in stream.columns if c not in ("session_id", "ended_at")], F.unix_micros("ended_at").alias("ended_at"))


# ---- row positions ---------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER () - 1 AS pos FROM lineitem")
def numbered_lineitems(spark, d):
    return positions.numbered(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"))


# ---- generation in phases --------------------------------------------------------------------------------------------

PHASES = ["strategy", "knowledge", "errors", "plan", "answer"]


def phase_stub(system: str, messages: list[dict]) -> str:
    """Says what it is and the end of what it hears; nothing about errors where that has a 7."""
    heard = messages[0]["content"]
    return "" if system == "errors" and "7" in heard[-3:] else f"{system}<{heard[-15:]}>"


def phase_steps() -> list[phases.Phase]:
    own = ["c_mktsegment", "c_name"]
    user = lambda i: lambda rows: F.concat(F.col(PHASES[i - 1]), F.lit("/"), F.col(own[i % 2])) if i else F.col("c_name")
    return [phases.Phase(name, lambda rows, name=name: F.lit(name), user(i)) for i, name in enumerate(PHASES)]


SAID = "'{0}<' || right({1}, 15) || '>'"


@query(f"""WITH a AS (SELECT c_custkey, c_name, c_mktsegment || CASE WHEN c_custkey % 5 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE '' END AS c_mktsegment, {SAID.format("strategy", "c_name")} AS strategy FROM customer),
b AS (SELECT *, {SAID.format("knowledge", "(strategy || '/' || c_name)")} AS knowledge FROM a),
c AS (SELECT *, CASE WHEN contains(right(knowledge || '/' || c_mktsegment, 3), '7') THEN NULL ELSE {SAID.format("errors", "(knowledge || '/' || c_mktsegment)")} END AS errors FROM b),
d AS (SELECT *, {SAID.format("plan", "(errors || '/' || c_name)")} AS plan FROM c),
e AS (SELECT *, {SAID.format("answer", "(plan || '/' || c_mktsegment)")} AS answer FROM d)
SELECT c_custkey, strategy, knowledge, errors, plan, answer, answer AS response FROM e""")
def phased_generation(spark, d):
    """Every customer through five phases, half of them in a run before."""
    segment = F.concat("c_mktsegment", F.when(c("c_custkey") % 5 == 0, c("c_custkey").cast("string")).otherwise(""))
    tasks, path = table(spark, d, "customer").select("c_custkey", "c_name", segment.alias("c_mktsegment")), scratch(spark, "phases")
    phases.generated(tasks.where("c_custkey % 2 = 0"), phase_steps(), phase_stub, path, ["c_custkey"], 8)
    return phases.generated(tasks, phase_steps(), phase_stub, path, ["c_custkey"], 8).drop("c_name", "c_mktsegment")



def method_stub(system: str, messages: list[dict]) -> str:
    """An analysis by the last digit of what it hears; nothing that can be read for a 9."""
    digit = messages[0]["content"][-1]
    return "?" if digit == "9" else f"STUDENT_METHOD: way {digit}\nALTERNATIVE_METHODS: {'none' if digit == '0' else f'first {digit}, second, third, fourth'}\nSHOULD_BRANCH: {'Yes.' if int(digit) % 2 else 'no'}"


@query("""WITH t AS (SELECT o_orderkey, o_custkey AS sample_id, ['Calculus', 'Physics', 'History'][o_custkey % 3 + 1] AS subject, o_custkey % 10 AS digit FROM orders)
SELECT o_orderkey, sample_id, CASE WHEN subject <> 'History' AND digit <> 9 THEN 'way ' || digit END AS student_method,
  CASE WHEN subject = 'History' THEN NULL WHEN digit IN (0, 9) THEN '' ELSE 'first ' || digit || '|second|third' END AS alternatives, subject <> 'History' AND digit <> 9 AND digit % 2 = 1 AS should_branch FROM t""")
def analysed_samples(spark, d):
    tasks = table(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("sample_id"), F.get(F.lit(["Calculus", "Physics", "History"]), (c("o_custkey") % 3).cast("int")).alias("subject"))
    out = phases.analysed(tasks, method_stub, "analyse", c("sample_id").cast("string"))
    return out.select("o_orderkey", "sample_id", "student_method", F.array_join("alternative_methods", "|").alias("alternatives"), "should_branch")


# ---- dialogues, quizzes, words ---------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT *, 'Problem ' || conv_id AS problem, lead(CASE WHEN role = 'user' THEN text END) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, problem, text AS system, answer AS usr, row_number() OVER w AS n, lag(answer) OVER w AS prior FROM p WHERE role <> 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, n = 1 OR coalesce(prior, '') <> '' AS starts, CASE WHEN n = 1 THEN problem ELSE prior END AS prompt FROM t),
g AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS pair FROM s),
f AS (SELECT conv_id, turn, pair, first_value(prompt) OVER w AS prompt, first_value(system) OVER w AS response FROM g WINDOW w AS (PARTITION BY conv_id, pair ORDER BY turn)),
e AS (SELECT DISTINCT conv_id, pair, prompt, response FROM f)
SELECT f.conv_id, f.turn, md5(f.prompt) AS prompt_md5, md5(f.response) AS response_md5, count(e.pair) AS n_history, md5(coalesce(string_agg(e.prompt || '|' || e.response, '|' ORDER BY e.pair), '')) AS history_md5
FROM f LEFT JOIN e ON e.conv_id = f.conv_id AND e.pair < f.pair GROUP BY f.conv_id, f.turn, f.prompt, f.response""")
def dialogue_histories(spark, d):
    """Training rows of the conversations: what is not said by the user is asked by the teacher, whose answer is the user's next turn."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("user", F.lead(F.when(c("role") == "user", c("text"))).over(w)).where("role <> 'user'")
    turns = rows.select(c("conv_id"), "turn", F.concat(F.lit("Problem "), c("conv_id").cast("string")).alias("problem"), c("text").alias("system"), "user")
    md5 = lambda x: F.md5(x.cast("binary"))
    out = dialogue.history(turns, "conv_id", "turn")
    return out.select("conv_id", "turn", md5(c("prompt")).alias("prompt_md5"), md5(c("response")).alias("response_md5"), F.size("history").cast("long").alias("n_history"), md5(F.array_join(F.flatten("history"), "|")).alias("history_md5"))


DRAW = "CAST(CAST('0x' || substr(md5({0}), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE"


@query(f"""WITH q AS (SELECT c_custkey, (c_custkey * 37 % 101) / 100.0::DOUBLE AS mastery, ['A', 'B', 'C', 'D'][c_custkey % 4 + 1] AS correct, list_filter(['A', 'B', 'C', 'D'], lambda o: o <> ['A', 'B', 'C', 'D'][c_custkey % 4 + 1]) AS wrong FROM customer)
SELECT c_custkey, CASE WHEN {DRAW.format("c_custkey || '/9'")} < 0.25::DOUBLE + 0.75::DOUBLE * mastery THEN correct ELSE wrong[CAST(floor({DRAW.format("c_custkey || '/other/9'")} * 3) AS INT) + 1] END AS student_answer FROM q""")
def quiz_draws(spark, d):
    k = c("c_custkey")
    letters = F.lit(["A", "B", "C", "D"])
    rows = table(spark, d, "customer").select("c_custkey", (k * 37 % 101 / 100.0).alias("mastery"), F.get(letters, (k % 4).cast("int")).alias("correct_answer"), letters.alias("options"))
    return dialogue.quiz_answers(rows, 9, "c_custkey").select("c_custkey", "student_answer")


@query(f"""WITH {T}, a AS (SELECT conv_id, CAST(CASE action_type {RATE} ELSE 0.03 END AS DOUBLE) AS r, row_number() OVER (PARTITION BY conv_id ORDER BY turn_index) - 1 AS i, turn_index FROM t WHERE speaker = 'tutor'),
n AS (SELECT conv_id, turn_index, r, ({DRAW.format("conv_id || '/' || i || '/7'")} * 2 - 1) * 0.01::DOUBLE AS n FROM a),
l AS (SELECT conv_id, list({{'r': r, 'n': n}} ORDER BY turn_index) AS l FROM n GROUP BY 1)
SELECT conv_id, round(list_reduce(list_prepend({{'r': 0.2::DOUBLE, 'n': 0.0::DOUBLE}}, l), lambda s, x: {{'r': least(1.0::DOUBLE, greatest(0.0::DOUBLE, s.r + x.r * (1 - s.r * 0.5::DOUBLE) + x.n)), 'n': 0.0::DOUBLE}}).r, 6) AS mastery FROM l""")
def noisy_mastery(spark, d):
    acts = turns(spark, d).where("speaker = 'tutor'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "action_type"))), lambda x: x["action_type"]).alias("actions"))
    draws = F.transform(F.sequence(F.lit(0), F.size("actions") - 1), lambda i: dialogue.draw(7, c("conv_id"), i))
    return acts.select("conv_id", F.round(dialogue.mastery_fold(c("actions"), F.lit(0.2), F.lit("struggling"), draws), 6).alias("mastery"))


@query(r"""WITH RECURSIVE w AS (SELECT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS word FROM part), d AS (SELECT word, count(*) AS n FROM w GROUP BY 1), s AS (SELECT ln(CAST(sum(n) AS DOUBLE)) AS total, max(length(word)) AS longest FROM d),
m AS (SELECT map(list(word), list(ln(CAST(n AS DOUBLE)) - total)) AS shares, any_value(total) AS total, any_value(longest) AS longest FROM d, s),
b AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z]', '', 'g') AS run, length(regexp_replace(lower(p_name), '[^a-z]', '', 'g')) AS i, [0.0::DOUBLE] AS worth FROM part
  UNION ALL
  SELECT p_partkey, run, i - 1, list_prepend(list_max(list_transform(range(1, least(longest, length(run) - i + 1) + 1),
    lambda k: coalesce(shares[substr(run, i, k)], CASE WHEN k = 1 THEN -total ELSE -1e9 END) + worth[k])), worth) FROM b, m WHERE i >= 1)
SELECT p_partkey, run, round(worth[1], 4) AS worth FROM b WHERE i = 0""")
def cut_names(spark, d):
    """Part names without their blanks, cut by the dictionary of all names: what the best cut is worth."""
    names = table(spark, d, "part").select("p_partkey", F.regexp_replace(F.lower("p_name"), "[^a-z]", "").alias("run"))
    words = cutter.spaced(table(spark, d, "part").select(F.regexp_replace(F.lower("p_name"), "[^a-z]+", " ").alias("text")))
    own = cutter.cutter(words, everywhere=True)
    cut = cutter.cut(names, "run", own).select("p_partkey", "run", F.posexplode_outer("words").alias("i", "word")).join(words, "word", "left")
    share = F.when(c("word").isNull(), 0.0).otherwise(F.log(F.coalesce("n", F.lit(1)).cast("double")) - F.lit(own.total))
    return rounded(cut.groupBy("p_partkey", "run").agg(F.sum(share).alias("worth")), "worth", places=4)
