"""Queries of the parsers over the tables' own texts, with markers of replies woven between their words.

Where a marker goes depends on the words, so that thousands of different replies come about; the SQL weaves the same texts and parses
them by itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query, rounded, table
from .functions import text

c = F.col


def literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return "[" + ", ".join(map(literal, values)) + "]"


def woven(spark, d, source: str, keys: list[str], markers: list[str], every: int):
    """(keys, t): the texts with a marker before each word whose length and place ask for one."""
    number = "doc_id" if source == "documents" else "conv_id * 13 + turn * 5"
    rows = table(spark, d, source).where("text IS NOT NULL").select(*keys, F.expr(number).alias("_n"), F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)").alias("w"))
    marker = lambda v, i: F.coalesce(F.get(F.lit(markers), ((F.length(v) * 31 + (i + 1) * 7 + c("_n")) % every).cast("int")), F.lit(""))
    return rows.select(*keys, F.array_join(F.transform("w", lambda v, i: F.concat(marker(v, i), v)), " ").alias("t"))


def weave(source: str, keys: list[str], markers: list[str], every: int) -> str:
    number = "doc_id" if source == "documents" else "conv_id * 13 + turn * 5"
    return rf"""w AS (SELECT {", ".join(keys)}, {number} AS number, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM {source} WHERE text IS NOT NULL),
t AS (SELECT {", ".join(keys)}, coalesce(array_to_string(list_transform(w, lambda v, i: coalesce({listed(markers)}[(length(v) * 31 + i * 7 + number) % {every} + 1], '') || v), ' '), '') AS t FROM w)"""


DOC, TURN = ["doc_id"], ["conv_id", "turn"]
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x)


def md5(x):
    return F.md5(x.cast("binary"))


JUDGMENTS = ("documents", DOC, ["\nJUDGMENT: PASS\n", "\nJudgment: fail ", "\n judgment: passed ", "\nEXPLANATION: ", "\nexplanation: so ", "\n", "JUDGMENT: PASS "], 37)


@query(f"""WITH {weave(*JUDGMENTS)}, l AS (SELECT doc_id, t, list_transform(string_split(t, chr(10)), lambda x: {strip("x")}) AS l FROM t),
f AS (SELECT doc_id, t, list_filter(l, lambda x: starts_with(upper(x), 'JUDGMENT:')) AS j, list_filter(l, lambda x: starts_with(upper(x), 'EXPLANATION:')) AS e FROM l)
SELECT doc_id, coalesce(contains(upper(j[-1]), 'PASS'), false) AS passed, md5(coalesce({strip("substr(e[-1], 13)")}, substr(t, 1, 200))) AS explanation_md5 FROM f""")
def woven_verdicts(spark, d):
    v = text.judgement(c("t"))
    return woven(spark, d, *JUDGMENTS).select("doc_id", v["passed"].alias("passed"), md5(v["explanation"]).alias("explanation_md5"))


CHOICES = ("documents", DOC, ["\nSELECTED: ", "Selected: option ", " 3 ", " 2\n", "-12 ", "\n", "selected:\n"], 53)


@query(rf"WITH {weave(*CHOICES)} SELECT doc_id, least(greatest(coalesce(TRY_CAST(regexp_extract(t, '(?i)SELECTED:.*?(\d+)', 1) AS INT) - 1, 0), 0), 4) AS choice FROM t")
def woven_selections(spark, d):
    return woven(spark, d, *CHOICES).select("doc_id", text.selection(c("t"), 5).alias("choice"))


REASONS = ("conversations", TURN, ["\nSELECTED: 2\n", "\nREASONING: ", "\n", " \n\n ", "REASONING:", "\nreasoning: "], 43)


@query(rf"""WITH {weave(*REASONS)}, l AS (SELECT conv_id, turn, list_transform(string_split({strip("t")}, chr(10)), lambda x: {strip("x")}) AS l FROM t),
p AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: starts_with(x, 'REASONING:')), true), 0) AS spot FROM l)
SELECT conv_id, turn, md5(CASE WHEN spot = 0 THEN 'No reasoning provided' ELSE array_to_string(list_concat([{strip("string_split(l[spot], 'REASONING:')[2]")}], list_filter(l, lambda x, i: i > spot AND NOT starts_with(x, 'SELECTED:') AND x <> '')), ' ') END) AS reasoning_md5 FROM p""")
def woven_reasons(spark, d):
    return woven(spark, d, *REASONS).select("conv_id", "turn", md5(text.selection_reason(c("t"))).alias("reasoning_md5"))


TEACHER = ("conversations", TURN, ["Thought: ", "\nAction: give hint\n", "\nAction: SUCCESS\n", "\n ACTION: probe_understanding ", "\nUtterance: \"", "\nutterance: ", "```", "\n", "end_stuck ", "thought: ", "Action: dance ", "' "], 41)
ACTIONS = listed(text.ACTIONS)
ACTION = "CASE WHEN list_contains({acts}, n) THEN n {alias} {holds} END".format(
    acts=ACTIONS, alias=" ".join(f"WHEN n = '{k}' THEN '{v}'" for k, v in text.ALIASES.items()), holds=" ".join(f"WHEN contains('{a}', n) OR contains(n, '{a}') THEN '{a}'" for a in text.ACTIONS)
)
UNTICKED = r"regexp_replace({0}, '`+$', '')"
UNQUOTED = r"""regexp_replace({0}, '^["'']|["'']$', '', 'g')"""
PARSED = rf"""s AS (SELECT conv_id, turn, t AS raw, {strip("t")} AS s FROM t),
p AS (SELECT *, {UNTICKED.format(strip(r"regexp_replace(regexp_extract(s, '(?is)Thought:\s*(.+)', 1), '(?is)^(.+?)(?:\n\s*Action:.*)?$', '\1')"))} AS thought,
  upper(regexp_extract(s, '(?i)Action:\s*(\w+)', 1)) AS n,
  {strip(UNQUOTED.format(strip(r"regexp_replace(regexp_extract(s, '(?is)Utterance:\s*(.+)', 1), '(?is)^(.+?)(?:```.*)?$', '\1')")))} AS said FROM s),
a AS (SELECT *, CASE WHEN n = '' THEN '' ELSE coalesce({ACTION}, n) END AS act FROM p)"""


@query(f"""WITH {weave(*TEACHER)}, {PARSED} SELECT conv_id, turn, md5(thought) AS thought_md5, act AS action, md5(said) AS utterance_md5, list_contains({ACTIONS}, act) AND said <> '' AS is_valid, act IN ('END_SUCCESS', 'END_STUCK') AS is_terminal FROM a""")
def woven_teacher_turns(spark, d):
    r = woven(spark, d, *TEACHER).withColumn("r", text.teacher_turn(c("t")))
    return r.select("conv_id", "turn", md5(c("r.thought")).alias("thought_md5"), "r.action", md5(c("r.utterance")).alias("utterance_md5"), "r.is_valid", "r.is_terminal")


@query(f"""WITH {weave(*TEACHER)}, {PARSED},
b AS (SELECT *, string_split(raw, chr(10)) AS l, list_filter({ACTIONS}, lambda x: contains(upper(raw), x)) AS there FROM a),
f AS (SELECT *, list_position(list_transform(l, lambda x: contains(lower(x), 'action:')), true) AS spot, CASE WHEN list_contains({ACTIONS}, act) THEN act ELSE coalesce(there[1], act) END AS act2 FROM b),
g AS (SELECT *, list_transform(list_filter(l, lambda x, i: coalesce(spot, 0) > 0 AND i > spot AND NOT contains(lower(x), 'action:') AND {strip("x")} <> '' AND NOT contains(lower(x), 'thought:')), lambda x: {strip("x")}) AS rest FROM f),
h AS (SELECT *, CASE WHEN said <> '' THEN said ELSE coalesce(array_to_string(rest, ' '), '') END AS said2 FROM g)
SELECT conv_id, turn, act2 AS action, md5(said2) AS utterance_md5, list_contains({ACTIONS}, act2) AND said2 <> '' AS is_valid FROM h""")
def woven_repairs(spark, d):
    r = woven(spark, d, *TEACHER).withColumn("p", text.teacher_turn(c("t"))).withColumn("r", text.repaired_turn(c("t"), c("p")))
    return r.select("conv_id", "turn", "r.action", md5(c("r.utterance")).alias("utterance_md5"), "r.is_valid")


LEGACY = ("conversations", TURN, ["Action: Hint(", "\naction: Ask (\"", "\") ", ") ", "' ", "\n", "Action: Summarize_And_Wrap_Up('", "')"], 43)


@query(rf"""WITH {weave(*LEGACY)}, i AS (SELECT conv_id, turn, regexp_extract(t, '(?i)Action:\s*(\w+)\s*\(', 1) AS name, {strip(r"regexp_extract(t, '(?is)Action:\s*\w+\s*\((.*)\)', 1)")} AS i FROM t)
SELECT conv_id, turn, name, md5(CASE WHEN length(i) >= 2 AND left(i, 1) = right(i, 1) AND left(i, 1) IN ('"', '''') THEN substr(i, 2, length(i) - 2) ELSE i END) AS argument_md5 FROM i""")
def woven_legacy_actions(spark, d):
    r = text.legacy_action(c("t"))
    return woven(spark, d, *LEGACY).select("conv_id", "turn", r["name"].alias("name"), md5(r["argument"]).alias("argument_md5"))


FINALS = ("documents", DOC, ["\nFINAL: ", " final:  ", ".\n", ";:\n", "\n", "FINAL:\n", ", "], 47)


@query(rf"""WITH {weave(*FINALS)}, f AS (SELECT doc_id, regexp_replace({strip(r"regexp_extract(t, '(?is).*FINAL:\s*([^\n]*)', 1)")}, '[.,;:]+$', '') AS l, regexp_replace({strip(r"regexp_extract(t, '(?i)FINAL:\s*(.+?)(?:\n|$)', 1)")}, '[.,;:]+$', '') AS f FROM t)
SELECT doc_id, md5(nullif(l, '')) AS last_md5, md5(nullif(f, '')) AS first_md5 FROM f""")
def woven_finals(spark, d):
    return woven(spark, d, *FINALS).select("doc_id", md5(text.last_final(c("t"))).alias("last_md5"), md5(text.first_final(c("t"))).alias("first_md5"))


TONES = ("documents", DOC, ["maybe ", "Definitely ", "not sure ", "must\nnot ", "Should  avoid ", "clearly ", "guessing ", "i think ", "should note "], 1013)


@query(rf"""WITH {weave(*TONES)} SELECT doc_id, CASE WHEN regexp_matches(t, {literal(text.LOW_CONFIDENCE)}) THEN 'low' WHEN regexp_matches(t, {literal(text.HIGH_CONFIDENCE)}) THEN 'high' ELSE 'medium' END AS confidence, regexp_matches(t, {literal(text.NEGATIVE)}) AS is_negative FROM t""")
def woven_tones(spark, d):
    return woven(spark, d, *TONES).select("doc_id", text.confidence(c("t")).alias("confidence"), text.is_negative_criterion(c("t")).alias("is_negative"))


SKILLS = ("documents", DOC, ["Ask ", "question ", "core ", "misconception ", "correct ", "steps ", "analogy ", "alternative ", "path ", "theorem ", "step ", "help ", "example "], 769)
HAS = lambda *ws: "(" + " AND ".join("(" + " OR ".join(f"contains(s, '{x}')" for x in w.split("|")) + ")" for w in ws) + ")"


@query(f"""WITH {weave(*SKILLS)}, s AS (SELECT doc_id, {strip("lower(t)")} AS s FROM t)
SELECT doc_id, CASE WHEN s IN ('', 'not applicable') THEN NULL WHEN {HAS("ask", "question")} THEN 'asking_guiding_questions' WHEN {HAS("core", "difficulty|misconception")} THEN 'identifying_core_difficulty' WHEN {HAS("correct", "steps")} THEN 'identifying_correct_steps'
  WHEN {HAS("example|analogy")} THEN 'including_examples' WHEN {HAS("alternative", "solution|path")} THEN 'providing_alternative_solutions' WHEN {HAS("definition|formula|theorem|law")} THEN 'stating_knowledge' WHEN {HAS("step", "help|analysis")} THEN 'step_by_step_help' END AS skill FROM s""")
def woven_skills(spark, d):
    return woven(spark, d, *SKILLS).select("doc_id", text.skill_by_keyword(c("t")).alias("skill"))


WORDS = {"algebra": ["th", "equation", "on"], "geometry": ["er", "an", "shape"], "language": ["é", "ung", "the", "ción"], "other": ["zzz"]}
COUNTED = {k: " + ".join(f"CAST(contains(lower(text), '{w}') AS INT)" for w in ws) for k, ws in WORDS.items()}


@query(f"""WITH s AS (SELECT doc_id, {", ".join(f"{v} AS {k}" for k, v in COUNTED.items())} FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE {" ".join(f"WHEN {k} = greatest({', '.join(COUNTED)}) THEN '{k}'" for k in COUNTED)} END AS choice FROM s""")
def document_choices(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", text.fuzzy_choice(c("text"), WORDS).alias("choice"))


SALVAGE = ("conversations", TURN, ["Thought: ", "\nAction: ", "[", "]\n", "\nGIVE_HINT\n", "\nshort\n", "\n"], 31)
CLEARED = "t"
for _m in ("Thought:", "Action:", "Utterance:", "[", "]"):
    CLEARED = f"replace({CLEARED}, '{_m}', ' ')"


@query(f"""WITH {weave(*SALVAGE)}, l AS (SELECT conv_id, turn, list_filter(list_transform(string_split({CLEARED}, chr(10)), lambda x: {strip("x")}), lambda x: length(x) >= 10 AND NOT list_contains({listed([a.replace("_", "") for a in text.ACTIONS])}, replace(upper(x), '_', ''))) AS l FROM t)
SELECT conv_id, turn, md5(CASE WHEN length(l[1]) > 300 THEN substr(l[1], 1, 297) || '...' ELSE coalesce(l[1], '') END) AS utterance_md5 FROM l""")
def woven_salvage(spark, d):
    return woven(spark, d, *SALVAGE).select("conv_id", "turn", md5(text.salvaged_utterance(c("t"))).alias("utterance_md5"))


QUIZ = ("documents", DOC, ["Which of the following ", " (A) ", "select the correct ", "choose the ", "\n", "(K) ", " (J)"], 61)


@query(rf"""WITH {weave(*QUIZ)} SELECT doc_id, md5({strip(r"regexp_replace(regexp_replace(regexp_replace(t, '(?i)\b(which of the following|select the correct|choose the)\b', '', 'g'), ' \([A-J]\)', ' ', 'g'), '\s+', ' ', 'g')")}) AS question_md5 FROM t""")
def woven_open_questions(spark, d):
    return woven(spark, d, *QUIZ).select("doc_id", md5(text.open_question(c("t"))).alias("question_md5"))


# ---- numbers and answers ---------------------------------------------------------------------------------------------

SUFFIXES = ["", "%", " kg", "π", " pi", " × 10^3", "*10^-2", " m", ",000 km", " Ohm ", "e2", "f", " abc", " * π", "m m", "s", " μC", "$"]
NUMERAL = "CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '' END || CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(p_size AS {0}) WHEN 2 THEN CAST(p_size AS {0}) || '.' || CAST(p_partkey % 10 AS {0}) WHEN 3 THEN '.' || CAST(p_size AS {0}) ELSE '1,' || lpad(CAST(p_size AS {0}), 3, '0') END"
WRITTEN = f"({NUMERAL.format('VARCHAR')}) || {listed(SUFFIXES)}[CAST(p_partkey // 15 AS BIGINT) % {len(SUFFIXES)} + 1]"
ANSWERED = f"({NUMERAL.format('VARCHAR')}) || CASE WHEN p_partkey % 4 = 0 THEN '0' WHEN p_partkey % 4 = 1 THEN '' ELSE '001' END"


def value(name: str, x: str) -> str:
    """CTEs that read the number of column x of ``name`` into ``name_v``."""
    s = strip(f"lower({x})")
    for unit in text.UNITS:
        s = rf"regexp_replace({s}, '\s*{unit}\s*$', '')"
    pi, power = r"'^(-?\d*\.?\d*)\s*[*×]?\s*(π|pi)$'", r"'^(-?\d*\.?\d+)\s*[×*]\s*10\^?\s*(-?\d+)$'"
    return rf"""{name}_s AS (SELECT *, {strip(f"translate({s}, '$, ', '')")} AS s_{x} FROM {name}),
{name}_v AS (SELECT *, CASE WHEN suffix(s_{x}, '%') THEN TRY_CAST(rtrim(s_{x}, '%') AS DOUBLE) / 100
  WHEN regexp_matches(s_{x}, {pi}) THEN TRY_CAST(CASE WHEN regexp_extract(s_{x}, {pi}, 1) IN ('', '-') THEN regexp_extract(s_{x}, {pi}, 1) || '1' ELSE regexp_extract(s_{x}, {pi}, 1) END AS DOUBLE) * pi()
  WHEN regexp_matches(s_{x}, {power}) THEN TRY_CAST(regexp_extract(s_{x}, {power}, 1) AS DOUBLE) * pow(10.0::DOUBLE, TRY_CAST(regexp_extract(s_{x}, {power}, 2) AS DOUBLE))
  WHEN NOT regexp_matches(s_{x}, '[df]$') THEN TRY_CAST(s_{x} AS DOUBLE) END AS v_{x} FROM {name}_s)"""


@query(f"""WITH n AS (SELECT p_partkey, {WRITTEN} AS a, {ANSWERED} AS b FROM part), {value("n", "a")}, {value("n_v", "b")}
SELECT p_partkey, round(v_a, 6) + 0.0::DOUBLE AS value, CASE WHEN v_a IS NULL OR v_b IS NULL THEN NULL WHEN v_a = 0 THEN abs(v_b) < 1e-6 ELSE abs(v_a - v_b) / abs(v_a) < 0.01 END AS agrees FROM n_v_v""")
def written_numbers(spark, d):
    numeral = F.expr(NUMERAL.format("string"))
    suffix = F.get(F.lit(SUFFIXES), (F.floor(c("p_partkey") / 15) % len(SUFFIXES)).cast("int"))
    end = F.when(c("p_partkey") % 4 == 0, "0").when(c("p_partkey") % 4 == 1, "").otherwise("001")
    rows = table(spark, d, "part").select("p_partkey", F.concat(numeral, suffix).alias("a"), F.concat(numeral, end).alias("b"))
    return rounded(rows.select("p_partkey", text.number(c("a")).alias("value"), text.numbers_agree(c("a"), c("b")).alias("agrees")), "value")


LEADS, ENDS = ["", "The answer is ", "Answer: ", " i think ", "answer is answer: ", "so ", "I think the answer is "], ["", ".", "!?", " ;", " 3", "e"]


def normal(x: str) -> str:
    t = strip(f"lower({x})")
    for prefix in text.ANSWER_PREFIXES:
        t = f"list_transform([{t}], lambda y: CASE WHEN starts_with(y, '{prefix}') THEN {strip(f'substr(y, {len(prefix) + 1})')} ELSE y END)[1]"
    return f"regexp_replace({t}, '[.,;:!?]+$', '')"


FIGURE = r"TRY_CAST(regexp_extract(lower({0}), '-?\d+\.?\d*(?:e[+-]?\d+)?', 0) AS DOUBLE)"


@query(f"""WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) WHEN p_partkey % 3 = 1 THEN p_name ELSE CAST(p_size AS VARCHAR) || ' kg' END AS a,
  {listed(LEADS)}[p_partkey % 7 + 1] || CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 3 THEN CAST(p_size AS VARCHAR) ELSE split_part(p_name, ' ', 1) END || {listed(ENDS)}[p_partkey // 7 % 6 + 1] AS b FROM part),
n AS (SELECT *, {normal("a")} AS na, {normal("b")} AS nb, {FIGURE.format("a")} AS fa, {FIGURE.format("b")} AS fb FROM p)
SELECT p_partkey, length(b) > 0 AND na = nb AS strict, length(b) > 0 AND (na = nb OR contains(nb, na) OR coalesce(abs(fa - fb) < 0.01, false)) AS flexible FROM n""")
def worded_answers(spark, d):
    k, name = c("p_partkey"), c("p_name")
    truth = F.when(k % 3 == 0, F.split_part(name, F.lit(" "), F.lit(1))).when(k % 3 == 1, name).otherwise(F.concat(c("p_size").cast("string"), F.lit(" kg")))
    said = F.when(k % 4 == 0, F.upper(name)).when(k % 4 == 3, c("p_size").cast("string")).otherwise(F.split_part(name, F.lit(" "), F.lit(1)))
    answer = F.concat(F.get(F.lit(LEADS), (k % 7).cast("int")), said, F.get(F.lit(ENDS), (F.floor(k / 7) % 6).cast("int")))
    rows = table(spark, d, "part").select("p_partkey", truth.alias("a"), answer.alias("b"))
    return rows.select("p_partkey", text.answer_matches(c("a"), c("b"), True).alias("strict"), text.answer_matches(c("a"), c("b")).alias("flexible"))
