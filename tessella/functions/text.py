"""Scalar text functions as column expressions: parsers, detectors, answer grading, formatting."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists and patterns of the tutoring domain.
QUESTION_STARTS = ["what", "how", "why", "when", "where", "who", "which", "can you", "could you", "do you", "does"]
CONFUSION = ["i don't understand", "i'm confused", "i'm not sure", "i don't know", "confused", "unclear", "not sure", "don't get it", "what do you mean"]
NEGATIVE = r"(?i)must\s+not|should\s+not|must\s+avoid|should\s+avoid"
ACTIONS = ["GIVE_HINT", "ASK_QUESTION", "CORRECT_ERROR", "EXPLAIN_CONCEPT", "CONFIRM_PROGRESS", "END_SUCCESS", "END_STUCK"]
TERMINAL = ["END_SUCCESS", "END_STUCK"]
ALIASES = {
    "HINT": "GIVE_HINT", "QUESTION": "ASK_QUESTION", "ASK": "ASK_QUESTION", "CORRECT": "CORRECT_ERROR", "ERROR": "CORRECT_ERROR", "EXPLAIN": "EXPLAIN_CONCEPT",
    "CONCEPT": "EXPLAIN_CONCEPT", "CONFIRM": "CONFIRM_PROGRESS", "PROGRESS": "CONFIRM_PROGRESS", "SUCCESS": "END_SUCCESS", "STUCK": "END_STUCK",
    "CORRECT_MISCONCEPTION": "CORRECT_ERROR", "ASK_GUIDING_QUESTION": "ASK_QUESTION", "PROBE_UNDERSTANDING": "ASK_QUESTION", "SCAFFOLD_STEP": "EXPLAIN_CONCEPT", "ENCOURAGE_REFLECTION": "ASK_QUESTION",
}
UNITS = ["seconds", "second", "meters", "meter", "sec", "ohm", "mm", "cm", "km", "kg", "nc", "μc", "mc", "hz", "s", "m", "g", "n", "j", "w", "v", "a", "ω"]
ANSWER_PREFIXES = ["the answer is", "answer:", "answer is", "i think"]
LOW_CONFIDENCE = r"(?i)\b(unsure|uncertain|not sure|maybe|I think|probably|guess|confused)\b"
HIGH_CONFIDENCE = r"(?i)\b(definitely|certainly|confident|sure|clearly)\b"
CHECKS = ["do you understand", "does that make sense", "can you explain", "let me check"]
BACKGROUND = ["have you seen", "do you know about", "are you familiar with", "what do you already know", "have you learned"]
EXPLANATION = ["let me explain", "here's how", "the way to", "step by step", "first", "second", "then"]
PRACTICE = ["try this", "practice problem", "work through", "solve this"]
WRAP_UP = ["to summarize", "in summary", "we've covered", "that's all", "great work today"]

# Patterns of the replies.
VERDICT, REASON = "JUDGMENT:", "EXPLANATION:"
SELECTED = r"(?i)SELECTED:.*?(\d+)"
THOUGHT, ACTION, UTTERANCE = r"(?is)Thought:\s*(.+?)(?=\n\s*Action:|$)", r"(?i)Action:\s*(\w+)", r"(?is)Utterance:\s*(.+?)(?:```|$)"
LEGACY_NAME, LEGACY_ARGUMENT = r"(?i)Action:\s*(\w+)\s*\(", r"(?is)Action:\s*\w+\s*\((.*)\)"
LAST_FINAL, FIRST_FINAL = r"(?is).*FINAL:\s*([^\n]*)", r"(?i)FINAL:\s*(.+?)(?:\n|$)"
OF_PI, POWER = r"^(-?\d*\.?\d*)\s*[*×]?\s*(π|pi)$", r"^(-?\d*\.?\d+)\s*[×*]\s*10\^?\s*(-?\d+)$"
FENCED = r"(?s)```(?:json)?\s*(.*?)```"


def holds_any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def strip(text: Column) -> Column:
    """Trims blanks of every kind, not spaces alone."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def is_question(text: Column) -> Column:
    lowered = strip(F.lower(text))
    return F.contains(text, F.lit("?")) | lowered.rlike("^(" + "|".join(QUESTION_STARTS) + ")")


def shows_confusion(text: Column) -> Column:
    return holds_any(F.lower(text), CONFUSION)


def is_negative_criterion(text: Column) -> Column:
    return text.rlike(NEGATIVE)


def skill_by_keyword(text: Column) -> Column:
    """First matching branch; "incorrect steps" falls under correct steps, as that branch comes first."""
    s = strip(F.lower(text))
    has = lambda w: F.contains(s, F.lit(w))
    return (
        F.when(F.coalesce(s, F.lit("")).isin("", "not applicable"), None)
        .when(has("ask") & has("question"), "asking_guiding_questions")
        .when(has("core") & (has("difficulty") | has("misconception")), "identifying_core_difficulty")
        .when(has("correct") & has("steps"), "identifying_correct_steps")
        .when(has("incorrect") & has("steps"), "identifying_incorrect_steps")
        .when(has("example") | has("analogy"), "including_examples")
        .when(has("alternative") & (has("solution") | has("path")), "providing_alternative_solutions")
        .when(has("definition") | has("formula") | has("theorem") | has("law"), "stating_knowledge")
        .when(has("step") & (has("help") | has("analysis")), "step_by_step_help")
    )


def use_case(batch: Column) -> Column:
    b = F.upper(batch)
    return F.when(b.like("%USE_CASE_1%"), "adaptive").when(b.like("%USE_CASE_2%"), "assessment").when(b.like("%USE_CASE_3%"), "active_learning").otherwise("adaptive")


def judgement(text: Column) -> Column:
    """struct(passed, explanation): the last JUDGMENT line decides; without one, failed and the first 200 characters."""
    lines = F.transform(F.split(text, "\n"), strip)
    verdicts = F.filter(lines, lambda x: F.startswith(F.upper(x), F.lit(VERDICT)))
    reasons = F.filter(lines, lambda x: F.startswith(F.upper(x), F.lit(REASON)))
    passed = F.coalesce(F.contains(F.upper(F.try_element_at(verdicts, F.lit(-1))), F.lit("PASS")), F.lit(False))
    reason = F.coalesce(strip(F.substring(F.try_element_at(reasons, F.lit(-1)), 13, 1_000_000)), F.substring(text, 1, 200))
    return F.struct(passed.alias("passed"), reason.alias("explanation"))


def selection(text: Column, n: int) -> Column:
    """Zero-based choice among n from a line "SELECTED: k", held to the range; 0 without one."""
    k = F.regexp_extract(text, SELECTED, 1).try_cast("int")
    return F.least(F.greatest(F.coalesce(k - 1, F.lit(0)), F.lit(0)), F.lit(n - 1))


def selection_reason(text: Column) -> Column:
    """What the first line "REASONING:" says, and the lines below it but for empty ones and selections, joined by blanks."""
    lines = F.transform(F.split(strip(text), "\n"), strip)
    at = F.array_position(F.transform(lines, lambda x: F.startswith(x, F.lit("REASONING:"))), True).cast("int")
    head = strip(F.get(F.split(F.get(lines, at - 1), "REASONING:"), F.lit(1)))
    rest = F.filter(lines, lambda x, i: (i >= at) & ~F.startswith(x, F.lit("SELECTED:")) & (x != ""))
    return F.when(at > 0, F.array_join(F.concat(F.array(head), rest), " ")).otherwise(F.lit("No reasoning provided"))


def method_analysis(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), strip)

    def field(name: str) -> Column:
        own = F.filter(lines, lambda x: F.startswith(x, F.lit(name + ":")))
        return strip(F.replace(F.try_element_at(own, F.lit(-1)), F.lit(name + ":"), F.lit("")))

    listed = F.filter(F.transform(F.split(field("ALTERNATIVE_METHODS"), ","), strip), lambda x: x != "")
    alternatives = F.when(F.lower(field("ALTERNATIVE_METHODS")) != "none", F.slice(listed, 1, 3))
    branch = F.coalesce(F.contains(F.lower(field("SHOULD_BRANCH")), F.lit("yes")), F.lit(False))
    none = F.array().cast("array<string>")
    return F.struct(field("STUDENT_METHOD").alias("student_method"), F.coalesce(alternatives, none).alias("alternative_methods"), branch.alias("should_branch"), field("STUDENT_METHOD_DESCRIPTION").alias("student_method_description"))


def action(name: Column) -> Column:
    """Canonical action of a name: itself, an alias, or the first action that holds it or is held by it."""
    n = F.upper(F.translate(name, " -", "__"))
    out = F.when(n.isin(ACTIONS), n)
    for alias, target in ALIASES.items():
        out = out.when(n == alias, target)
    for a in ACTIONS:
        out = out.when(F.contains(F.lit(a), n) | F.contains(n, F.lit(a)), a)
    return out


def teacher_turn(raw: Column) -> Column:
    """struct(thought, action, utterance, is_valid, is_terminal) of a Thought / Action / Utterance triple."""
    t = strip(raw)
    thought = F.regexp_replace(strip(F.regexp_extract(t, THOUGHT, 1)), "`+$", "")
    named = F.upper(F.regexp_extract(t, ACTION, 1))
    chosen = F.when(named == "", "").otherwise(F.coalesce(action(named), named))
    said = strip(F.regexp_replace(strip(F.regexp_extract(t, UTTERANCE, 1)), r"""^["']|["']$""", ""))
    return F.struct(thought.alias("thought"), chosen.alias("action"), said.alias("utterance"), (chosen.isin(ACTIONS) & (said != "")).alias("is_valid"), chosen.isin(TERMINAL).alias("is_terminal"))


def repaired_turn(raw: Column, turn: Column) -> Column:
    """A turn whose action is sought anywhere in the text, and whose utterance is what follows the action line."""
    found = F.coalesce(*[F.when(F.contains(F.upper(raw), F.lit(a)), F.lit(a)) for a in ACTIONS], turn.getField("action"))
    act = F.when(turn.getField("action").isin(ACTIONS), turn.getField("action")).otherwise(found)
    lines = F.split(raw, "\n")
    is_action = lambda x: F.contains(F.lower(x), F.lit("action:"))
    first = F.array_position(F.transform(lines, is_action), True)
    rest = F.filter(lines, lambda x, i: (first > 0) & (i >= first) & ~is_action(x) & (strip(x) != "") & ~F.contains(F.lower(x), F.lit("thought:")))
    said = F.when(turn.getField("utterance") != "", turn.getField("utterance")).otherwise(F.array_join(F.transform(rest, strip), " "))
    return F.struct(turn.getField("thought").alias("thought"), act.alias("action"), said.alias("utterance"), (act.isin(ACTIONS) & (said != "")).alias("is_valid"), act.isin(TERMINAL).alias("is_terminal"))


def legacy_action(text: Column) -> Column:
    """struct(name, argument) of "Action: Name(argument)"; the argument ends at the last parenthesis, matching quotes removed."""
    name = F.regexp_extract(text, LEGACY_NAME, 1)
    inner = strip(F.regexp_extract(text, LEGACY_ARGUMENT, 1))
    return F.struct(name.alias("name"), F.regexp_replace(inner, r"""(?s)^(["'])(.*)\1$""", "$2").alias("argument"))


def fuzzy_choice(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The first choice with most keywords in the text; the very first if none has any."""
    lowered = F.lower(text)
    score = {k: sum((F.contains(lowered, F.lit(w)).cast("int") for w in ws), F.lit(0)) for k, ws in keywords.items()}
    best = F.greatest(*score.values()) if len(score) > 1 else next(iter(score.values()))
    return F.coalesce(*[F.when(s == best, F.lit(k)) for k, s in score.items()])


def inferred_action(text: Column) -> Column:
    t = F.lower(text)
    asked = F.when(holds_any(t, CHECKS), "Ask_Check_Understanding").when(holds_any(t, BACKGROUND), "Ask_Background").otherwise("Ask_Open_Question")
    return (
        F.when(F.contains(text, F.lit("?")), asked)
        .when(holds_any(t, EXPLANATION), "Give_Step_By_Step_Explanation")
        .when(holds_any(t, PRACTICE), "Assign_Practice_Problem")
        .when(holds_any(t, WRAP_UP), "Summarize_And_Wrap_Up")
        .otherwise("Give_Step_By_Step_Explanation")
    )


def last_final(text: Column) -> Column:
    """Answer after the last FINAL:, to the end of its line; null if empty."""
    return F.nullif(F.regexp_replace(strip(F.regexp_extract(text, LAST_FINAL, 1)), "[.,;:]+$", ""), F.lit(""))


def first_final(text: Column) -> Column:
    return F.nullif(F.regexp_replace(strip(F.regexp_extract(text, FIRST_FINAL, 1)), "[.,;:]+$", ""), F.lit(""))


def confidence(text: Column) -> Column:
    return F.when(text.rlike(LOW_CONFIDENCE), "low").when(text.rlike(HIGH_CONFIDENCE), "high").otherwise("medium")


def number(text: Column) -> Column:
    """Numeric answer: units off the end, percent, multiples of pi, powers of ten; null if it is none."""
    s = strip(F.lower(text))
    for unit in UNITS:
        s = F.regexp_replace(s, rf"\s*{unit}\s*$", "")
    s = strip(F.translate(s, "$, ", ""))
    coefficient = F.regexp_extract(s, OF_PI, 1)
    pi = F.when(coefficient.isin("", "-"), F.concat(coefficient, F.lit("1"))).otherwise(coefficient).try_cast("double") * math.pi
    scaled = F.regexp_extract(s, POWER, 1).try_cast("double") * F.pow(F.lit(10.0), F.regexp_extract(s, POWER, 2).try_cast("double"))
    plain = F.when(~s.rlike("[df]$"), s.try_cast("double"))
    return F.when(F.endswith(s, F.lit("%")), F.rtrim(s, F.lit("%")).try_cast("double") / 100).when(s.rlike(OF_PI), pi).when(s.rlike(POWER), scaled).otherwise(plain)


def numbers_agree(truth: Column, answer: Column, tolerance: float = 0.01) -> Column:
    """Null where either is no number."""
    a, b = number(truth), number(answer)
    return F.when(a.isNull() | b.isNull(), None).when(a == 0, F.abs(b) < 1e-6).otherwise(F.abs(a - b) / F.abs(F.nullif(a, F.lit(0.0))) < tolerance)


def normal_answer(text: Column) -> Column:
    t = strip(F.lower(text))
    for prefix in ANSWER_PREFIXES:
        t = F.when(F.startswith(t, F.lit(prefix)), strip(F.substring(t, len(prefix) + 1, 1_000_000))).otherwise(t)
    return F.regexp_replace(t, "[.,;:!?]+$", "")


def answer_matches(truth: Column, answer: Column, strict: bool = False) -> Column:
    a, b = normal_answer(truth), normal_answer(answer)
    if strict:
        return F.coalesce((F.length(answer) > 0) & (a == b), F.lit(False))
    n = [F.regexp_extract(F.lower(x), r"-?\d+\.?\d*(?:e[+-]?\d+)?", 0).try_cast("double") for x in (truth, answer)]
    return F.coalesce((F.length(answer) > 0) & ((a == b) | F.contains(b, a) | F.coalesce(F.abs(n[0] - n[1]) < 0.01, F.lit(False))), F.lit(False))


def choice_score(truth: Column, answer: Column) -> Column:
    return (strip(F.upper(truth)) == strip(F.upper(answer))).cast("double")


def short_answer_score(truth: Column, answer: Column) -> Column:
    """Share of the truth's words over three letters that the answer has; 0.5 if there are none."""
    parts = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    key = F.filter(parts(truth), lambda w: F.length(w) > 3)
    return F.when(F.size(key) == 0, 0.5).otherwise(F.size(F.array_intersect(key, parts(answer))) / F.greatest(F.size(key), F.lit(1)))


def fenced_json(text: Column, schema: str) -> Column:
    """A JSON object in a fenced block, or the whole text; a struct of nulls if it is not JSON."""
    inner = F.regexp_extract(text, FENCED, 1)
    return F.from_json(F.when(inner != "", inner).otherwise(text), schema)


def salvaged_utterance(raw: Column) -> Column:
    """First line of ten characters or more that is no action's name, held to 300 characters."""
    t = raw
    for marker in ("Thought:", "Action:", "Utterance:", "[", "]"):
        t = F.replace(t, F.lit(marker), F.lit(" "))
    bare = [a.replace("_", "") for a in ACTIONS]
    lines = F.filter(F.transform(F.split(t, "\n"), strip), lambda x: (F.length(x) >= 10) & ~F.replace(F.upper(x), F.lit("_"), F.lit("")).isin(bare))
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    return F.when(F.length(first) > 300, F.concat(F.substring(first, 1, 297), F.lit("..."))).otherwise(first)


def percent(x: Column) -> Column:
    return F.format_string("%.2f%%", x * 100)


def score_with_ci(mean: Column, margin: Column) -> Column:
    return F.format_string("%.2f%% ± %.2f%%", mean * 100, margin * 100)


def signed_percent(delta: Column) -> Column:
    return F.when(delta > 0, F.concat(F.lit("+"), percent(delta))).otherwise(percent(delta))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def mastery_label(m: Column) -> Column:
    return F.when(m < 0.3, "very limited").when(m < 0.5, "basic").when(m < 0.7, "partial").when(m < 0.9, "good").otherwise("strong")


def safe_name(x: Column) -> Column:
    return F.regexp_replace(x, "[/:]", "_")


def repetitive(current: Column, previous: Column) -> Column:
    a, b = strip(F.lower(current)), strip(F.lower(previous))
    return F.coalesce((a != "") & (b != "") & ((a == b) | F.contains(a, b) | F.contains(b, a)), F.lit(False))


def open_question(text: Column) -> Column:
    """A multiple-choice question without its references to the options."""
    t = F.regexp_replace(text, r"(?i)\b(which of the following|select the correct|choose the)\b", "")
    return strip(F.regexp_replace(F.regexp_replace(t, r" \([A-J]\)", " "), r"\s+", " "))


def key(*parts: str) -> Column:
    return F.concat_ws("_", *[F.col(p).cast("string") for p in parts])


def cache_key(messages: Column, model: Column, temperature: Column, max_tokens: Column) -> Column:
    return F.sha2(F.concat_ws("|", messages, model, temperature.cast("string"), max_tokens.cast("string")), 256)


def provider_of(model: Column) -> Column:
    m = F.lower(model)
    return F.when(F.startswith(m, F.lit("gpt")), "openai").when(F.startswith(m, F.lit("claude")), "anthropic").when(F.contains(m, F.lit("/")), "hosted").otherwise("local")


def error_kind(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike("quota|credit|billing"), "fatal").when(t.rlike("rate|429|timeout|503"), "retry").otherwise("other")


def mark_turns(messages: Column, names: dict[str, str]) -> Column:
    """Messages of the named roles, one line each behind the role's name."""
    kept = F.filter(messages, lambda m: m["role"].isin(list(names)))
    named = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.array_join(F.transform(kept, lambda m: F.concat(named[m["role"]], F.lit(": "), m["content"])), "\n")


def numbered_turns(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m, i: F.concat(F.lit("Turn "), (i + 1).cast("string"), F.lit(" ["), F.upper(m["role"]), F.lit("]: "), m["content"])), "\n\n")


def question_and_work(messages: Column) -> Column:
    """struct(question, student_work): the first non-empty user text, and those after it behind a line break each."""
    asked = F.transform(F.filter(messages, lambda m: (m["role"] == "user") & (F.length(m["content"]) > 0)), lambda m: m["content"])
    work = F.array_join(F.transform(F.slice(asked, 2, 1_000_000), lambda x: F.concat(F.lit("\n"), x)), "")
    return F.struct(F.coalesce(F.get(asked, F.lit(0)), F.lit("")).alias("question"), work.alias("student_work"))
