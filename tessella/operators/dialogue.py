"""Dialogue metrics, episode scores, PES, session statistics and rankings over turn tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import quantiles

# Learning rates of the student personas by tutor action, and the dimensions of the composite.
RATES = {
    "struggling": {"Ask_Open_Question": 0.02, "Ask_Check_Understanding": 0.03, "Give_Step_By_Step_Explanation": 0.05, "Ask_Background": 0.01, "Assign_Practice_Problem": 0.04, "Summarize_And_Wrap_Up": 0.03},
    "confident_mistaken": {"Ask_Open_Question": 0.04, "Ask_Check_Understanding": 0.05, "Give_Step_By_Step_Explanation": 0.06, "Ask_Background": 0.02, "Assign_Practice_Problem": 0.07, "Summarize_And_Wrap_Up": 0.04},
    "minimal_talker": {"Ask_Open_Question": 0.03, "Ask_Check_Understanding": 0.04, "Give_Step_By_Step_Explanation": 0.05, "Ask_Background": 0.02, "Assign_Practice_Problem": 0.05, "Summarize_And_Wrap_Up": 0.03},
}
PES_DIMENSIONS = ["comprehension_probing", "background_knowledge", "guidance_level", "error_feedback", "encouragement", "coherence", "relevance", "student_talk_ratio"]


def metrics(turns: DataFrame, k: int = 5) -> DataFrame:
    """Per conv_id of (conv_id, turn_index, speaker, utterance, action_type): ten dialogue metrics.

    Talk ratio is over student and tutor words only; the last k checks are among tutor turns.
    """
    words, tutor = text.word_count(F.col("utterance")), F.col("speaker") == "tutor"
    student, act = F.col("speaker") == "student", F.coalesce("action_type", F.lit(""))
    recent = F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy(F.desc("turn_index")))
    rows = turns.withColumns({"_w": words, "_r": recent})
    total = F.sum(F.when(student | tutor, F.col("_w")).otherwise(0))
    when_count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.sum(F.when(student, F.col("_w"))) / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("student_talk_ratio"),
        F.count("*").alias("session_step"),
        when_count(tutor & text.is_question(F.col("utterance"))).alias("num_questions_asked"),
        F.bool_or(tutor & (act == "Ask_Background")).alias("asked_background"),
        F.coalesce(F.min(F.when(tutor & (act == "Ask_Background"), F.col("turn_index"))), F.lit(-1)).alias("background_asked_at_turn"),
        when_count(tutor & (act == "Ask_Check_Understanding") & (F.col("_r") <= k)).alias("checks_of_understanding_last_k_turns"),
        F.bool_or(tutor & (act == "Give_Step_By_Step_Explanation")).alias("gave_explanation"),
        F.bool_or(tutor & (act == "Assign_Practice_Problem")).alias("assigned_practice"),
        when_count(student & text.shows_confusion(F.col("utterance"))).alias("student_confusion_count"),
        F.bool_or(tutor & (act == "Summarize_And_Wrap_Up")).alias("wrapped_up"),
    )


def ratio_score(r: Column, low: float = 0.5, high: float = 0.8) -> Column:
    d = F.greatest(low - r, r - high, F.lit(0.0))
    return F.greatest(F.lit(0.0), 1 - 4 * d * d)


def background_score() -> Column:
    at = F.col("background_asked_at_turn")
    return F.when(at < 0, 0.0).when(at <= 3, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (at - 3) * 0.1))


def target_scores(m: DataFrame, max_turns: int = 10) -> DataFrame:
    asked = F.col("num_questions_asked") / F.greatest(F.col("session_step") / max_turns * 5, F.lit(1.0))
    return m.select("conv_id", ratio_score(F.col("student_talk_ratio")).alias("ratio_score"), F.least(F.lit(1.0), asked).alias("questions_score"), background_score().alias("background_score"), F.least(F.lit(1.0), F.col("checks_of_understanding_last_k_turns") / 3.0).alias("checks_score"))


def learning_gain(pre: Column, post: Column) -> Column:
    return F.when(pre >= 0.99, 0.0).otherwise(F.greatest(F.lit(0.0), (post - pre) / F.nullif(1 - pre, F.lit(0.0))))


def gain_score(g: Column) -> Column:
    return F.when(g >= 0.3, 1.0).when(g >= 0.1, 0.5 + 0.5 * (g - 0.1) / 0.2).otherwise(0.5 * g / 0.1)


def mean_of_map(m: Column) -> Column:
    return F.coalesce(F.aggregate(F.map_values(m), F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(m), F.lit(0)), F.lit(0.0))


def episode_scores(episodes: DataFrame) -> DataFrame:
    """Pedagogy, learning and quality scores and their weighted total; missing quality marks have defaults."""
    asked, checks = F.least(F.lit(1.0), F.col("num_questions_asked") / 5.0), F.least(F.lit(1.0), F.col("checks_of_understanding_last_k_turns") / 3.0)
    pedagogy = (ratio_score(F.col("student_talk_ratio")) + asked + background_score() + checks) / 4
    learning = 0.6 * gain_score(F.col("learning_gain")) + 0.4 * mean_of_map(F.col("knowledge"))
    mark = lambda name, default: F.coalesce(F.try_element_at("quality", F.lit(name)), F.lit(default))
    quality = 0.5 * mark("pedagogical_usefulness", 0.5) + 0.3 * mark("student_felt_heard", 0.5) + 0.2 * mark("no_hallucinations", 1.0)
    out = episodes.withColumns({"pedagogy_score": pedagogy, "learning_score": learning, "quality_score": quality})
    return out.withColumn("total_score", 0.4 * F.col("pedagogy_score") + 0.4 * F.col("learning_score") + 0.2 * F.col("quality_score"))


def episode_summary(scores: DataFrame) -> DataFrame:
    s = F.col("pedagogy_score")
    aggregates = [F.count("*").alias("n"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.avg("learning_gain").alias("mean_gain"), F.avg("total_score").alias("mean_total")]
    return quantiles.summarised(scores.select("agent_type", "pedagogy_score", "learning_gain", "total_score"), ["agent_type"], "pedagogy_score", *aggregates)


def quiz_score(answers: DataFrame, *keys: str) -> DataFrame:
    one = F.when(F.col("question_type") == "multiple_choice", text.choice_score(F.col("correct_answer"), F.col("student_answer"))).otherwise(text.short_answer_score(F.col("correct_answer"), F.col("student_answer")))
    return answers.groupBy(*keys).agg(F.coalesce(F.avg(one), F.lit(0.0)).alias("quiz_score"))


def draw(seed: int, *ids: Column) -> Column:
    """A number from 0 up to 1 that depends on the seed and the ids alone: 52 bits of their MD5, so any engine can draw it and no order of rows matters."""
    said = F.concat_ws("/", *[x.cast("string") for x in ids], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(said.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mastery_fold(actions: Column, start: Column, persona: Column, draws: Column | None = None, noise: float = 0.01) -> Column:
    """Mastery after an ordered array of tutor actions, with diminishing returns; ``draws``, an array beside the actions, moves each step by up to ``noise``."""
    table = F.create_map(*[x for p, rs in RATES.items() for a, r in rs.items() for x in (F.lit(f"{p}/{a}"), F.lit(r))])
    known = F.when(persona.isin(list(RATES)), persona).otherwise("struggling")
    rate = lambda a: F.coalesce(F.try_element_at(table, F.concat(known, F.lit("/"), a)), F.lit(0.03))
    moved = F.transform(actions, lambda a, i: F.struct(rate(a).alias("r"), (F.lit(0.0) if draws is None else (F.get(draws, i) * 2 - 1) * noise).alias("n")))
    return F.aggregate(moved, start.cast("double"), lambda s, x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), s + x["r"] * (1 - s * 0.5) + x["n"])))


def quiz_answers(questions: DataFrame, seed: int, *ids: str) -> DataFrame:
    """``questions`` (mastery, correct_answer, options) with student_answer: the right one by a draw below 0.25 + 0.75 * mastery, else one of the others by a second draw.

    Without other options it is A. The draws depend on the values of ``ids``: rows that agree in all of them answer alike.
    """
    own = [F.col(i) for i in ids]
    wrong = F.filter(F.coalesce("options", F.array().cast("array<string>")), lambda o: o != F.col("correct_answer"))
    other = F.get(F.col("_wrong"), F.floor(draw(seed, *own, F.lit("other")) * F.size("_wrong")).cast("int"))
    right = draw(seed, *own) < 0.25 + 0.75 * F.coalesce("mastery", F.lit(0.0))
    return questions.withColumn("_wrong", wrong).withColumn("student_answer", F.when(right, F.col("correct_answer")).otherwise(F.coalesce(other, F.lit("A")))).drop("_wrong")


def pes(scores: DataFrame) -> DataFrame:
    """Composite of eight dimensions, question depth and engagement (1 to 5 each), and its category."""
    unit = lambda c: (F.col(c) - 1) / 4
    layer1 = sum((unit(d) for d in PES_DIMENSIONS[1:]), unit(PES_DIMENSIONS[0])) / 8
    value = F.round((layer1 * 0.8 + unit("question_depth") * 0.1 + unit("icap") * 0.1) * 100, 2)
    out = scores.withColumns({"layer1": layer1, "layer2": unit("question_depth"), "layer3": unit("icap"), "pes_score": value})
    p = F.col("pes_score")
    return out.withColumn("pes_category", F.when(p >= 85, "Excellent").when(p >= 70, "Good").when(p >= 55, "Fair").when(p >= 40, "Poor").otherwise("Very Poor"))


def dimension_rows(scores: DataFrame, name: str = "name") -> DataFrame:
    long = scores.unpivot([name], PES_DIMENSIONS, "dimension", "score")
    return long.withColumn("normalized", (F.col("score") - 1) / 4)


def layer_rows(scored: DataFrame, name: str = "name") -> DataFrame:
    weight = {"layer1": 0.8, "layer2": 0.1, "layer3": 0.1}
    long = scored.unpivot([name], list(weight), "layer", "score")
    w = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in weight.items()])
    return long.withColumns({"weight": w, "contribution": F.col("score") * w * 100})


def pes_report(scored: DataFrame, name: str = "name") -> DataFrame:
    """(name, report): a text page of the score, its category, the layers and the dimensions."""
    bar = lambda c: F.concat(F.lit(f"  {c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-")), F.lit("/5"))
    layers = [F.format_string(f"  {k} (weight {w}): %.4f", F.bround(k, 4)) for k, w in (("layer1", 0.8), ("layer2", 0.1), ("layer3", 0.1))]
    head = [F.concat(F.lit("Evaluation of "), F.col(name).cast("string")), F.format_string("PES %.2f: %s", F.col("pes_score"), F.col("pes_category"))]
    return scored.select(name, F.concat_ws("\n", *head, F.lit("Layers"), *layers, F.lit("Dimensions"), *map(bar, [*PES_DIMENSIONS, "question_depth", "icap"])).alias("report"))


def pes_summary(scored: DataFrame) -> DataFrame:
    rows = scored.groupBy("pes_category").agg(F.count("*").alias("n"), F.min("pes_score").alias("lo"), F.max("pes_score").alias("hi"), F.sum("pes_score").alias("s"))
    whole = Window.partitionBy(F.lit(1))  # at most one row per category
    return rows.select("pes_category", "n", (F.col("n") * 100 / F.sum("n").over(whole)).alias("share"), (F.sum("s").over(whole) / F.sum("n").over(whole)).alias("avg_pes"), F.min("lo").over(whole).alias("min_pes"), F.max("hi").over(whole).alias("max_pes"))


def judged_well(scored: DataFrame, error: str = "Error") -> DataFrame:
    """Rows of a batch whose evaluation did not fail."""
    return scored.where(F.col("pes_category") != error)


def episode_record(episodes: DataFrame, turns: DataFrame, key: str = "episode_id", pos: str = "turn_index") -> DataFrame:
    """One nested record an episode: agent, task, student, its turns in order, metrics, scores and quiz results."""
    told = turns.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, "speaker", "utterance", *[c for c in ("action_type",) if c in turns.columns]))), lambda t: t).alias("turns"))
    agent, student, task = (F.struct(F.col(c).alias(n)).alias(s) for c, n, s in (("agent_type", "type", "agent"), ("student_persona", "persona", "student"), ("task_id", "id", "task")))
    quiz = F.struct(F.col("pre_quiz_score").alias("pre"), F.col("post_quiz_score").alias("post"), "learning_gain").alias("quiz")
    scores = F.struct(*[c for c in ("pedagogy_score", "learning_score", "quality_score", "total_score") if c in episodes.columns]).alias("scores")
    return episodes.join(told, key, "left").select(key, agent, task, student, F.coalesce("turns", F.array()).alias("turns"), "metrics", scores, quiz)


def damr(actual: Column, desired: Column) -> Column:
    """Desired entries matched, in percent to two places; 0 if either map is empty."""
    hits = F.size(F.filter(F.map_entries(desired), lambda e: F.coalesce(F.try_element_at(actual, e["key"]) == e["value"], F.lit(False))))
    return F.when((F.size(actual) <= 0) | (F.size(desired) <= 0), 0.0).otherwise(F.round(hits * 100 / F.nullif(F.size(desired), F.lit(0)), 2))


def alternation(messages: DataFrame, conv: str = "conv_id", pos: str = "turn") -> DataFrame:
    """Per conversation: whether the first message after the system's is the user's, and the first repeated role's position."""
    said = messages.where("role <> 'system'").withColumn("_p", F.lag("role").over(Window.partitionBy(conv).orderBy(pos)))
    return said.groupBy(conv).agg((F.min_by("role", pos) == "user").alias("starts_with_user"), F.min(F.when(F.col("_p") == F.col("role"), F.col(pos))).alias("first_repeat"))


def context(turns: DataFrame, n: int = 5, conv: str = "conv_id", pos: str = "turn_index") -> DataFrame:
    """``context``: the last n turns up to and with each."""
    w = Window.partitionBy(conv).orderBy(pos).rowsBetween(-(n - 1), 0)
    return turns.withColumn("context", F.array_join(F.collect_list(F.concat("speaker", F.lit(": "), "utterance")).over(w), "\n"))


def repetition(turns: DataFrame, conv: str = "conv_id", pos: str = "turn_index") -> DataFrame:
    before = F.lag("utterance").over(Window.partitionBy(conv, "speaker").orderBy(pos))
    return turns.withColumn("_b", before).withColumn("is_repetitive", text.repetitive(F.col("utterance"), F.col("_b"))).drop("_b")


def so_far(turns: DataFrame, conv: str = "conv_id", pos: str = "turn_index") -> DataFrame:
    """The tutor's last utterance before each turn, and the number of tutor turns up to it."""
    w = Window.partitionBy(conv).orderBy(pos)
    tutor = F.col("speaker") == "tutor"
    return turns.withColumns({"last_tutor": F.last(F.when(tutor, F.col("utterance")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)), "tutor_turns": F.count_if(tutor).over(w)})


def history_index(turns: DataFrame, dialogue: str = "dialogue_id", pos: str = "pos") -> tuple[DataFrame, DataFrame]:
    """Training rows of a dialogue (problem, system, user per turn) without copies of what was said before: (rows, pairs).

    ``rows``: the turns with prompt, response and n_history, how many pairs come before. ``pairs``: each dialogue's [prompt, response] pairs once, in order. A turn after one
    without a user text repeats that turn's first response, as the pair it extends keeps its first.
    """
    w = Window.partitionBy(dialogue).orderBy(pos)
    before = F.lag("user").over(w)
    start = (F.row_number().over(w) == 1) | F.lag(F.coalesce(F.col("user"), F.lit("")) != "").over(w)
    rows = turns.withColumns({"_start": start, "prompt": F.when(F.row_number().over(w) == 1, F.col("problem")).otherwise(before)})
    rows = rows.withColumn("_pair", F.sum(F.col("_start").cast("int")).over(w))
    own = Window.partitionBy(dialogue, "_pair").orderBy(pos)
    rows = rows.withColumns({"prompt": F.first("prompt").over(own), "response": F.first("system").over(own), "n_history": F.col("_pair") - 1})
    said = F.array_sort(F.collect_list(F.struct("_pair", "prompt", "response")))
    pairs = rows.where("_start").groupBy(dialogue).agg(F.transform(said, lambda x: F.array(x["prompt"], x["response"])).alias("pairs"))
    return rows.drop("_start", "_pair"), pairs


def history(turns: DataFrame, dialogue: str = "dialogue_id", pos: str = "pos") -> DataFrame:
    """The rows of ``history_index`` with ``history``, the earlier [prompt, response] pairs, for a sink: a row's pairs are cut from its dialogue's as it is written."""
    rows, pairs = history_index(turns, dialogue, pos)
    return rows.join(pairs, dialogue, "left").withColumn("history", F.slice("pairs", F.lit(1), F.col("n_history").cast("int"))).drop("pairs", "n_history")


def session_stats(sessions: DataFrame, *keys: str) -> DataFrame:
    """Counts of verdicts that are true (null is not), lengths and endings."""
    yes = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    n = F.count("*")
    return sessions.groupBy(*keys).agg(
        n.alias("n_sessions"), yes("initial_judge_verdict").alias("initial_correct"), yes("final_judge_verdict").alias("final_correct"),
        (yes("final_judge_verdict") - yes("initial_judge_verdict")).alias("improvement"), (yes("final_judge_verdict") / n).alias("accuracy"),
        F.avg("total_turns").alias("avg_turns"), yes("terminated_naturally").alias("natural_endings"), yes("forced_termination").alias("forced_endings"), F.sum("duration_seconds").alias("duration_seconds"),
    )


def ranked(stats: DataFrame, metric: str, pos: str = "pos") -> DataFrame:
    """Places 1..n, equal values in order of insertion. The table has a row for each variant."""
    return stats.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(metric), pos)))


def replayed(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """A session's outcome from its turn log: last answer and verdict that was given, turns, last action, ending."""
    forced = F.coalesce(F.col("forced"), F.lit(False))
    end = F.coalesce(F.col("teacher_is_terminal"), F.lit(False))
    at = F.struct("turn_number", "pos")
    return turns.groupBy(key).agg(
        F.max_by("student_final_answer", F.when(F.col("student_final_answer").isNotNull(), at)).alias("final_answer"),
        F.min_by("judge_verdict", F.when(F.col("turn_number") == 0, at)).alias("initial_judge_verdict"),
        F.max_by("judge_verdict", F.when(F.col("judge_verdict").isNotNull(), at)).alias("final_judge_verdict"),
        F.coalesce(F.max(F.when(~forced, F.col("turn_number"))), F.lit(0)).alias("total_turns"),
        F.max_by("teacher_action", F.when(F.col("teacher_action").isNotNull(), at)).alias("final_action"),
        F.bool_or(end & ~forced).alias("terminated_naturally"), F.bool_or(forced).alias("forced_termination"),
    )


def judge_conversations(turns: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions as role/content arrays for the judge; empty turns are dropped, the teacher is called tutor."""
    said = F.when(F.col("speaker") == "teacher", F.struct(F.lit("tutor").alias("role"), F.col("teacher_utterance").alias("content"))).otherwise(F.struct(F.lit("student").alias("role"), F.col("student_text").alias("content")))
    rows = turns.select(key, "pos", said.alias("m")).where(F.coalesce(F.length("m.content"), F.lit(0)) > 0)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("conversation"))
