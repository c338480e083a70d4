"""Simulated tutoring sessions and their judges, with injected model calls inside Arrow tasks.

Every session is one row, so a lost task plays its sessions again and no other; write the turns before two branches read them.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dialogue
from ..operators.staging import dealt, staged
from ..providers import Call

# What the judge is asked for, the score of an unreadable answer, and the word a correct verdict begins with.
JUDGED = [*dialogue.PES_DIMENSIONS, "question_depth", "icap"]
MISSING, CORRECT = 3, "CORRECT"
TERMINAL = text.TERMINAL
#: Sessions that a task plays, about.
SESSIONS = 25_000

TURNS = "session_id string, pos int, turn_number int, speaker string, teacher_action string, teacher_utterance string, teacher_is_terminal boolean, student_text string, student_final_answer string, judge_verdict boolean, forced boolean"
Verdict = Callable[[str, str], bool | None]


def resolved(name: str) -> str:
    """The action that a name means, as ``text.action`` has it; the name itself if none."""
    n = name.upper().replace(" ", "_").replace("-", "_")
    if n in text.ACTIONS or n in text.ALIASES:
        return text.ALIASES.get(n, n) if n not in text.ACTIONS else n
    return next((a for a in text.ACTIONS if n in a or a in n), n)


def read_turn(raw: str) -> tuple[str, str]:
    """Action and utterance of a teacher's reply, by the rules of ``text.teacher_turn``; without an action that is known it hints and says all of it."""
    act, said = re.search(r"(?i)Action:\s*(\w+)", raw), re.search(r"(?is)Utterance:\s*(.+?)(?:```|$)", raw.strip())
    action = resolved(act.group(1)) if act else ""
    utterance = re.sub(r"""^["']|["']$""", "", said.group(1).strip()).strip() if said else ""
    return (action, utterance or raw.strip()) if action in text.ACTIONS else ("GIVE_HINT", raw.strip())


def final_answer(said: str) -> str | None:
    found = re.findall(r"(?i)FINAL:\s*([^\n]*)", said)
    return (found[-1].strip().rstrip(".,;:") or None) if found else None


def played(questions: DataFrame, teacher: Call, student: Call, verdict: Verdict, max_turns: int = 10) -> DataFrame:
    """Turns of a session for each question (session_id, question, ground_truth).

    The student answers first and is judged; then teacher and student take turns until the teacher ends the session. A session that
    reaches max_turns ends by force: a last teacher turn that is marked ``forced``. A failed call ends its session with what was said.
    """

    def session(row: dict) -> Iterator[tuple]:
        said: list[dict] = []

        def speak(call: Call, system: str) -> str | None:
            try:
                return call(system, said)
            except Exception:
                return None

        first = speak(student, row["question"] or "")
        if first is None:
            return
        answer = final_answer(first)
        judged = None if answer is None else verdict(row["ground_truth"] or "", answer)
        said.append({"role": "student", "content": first})
        yield row["session_id"], 0, 0, "student", None, None, None, first, answer, judged, False
        pos = 1
        for turn in range(1, max_turns + 1):
            reply = speak(teacher, row["question"] or "")
            if reply is None:
                return
            act, utterance = read_turn(reply)
            if act == "END_SUCCESS" and judged is False:
                act = "CORRECT_ERROR"  # no success on an answer that was judged wrong
            forced = turn == max_turns and act not in TERMINAL
            if forced:
                act = TERMINAL[0] if judged else TERMINAL[1]
            said.append({"role": "tutor", "content": utterance})
            yield row["session_id"], pos, turn, "teacher", act, utterance, act in TERMINAL, None, None, None, forced
            if act in TERMINAL:
                return
            reply = speak(student, row["question"] or "")
            if reply is None:
                return
            answer = final_answer(reply)
            judged = judged if answer is None else verdict(row["ground_truth"] or "", answer)
            said.append({"role": "student", "content": reply})
            yield row["session_id"], pos + 1, turn, "student", None, None, None, reply, answer, None if answer is None else judged, False
            pos += 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split() for c in TURNS.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
        for b in batches:
            rows = [t for r in b.to_pylist() for t in session(r)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])

    asked = questions.select(F.col("session_id").cast("string"), "question", "ground_truth")
    return dealt(asked, asked.count(), most=SESSIONS).mapInArrow(run, TURNS)


def experiment(questions: DataFrame, variants: dict[str, tuple[Call, Call]], verdict: Verdict, max_turns: int = 10) -> tuple[DataFrame, DataFrame]:
    """Turns of all variants (each a teacher and a student), written once, and each session's outcome."""
    parts = [staged(played(questions, teacher, student, verdict, max_turns), "episodes").withColumn("variant", F.lit(name)) for name, (teacher, student) in variants.items()]
    turns = parts[0]
    for p in parts[1:]:
        turns = turns.unionByName(p)
    keyed = dealt(turns.withColumn("run", F.concat_ws("/", "variant", "session_id")), turns.count(), "run")
    return turns, dialogue.replayed(keyed, "run").withColumns({"variant": F.split_part("run", F.lit("/"), F.lit(1)), "session_id": F.split_part("run", F.lit("/"), F.lit(2))}).drop("run")


def conversation_judged(conversations: DataFrame, judge: Call, **limits) -> DataFrame:
    """The rows (with ``conversation``: array of role and content) with a score from 1 to 5 for each of JUDGED, and a summary.

    Eleven calls a row, each a row of its own that is asked on its own; the replies are written before they are read. A reply is JSON with "score", bare or fenced: a failed call, or one
    without a score that is a number, counts 3. ``limits``: as of ``providers.respond``.
    """
    from ..providers import respond

    rows = staged(conversations.withColumn("_row", F.monotonically_increasing_id()), "conversations")
    none = F.array().cast("array<struct<role:string,content:string>>")
    asked = rows.select("_row", F.coalesce("conversation", none).alias("messages"), F.explode(F.lit([*JUDGED, "summary"])).alias("system_prompt"))
    said = staged(respond(asked, judge, **limits).select("_row", F.col("system_prompt").alias("what"), "response"), "judged")
    value = text.fenced_json(F.col("response"), "score string")["score"].try_cast("double")
    score = F.coalesce(F.greatest(F.lit(1), F.least(F.lit(5), value.try_cast("int"))), F.lit(MISSING))
    found = said.withColumn("score", F.when(value.isNull(), MISSING).otherwise(score)).groupBy("_row").agg(
        *[F.max(F.when(F.col("what") == n, F.col("score"))).alias(n) for n in JUDGED], F.max(F.when(F.col("what") == "summary", F.col("response"))).alias("summary")
    )
    return rows.join(found, "_row").drop("_row")


def answers_judged(rows: DataFrame, judge: Call, truth: str = "ground_truth", answer: str = "answer") -> DataFrame:
    """``is_correct`` and ``by``: numbers are compared within a percent; only where either side is none is the judge called.

    An answer that begins with CORRECT is a yes, a failed call is null, an empty answer is wrong without a call.
    """
    from ..providers import respond

    agreed = staged(rows.withColumns({"_row": F.monotonically_increasing_id(), "_n": text.numbers_agree(F.col(truth), F.col(answer))}), "compared")
    empty = F.coalesce(F.length(F.col(answer)), F.lit(0)) == 0
    asked = agreed.where(F.col("_n").isNull() & ~empty).select("_row", F.lit("Are both answers the same?").alias("system_prompt"), F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("Truth: "), truth, F.lit("\nAnswer: "), answer).alias("content"))).alias("messages"))
    said = staged(respond(asked, judge), "equality").select("_row", F.when(F.col("error").isNull(), F.startswith(F.upper(text.strip(F.col("response"))), F.lit(CORRECT))).alias("_said"))
    out = agreed.join(said, "_row", "left")
    return out.withColumns({"is_correct": F.when(F.col("_n").isNotNull(), F.col("_n")).when(empty, F.lit(False)).otherwise(F.col("_said")), "by": F.when(F.col("_n").isNotNull(), "numbers").when(empty, "empty").otherwise("judge")}).drop("_row", "_n", "_said")
