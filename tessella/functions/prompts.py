"""Prompts as columns: templates with slots, lookups with defaults, rounds of a dialogue."""

from __future__ import annotations

import re
from itertools import zip_longest

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the fine-tuning prompts.
ROUND = "[Round {round}]\n\n问：{query}\n\n答："
QA = "Question: {query}\nAnswer: \nLet's think step by step.\n"
SPEAKERS = {"user": "Student: ", "assistant": "Initial Response: "}


def filled(template: str, **slots: Column) -> Column:
    """The template with its ``{slots}`` replaced; a null value counts as empty, an unknown slot raises KeyError."""
    texts, names = re.split(r"\{\w+\}", template), re.findall(r"\{(\w+)\}", template)
    parts = []
    for text, name in zip_longest(texts, names):
        parts.append(F.lit(text))
        if name:
            parts.append(F.coalesce(slots[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def looked_up(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    """The text of a key (subject guidance, a system prompt by use case and modality), else the default."""
    if not table:
        return F.lit(default)
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), F.lit(default))


def system_prompt(use_case: Column, multimodal: Column, table: dict[tuple[str, bool], str], default: str | None = None) -> Column:
    flat = {f"{case}|{str(images).lower()}": text for (case, images), text in table.items()}
    return looked_up(F.concat_ws("|", use_case, F.coalesce(multimodal, F.lit(False)).cast("string")), flat, default)


def judge_context(messages: Column, system: Column | None = None) -> Column:
    """Lines of a dialogue by speaker; other roles are left out. ``messages``: array of role and content."""
    kept = F.filter(F.coalesce(messages, F.array()), lambda m: m["role"].isin(*SPEAKERS))
    lines = F.transform(kept, lambda m: F.concat(looked_up(m["role"], SPEAKERS), F.coalesce(m["content"], F.lit(""))))
    own = F.array_join(lines, "\n")
    return own if system is None else F.concat_ws("\n", F.when(system != "", system), own)


def question_prompt(query: Column) -> Column:
    return filled(QA, query=query)


def round_prompt(query: Column, history: Column) -> Column:
    """Earlier rounds with their answers, then the open one. ``history``: array of query and response; null: none."""
    past = F.coalesce(history, F.array())
    told = F.transform(past, lambda h, i: F.concat(filled(ROUND, round=i + 1, query=h["query"]), F.coalesce(h["response"], F.lit("")), F.lit("\n\n")))
    return F.concat(F.array_join(told, ""), filled(ROUND, round=F.size(past) + 1, query=query))
