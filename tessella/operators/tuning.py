"""Fine-tuning rows from token ids: role headers, masked labels, padding and batch collation. The tokenizer is injected."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IGNORED = -100
ROLES = ["system", "user", "assistant", "observation"]
Encoder = Callable[[list[str]], list[list[int]]]


def encoded(text: Column, encoder: Callable[[], Encoder]) -> Column:
    """Ids of a text, a batch at a time; ``encoder`` is called once a batch and should cache. A null text has none."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(encoder()([t or "" for t in texts.to_pylist()]), pa.list_(pa.int32()))

    return run(text)


def message_ids(role: Column, header: Column, body: Column, commands: dict[str, int]) -> Column:
    """A message: its role's command, the ids of its metadata line, the ids of its text. An unknown role fails."""
    command = F.create_map(*[F.lit(x) for r in ROLES if r in commands for x in (r, commands[r])])
    known = F.coalesce(F.try_element_at(command, role), F.raise_error(F.concat(F.lit("unknown role "), F.coalesce(role, F.lit("null")))).cast("int"))
    return F.concat(F.array(known), header, body)


def chat_ids(messages: Column, assistant: int) -> Column:
    """Messages' ids in a row, then the assistant's command."""
    return F.concat(F.flatten(messages), F.array(F.lit(assistant)))


def usable(prompt: Column, response: Column) -> Column:
    """Rows without a prompt or response are left out."""
    return F.coalesce((prompt != "") & (response != ""), F.lit(False))


def _repeated(value: int, n: Column) -> Column:
    return F.array_repeat(F.lit(value), F.greatest(n, F.lit(0)))


def training_ids(context: Column, answer: Column, eos: int, pad: int, max_source: int, max_target: int, mask: bool = True, cut_context: bool = True) -> tuple[Column, Column]:
    """(input_ids, labels), right-padded to max_source + max_target + 1.

    The context is cut to max_source (but for problem rows, whose context stays whole and may exceed the length) and
    the answer to max_target. Labels hide the context and the padding, and so an eos that equals pad.
    """
    a = F.slice(context, 1, max_source) if cut_context else context
    b = F.concat(F.slice(answer, 1, max_target), F.array(F.lit(eos)))
    fill = _repeated(pad, F.lit(max_source + max_target + 1) - F.size(a) - F.size(b))
    hidden = IGNORED if mask else pad
    shown = F.transform(b, lambda x: F.when(x == pad, IGNORED).otherwise(x)) if mask else b
    gap = _repeated(hidden, F.lit(max_source + max_target + 1) - F.size(a) - F.size(b))
    return F.concat(a, b, fill), F.concat(_repeated(hidden, F.size(a)), shown, gap)


def left_padded(ids: Column, length: Column, pad: int, multiple: int = 1) -> Column:
    """input_ids, attention_mask and position_ids, filled on the left up to the length, rounded up to a multiple."""
    n = F.size(ids)
    gap = F.ceil(length / multiple).cast("int") * multiple - n
    places = F.transform(ids, lambda _, i: i)
    return F.struct(
        F.concat(_repeated(pad, gap), ids).alias("input_ids"),
        F.concat(_repeated(0, gap), F.transform(ids, lambda _: F.lit(1))).alias("attention_mask"),
        F.concat(_repeated(0, gap), places).alias("position_ids"),
    )


def effective_length(ids: Column, pad: int) -> Column:
    """Ids before the first padding behind the first largest id (so that padding on the left is passed over)."""
    peak = F.array_position(ids, F.array_max(ids)).cast("int")
    behind = F.slice(ids, peak, F.size(ids))
    end = F.least(*[F.nullif(F.array_position(behind, F.lit(x)), F.lit(0)).cast("int") for x in (pad, IGNORED)])  # the first there is
    return F.coalesce(peak + end - 2, F.size(ids))


def collated(rows: DataFrame, batch: str, pad: int, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """Ids and labels cut to the longest effective length of their batch. Batches are small; each is one window."""
    longest = F.max(effective_length(F.col(ids), pad)).over(Window.partitionBy(batch))
    return rows.withColumn("_n", longest).withColumns({c: F.slice(F.col(c), F.lit(1), F.col("_n")) for c in (ids, labels)}).drop("_n")


def concatenated(*tables: DataFrame) -> DataFrame:
    """Training tables one after the other, with ``part`` naming the table; columns that one lacks are null."""
    named = [t.withColumn("part", F.lit(i)) for i, t in enumerate(tables)]
    out = named[0]
    for t in named[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
