"""Stages over streams whose rows are there exactly once: a batch counts when its entry in the ledger is written, which is last.

An entry names the folder of its batch's rows. Folders without an entry, as of a job that died between the two, are never read; a
batch that has an entry is not written again. Every ``FOLDED``-th entry names all folders before it, so that readers open few entries.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import manifest

FOLDED = 64


def folders(spark: SparkSession, out: str) -> list[str]:
    """The batches' folders in the order of their numbers."""
    numbers, later = manifest.numbers(spark, out), []
    for n in reversed(numbers):
        entry = manifest.read(spark, out, n)
        later.append([*entry.get("folded", []), *entry["folders"]])
        if "folded" in entry:
            break
    return [f for fs in reversed(later) for f in fs]


def committed(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """The rows of all batches that count."""
    places = [f"{out}/{f}" for f in folders(spark, out)]
    return spark.read.schema(schema).json(places) if places else spark.createDataFrame([], schema)


def has(spark: SparkSession, out: str, number: int) -> bool:
    """Whether a batch counts already. Numbers only rise, so the last entry tells."""
    numbers = manifest.numbers(spark, out)
    return bool(numbers) and numbers[-1] >= number


def add(rows: DataFrame, out: str, number: int) -> str:
    """Writes a batch's rows where no reader looks yet; returns the folder."""
    at = f"data/{number:012d}-{uuid.uuid4().hex}"
    rows.write.option("ignoreNullFields", False).json(f"{out}/{at}")
    return at


def enter(spark: SparkSession, out: str, number: int, *added: str) -> bool:
    entry: dict = {"folders": list(added)}
    if number % FOLDED == FOLDED - 1:
        entry["folded"] = folders(spark, out)
    return manifest.commit(spark, out, number, entry)


def staged(source: DataFrame, stage: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """A resumable stage: each micro-batch's rows go through ``stage`` and count once, whenever the job dies. Without an interval it handles what is there and ends.

    How much work a crash can cost is one micro-batch: bound it where the source is read (maxFilesPerTrigger).
    """

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not has(spark, out, number):
            enter(spark, out, number, add(stage(batch), out, number))

    writer = source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
