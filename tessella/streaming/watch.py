"""Export of passing rows from growing folders, and live sessions with an end in time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import text
from ..operators import curation
from ..operators import staging as tables_of
from ..sources import io, tables
from . import ledger


def growing(spark: SparkSession, path: str) -> DataFrame:
    """New rows of a growing folder of JSON lines."""
    return spark.readStream.schema(io.RESPONSE).option("mode", "DROPMALFORMED").json(path)


def passing(rows: DataFrame, threshold: float = curation.OVERALL, key: list[str] = curation.FULL_KEY) -> DataFrame:
    """Rows at or above the threshold, with ``_key``; rows without a sample or a persona are left out."""
    good = rows.where((F.coalesce("weighted_score", F.lit(0.0)) >= threshold) & F.col("sample_id").isNotNull() & F.col("persona_name").isNotNull())
    return good.withColumn("_key", text.key(*key))


def both(graded: DataFrame, revised: DataFrame | None) -> DataFrame:
    """Graded rows and revised ones, which come second (``_source``)."""
    rows = graded.withColumn("_source", F.lit(0))
    return rows if revised is None else rows.unionByName(revised.withColumn("_source", F.lit(1)), allowMissingColumns=True)


def first_of_each(rows: DataFrame) -> DataFrame:
    """One row of each ``_key``: a graded one before a revised one, then the best score, then by hash."""
    names = [c for c in rows.columns if c != "_key"]
    order = F.struct("_source", -F.col("weighted_score"), F.xxhash64(*names))
    return rows.groupBy("_key").agg(F.min_by(F.struct(*names), order).alias("_r")).select("_key", "_r.*")


#: Keys that are exported, with the number of the batch that did it.
KEYS = "_key string, batch long"


def export(graded: DataFrame, revised: DataFrame | None, system: str, out: str, checkpoint: str, threshold: float = curation.OVERALL, key: list[str] = curation.FULL_KEY, interval: str | None = None) -> StreamingQuery:
    """Adds a training row for each key that passes, once, from two growing inputs; read them with ``exported``.

    The stream itself keeps no keys: those of earlier batches are in a table beside the output (bucketed by hash, of which a batch reads and writes
    only the buckets that its keys fall in). A batch that died after its keys were written finds them with its own number, and exports them again; its rows count when its ledger
    entry is written. Without an interval it handles what is there and ends.
    """
    rows = passing(both(graded, revised), threshold, key)

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if ledger.has(spark, out, number):
            return
        new = tables_of.staged(first_of_each(batch), "exported")
        found = tables.current(spark, f"{out}/keys")
        if found is not None:
            hit = {r.b for r in new.select(tables.bucket(["_key"], found[1]["buckets"]).alias("b")).distinct().collect()}  # at most as many rows as there are buckets
            known = tables.rows_of(spark, f"{out}/keys", found[1], hit).where(F.col("batch") < number).select("_key")
            fresh = tables_of.staged(new.join(known, "_key", "left_anti"), "exported")
            tables_of.discarded(new)
            new = fresh
        at = ledger.add(curation.training_rows(new, system), out, number)
        tables.upsert(spark, f"{out}/keys", new.select("_key", F.lit(number).cast("long").alias("batch")), ["_key"])
        tables_of.discarded(new)
        ledger.enter(spark, out, number, at)

    writer = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


EXPORTED = f"messages array<{io.MESSAGE}>"


def exported(spark: SparkSession, out: str) -> DataFrame:
    return ledger.committed(spark, out, EXPORTED)


def export_once(graded: DataFrame, revised: DataFrame | None, system: str, threshold: float = curation.OVERALL, key: list[str] = curation.FULL_KEY) -> DataFrame:
    """The training rows of what is there now: all passing rows of both tables, repeated keys too."""
    return curation.training_rows(passing(both(graded, revised), threshold, key), system)


STATE = "turns int, answer string, initial boolean, verdict boolean, action string, last long, ended long"
OUTPUT = "session_id string, total_turns int, final_answer string, initial_judge_verdict boolean, final_judge_verdict boolean, final_action string, ended string, ended_at long"
NAMES = [c.split()[0] for c in OUTPUT.split(", ")]


class Sessions(StatefulProcessor):
    """Times are microseconds. A session's state is its outcome so far; a timer ends it when nothing came for ``idle`` seconds. An ended session leaves its end time only, for ``keep`` seconds."""

    def __init__(self, max_turns: int, idle: float, keep: float):
        self.max_turns, self.idle, self.keep = max_turns, int(idle * 1e6), int(keep * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("session", STATE)

    def outcome(self, key: tuple, s: list, cause: str, at: int) -> tuple:
        n, answer, initial, verdict, action = s[:5]
        s[:] = [0, None, None, None, None, None, at]
        return (key[0], n, answer, initial, verdict, action, cause, at)

    def passed(self, key: tuple, s: list, now: int) -> Iterator[tuple]:
        """What the time up to ``now`` brings: the end of an idle session, and of the memory of an ended one."""
        if s[5] is not None and now > s[5] + self.idle:
            yield self.outcome(key, s, "idle", s[5] + self.idle)
        if s[6] is not None and now > s[6] + self.keep:
            s[6] = None

    def kept(self, s: list) -> None:
        """Stores the state, or forgets the key, and sets its one timer."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        due = s[5] + self.idle if s[5] is not None else s[6] + self.keep if s[6] is not None else None
        if due is None:
            self.state.clear()
        else:
            self.state.update(tuple(s))
            self.handle.registerTimer(due // 1000 + 1)

    def current(self) -> list:
        return list(self.state.get()) if self.state.exists() else [0, None, None, None, None, None, None]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802 - Spark's names
        s, out = self.current(), []
        for r in pd.concat(list(rows)).sort_values(["micros", "turn_number"]).itertuples():
            out += self.passed(key, s, int(r.micros))
            if s[6] is not None:
                continue  # a turn of an ended session
            if pd.notna(r.judge_verdict):
                s[3] = bool(r.judge_verdict)
                s[2] = s[3] if r.turn_number == 0 else s[2]
            s[1] = r.student_final_answer if pd.notna(r.student_final_answer) else s[1]
            s[4] = r.teacher_action if pd.notna(r.teacher_action) else s[4]
            s[0], s[5] = max(s[0], int(r.turn_number)), int(r.micros)
            if bool(r.teacher_is_terminal) or s[0] >= self.max_turns:
                out.append(self.outcome(key, s, "natural" if bool(r.teacher_is_terminal) else "forced", int(r.micros)))
        self.kept(s)
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = self.current()
        out = list(self.passed(key, s, expiredTimerInfo.getExpiryTimeInMs() * 1000))
        self.kept(s)
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


def sessions(turns: DataFrame, max_turns: int = 10, idle: float = 1800, keep: float = 3600, delay: str = "10 minutes") -> DataFrame:
    """Live sessions keyed by session_id: an outcome row when a session ends, naturally, forced after max_turns, or idle, when no turn came for ``idle`` seconds.

    ``turns``: session_id, at, turn_number, teacher_action, teacher_is_terminal, student_final_answer, judge_verdict. Time is that of ``at``; turns later than ``delay`` are dropped, and those without time or session.
    For ``keep`` seconds after its end later turns of a session are ignored; then it is forgotten, and a turn with its id begins another. So the state is that
    of sessions not long ended. Sets the session's state store to RocksDB, which timers need.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = turns.where("at IS NOT NULL AND session_id IS NOT NULL").withColumn("micros", F.unix_micros("at")).withWatermark("at", delay)
    return timed.groupBy("session_id").transformWithStateInPandas(Sessions(max_turns, idle, keep), OUTPUT, "append", "EventTime").withColumn("ended_at", F.timestamp_micros("ended_at"))
