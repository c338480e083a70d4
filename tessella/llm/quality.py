"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics are measured once per text. Random Fourier features approximate a Gaussian kernel over the standardised
statistics; every partition sums its normal equations, a tree of shuffles adds them, and the driver solves for
ridge weights. Scores of a fifth of the training rows, kept out of the
sums, are counted in fixed bins and calibrated by pool-adjacent-violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Byte classes whose shares are statistics.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b"#*$%&", b"|<>", b"!?", b".,;:", b"()[]{}\"'`", b"_-=+~^/\\@", bytes(range(128, 256))]
IN_CLASS = np.array([[c in group for group in CLASSES] for c in range(256)], np.float64)
N_STATS = len(CLASSES) + 7
FEATURES, RIDGE, FAN, BINS = 384, 1.0, 8, 1000


def statistics(text: str | None) -> np.ndarray:
    """What a document measures; a null text is an empty one."""
    data = (text or "").encode()
    n, words = len(data), data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    share = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ IN_CLASS / max(1, n)
    nw, nl = len(words), len(lines)
    return np.concatenate([np.sqrt(share), [np.log1p(n), np.log1p(nw), n / (nw + 1.0) if n < 1000 * (nw + 1) else 1000.0, len(set(words)) / (nw + 1.0), np.log1p(nl), 1 - len(set(lines)) / max(1, nl), np.log1p(n / (nl + 1.0))]])


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and x, the statistics of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1)]).reshape(len(b), N_STATS)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(b) + 1) * N_STATS, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), rows], ["doc_id", "x"])

    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, x array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), N_STATS)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, np.sqrt(2 / FEATURES) * np.cos(z @ self.frequency + self.phase)])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.knots), 0.0, 1.0)


def summed(rows: DataFrame, of) -> np.ndarray | None:
    """Sum of of(x, y) over all rows (x array, y double).

    Every partition sums its own rows; a tree of shuffles with fan-in ``FAN`` adds the sums until at most ``FAN`` are
    left for the driver. Sums are added in order of the partition that made them, so that a repeated task gives the
    same bits.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if len(b):
                part = of(matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], ["node", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, total = 0, None
        for b in batches:
            for at, sums in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = np.frombuffer(sums.as_buffer())
                node, total = at // FAN, part.copy() if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), pa.array([total.tobytes()])], ["node", "sums"])

    rows = rows.select("x", "y")
    width, level = rows.rdd.getNumPartitions(), rows.mapInArrow(first, "node int, sums binary")
    while width > FAN:
        width = -(-width // FAN)
        level = level.repartitionById(width, (F.col("node") / FAN).cast("int")).sortWithinPartitions("node").mapInArrow(add, "node int, sums binary")
    parts = [np.frombuffer(r.sums) for r in sorted(level.collect(), key=lambda r: r.node)]  # at most FAN rows
    return sum(parts) if parts else None


def means(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, y): labels for learning, repeated ones averaged; rows without id or label are left out."""
    known = labels.select(F.col("doc_id").cast("long"), F.col(column).cast("double").alias("y")).dropna()
    return known.where(common.remainder("doc_id", 5) != 0).groupBy("doc_id").agg(F.avg("y").alias("y"))


def fit(stats: DataFrame, labels: DataFrame, column: str = "quality") -> Model | None:
    """Learns from the labelled rows whose crc32(doc_id) mod 5 is not 0; None if there are none."""
    rows, path = common.materialise(stats.join(means(labels, column), "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).alias("aside")), "quality-train")
    moments = summed(rows, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x**2).sum(0)]))
    if moments is None:
        return None
    n, s, q = moments[0], moments[1 : N_STATS + 1], moments[N_STATS + 1 :]
    mean, rng = s / n, np.random.default_rng(1)
    scale = np.sqrt(np.maximum(q / n - mean**2, 1e-6))
    start = Model(mean, scale, rng.normal(size=(N_STATS, FEATURES)) / np.sqrt(N_STATS), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), (np.zeros(1), np.zeros(1)))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = start.features(x)
        return np.hstack([z.T @ z, (z.T @ y)[:, None]]).ravel()

    sums = summed(rows.where("NOT aside"), normal)
    if sums is None:
        sums = summed(rows, normal)
    size = 1 + N_STATS + FEATURES
    sums = sums.reshape(size, size + 1)
    weight = np.linalg.solve(sums[:, :-1] + RIDGE * np.eye(size), sums[:, -1])
    ready = Model(mean, scale, start.frequency, start.phase, weight, start.knots)
    aside = rows.where("aside") if rows.where("aside").limit(1).count() else rows

    @F.arrow_udf("double")
    def raw(x: pa.Array) -> pa.Array:
        return pa.array(ready.raw(matrix(x)))

    bins = aside.select(F.round(F.least(F.greatest(raw("x"), F.lit(-1.0)), F.lit(2.0)) * BINS).alias("bin"), "y").groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y")).collect()  # at most 3 * BINS + 1 rows
    knots = common.isotonic(*(np.array([float(r[k]) for r in bins]) / (BINS if k == "bin" else 1) for k in ("bin", "y", "n")))
    common.discard(rows.sparkSession, path)
    return Model(mean, scale, start.frequency, start.phase, weight, knots)


def scored(model: Model | None, x: Column) -> Column:
    """Calibrated score of statistics; without a model every document scores 0.5."""
    if model is None:
        return F.lit(0.5)

    @F.arrow_udf("double")
    def score(rows: pa.Array) -> pa.Array:
        return pa.array(model.score(matrix(rows)))

    return score(x)


def classified(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null texts count as empty and are scored; very long texts are measured whole; null ids are kept, held out by the checksum of no bytes, and never
    labelled; repeated rows stay (each counts in training) and score alike; other columns are ignored; an empty table gives no rows. Without labels every score is 0.5.
    """
    stats, _ = common.materialise(measured(docs), "quality-stats")
    score = stats.select("doc_id", scored(fit(stats, labels, column), F.col("x")).alias("score"))
    return score.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, column: str = "quality", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold, with their own columns.

    Odd rows as in ``classified``: each row is judged by its own text; repeated rows share their fate; an empty table gives no rows. Without
    labels all rows stay.
    """
    stats, _ = common.materialise(measured(docs), "quality-stats")
    model = fit(stats, labels, column)
    if model is None:
        return docs

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(np.array([statistics(t.as_py()) for t in texts]).reshape(-1, N_STATS)))

    return common.spread(docs).where(score("text") >= threshold)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return classified(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
