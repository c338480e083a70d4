"""Shared plumbing of the training-data operators: scratch tables, reading, grouping of sorted Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch tables that are there.
live: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Only a local session, as in tests, may leave it unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/scratch-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Writes ``df`` to the shared folder and reads it back: later plans restart from files that outlive any executor.

    Tables that no operator discards (those a result still reads) go when the application ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target, files = filesystem(spark, path)
    files.deleteOnExit(target)
    live.add(path)
    return spark.read.schema(df.schema).parquet(path), path


def filesystem(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later plan reads."""
    for path in paths:
        target, files = filesystem(spark, path)
        files.delete(target, True)
        live.discard(path)


def spread(df: DataFrame) -> DataFrame:
    """Deals a small input out over the cores; a table with enough splits is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % n


def runs(keys: np.ndarray) -> np.ndarray:
    """Start positions of runs of equal values, and the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over (x, weighted mean y); returns the knots of a monotone curve."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order].tolist(), y[order].tolist(), w[order].tolist(), strict=True):
        blocks.append([xi, xi, yi, wi])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            hi, lo = blocks.pop(), blocks[-1]
            total = lo[3] + hi[3]
            lo[1], lo[2], lo[3] = hi[1], (lo[2] * lo[3] + hi[2] * hi[3]) / total, total
    xs = [e for b in blocks for e in (b[0], b[1])]
    ys = [b[2] for b in blocks for _ in range(2)]
    return np.array(xs or [0.0]), np.array(ys or [0.5])
