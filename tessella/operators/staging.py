"""Tables in the shared checkpoint folder, where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is written there goes when the application ends.

    The folder is the one that spark.checkpoint.dir names; only a local session, as in tests, may leave that unset.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/scratch-{spark.sparkContext.applicationId}"
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes and rereads: later plans restart from files that outlive any executor. The table goes when it is discarded, or the application ends."""
    path, schema = scratch(df.sparkSession, tag), df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def dealt(df: DataFrame, rows: int, *keys: str, most: int = 250_000) -> DataFrame:
    """``df`` of so many rows, dealt out so that a task has about ``most`` of them (a key's rows stay together), however many there are: what it sorts doesn't grow.

    A shuffle by keys to few tasks (Spark's bypassMergeThreshold) is written as the rows come; one to more holds a split's rows and sorts them. So a task gets up to four times ``most`` before there are more tasks than that.
    """
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streamed = int(df.sparkSession.sparkContext.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    wide = -(-rows // most)
    if keys and wide > streamed:
        wide = max(streamed, -(-rows // (4 * most)))
    return df.repartition(max(own, wide), *keys)


def dealt_if_many(df: DataFrame, rows: int, *keys: str, most: int = 250_000) -> DataFrame:
    """A side of a join whose larger side has so many rows: as it is where Spark's own number of tasks gives each at most ``most`` of them, else dealt out for them."""
    return df if rows <= most * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else dealt(df, rows, *keys, most=most)


def discarded(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(t._staged_at)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
