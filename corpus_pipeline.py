"""The corpus pipeline: quality, toxicity, near-duplicates, packing; each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import common, packing, quality, shingles, simhash, toxicity  # noqa: F401


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.3.

    Each row is judged by its own text: null and empty texts and null ids too, repeated rows share their fate; an empty table gives
    none, and without labels all stay. Very long texts are measured whole.
    """
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; odd rows as in the stage before."""
    return toxicity.accepted(docs, common.table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the one with the smallest id (null last), of ties by hash of the text, then by place in the table.

    Rows are decided each by its own text, so that one that repeats an id, or has none, goes only with its own text's group. Null and empty
    texts are copies of each other; an empty table gives no rows; very long texts are compared whole.
    """
    rows, seen = shingles.signed_sets(docs.withColumn("_row", F.monotonically_increasing_id()))
    rows, _ = common.materialise(rows, "pipeline-rows")
    roots, _ = shingles.links(rows, seen)
    own = rows.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row").alias("place"), "_sig")
    held, _ = common.materialise(own.join(roots.withColumnRenamed("node", "_sig"), "_sig", "left").select("_row", "place", F.coalesce("root", "_sig").alias("root")), "pipeline-held")
    least = held.groupBy("root").agg(F.count("*").alias("n"), F.min("place").alias("least")).where("n > 1")
    gone = held.join(least, "root").where("_row <> least._row").select("_row")
    # One merge join at every size: the rows that go are a share of the documents, with no bound to broadcast them under.
    return rows.join(gone.hint("merge"), "_row", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens.

    Null and empty texts are their end token; each row is packed on its own, repeated rows and ids too. Very long texts are encoded whole and cut into as many pieces as
    they need; an empty table gives no pieces.
    """
    return packing.packed(docs, packing.vocabulary())


STAGES = [("quality", quality_stage), ("toxicity", toxicity_stage), ("near_duplicates", near_duplicate_stage), ("packing", packing_stage)]

#: Models and fingerprints are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's table is deleted once the next one's is written, and its scratch tables as soon as its own is."""
    docs, last = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        before = set(common.live)
        docs, path = common.materialise(stage(spark, docs, sf_dir).select(*docs.columns), f"pipeline-{name}")
        common.discard(spark, *(common.live - before - {path}), *([last] if last else []))
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
