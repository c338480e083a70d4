"""Row numbers in file order: gapless, and without a sort of the rows.

A row's place in its split comes from the reading task; how many rows each split has is counted where they are read. So the number of
a row is the rows of all splits before its own, files in the order of their paths, and its place. Only the counts, one row a split, go to one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SPLIT = ["_file", "_start"]


def numbered(rows: DataFrame, name: str = "pos", base: int = 0) -> DataFrame:
    """``rows``, as a file source reads them, with ``name``: their number in file order from ``base`` on.

    Files are ordered by path. ``rows`` must come straight from the reader (columns may have been selected): its hidden columns tell the split. They are read twice, once
    for counting only. Empty files have no rows, an empty folder none.
    """
    marked = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")).withColumn("_at", F.monotonically_increasing_id())
    counts = marked.groupBy(*SPLIT).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    offsets = counts.select(*SPLIT, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return marked.join(offsets, SPLIT).withColumn(name, F.col("_at") + F.col("_shift") + base).drop(*SPLIT, "_at", "_shift")
