"""Exact medians by distributed selection: histograms of a group's range, refined only where the middle falls.

A round counts, for each group, values in ``BINS`` equal parts of its range, with each part's least and largest value; partial aggregates do
that where the values are. The part that holds the middle is the range of the next round, until it has at most ``FEW`` values, which are sorted,
or a single value. No task holds more of a group than ``BINS`` counts or ``FEW`` values, and values are not shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import discarded, staged

BINS, FEW = 1024, 1024


def place(v: Column, lo: Column, hi: Column) -> Column:
    """The part of [lo, hi] that v falls in; it never falls as v rises, and tells the two ends apart whatever the range. NaN is the largest value."""
    share = (v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS
    return F.when(v == lo, 0).when(v == hi, BINS - 1).when(F.isnan(share), BINS // 2).otherwise(F.least(F.floor(share), F.lit(BINS - 1)).cast("int"))


def medians(rows: DataFrame, keys: list[str], column: str, name: str = "median") -> DataFrame:
    """The keys and the median of ``column`` of each group that has a value; the mean of the two middle values where their number is even.

    ``rows`` is read once a round, so it should be a table. Null values don't count, null keys are a group; NaN is above all numbers. Groups without a value
    and empty tables have no row.
    """
    by = [f"_k{i}" for i in range(len(keys))] or ["_k"]
    group = [F.struct(F.col(k).alias("x")).alias(b) for k, b in zip(keys, by, strict=False)] or [F.lit(0).alias("_k")]
    values = rows.select(*group, F.col(column).cast("double").alias("_v")).where("_v IS NOT NULL")
    open_ = values.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("held")).withColumn("before", F.lit(0).cast("long"))
    done, old = [], []
    low, high = F.expr("(n - 1) div 2"), F.expr("n div 2")
    while True:
        open_ = staged(open_, "quantiles")
        old.append(open_)
        single = open_.where("lo = hi").select(*by, F.col("lo").alias("_m"))
        few = values.join(open_.where(f"lo <> hi AND held <= {FEW}"), by).where("_v >= lo AND _v <= hi").groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("l"), F.first(low - F.col("before")).alias("a"), F.first(high - F.col("before")).alias("b"))
        done += [single, few.select(*by, F.expr("(get(l, cast(a AS int)) + get(l, cast(b AS int))) / 2").alias("_m"))]
        wide = open_.where(f"lo <> hi AND held > {FEW}")
        if wide.isEmpty():
            break
        counts = values.join(wide, by).where("_v >= lo AND _v <= hi").groupBy(*by, place(F.col("_v"), F.col("lo"), F.col("hi")).alias("bin")).agg(
            F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first("n").alias("n"), F.first("before").alias("before")
        )
        sofar = counts.withColumn("end", F.col("before") + F.sum("c").over(Window.partitionBy(*by).orderBy("bin")))  # at most BINS rows for each group
        middle = sofar.where((F.col("end") > low) & (F.col("end") - F.col("c") <= high)).groupBy(*by).agg(
            F.count("*").alias("k"), F.first("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("c").alias("held"), F.min(F.col("end") - F.col("c")).alias("before"),
            F.min("hi").alias("left"), F.max("lo").alias("right"),
        )
        # Where the two middle values lie in two parts, they are the end of one and the start of the other.
        middle = staged(middle, "quantiles")
        old.append(middle)
        done.append(middle.where("k = 2").select(*by, ((F.col("left") + F.col("right")) / 2).alias("_m")))
        open_ = middle.where("k = 1").select(*by, "n", "lo", "hi", "held", "before")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = staged(out, "medians")
    discarded(*old)
    return out.select(*[F.col(f"{b}.x").alias(k) for k, b in zip(keys, by, strict=False)], F.col("_m").alias(name))


def with_median(aggregated: DataFrame, rows: DataFrame, keys: list[str], column: str, name: str = "median") -> DataFrame:
    """``aggregated`` (a row for each group) with the median, null where a group has no value."""
    found = medians(rows, keys, column, name)
    if not keys:
        return aggregated.withColumn("_k", F.lit(0)).join(found.withColumn("_k", F.lit(0)), "_k", "left").drop("_k")  # one row each
    other = found.select(*[F.col(k).alias(f"_m{i}") for i, k in enumerate(keys)], name)
    on = [aggregated[k].eqNullSafe(other[f"_m{i}"]) for i, k in enumerate(keys)]
    return aggregated.join(other, on, "left").drop(*[f"_m{i}" for i in range(len(keys))])


def summarised(rows: DataFrame, keys: list[str], column: str, *aggregates: Column, spread: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Aggregates of each group and the median of ``column``. ``rows`` are computed once; ``spread`` may multiply them after that, as for several groupings."""
    held = staged(rows, "summarised")
    view = spread(held) if spread else held
    out = staged(with_median(view.groupBy(*keys).agg(*aggregates), view, keys, column), "summary")
    discarded(held)
    return out
