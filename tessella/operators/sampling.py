"""Seeded, exact-size sampling and splitting by hash order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged


#: Hash order is ranked within so many slots (hexadecimal digits of the hash), so that no task ranks a whole group.
DIGITS = 4


def order(key: str, seed: int) -> list[Column]:
    return [F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")).cast("binary")), F.col(key)]


def first_of(rows: DataFrame, group: str, key: str, targets: DataFrame, seed: int) -> DataFrame:
    """The rows with ``_in``: whether they are among the first ``_target`` of their group in hash order.

    ``targets`` (group, _target) has a row for each group. Slots before the one in which the target falls are in whole, slots behind
    it out; only rows of that slot are ranked.
    """
    slotted = rows.withColumn("_slot", F.substring(order(key, seed)[0], 1, DIGITS))
    sofar = Window.partitionBy(group).orderBy("_slot")  # at most 16 ** DIGITS rows for each group
    counts = slotted.groupBy(group, "_slot").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(sofar) - F.col("_n"))
    edges = counts.join(F.broadcast(targets), group).where("_before < _target AND _before + _n >= _target").select(group, F.col("_slot").alias("_edge"), (F.col("_target") - F.col("_before")).alias("_rest"))
    known = slotted.join(F.broadcast(targets), group, "left").join(F.broadcast(edges), group, "left")  # a row for each group
    at = F.coalesce(F.col("_slot") == F.col("_edge"), F.lit(False))
    whole = F.coalesce(F.col("_target"), F.lit(0)) > 0
    place = F.row_number().over(Window.partitionBy(group, "_slot").orderBy(*order(key, seed)))
    # Only rows of the edges' slots are shuffled and ranked. Without an edge the group is smaller than its target.
    ranked = known.where(at).withColumn("_in", whole & (place <= F.col("_rest")))
    others = known.where(~at).withColumn("_in", whole & F.coalesce(F.col("_slot") < F.col("_edge"), F.lit(True)))
    return ranked.unionByName(others).drop("_slot", "_target", "_edge", "_rest")


def seeded_take(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in hash order (a top-n per partition and a merge, no full sort)."""
    return rows.orderBy(*order(key, seed)).limit(n)


def take_per(rows: DataFrame, group: str, key: str, k: int, seed: int = 42) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order(key, seed)))
    return rows.withColumn("_n", place).where(F.col("_n") <= k).drop("_n")


def sizes(counts: DataFrame, mode: str, amount: float, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """(category, available) -> target: ``fixed`` k each, ``percentage`` of each (1 at least), ``cap`` shared evenly."""
    kept = counts if include is None else counts.where(F.col("category").isin(include))
    kept = kept if exclude is None else kept.where(~F.col("category").isin(exclude))
    have = F.col("available")
    if mode == "fixed":
        target = F.least(F.lit(int(amount)), have)
    elif mode == "percentage":
        target = F.greatest(F.lit(1), F.floor(have * F.lit(float(amount))))
    elif mode == "cap":
        n = F.count("*").over(Window.partitionBy(F.lit(1)))  # a row for each category
        target = F.least(F.floor(F.lit(int(amount)) / n), have)
    else:
        raise ValueError(f"mode is fixed, percentage or cap, not {mode!r}")
    return kept.withColumn("target", target.cast("long"))


@dataclass(frozen=True)
class Plan:
    """How a sample is drawn: one of ``per_category``, ``percentage`` (of each, over 0 and up to 1) and ``total``; 3 of each category if none is given."""

    per_category: int | None = None
    percentage: float | None = None
    total: int | None = None
    include: tuple[str, ...] | None = None
    exclude: tuple[str, ...] | None = None
    seed: int = 42

    def __post_init__(self) -> None:
        given = [x is not None for x in (self.per_category, self.percentage, self.total)]
        if sum(given) > 1:
            raise ValueError("only one of per_category, percentage and total")
        if self.percentage is not None and not 0 < self.percentage <= 1:
            raise ValueError("percentage is over 0 and at most 1")

    def mode(self) -> tuple[str, float]:
        if self.percentage is not None:
            return "percentage", self.percentage
        return ("cap", self.total) if self.total is not None else ("fixed", 3 if self.per_category is None else self.per_category)


def planned(rows: DataFrame, category: str, key: str, plan: Plan) -> DataFrame:
    """The sample of a plan; a plan that leaves no category is an error."""
    kept = rows if plan.include is None else rows.where(F.col(category).isin(*plan.include))
    kept = kept if plan.exclude is None else kept.where(~F.col(category).isin(*plan.exclude))
    if kept.isEmpty():
        raise ValueError("no rows are left by include and exclude")
    return balanced(kept, category, key, *plan.mode(), plan.seed)


def one_of(rows: DataFrame, column: str, value: str, key: str, seed: int = 42) -> DataFrame:
    """A random row among those with a value (a difficulty, say); an error if there are none."""
    found = seeded_take(rows.where(F.col(column) == value), key, 1, seed)
    if found.isEmpty():
        raise ValueError(f"no row with {column} = {value!r}")
    return found


def balanced(rows: DataFrame, category: str, key: str, mode: str, amount: float, seed: int = 42, **filters) -> DataFrame:
    plan = sizes(rows.groupBy(F.col(category).alias("category")).agg(F.count("*").alias("available")), mode, amount, **filters).select(F.col("category").alias(category), F.col("target").alias("_target"))
    return first_of(rows, category, key, plan, seed).where("_in").drop("_in")


def stratified_split(rows: DataFrame, stratum: str, key: str, n_test: int, seed: int = 42) -> DataFrame:
    """``split`` test or train; test has exactly n_test rows, shared by largest remainder (ties by name)."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(F.lit(1))  # a row for each stratum
    exact = F.col("n") * n_test / F.sum("n").over(whole)
    shares = counts.withColumns({"_q": F.floor(exact), "_f": exact - F.floor(exact)})
    left = F.lit(n_test) - F.sum("_q").over(whole)
    shares = shares.withColumn("_test", F.col("_q") + (F.row_number().over(whole.orderBy(F.desc("_f"), stratum)) <= left).cast("long")).select(stratum, F.col("_test").alias("_target"))
    return first_of(rows, stratum, key, shares, seed).withColumn("split", F.when(F.col("_in"), "test").otherwise("train")).drop("_in")


def positional_split(rows: DataFrame, key: str, seed: int = 42, test: tuple[int, int] = (0, 100), valid: tuple[int, int] = (1000, 2000)) -> DataFrame:
    """Ranges of the hash order as test and valid, the rest from valid's end as train; between them rows are left out.

    Train rows that share a three-part key prefix with test or valid are dropped. The held-out prefix of the order
    is a top-n, so that no task sorts everything.
    """
    head = rows.orderBy(*order(key, seed)).limit(valid[1]).select(key, F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order(key, seed))).alias("_n"))
    at = F.col("_n") - 1
    named = head.withColumn("split", F.when((at >= test[0]) & (at < test[1]), "test").when((at >= valid[0]) & (at < valid[1]), "valid").otherwise("unused"))
    prefix = F.substring_index(F.col(key).cast("string"), "_", 3)
    leaks = named.where("split <> 'unused'").select(prefix.alias("_p")).distinct()
    held = rows.join(F.broadcast(named.where("split <> 'unused'").select(key, "split")), key)  # at most test and valid rows
    train = rows.join(F.broadcast(named.select(key)), key, "left_anti").withColumn("_p", prefix).join(F.broadcast(leaks), "_p", "left_anti").drop("_p").withColumn("split", F.lit("train"))
    return held.select(*rows.columns, "split").unionByName(train)


def chunks(rows: DataFrame, pos: str, n: int) -> DataFrame:
    """``chunk`` 0..n-1 of consecutive rows, the first ones a row longer; positions are 0-based and gapless."""
    total = rows.count()
    size, extra = divmod(total, n)
    edge = extra * (size + 1)
    p = F.col(pos)
    late = F.lit(extra) + F.floor((p - edge) / max(size, 1))
    return rows.withColumn("chunk", F.when(p < edge, F.floor(p / (size + 1))).otherwise(late).cast("int"))


def numbered(rows: DataFrame, *keys: str) -> DataFrame:
    """``pos``: 0-based and gapless in the order of keys, from range partitions and their counts, without one sorting task."""
    spark = rows.sparkSession
    parted = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    parted = staged(parted, "numbered")  # ids and counts are of one and the same partitioning
    part = F.shiftrightunsigned("_id", 33)
    counts = {r.p: r["count"] for r in parted.groupBy(part.alias("p")).count().collect()}  # a row for each partition
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    return parted.withColumn("pos", F.element_at(F.lit(before or [0]), (part + 1).cast("int")) + F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def episode_seed(base: Column, index: Column) -> Column:
    return base + 1000 * index
