"""Tables that are upserted by key: rows lie in buckets by the key's hash, and an upsert writes only the buckets that new keys fall in.

A version is a manifest that names a folder for each bucket. Readers see the version they began with; a writer whose version another one
took begins anew. Folders of no recent version are removed by ``vacuum``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.staging import discarded, staged
from . import manifest

#: Times that an upsert begins anew when others commit before it.
TRIES = 5


def current(spark: SparkSession, path: str) -> tuple[int, dict] | None:
    found = manifest.numbers(spark, path)
    return (found[-1], manifest.read(spark, path, found[-1])) if found else None


def bucket(key: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")


def rows_of(spark: SparkSession, path: str, content: dict, only: set[int] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(content["schema"])
    places = [f"{path}/{at}" for b, at in sorted(content["files"].items()) if only is None or int(b) in only]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema: str | None = None, key: dict | None = None) -> DataFrame:
    """The table as it is now; without one, an empty table of ``schema``. ``key``: values of all key columns, to read their bucket only."""
    found = current(spark, path)
    if found is None:
        if schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    content = found[1]
    if key is None:
        return rows_of(spark, path, content)
    kinds = T.StructType.fromJson(content["schema"])
    one = spark.range(1).select(bucket([F.lit(key[k]).cast(kinds[k].dataType) for k in content["key"]], content["buckets"]).alias("b")).first().b
    out = rows_of(spark, path, content, {one})
    for k in content["key"]:
        out = out.where(F.col(k).eqNullSafe(F.lit(key[k])))
    return out


def upsert(spark: SparkSession, path: str, new: DataFrame, key: list[str], newest: str | None = None, buckets: int = 64) -> int:
    """Puts the rows of ``new`` in, in the place of those with their keys; returns the version, or the present one if there are no new rows.

    Of new rows with one key the one with the largest ``newest`` stays (without it, or of equals, the one with the largest hash). Null keys are keys. The table's columns are those
    of the first upsert; later ones are cast to them, missing ones null. ``buckets`` counts when the table is made; choose them so that a bucket fits a task.
    """
    for _ in range(TRIES):
        found = current(spark, path)
        version, content = found or (0, {"buckets": buckets, "key": key, "schema": new.schema.jsonValue(), "files": {}})
        schema, key, n = T.StructType.fromJson(content["schema"]), content["key"], content["buckets"]
        shaped = new.select(*[(F.col(f"`{f.name}`") if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        everything = F.struct(*[F.col(f"`{f.name}`") for f in schema])
        order = F.struct(*([F.col(newest)] if newest else []), F.xxhash64(*[F.col(f"`{f.name}`") for f in schema]))
        last = shaped.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]).agg(F.max_by(everything, order).alias("_r")).select("_r.*")
        placed = staged(last.withColumn("_bucket", bucket(key, n)), "upsert")
        touched = {r._bucket for r in placed.select("_bucket").distinct().collect()}  # at most ``buckets`` rows
        if not touched:
            discarded(placed)
            return version
        old, keys = rows_of(spark, path, content, touched), placed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
        same = [old[k].eqNullSafe(keys[f"_k{i}"]) for i, k in enumerate(key)]
        whole = old.join(keys, same, "left_anti").withColumn("_bucket", bucket(key, n)).unionByName(placed)
        at = f"data/{version + 1:012d}-{uuid.uuid4().hex}"
        whole.repartition(len(touched), "_bucket").write.partitionBy("_bucket").parquet(f"{path}/{at}")
        discarded(placed)
        files = content["files"] | {str(b): f"{at}/_bucket={b}" for b in touched}
        if manifest.commit(spark, path, version + 1, content | {"files": files}):
            return version + 1
    raise RuntimeError(f"{path}: others committed first, {TRIES} times")


def clear(spark: SparkSession, path: str) -> int:
    """Empties the table; earlier versions stay readable until they are vacuumed."""
    for _ in range(TRIES):
        found = current(spark, path)
        if found is None:
            return 0
        if manifest.commit(spark, path, found[0] + 1, found[1] | {"files": {}}):
            return found[0] + 1
    raise RuntimeError(f"{path}: others committed first, {TRIES} times")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes the buckets that none of the last ``keep`` versions names, and older manifests; returns how many. Not while an upsert runs: its files have no manifest yet."""
    versions = manifest.numbers(spark, path)
    named = {at for v in versions[-keep:] for at in manifest.read(spark, path, v)["files"].values()}
    top, files = manifest.opened(spark, f"{path}/data")
    gone = 0
    for each in files.listStatus(top) if files.exists(top) else []:
        for part in files.listStatus(each.getPath()):
            name = f"data/{each.getPath().getName()}/{part.getPath().getName()}"
            if part.isDirectory() and name not in named:
                files.delete(part.getPath(), True)
                gone += 1
    for v in versions[:-keep]:
        files.delete(manifest.opened(spark, f"{path}/_manifests/{v:012d}.json")[0], False)
    return gone


def answered(requests: DataFrame, path: str, call: Callable[[DataFrame], DataFrame], cache: str) -> DataFrame:
    """Requests (cache_key, ...) with ``response``: from the cache at ``path``, or by ``call``, which adds response and error; its answers are put into the cache before they are used.

    An empty cached response is a miss, a failed call is not kept. Requests with one key are called once.
    """
    spark = requests.sparkSession
    known = read(spark, path, cache).where(F.length("response") > 0).select("cache_key", "response")
    missing = requests.dropDuplicates(["cache_key"]).join(known, "cache_key", "left_anti")
    made = call(missing).where("error IS NULL AND length(response) > 0").withColumn("created_at", F.unix_timestamp().cast("double"))
    names = T.StructType.fromDDL(cache).names
    upsert(spark, path, made.select(*[F.col(c) if c in made.columns else F.lit(None).alias(c) for c in names]), ["cache_key"], "created_at")
    return requests.join(read(spark, path).select("cache_key", "response"), "cache_key", "left")
