"""Numbered manifests of a folder: small JSON files that are whole before they can be seen, and never replaced.

What a manifest names exists for readers; files that none names, as those of a job that died, don't.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def opened(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the manifests, ascending."""
    target, files = opened(spark, f"{folder}/_manifests")
    names = [f.getPath().getName() for f in files.listStatus(target)] if files.exists(target) else []
    return sorted(int(n[:-5]) for n in names if n.endswith(".json"))


def read(spark: SparkSession, folder: str, number: int) -> dict:
    target, files = opened(spark, f"{folder}/_manifests/{number:012d}.json")
    stream = files.open(target)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Puts the manifest in place; False if there is one of this number, which then stays."""
    jvm = spark.sparkContext._jvm
    draft, files = opened(spark, f"{folder}/_manifests/_draft-{uuid.uuid4().hex}")
    target, _ = opened(spark, f"{folder}/_manifests/{number:012d}.json")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(content).encode("utf-8")))
    stream.close()
    # A rename that refuses to replace: of two writers of a number one wins.
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    nothing = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs.Options, "Rename"), 0)
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(target), nothing)
    except Exception:
        files.delete(draft, False)
        if files.exists(target):
            return False
        raise
    return True
