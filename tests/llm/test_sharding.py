import hashlib
import math
import zlib
from collections import defaultdict

from tessella.llm import sharding


def plain(key, weights):
    def score(s):
        u = (int(hashlib.md5(f"{s}/{key}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        return -weights[s] / math.log(u)

    return max((s for s in range(len(weights)) if weights[s] > 0), key=lambda s: (score(s), -s))


def test_query(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(5, "text 5"), (5, None), (None, ""), (None, "é")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int")
    got = sharding.sharded(docs, [1.0] * 8, buckets=16, parts=3).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard, r.law) == (plain(key, [1.0] * 8), plain(key, [1.0] * 9), "key")
        assert r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert sharding.sharded(docs.limit(0), [1.0] * 8).count() == 0


def test_weights(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'x' AS text")
    n = {r.shard: r["count"] for r in sharding.sharded(docs, [1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(n) == {0, 1} and 0.2 < n[0] / 4000 < 0.3


def test_many_rows_of_one_id_and_long_texts(spark):
    """A third of the rows have no id: they are numbered in many parts, and a very long text is hashed whole."""
    rows = [(None, f"text {i}") for i in range(2000)] + [(i, "same") for i in range(4000)] + [(9, "x" * 3_000_000 + "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.sharded(docs, [1.0] * 8)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    got = out.collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    long = max(got, key=lambda r: r.size)
    assert long.size == 3_000_003 and long.text_crc32 == zlib.crc32(("x" * 3_000_000 + "é").encode())
