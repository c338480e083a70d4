import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import topk


def plain(rows, every, k):
    out = []
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    ints = lambda v: [int(np.floor(1024.0 * x)) for x in v]
    good = [(i, ints(v)) for i, v in rows if i is not None and ok(v)]
    for n, (q, v) in enumerate(good):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for m, (i, w) in enumerate(good) if m != n and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("target, part", [(4096, 16_384), (16, 10)])
def test_small(spark, monkeypatch, target, part):
    """With one annulus a cell, and with many of several parts."""
    monkeypatch.setattr(topk, "TARGET", target)
    monkeypatch.setattr(topk, "PART", part)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 340)] + [(400, None), (401, [1.0, None] * 4), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (500, [1.0, 2.0]), (501, [3.0, -1.0]), (0, [0.1] * 8), (0, [0.1] * 8), (None, [1.0] * 8), (600, []), (601, [])]
    frame = spark.createDataFrame([(*r, 9, 1) for r in rows], "vec_id long, embedding array<double>, score int, _row int")
    out, tally = topk.best(frame, F.col("vec_id") % 50 == 0, 7)
    assert sorted(map(tuple, out.collect())) == plain(rows, 50, 7)
    assert 0 < tally["visited"] <= tally["pairs"]
    assert topk.best(frame.limit(0), F.col("vec_id") % 50 == 0)[0].count() == 0
    assert topk.best(frame, F.lit(None).cast("boolean"))[0].count() == 0


def test_stops_early(spark, monkeypatch):
    """Clustered vectors: few annuli of many are visited, and the results are those of the plain product."""
    monkeypatch.setattr(topk, "TARGET", 256)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = np.floor((centres[rng.integers(0, 40, 10000)] + rng.normal(size=(10000, 16)) * 0.02) * 1024) / 1024
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out, tally = topk.best(frame, F.col("vec_id") % 500 == 0)
    assert tally["visited"] < tally["pairs"] / 2
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    for q, found in got.items():
        s = (np.floor(x * 1024) @ np.floor(x[q] * 1024)).astype(int)
        want = sorted((-int(s[i]), i) for i in range(10000) if i != q)[:10]
        assert sorted(found) == want
    assert len(got) == 20


def test_few_vectors_are_indexed_too(spark):
    """2,000 vectors in clusters, with the production parameters: most annuli are never visited, and vectors that aren't are not shuffled."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(25, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(centres[rng.integers(0, 25, 2000)] + rng.normal(size=(2000, 16)) * 0.02)]
    out, tally = topk.best(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, out.collect())) == plain(rows, 100, 10)
    assert tally["pairs"] >= 20 * 20 and tally["visited"] < tally["pairs"] / 3


def test_large_numbers():
    q, x = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**30, 0.0]])
    assert topk.products(q, x).tolist() == [[2**60 + 3, 2**63 - 1]]


def test_long_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=5000).tolist()) for i in range(30)]
    out, _ = topk.best(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 3)
    assert sorted(map(tuple, out.collect())) == plain(rows, 50, 3)
