import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import common, voronoi

SCHEMA = "vec_id long, embedding array<double>, label int, score int, _row int, dim string"


def plain(rows, every, positives=5, negatives=10):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    good = [(i, [int(np.floor(256.0 * x)) for x in v], label) for i, v, label in rows if i is not None and label is not None and ok(v)]
    out = []
    for a, (q, v, label) in enumerate(good):
        if q % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, m) for m, (i, w, _) in enumerate(good) if m != a and len(w) == len(v))
        for s, p, _ in [x for x in scores if good[x[2]][2] == label][:positives]:
            fit = [x for x in scores if good[x[2]][2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives]
            out += [(q, p, r + 1, i, -s, -t) for r, (t, i, _) in enumerate(fit)]
    return sorted(out)


def clustered(seed, n, dim, centres, spread=0.3):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    own = rng.integers(0, centres, n)
    x = c[own] + rng.normal(size=(n, dim)) * spread
    return [(i, v.tolist(), int(o) % 5) for i, (v, o) in enumerate(zip(x, own, strict=True))]


@pytest.mark.parametrize("group, part, bounds", [(4096, 65_536, 65_536), (3, 40, 65_536), (3, 40, 2)])
def test_against_all_pairs(spark, monkeypatch, group, part, bounds):
    """One group and many, of one part and several, with bounds by label and without; odd rows, ties, repeats and clashing names."""
    for name, value in (("GROUP", group), ("PART", part), ("SMALL", 16), ("BOUNDS", bounds)):
        monkeypatch.setattr(voronoi, name, value)
    rows = clustered(1, 400, 6, 8)
    rows += [(i, [0.5] * 6, i % 2) for i in range(400, 440)] + [(0, [0.1] * 6, 1), (0, [0.1] * 6, 1), (10, [2.0, 0.0] * 3, 77), (10, [2.0, 0.0] * 3, 77)]
    rows += [(500, None, 1), (500, [1.0] * 6, None), (510, [1.0, None] * 3, 1), (520, [float("nan")] * 6, 2), (530, [float("inf")] * 6, 2), (None, [1.0] * 6, 1)]
    rows += [(600, [1.0, 2.0], 1), (601, [3.0, 1.0], 1), (602, [0.9, 1.0], 2), (700, [], 1), (701, [], 1), (702, [], 2), (800, [-1.0] * 7, 3), (801, [1.0] * 7, 3), (802, [1.0] * 7, 4)]
    frame = spark.createDataFrame([(*r, 9, 1, "d") for r in rows], SCHEMA)
    out = voronoi.mined(frame, F.col("vec_id") % 10 == 0)
    assert out.columns == [c.split()[0] for c in voronoi.MINED.split(", ")]
    assert sorted(map(tuple, out.collect())) == plain(rows, 10)
    assert voronoi.mined(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert voronoi.mined(frame, F.lit(None).cast("boolean")).count() == 0


def test_bounds_keep_candidates_at_home(spark, monkeypatch):
    """Clusters far apart: in the second pass few candidates are sent to a group, and the results are still those of all pairs."""
    monkeypatch.setattr(voronoi, "GROUP", 8)
    rows = clustered(3, 3000, 8, 30, 0.02)
    frame = spark.createDataFrame([(*r, 9, 1, "d") for r in rows], SCHEMA)
    asked = F.col("vec_id") % 50 == 0
    passes = []
    inner = voronoi.sent
    monkeypatch.setattr(voronoi, "sent", lambda r, known: passes.append((inner(r, known).count(), sum(len(s.parts) for s in known.values()))) or inner(r, known))
    assert sorted(map(tuple, voronoi.mined(frame, asked).collect())) == plain(rows, 50)
    (first, groups), (second, _), (third, _), (last, _) = passes
    assert first == third == 3000 and groups >= 6
    assert second < 3000 * groups / 3 and last < 3000 * groups


def test_products_of_the_tables(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label")
    rows = [(r.vec_id, r.embedding, r.label) for r in vectors.collect()]
    before = set(common.live)
    assert sorted(map(tuple, voronoi.mined(vectors, F.col("vec_id") % 100 == 0).collect())) == plain(rows, 100)
    assert len(common.live - before) <= 4  # what the result reads
