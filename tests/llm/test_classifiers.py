import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessella.llm import common, quality, toxicity


def corpus(spark, n=600):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice(["ba", "to", "ri", "se", "nu", "lo"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        bad, junk = i % 5 == 1, i % 7 == 2
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "moron,", "worthless"]))
        if junk:
            words = [w + rng.choice(["%%%", "$$$"]) for w in words]
        docs.append((i, " ".join(words), "x", 0.0))
        labels.append((i, int(not junk), int(bad)))
    docs += [(n, None, "x", 0.0), (n + 1, "", "x", 0.0), (None, "idiot " * 4, None, 0.0), (3, docs[3][1], "x", 0.0)]
    labels += [(None, 1, 1), (7, None, None), (8, 1, int(8 % 5 == 1)), (n + 50, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module, wanted, threshold", [(quality, lambda i: int(i % 7 != 2), 0.3), (toxicity, lambda i: int(i % 5 == 1), 0.5)])
def test_held_out(spark, module, wanted, threshold):
    docs, labels = corpus(spark)
    got = module.classified(docs, labels).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    known = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted == wanted(r.doc_id) for r in known]) > 0.95
    kept = module.accepted(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert module.classified(docs.limit(0), labels).count() == 0
    assert {r.score for r in module.classified(docs, labels.limit(0)).collect()} == {0.5 if module is quality else 0.0}


def test_isotonic():
    x, y = np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])
    assert np.interp(x, *common.isotonic(x, y, np.ones(4))).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_tree_of_sums(spark):
    x = np.random.default_rng(2).normal(size=(400, quality.N_STATS))
    y = np.arange(400.0)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(90)
    of = lambda x, y: np.concatenate([(x.T @ x).ravel(), x.T @ y])
    got = quality.summed(rows, of)
    assert np.allclose(got, of(x, y)) and (got == quality.summed(rows, of)).all()
    assert quality.summed(rows.limit(0), of) is None


@pytest.mark.parametrize("bits", [2, 16])
def test_sample_takes_the_first_of_each_class(spark, monkeypatch, bits):
    from pyspark.sql import functions as F

    for name, value in (("MOST_TOXIC", 30), ("MOST_ORDINARY", 10_000), ("SLOT_BITS", bits)):
        monkeypatch.setattr(toxicity, name, value)
    docs, labels = corpus(spark)
    rows, _ = toxicity.sample(docs.dropDuplicates(["doc_id"]), labels, "toxic")
    known = quality.means(labels, "toxic").withColumn("h", F.xxhash64("doc_id")).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = sorted((r.h, r.doc_id) for r in known if r.y >= 0.5)[:30]
    want = [texts[i] for _, i in first] + [texts[r.doc_id] for r in known if r.y < 0.5]
    assert sorted(r.text for r in rows.collect()) == sorted(t for t in want if t is not None)


def test_windows():
    assert toxicity.windows(b"").tolist() == toxicity.windows(b" \n\t").tolist() == []
    assert toxicity.windows(b" a bb", 3, 2).tolist() == [[1, 4]]
    data = b"w0 w1\nw2  w3 w4 w5 w6 "
    assert [data[a : a + n] for a, n in toxicity.windows(data, 3, 2).tolist()] == [b"w0 w1\nw2", b"w2  w3 w4", b"w4 w5 w6"]
    assert [data[a : a + n] for a, n in toxicity.windows(data, 4, 2).tolist()] == [b"w0 w1\nw2  w3", b"w2  w3 w4 w5", b"w3 w4 w5 w6"]


def test_gains_by_plain_windows():
    """Grouped texts against one compression for each window by each dictionary; a text of 400,000 words among them."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "idiot,", "Of", "\u00e9t\u00e9"]) for _ in range(n))
    texts = [text(n) for n in (0, 1, 5, 23, 24, 25, 300, 400_000, 60)] + [None, " \n", "x" * 300_000]
    own = toxicity.Scorer(b"some idiot, and moron there", b"alpha beta gamma delta " * 20)
    data = toxicity.prepared(pa.array(texts))
    assert data[9] == b"" and data[3] == texts[3].lower().encode()
    for raw, (spans, gain) in zip(data, own.gains(data), strict=True):
        words = raw.split()
        starts = [*range(0, max(0, len(words) - 24), 12), max(0, len(words) - 24)] if words else []
        assert [raw[a : a + n].split() for a, n in spans.tolist()] == [words[i : i + 24] for i in starts]
        plain = [raw[a : a + n] for a, n in spans.tolist()] if len(spans) != 1 else [own.carrier + raw]
        assert gain.tolist() == [len(own.by[0].compress(w)) - len(own.by[1].compress(w)) for w in plain]
    x = own.features(pa.array(texts))
    assert x[0].tolist() == x[9].tolist() == [1, 0, 0, 0, 0] and (x[:, 2] >= x[:, 1]).all()


def test_logistic():
    x = np.column_stack([np.ones(200), np.random.default_rng(1).normal(5, 3, 200)])
    y = (x[:, 1] + np.random.default_rng(2).normal(0, 1, 200) > 5).astype(float)
    beta = toxicity.logistic(x, y, np.ones(200))
    p = toxicity.sigmoid(x @ beta)
    assert abs((y - p).sum()) < 0.1 and 4 < -beta[0] / beta[1] < 6


def test_quality_against_plain_formulas(spark):
    """Features, ridge weights, calibration and scores of a small table, by whole-matrix formulas; null, empty and very long texts score too."""
    import zlib

    from pyspark.sql import functions as F

    docs, labels = corpus(spark)
    docs = docs.unionByName(spark.createDataFrame([(700, "long word " * 200_000, "x", 0.0), (701, "x" * 1_000_000, "x", 0.0)], docs.schema))
    rows = docs.where("doc_id IS NOT NULL AND doc_id < 600").withColumn("aside", F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0).collect()
    known = [(quality.statistics(r.text), float(r.doc_id % 7 != 2), r.aside) for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5]
    x, y, aside = np.array([k[0] for k in known]), np.array([k[1] for k in known]), np.array([k[2] for k in known])
    rng = np.random.default_rng(1)
    z = lambda v: np.clip((v - x.mean(0)) / np.sqrt(np.maximum(x.var(0), 1e-6)), -8, 8)
    frequency, phase = rng.normal(size=(quality.N_STATS, quality.FEATURES)) / np.sqrt(quality.N_STATS), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    phi = lambda v: np.hstack([np.ones((len(v), 1)), z(v), np.sqrt(2 / quality.FEATURES) * np.cos(z(v) @ frequency + phase)])
    a = phi(x[~aside])
    weight = np.linalg.solve(a.T @ a + quality.RIDGE * np.eye(a.shape[1]), a.T @ y[~aside])
    raw = np.round(np.clip(phi(x[aside]) @ weight, -1, 2) * quality.BINS) / quality.BINS
    # The best monotone step function, by the minimum over ends of the maximum over starts of means.
    order = np.unique(raw)
    fits = [min(max(y[aside][(raw >= lo) & (raw <= hi)].mean() for lo in order[order <= v]) for hi in order[order >= v]) for v in order]
    got = {(r.doc_id, r.held_out): r.score for r in quality.classified(docs, labels).collect()}
    for r in docs.collect():
        s = phi(quality.statistics(r.text)[None])[0] @ weight
        held = zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0
        assert got[r.doc_id, held] == pytest.approx(np.clip(np.interp(s, order, fits), 0, 1), abs=1e-6)
