import hashlib
import random
import re
import zlib

import numpy as np

from tessella.llm import periods


def plain_runs(w):
    """All runs by the definition: smallest periods by trying them all."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            x = w[i : e + q]
            if len(x) >= max(12, 2 * q) and not any(all(x[k] == x[k + d] for k in range(len(x) - d)) for d in range(1, q)):
                out.append((i, len(x), q))
            i = e
    return sorted(out)


def words_of(rng):
    kind = rng.randrange(6)
    w = [rng.randrange(rng.choice([1, 2, 3, 40])) for _ in range(rng.randrange(0, 130))]
    if kind == 1:
        w = (w[:40] or [1]) * rng.randrange(1, 5) + [9] * rng.randrange(20)
    if kind == 2:
        w = [x for x in w[:9] for _ in range(rng.randrange(1, 15))] * 2
    if kind == 3 and len(w) > 20:
        w = w[:10] + (w[10:15] * 9)[: rng.randrange(12, 45)] + w[15:]
    if kind == 4:
        a, b = [0], [0, 1]
        while len(b) < 100:
            a, b = b, b + a
        w = b
    if kind == 5:
        w = [7] * rng.randrange(60) + [3] + [7] * rng.randrange(60)
    return w


def test_runs_are_those_of_the_definition():
    rng = random.Random(5)
    for _ in range(600):
        w = words_of(rng)
        assert periods.runs(np.array(w, np.int64)) == plain_runs(w), w


def test_far_lags_with_every_near_limit(monkeypatch):
    monkeypatch.setattr(periods, "NEAR", 1)
    rng = random.Random(6)
    for _ in range(300):
        w = words_of(rng)
        assert periods.runs(np.array(w, np.int64)) == plain_runs(w), w


def test_lag_counts():
    """Heavy words (by transform), light ones (by pairs), and both."""
    rng = np.random.default_rng(7)
    for n, k in ((1, 1), (2, 1), (400, 400), (3000, 2), (3000, 30), (4096, 1)):
        w = rng.zipf(1.5, n) % k
        got = periods.lag_matches(w)
        assert got.tolist() == [0] + [int((w[q:] == w[:-q]).sum()) for q in range(1, n // 2 + 1)]


def plain_row(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w[i] for i in range(n) if i not in gone)))


def test_query(spark, tmp_path):
    rng = random.Random(8)
    words = ["a", "b b", "été", "x y", "\x1c", "z"]
    texts = [rng.choice([" ", "\t\n ", "\x0b"]).join(rng.choice(words[: rng.randrange(1, 7)]) for _ in range(rng.randrange(90))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a " * 30), (900, None), (901, ""), (903, "a " * 15 + "b c " * 9), (902, " \t"), (902, "one"), (7, "a b " * 9), (7, "a b " * 9)]
    rows += [(i, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2) for i in range(1000, 1060)]
    spark.createDataFrame([(*r, 1, "r", "c") for r in rows], "doc_id long, text string, n_chars long, runs string, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    out = periods.op13_periods(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for c, t in out.dtypes if "sha" not in c} == {"bigint"}
    assert sorted(map(tuple, out.collect()), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert any(r[1] > 1 for r in out.collect())


def test_empty_table_and_long_texts(spark):
    frame = spark.createDataFrame([(1, "a " * 300_000, 1), (2, " ".join(str(i % 70_001) for i in range(300_000)), 2)], "doc_id long, text string, runs int")
    got = {r.doc_id: r for r in periods.collapsed(frame).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 300_000, 1)] and got[1].collapsed == "a"
    assert [tuple(x) for x in got[2].runs] == [(0, 300_000, 70_001)] and len(got[2].collapsed.split()) == 70_001
    assert periods.collapsed(frame.limit(0)).count() == 0
