import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessella.llm import lm


def corpus(n=300):
    rng = random.Random(6)
    follows = {w: rng.sample("abcdefghijklmnop", 3) for w in "abcdefghijklmnop"}
    rows = []
    for i in range(n):
        w, out = rng.choice("abcdefgh"), []
        for _ in range(rng.randrange(1, 40)):
            out.append(w if rng.random() > 0.05 else f"{w}{i}")
            w = rng.choice(follows[w])
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(out).upper()))
    return rows + [(n, None), (n + 1, ""), (5, "a b c"), (5, "a b c"), (None, "a new word")]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def bucket(n):
    return min(1 + int(math.log2(n)), lm.CONTEXTS - 1) if n else 0


@pytest.mark.parametrize("small", [False, True])
def test_against_plain(spark, monkeypatch, small):
    """With one exchange, and with chunks of some texts whose keys are summed through two levels of bundles."""
    if small:
        for name, value in (("CHUNK", 400), ("BUCKET", 100), ("LEAST_FAN", 4), ("FAN", 4), ("BUNDLE", 300)):
            monkeypatch.setattr(lm, name, value)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int").coalesce(2)
    toks = [[w.decode() for w in (t or "").encode().lower().split()] + ["</s>"] for _, t in rows]
    one, two, ctx = Counter(), Counter(), Counter()
    for (i, _), t in zip(rows, toks, strict=True):
        if not held(i):
            one.update(t)
            two.update(zip(["<s>", *t], t))  # noqa: B905
            ctx.update(["<s>", *t[:-1]])
    n, v = sum(one.values()), len(one)
    counted, n_got, v_got, lam = lm.model(docs)
    assert (n_got, v_got) == (n, v) and np.allclose(lam.sum(1), 1) and (lam[:, 2] > 0).all()

    def p(w, c):
        b = bucket(ctx[c])
        return lam[b][0] * two[c, w] / max(ctx[c], 1) + lam[b][1] * one[w] / n + lam[b][2] / (v + 1)

    assert sum(p(w, "a") for w in one) + lam[bucket(ctx["a"])][2] / (v + 1) == pytest.approx(1)
    want = []
    for (i, _), t in zip(rows, toks, strict=True):
        base = sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want.append((i is None, i or 0, held(i), len(t), sum(one[w] > 0 for w in t), n, base, sum(math.log10(p(w, c)) for c, w in zip(["<s>", *t], t))))  # noqa: B905
    got = sorted((r.doc_id is None, r.doc_id or 0, *tuple(r)[1:]) for r in lm.scored(docs).collect())
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:6] == w[:6] and g[6:] == pytest.approx(w[6:])
    out = [g for g in got if g[2]]
    assert sum(g[7] for g in out) > sum(g[6] for g in out)  # better than the base on held-out documents


def test_long_text(spark):
    """One text of 300,000 words is a chunk of its own and scores as its words do."""
    rows = [(1, "a b " * 150_000), (2, "a b a b c"), (3, None)]
    got = {r.doc_id: r for r in lm.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_tokens == 300_001 and got[2].n_tokens == 6 and got[3].n_tokens == 1
    assert got[1].train_tokens == sum(got[i].n_tokens for i in (1, 2, 3) if not held(i))
    assert got[1].score < 0 and all(np.isfinite(r.score) for r in got.values())


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert lm.scored(docs.limit(0)).count() == 0
    only_held = next(i for i in range(100) if held(i))
    r = lm.scored(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_tokens, r.n_known, r.base_score, r.score) == (0, 3, 0, 0.0, 0.0)


def test_weights_find_the_mixture():
    """Tokens drawn from a known mixture give its weights back."""
    rng = np.random.default_rng(3)
    cells = [((5 << 18) + k, 1.0, *(np.array([0.001, 100.0]) if x < 0.3 else np.array([50.0, 0.001]))) for k, x in enumerate(rng.random(2000))]
    assert lm.weights(cells)[5][1] == pytest.approx(0.3, abs=0.05)
    assert lm.weights([])[3].tolist() == lm.START_WEIGHTS.tolist()


def test_weights_against_exact_ones(spark):
    """The grid's weights beside expectation-maximisation on the deleted tokens one by one."""
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in corpus(600) if i is not None and i != 5]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {r.doc_id for r in docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(lm.DELETED)) == 0).collect()}
    _, _, v, lam = lm.model(docs)
    one, two, ctx, out = Counter(), Counter(), Counter(), []
    for i, text in rows:
        t = [w.decode() for w in (text or "").encode().lower().split()] + ["</s>"]
        pairs = list(zip(["<s>", *t], t))  # noqa: B905
        if held(i):
            continue
        if i in gone:
            out += pairs
        else:
            one.update(t)
            two.update(pairs)
            ctx.update(c for c, _ in pairs)
    n = sum(one.values())
    for b in range(1, lm.CONTEXTS):
        x = np.array([[two[c, w] / ctx[c], one[w] / n, 1 / (v + 1)] for c, w in out if bucket(ctx[c]) == b])
        if len(x) < 100:
            continue
        exact = lm.START_WEIGHTS
        for _ in range(lm.ROUNDS):
            part = x * exact
            exact = (part / part.sum(1, keepdims=True)).mean(0)
        assert np.abs(lam[b] - exact).max() < 0.02


def test_rows_grow_with_the_input(spark, monkeypatch):
    """Four times the text: four times the rows sent, about, at either level."""
    for name, value in (("CHUNK", 2000), ("BUCKET", 500), ("LEAST_FAN", 8), ("FAN", 8), ("BUNDLE", 2000)):
        monkeypatch.setattr(lm, name, value)
    sent = []
    for n in (400, 1600):
        docs = spark.createDataFrame([(i, t) for i, t in corpus(n)], "doc_id long, text string").coalesce(1)
        chunks = lm.chunked(docs).cache()
        requests = lm.asked(chunks, lm.FAN)
        size = sum(r.bytes for r in chunks.collect())
        answers, paths = lm.answered(requests, size, lm.FAN)
        sent.append((requests.count(), answers.where("unit >= 0").count(), chunks.count()))
        assert paths and sent[-1][0] == sent[-1][1] <= 2 * lm.FAN * sent[-1][2]
    assert 3 < sent[1][0] / sent[0][0] < 5
