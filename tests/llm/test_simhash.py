import random

import numpy as np
import pytest
import xxhash

from tessella.llm import simhash


def plain(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(fps, radius=2):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def ball(rng, n, spread):
    out = set()
    for _ in range(n // 40 or 1):
        x = rng.getrandbits(64)
        for _ in range(40):
            out.add(x)
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(spread)))
    return sorted(out)


def test_fingerprint(spark):
    for text in (None, "", " \n", "One", "a b", "A b C", "a b c d É", "x " * 10000, "w z " * 3):
        assert simhash.fingerprint(text) == plain(text)
    assert spark.sql("SELECT xxhash64('a b c') AS h").first().h == simhash.signed(xxhash.xxh64_intdigest("a b c", 42))


def test_coordinates(spark):
    """Each bit of a fingerprint changes one coordinate by one, and the table holds distances."""
    rng = random.Random(6)
    middle, neighbours, spread = simhash.references()
    x = rng.getrandbits(64)
    near = [x] + [x ^ 1 << b for b in range(64)]
    rows = simhash.tabled(spark.createDataFrame([(simhash.signed(f),) for f in near], "fp long"), 2).collect()
    groups = {r.fp: r.groups for r in rows}
    for f in near[1:]:
        assert sum(a != b for a, b in zip(groups[simhash.signed(x)], groups[simhash.signed(f)], strict=True)) == 1
    for r in rows:
        f = r.fp % 2**64
        assert list(r.near.to_bytes(8, "little") + r.far.to_bytes(8, "little")) == [(f ^ p).bit_count() for p in spread]
        turned = [((f ^ n).bit_count() - (f ^ middle).bit_count()) // 2 + 1 for n in neighbours]
        assert sorted(r.groups) == sorted(sum(c * 3**k for k, c in enumerate(turned[32 * i // 6 : 32 * (i + 1) // 6])) for i in range(6))


@pytest.mark.parametrize("most, radius", [(4096, 2), (4, 2), (4, 0), (16, 4)])
def test_links_and_components(spark, monkeypatch, most, radius):
    """Against all pairs; cells of more than ``most`` go through finer cells, and what stays crowded is compared in place."""
    rng = random.Random(4)
    fps = ball(rng, 600, 4)
    low = rng.getrandbits(64)
    fps = sorted({*fps, *(low ^ i for i in range(200)), *(low ^ (i << 20) ^ (1 << 50) for i in range(100))})
    monkeypatch.setattr(simhash, "MOST", 50)
    table = simhash.tabled(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long"), radius)
    edges, paths, tally = simhash.links(table, radius, most)
    assert len(paths) == (1 if most == 4096 else len(paths)) and tally[0] >= tally[1] >= tally[2] > 0 or radius == 0
    roots, _ = simhash.components(edges)
    got = {r.node: r.root for r in roots.collect()}
    want, by = closure(fps, radius), {}
    for x, c in zip(fps, want, strict=True):
        by.setdefault(c, []).append(simhash.signed(x))
    assert {x: min(g) for g in by.values() if len(g) > 1 for x in g} == got


def test_random_pairs_are_discarded():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 2**63, 3000).astype(np.uint64)
    _, _, spread = simhash.references()
    table = np.bitwise_count(fps[:, None] ^ np.array(spread, np.uint64)).astype(np.uint8)
    order = np.lexsort((fps, table[:, 0]))
    packed = np.ascontiguousarray(table[order]).view(np.int64)
    rows = np.column_stack([np.zeros((3000, 2), np.int64), fps[order].view(np.int64), packed, np.ones(3000, np.int64)])
    tally = np.zeros(3, np.int64)
    assert sum(len(i) for i, _ in simhash.pairs(rows, 2, tally)) == 0
    assert tally[0] > 500_000 and tally[1] < 50


def test_query(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [(3, base), (9, base + " end"), (7, base.upper()), (1, None), (2, ""), (4, "quite other words here"), (4, "quite other words here"), (None, base), (None, "lonely row with no id")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "5 AS fp", "6 AS component_id")
    got = simhash.grouped(docs).collect()
    fps = [plain(t) for _, t in texts]
    label = closure(fps)
    want = []
    for (i, _), f, c in zip(texts, fps, label, strict=True):
        ids = [k for (k, _), d in zip(texts, label, strict=True) if d == c and k is not None]
        want.append((i, f"{f:016x}", min(ids, default=None)))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.grouped(docs.limit(0)).count() == 0
