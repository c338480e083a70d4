import random
from itertools import combinations

import corpus_pipeline
import numpy as np

from tessella.llm import shingles, simhash


def plain(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def edited(rng, words, k):
    words = list(words)
    for i in rng.sample(range(len(words)), k):
        words[i] = f"x{rng.randrange(10**9)}"
    return " ".join(words)


def test_links_against_brute_force(spark):
    """All and only the pairs of 4/5 or more in components: few and many under a shingle, shared passages, short texts."""
    rng, texts = random.Random(5), ["", None, "one", "ONE", "a b c d", "a b c d e", "a b c d e f"]
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(rng.randrange(60, 200))]
        texts += [edited(rng, base, k) for k in (1, 2, 3, 4, 5, 6, 8)]
    hot = [f"h{i}" for i in range(150)]
    texts += [edited(rng, hot, rng.randrange(1, 5)) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [passage + " " + " ".join(f"q{rng.randrange(10**9)}" for _ in range(rng.randrange(3, 60))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in shingles.grouped(docs).collect()}
    sets, label = [plain(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert got == dict(enumerate(label))
    assert 20 < len(set(label)) < len(texts) - 20
    assert shingles.grouped(docs.limit(0)).count() == 0


def test_crowded_shingles(spark, monkeypatch):
    """With counts that are held to three and no sample, the components are the same; bitmaps never differ in more than the sets do."""
    import numpy as np

    rng = random.Random(8)
    base = [f"b{i}" for i in range(90)]
    texts = [edited(rng, base, rng.randrange(1, 12)) for _ in range(60)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = {r.doc_id: r.component_id for r in shingles.grouped(docs).collect()}
    monkeypatch.setattr(shingles, "MANY", 3)
    monkeypatch.setattr(shingles, "repeats", lambda docs: (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    assert {r.doc_id: r.component_id for r in shingles.grouped(docs).collect()} == want
    sets, label = [plain(t) for t in texts], list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
            label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert want == dict(enumerate(label))
    for a, b in combinations([shingles.shingles(t) for t in texts[:20]], 2):
        x, y = (int.from_bytes(shingles.parity(v), "big") for v in (a, b))
        assert (x ^ y).bit_count() <= len(np.setxor1d(a, b))


def test_second_round(spark):
    """Every centre's sets but one pair apart: what centres leave is compared in full."""
    common_part, rng = [f"c{i}" for i in range(12)], random.Random(6)
    rows = [(i, " ".join(common_part + [f"u{rng.randrange(10**9)}" for _ in range(40)])) for i in range(60)]
    rows += [(100, rows[7][1] + " end"), (101, rows[30][1] + " end"), (102, rows[51][1] + " end")]
    got = {r.doc_id: r.component_id for r in shingles.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: c for k, c in got.items() if k != c} == {100: 7, 101: 30, 102: 51}


def test_pipeline_drops_planted_near_copies(spark):
    """Near copies of 0.8 and more go though their fingerprints differ in over two bits; one below 0.8 stays."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(200)]
    copies = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in (50, 100, 150)]
    copies += [edited(rng, base, 3)]
    below = edited(rng, base, 30)
    rows = [(1, " ".join(base)), *[(10 + i, t) for i, t in enumerate(copies)], (20, below)]
    bits = [(simhash.fingerprint(t) ^ simhash.fingerprint(rows[0][1])).bit_count() for t in copies]
    assert max(bits) > 2
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == [1, 20]


def test_rows_that_repeat_an_id(spark):
    """A text that shares its id with a copy of another document stays; the copy goes."""
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(60)) for k in "abcd")
    rows = [(1, a), (5, a), (5, b), (5, b), (6, c), (6, d)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (5, b), (6, c), (6, d)]


def test_very_long_texts(spark):
    """120,000 words with few and with many edits, near the similarity itself: of n shingles an edit of one word takes five."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120_000)]
    n = len(base) - 4
    most = n // 45  # 5 k shingles differ on either side: (n - 5 k) / (n + 5 k) is 4/5 at k = n / 45
    texts = [" ".join(base), edited(rng, base, 10), " ".join(base[: -most * 10]), " ".join(base[:60_000])]
    docs = spark.createDataFrame([(*r, "x") for r in enumerate(texts)], "doc_id long, text string, component_id string")
    got = {r.doc_id: r.component_id for r in shingles.grouped(docs).collect()}
    sets = [plain(t) for t in texts]
    near = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])
    assert [near(0, 1), near(0, 2), near(0, 3)] == [True, False, False]
    assert got == {0: 0, 1: 0, 2: 2, 3: 3}


def test_a_pair_is_made_once_for_a_run_of_shared_shingles():
    """Of sets that share all of their prefixes only the first shingle makes their pairs; one that follows other shingles makes them again."""
    sig, n, place, root = np.arange(4), np.full(4, 50), np.full(4, 3), np.arange(4)
    bits = np.zeros((4, 8), np.uint64)
    made = lambda before, full: sum(len(i) for i, _ in shingles.pairs_of(1, sig, n, place, root, bits, full, np.array(before)))
    for full in (False, True):
        assert made([[100 + k, 200 + k] for k in range(4)], full) == 6
        assert made([[7, 8]] * 4, full) == 0
        assert made([[7, 100], [101, 7], [102, 103], [104, 105]], full) == 5
