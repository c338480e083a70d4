import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm import packing

TEXTS = ["", " ", "Hello the World! don't <|endoftext|> \t x", "ÄÖ ñ  é\n\n日本 12 345", "a\x1cb　c \x85 ", "the cat " * 9000]


def plain(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(packing.vocabulary()).encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("text", TEXTS)
def test_ids(text):
    (ids,) = packing.Words(packing.vocabulary(), 2).ids([text])
    assert np.frombuffer(ids, "<u4").tolist() == plain(text)


def test_ids_of_mixed_texts():
    """Random strings of letters, signs, marks, blanks and added tokens, against the tokenizer on whole texts."""
    rng, words = random.Random(5), packing.Words(packing.vocabulary(), 2)
    signs = "aBsS'tLlD.,!?$%<|> \n\t0\u0661\u00b2\u00e9\u00c9e\u0301\u0300\u0130I\u0131\u017f\u03a3\u03c3\u00df\u01c5A\u030a\u0416\u4e2d\u3000\u00a0_-\"\u00ab\u2019\U0001d400\u0345\u02bcn\u023a"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) + rng.choice([""] * 9 + ["<|endoftext|>s", "<|ENDOFTEXT|>."]) for _ in range(4000)]
    got = words.ids(texts)
    want = words.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [[*w.ids, 2] for w in want]


def test_sum_of_squares():
    """Each choice is the least over all levels, by recomputing the sums."""
    rng, packer = random.Random(1), packing.Packer(64)
    for i in range(400):
        size = rng.choice([5, 7, 20, 31, 40, 63])
        count = packer.count.copy()
        fill = packer.best(size)

        def after(h):
            c = count.copy()
            if h:
                c[h] -= 1
            if h + size < 64:
                c[h + size] += 1
            return int((c**2).sum())

        costs = {h: after(h) for h in range(65 - size) if not h or count[h]}
        assert costs[fill] == min(costs.values())
        packer.add(i, b"\0" * 4 * size)


def test_pieces():
    rng, packer, docs = random.Random(2), packing.Packer(64), {}
    for i in range(300):
        docs[i] = np.array([rng.randrange(1000) for _ in range(rng.choice([1, 3, 50, 64, 200]))], "<u4").tobytes()
        packer.add(i, docs[i])
    packer.finish()
    back = defaultdict(dict)
    for window in packer.done:
        n = sum(len(p[2]) // 4 for p in window)
        assert 0 < n <= 64 and n & (n - 1) == 0
        for key, at, ids, total in window:
            assert total * 4 == len(docs[key]) and at not in back[key]
            back[key][at] = ids
    assert {k: b"".join(v for _, v in sorted(p.items())) for k, p in back.items()} == docs


def test_query(spark):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])] + [(2, TEXTS[2]), (None, "x y")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, offset int")
    got = packing.packed(docs, packing.vocabulary()).collect()
    want = {(i, t): plain(t) for i, t in rows}
    assert sum(r.length for r in got) == sum(len(plain(t)) for _, t in rows)
    for r in got:
        assert any(i == r.doc_id and len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for (i, _), ids in want.items())
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        ends = [0] + [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096
    assert packing.packed(docs.limit(0), packing.vocabulary()).count() == 0
