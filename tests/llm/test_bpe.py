import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
OURS = bpe.Codec(bpe.load(PATH), public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", " ", "a", "  a\n\n b \t", "x" * 700, "don't they're", "é　ü \x1c\x1d x\x85y", "\n \n", "日本語 текст 123,45", "aaaa" * 50 + "bbb", "<|endoftext|>", "   a"]


def same(text):
    ids = OURS.encode([text])[0]
    assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == THEIRS.encode_ordinary(text)
    assert OURS.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ODD)
def test_odd(text):
    same(text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcthe  \n\t'!.,é1日\x1c\xa0"), max_size=60))
def test_any(text):
    same(text)


def test_long_pieces():
    """Both trees on the same pieces, and unbroken runs against the library."""
    import random
    import time

    rng = random.Random(1)
    pieces = ["".join(rng.choice("abcdeht") for _ in range(n)).encode() for n in (2, 3, 17, 64, 65, 400)]
    for p in pieces:
        assert OURS.merge_long(p) == OURS.merge([p], 1 << (len(p) - 1).bit_length())[0]
    run = "".join(rng.choice("etaoinshr\u4e2d\u6587") for _ in range(100_000))
    start = time.time()
    same(run)
    assert time.time() - start < 60
    for text in ("a" * 30_000, "=" * 30_001, "ab" * 20_000 + " c"):
        same(text)


def test_query(spark):
    rows = [(1, "hello there"), (2, None), (3, ""), (3, ""), (None, "x")]
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, ids string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH, public_tokenizers.PATTERN).collect())
    want = []
    for i, t in rows:
        ids = THEIRS.encode_ordinary(t or "")
        want.append((i is None, i or 0, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.digests(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
