import itertools
import math
import random

import pytest

from tessella.functions import cutter, overlap


def every_cut(run):
    for bits in itertools.product([0, 1], repeat=max(0, len(run) - 1)):
        at = [0, *[i + 1 for i, b in enumerate(bits) if b], len(run)]
        yield [run[s:e] for s, e in zip(at, at[1:], strict=False)]


def test_best_path_against_all_cuts():
    rng = random.Random(3)
    for _ in range(200):
        counts = {"".join(rng.choice("中文字") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 60) for _ in range(rng.randrange(0, 12))}
        own = cutter.Cutter(counts)
        total = max(1, sum(counts.values()))
        worth = lambda w: math.log(counts[w] / total) if w in counts else math.log(1 / total) if len(w) == 1 else -math.inf  # noqa: E731, B023
        run = "".join(rng.choice("中文字本") for _ in range(rng.randrange(1, 9)))
        got = own(run)
        assert "".join(got) == run
        assert sum(map(worth, got)) == pytest.approx(max(sum(map(worth, c)) for c in every_cut(run)))


def test_scripts_and_signs():
    own = cutter.Cutter({"导数": 9, "是": 5, "斜率": 4, "ab": 3})
    assert own("导数是斜率 of f2, ab!") == ["导数", "是", "斜率", "of", "f2", ",", "ab", "!"]
    assert own("") == [] and own(" \n") == [] and cutter.Cutter({})("数是x") == ["数", "是", "x"]
    assert cutter.Cutter({"the": 3, "cat": 2}, everywhere=True)("thecat") == ["the", "cat"]


def test_dictionaries_from_tables(spark):
    rows = spark.createDataFrame([("The cat, the hat",), (None,), ("",), ("cat",)], "text string")
    assert [tuple(r) for r in cutter.spaced(rows).collect()] == [("cat", 2), ("the", 2), ("hat", 1)]
    rng = random.Random(5)
    words, single = ["导数", "斜率", "函数值"], list("的了是在不我有他这中大来上国和")
    texts = ["".join(rng.choice(words) if rng.random() < 0.3 else rng.choice(single) for _ in range(30)) for _ in range(200)]
    found = {r.word: r.n for r in cutter.learnt(spark.createDataFrame([(t,) for t in texts], "text string"), least=40, bond=4.0).collect()}
    assert {w for w in found if len(w) > 1} >= set(words)
    assert found["导数"] == sum(t.count("导数") for t in texts)
    assert not {a + b for a in single for b in single} & set(found)
    own = cutter.Cutter(found)
    assert own("我的导数是函数值") == ["我", "的", "导数", "是", "函数值"]


def test_overlap_of_unspaced_text(spark):
    own = cutter.Cutter({"导数": 9, "斜率": 4, "切线": 4})
    rows = spark.createDataFrame([("导数是斜率", "导数是切线"), (None, "x"), ("导数", "导数")], "predict string, labels string")
    plain, cut = (sorted(overlap.overlaps(rows, cutter=c).collect(), key=str) for c in (None, own))
    by = {r.predict: r for r in cut}
    assert by["导数是斜率"].rouge_1 == pytest.approx(66.6667, abs=1e-3) and by["导数是斜率"].rouge_l == pytest.approx(66.6667, abs=1e-3) and by["导数"].rouge_l == pytest.approx(100, abs=1e-3)
    assert by[None].rouge_1 is None and {r.predict: r.bleu_4 for r in plain} == {r.predict: r.bleu_4 for r in cut}
    assert {r.predict: r.rouge_1 for r in plain}["导数是斜率"] == 0.0
