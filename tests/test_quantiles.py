import random
import statistics

import pytest

from tessella.operators import quantiles


def plain(rows):
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    return {k: statistics.median(v) for k, v in groups.items()}


@pytest.mark.parametrize("bins, few", [(1024, 1024), (5, 2)])
def test_medians_of_all_kinds(spark, monkeypatch, bins, few):
    """Ties, far values, one and two values, even and odd numbers, null keys and values; at any number of parts and of values that are sorted."""
    monkeypatch.setattr(quantiles, "BINS", bins)
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = random.Random(4)
    rows = [("a", rng.random()) for _ in range(301)] + [("b", float(rng.randrange(3))) for _ in range(200)] + [("c", 10.0 ** rng.randrange(-9, 9)) for _ in range(60)]
    rows += [("d", 7.0), ("e", 1.0), ("e", 4.0), ("f", None), (None, 2.0), (None, -3.0), (None, None)] + [("g", 0.5)] * 90 + [("g", 9.0)] * 90
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.median for r in quantiles.medians(frame, ["k"], "v").collect()}
    assert got == pytest.approx(plain(rows))
    assert quantiles.medians(frame, [], "v").first().median == pytest.approx(statistics.median(v for _, v in rows if v is not None))
    assert quantiles.medians(frame.limit(0), ["k"], "v").count() == 0 == quantiles.medians(frame.where("k = 'f'"), [], "v").count()


def test_endless_and_missing_numbers(spark):
    rows = [(1, float("inf")), (1, 5.0), (1, 2.0), (2, float("nan")), (2, 1.0), (2, 3.0), (3, float("-inf")), (3, float("inf")), (3, 0.0)]
    got = {r.k: r.median for r in quantiles.medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert got == {1: 5.0, 2: 3.0, 3: 0.0}


def test_tasks_hold_a_histogram(spark, monkeypatch):
    """Of 50,000 different values no group of the rounds has more rows than there are parts, and only FEW values are sorted."""
    monkeypatch.setattr(quantiles, "BINS", 64)
    monkeypatch.setattr(quantiles, "FEW", 100)
    seen = []
    inner = quantiles.staged
    monkeypatch.setattr(quantiles, "staged", lambda df, tag: seen.append(inner(df, tag)) or seen[-1])
    monkeypatch.setattr(quantiles, "discarded", lambda *t: None)
    frame = spark.range(50_001).selectExpr("id * 0.25 AS v")
    assert quantiles.medians(frame, [], "v").first().median == 6250.0
    held = [r.held for t in seen if "held" in t.columns for r in t.collect()]
    assert held[0] == 50_001 and sorted(held, reverse=True) == held and held[-1] <= 100 and len(held) <= 6


def test_joined_to_aggregates(spark):
    frame = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", None), ("b", 3.0)], "k string, v double")
    counts = frame.groupBy("k").count()
    assert sorted(map(tuple, quantiles.with_median(counts, frame, ["k"], "v").collect()), key=str) == sorted([(None, 2, 1.5), ("a", 1, None), ("b", 1, 3.0)], key=str)
    assert quantiles.with_median(frame.where("k = 'a'").groupBy().count(), frame.where("k = 'a'"), [], "v").first().median is None
