import json
from dataclasses import dataclass

import pytest

from tessella.operators import sampling
from tessella.sources import io


def test_plans_check_themselves(spark):
    assert sampling.Plan().mode() == ("fixed", 3) and sampling.Plan(percentage=1.0).mode() == ("percentage", 1.0) and sampling.Plan(total=5).mode() == ("cap", 5)
    for wrong in ({"per_category": 1, "total": 2}, {"percentage": 0.0}, {"percentage": 1.5}):
        with pytest.raises(ValueError):
            sampling.Plan(**wrong)
    rows = spark.createDataFrame([(f"q{i}", "ab"[i % 2], "hard" if i == 3 else "easy") for i in range(20)], "id string, category string, difficulty string")
    assert {r.category: r["count"] for r in sampling.planned(rows, "category", "id", sampling.Plan(per_category=4, exclude=("b",))).groupBy("category").count().collect()} == {"a": 4}
    assert sampling.planned(rows, "category", "id", sampling.Plan(total=6)).count() == 6
    with pytest.raises(ValueError, match="no rows"):
        sampling.planned(rows, "category", "id", sampling.Plan(include=("c",)))
    assert sampling.one_of(rows, "difficulty", "hard", "id").first().id == "q3"
    with pytest.raises(ValueError, match="no row"):
        sampling.one_of(rows, "difficulty", "none", "id")


def test_exact_sizes_with_small_and_missing_groups(spark):
    rows = spark.createDataFrame([(i, "abc"[min(i // 40, 2)]) for i in range(83)] + [(900, None)], "id int, g string")
    targets = spark.createDataFrame([("a", 7), ("b", 40), ("c", 9)], "g string, _target long")
    got = {(r.g, r._in): r["count"] for r in sampling.first_of(rows, "g", "id", targets, 1).groupBy("g", "_in").count().collect()}
    assert got == {("a", True): 7, ("a", False): 33, ("b", True): 40, ("c", True): 3, (None, False): 1}


@dataclass
class Experiment:
    name: str
    subjects: tuple[str, ...] = ()
    turns: int = 10

    def __post_init__(self):
        if self.turns < 1:
            raise ValueError("turns")


def test_typed_configurations(tmp_path):
    def read(values):
        (tmp_path / "c.json").write_text(json.dumps(values))
        return io.typed(str(tmp_path / "c.json"), Experiment)

    assert read({"name": "x", "subjects": ["a", "b"]}) == Experiment("x", ("a", "b"))
    for wrong, what in (({"name": "x", "turn": 3}, "turn"), ({"name": "x", "turns": 0}, "turns")):
        with pytest.raises(ValueError, match=what):
            read(wrong)
    assert io.typed(str(tmp_path / "none.json"), Experiment, {"name": "d"}).name == "d"
    assert io.weights(a=0.4, b=0.4, c=0.2)["b"] == 0.4
    with pytest.raises(ValueError):
        io.weights(a=0.5, b=0.4)


@pytest.mark.parametrize("csv", [True, False])
def test_splits_have_folders(spark, tmp_path, csv):
    rows = spark.createDataFrame([(1, 'a "b"', "train"), (2, None, "test")], "id int, t string, split string")
    io.write_splits(rows, str(tmp_path / "out"), csv)
    read = lambda s: (spark.read.option("header", True).option("escape", '"').schema("id int, t string").csv if csv else spark.read.schema("id int, t string").json)(str(tmp_path / f"out/split={s}")).collect()
    assert [tuple(r) for r in read("train")] == [(1, 'a "b"')] and [tuple(r) for r in read("test")] == [(2, None)]


def test_a_grid_sends_a_catalogue_only(spark, monkeypatch):
    from tessella.operators import curation

    samples, personas = spark.range(3).withColumnRenamed("id", "sample_id"), spark.createDataFrame([("a",), ("b",)], "persona_name string")
    assert curation.grid(samples, personas, 2).count() == 12
    monkeypatch.setattr(curation, "CATALOGUE", 1)
    with pytest.raises(ValueError, match="personas"):
        curation.grid(samples, personas, 2)
