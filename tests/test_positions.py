import pytest

from tessella.sources import io, positions


@pytest.mark.parametrize("size", ["2k", "10m"])
def test_a_csv_of_many_splits_is_numbered_as_one(spark, tmp_path, size):
    """Also over several files, of which one is empty, in the order of their names."""
    n = 0
    for f, count in (("b.csv", 700), ("a.csv", 900), ("c.csv", 0), ("d.csv", 1)):
        (tmp_path / f).write_text("name,n\n" + "".join(f"{f}{'x' * (i % 50)},{i}\n" for i in range(count)))
        n += count
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = spark.read.option("header", True).schema("name string, n int").csv(str(tmp_path))
        assert (raw.rdd.getNumPartitions() > 10) == (size == "2k")
        got = sorted((r.pos, r.name[:5], r.n) for r in positions.numbered(raw.select("name", "n")).collect())
        assert got == [(k, f, i) for k, (f, i) in enumerate([("a.csv", i) for i in range(900)] + [("b.csv", i) for i in range(700)] + [("d.csv", 0)])]
        assert positions.numbered(raw, "at", 1).where("n = 5").count() == 2
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_samples_of_quoted_cells_get_ids_by_place(spark, tmp_path):
    (tmp_path / "s.csv").write_text('SUBJECT,PROMPT,RUBRICS\nMaths,"two\nlines, and ""quotes""",[]\nPhysics,p,[]\n,q,[]\n')
    rows = positions.numbered(io.csv(spark, str(tmp_path / "s.csv"), io.RAW_CSV))
    got = sorted((r.sample_id, r.subject, r.messages[0].content) for r in io.csv_samples(rows).collect())
    assert got == [("sample_0000", "Maths", 'two\nlines, and "quotes"'), ("sample_0001", "Physics", "p"), ("sample_0002", "unknown", "q")]
    assert [r.sample_id for r in io.csv_samples(rows, subject="physics").collect()] == ["sample_0001"]


def test_no_rows(spark, tmp_path):
    (tmp_path / "e.csv").write_text("a,b\n")
    assert positions.numbered(spark.read.option("header", True).schema("a string, b string").csv(str(tmp_path))).count() == 0
