import corpus_pipeline
from pyspark.sql import functions as F


def test_near_duplicates_keep_one(spark):
    a, b = " ".join(f"w{i}" for i in range(300)), " ".join(f"v{i}" for i in range(300))
    rows = [(5, a), (3, a), (9, a + " end"), (4, b), (4, b), (7, "other words entirely here"), (None, a), (None, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "7"]
    lonely = docs.where("doc_id IS NULL")
    assert [r.text for r in corpus_pipeline.near_duplicate_stage(spark, lonely, "").collect()] == [a]
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), "").count() == 0


def test_stages_on_odd_rows(spark):
    """Null and empty texts, null and repeated ids, an empty table: quality and toxicity keep or drop whole rows, packing packs each."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "plain words here", None, None, 3), (None, "x " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        if name == "packing":
            assert sum(r.length for r in got.collect()) >= 50_000
        else:
            assert got.columns == docs.columns and {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0


def test_run(spark):
    """All stages in turn over the smallest tables: what comes out is what the stages keep, whole."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = corpus_pipeline.run(spark, sf)
    got = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert 0 < len(got) <= docs.count() and all(r.n == r["all"] for r in got)
    kept = {r.doc_id for r in got}
    junk = {r.doc_id for r in labels.where("quality = 0").collect()}
    assert len(kept & junk) <= 0.1 * len(junk)
    groups = corpus_pipeline.simhash.grouped(docs).collect()
    of = {r.doc_id: r.component_id for r in groups}
    assert len({of[i] for i in kept}) == len(kept)
