"""What a task holds or does for each row stays the same as tables grow."""

from pyspark.sql import functions as F

from tessella.operators import curation, dedup, staging, tuning
from tessella.plans import episodes


def test_effective_length_reads_arrays_without_a_function_for_each_element(spark):
    rows = [([5, 9, 7, 0, 3], 3), ([0, 0, 4, 9], 4), ([9, 0], 1), ([0, 0], 0), ([-100, 3, -100, 0], 2), ([7, 0, -100], 1), ([7, -100, 0], 1), ([None, 2, None, 0], 3), ([], 0), (None, None)]
    frame = spark.createDataFrame(rows, "ids array<int>, want int").select(tuning.effective_length(F.col("ids"), 0).alias("got"), "want")
    assert [r.got for r in frame.collect()] == [w for _, w in rows]
    assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_hidden_labels_with_and_without_mask(spark):
    frame = spark.createDataFrame([([5, 0, 7], [3, 0]), ([1] * 9, [2] * 9)], "a array<int>, b array<int>")
    got = [frame.select(*tuning.training_ids(F.col("a"), F.col("b"), 0, 0, 4, 3, mask)).collect() for mask in (True, False)]
    assert [list(r) for r in got[0]] == [[[5, 0, 7, 3, 0, 0, 0, 0], [-100] * 3 + [3, -100, -100, -100, -100]], [[1] * 4 + [2] * 3 + [0], [-100] * 4 + [2] * 3 + [-100]]]
    assert [list(r)[1] for r in got[1]] == [[0, 0, 0, 3, 0, 0, 0, 0], [0] * 4 + [2] * 3 + [0]]


def test_failing_rows_are_sorted_over_as_many_tasks_as_they_need(spark, monkeypatch):
    most = lambda df, rows, *keys: staging.dealt(df, rows, *keys, most=10)
    monkeypatch.setattr(curation, "dealt", most)
    rows = spark.range(300).select((F.col("id") % 60).alias("sample_id"), F.col("id").alias("pos"), F.lit(0.1).alias("weighted_score"), F.lit(0.1).alias("critical_pass_rate"))
    out = curation.shortfall(rows)
    assert out.rdd.getNumPartitions() == 30 and out.count() == 60
    assert curation.shortfall(rows.limit(0)).count() == 0


def test_failing_rows_are_sorted_once(spark):
    """Also where the counts are too many to be sent to every task; the other sort is theirs."""
    rows = spark.range(300).select((F.col("id") % 60).alias("sample_id"), F.col("id").alias("pos"), F.lit(0.1).alias("weighted_score"), F.lit(0.1).alias("critical_pass_rate"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = curation.shortfall(rows)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 1 and plan.count("Sort [") == 2
        assert sorted((r.sample_id, r.pos, r.shortfall, r.revision_rank) for r in out.collect()) == [(i, i, 1, 1) for i in range(60)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_shuffle_by_keys_is_streamed_until_tasks_would_be_four_times_as_large(spark):
    width = lambda rows, *keys: staging.dealt(spark.range(1), rows, *keys, most=10).rdd.getNumPartitions()
    assert [width(n, "id") for n in (0, 79, 300, 2000, 2020, 8000, 8001, 20000)] == [8, 8, 30, 200, 200, 200, 201, 500]
    assert width(2020) == 202


def test_copies_leave_over_as_many_tasks_as_they_need(spark, monkeypatch):
    """Kept rows and the log stay the same whether joins are dealt out or not: copies of kept and of removed texts, and of texts without words."""
    rows = spark.range(600).select(F.col("id").alias("pos"), F.concat(F.element_at(F.array(*map(F.lit, ["alpha beta", "Alpha, beta", "gamma delta", "a", "", "only words here"])), (F.col("id") % 6 + 1).cast("int"))).alias("text"))
    seen = []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (250_000, 10):
            monkeypatch.setattr(dedup, "dealt_if_many", lambda df, n, *keys, most=most: staging.dealt_if_many(df, n, *keys, most=most))
            kept, log = dedup.deduplicated(rows)
            seen.append((kept.rdd.getNumPartitions(), sorted(r.pos for r in kept.collect()), sorted((r.removed, r.kept, round(r.similarity, 9)) for r in log.collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    stay = sorted([0, 2, 5, *range(3, 600, 6), *range(4, 600, 6)])
    gone = sorted([(i, i % 6 if i % 6 != 1 else 0, 1.0) for i in range(600) if i not in set(stay)])
    assert [s[1:] for s in seen] == [(stay, gone)] * 2
    assert seen[0][0] <= 8 and seen[1][0] == 60


def test_sessions_are_played_and_replayed_over_as_many_tasks_as_they_need(spark, monkeypatch):
    """Also those of a table of one split."""
    monkeypatch.setattr(episodes, "SESSIONS", 5)
    asked = spark.range(100).coalesce(1).select(F.col("id").alias("session_id"), F.lit("q").alias("question"), F.lit("1").alias("ground_truth"))
    say = lambda system, m: "FINAL: 1"
    played = episodes.played(asked, say, say, lambda truth, answer: truth == answer, 2)
    assert played.rdd.getNumPartitions() == 20 and played.select("session_id").distinct().count() == 100
    _, out = episodes.experiment(asked, {"one": (say, say)}, lambda truth, answer: truth == answer, 2)
    assert out.count() == 100 and out.where("final_judge_verdict").count() == 100
