"""Micro-fixtures with known values, and every catalogue query on the smallest tables."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella import catalog, providers
from tessella.functions import stats, text
from tessella.operators import curation, dedup, dialogue, rubrics, sampling
from tessella.plans import flows
from tessella.sources import io


def one(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(expression.alias("x")).first().x


@pytest.mark.parametrize("rows, want", [([(5, True), (1, True), (-5, False)], 1.0), ([(5, True), (1, False), (-5, True)], 0.0), ([(5, False), (1, True), (-5, True)], 0.0), ([(-5, True)], 0.0)])
def test_weighted_score(spark, rows, want):
    df = spark.createDataFrame([("s", *r) for r in rows], "k string, weight int, passed boolean")
    assert rubrics.scored(df, "k").first().weighted_score == want
    assert df.groupBy().agg(F.collect_list(F.struct("weight", "passed")).alias("r")).select(rubrics.array_scores(F.col("r"))["weighted_score"].alias("x")).first().x == want


def test_interval_and_t():
    assert [round(stats.critical(d), 4) for d in (1, 2, 4, 9, 30)] == [12.7062, 4.3027, 2.7764, 2.2622, 2.0423]


def test_runs(spark):
    df = spark.createDataFrame([("a", 0.52), ("a", 0.54), ("a", 0.53), ("b", 0.7)], "k string, value double")
    got = {r.k: (round(r.mean, 6), round(r.ci_margin, 7)) for r in rubrics.over_runs(df, "k").collect()}
    assert got == {"a": (0.53, 0.0248414), "b": (0.7, 0.0)}
    imp = [one(spark, rubrics.improvement(F.lit(a), F.lit(b))) for a, b in ((0.0, 0.2), (0.0, 0.0), (0.3165320924939213, 0.21833714341179192))]
    assert imp[0] == math.inf and imp[1] == 0 and imp[2] == pytest.approx(-31.022114790466343)


@pytest.mark.parametrize("t, want", [("10%", 0.1), ("10π", 31.41592653589793), ("5.5 × 10^-2", 0.055), ("1,200 kg", 1200.0), ("abc", None), ("-pi", -math.pi), ("5.5e-2", 0.055), ("$3.50", 3.5)])
def test_numbers(spark, t, want):
    got = one(spark, text.number(F.col("t")), t=t)
    assert got is None if want is None else got == pytest.approx(want)


def test_answers(spark):
    assert one(spark, text.numbers_agree(F.col("a"), F.col("b")), a="31.4", b="10π") is True
    assert one(spark, text.numbers_agree(F.col("a"), F.col("b")), a="x", b="1") is None
    t = F.col("t")
    assert one(spark, text.last_final(t), t="FINAL: 3\nFINAL: 4.") == "4" and one(spark, text.first_final(t), t="FINAL: 3\nFINAL: 4.") == "3"
    assert one(spark, text.short_answer_score(F.col("a"), F.col("b")), a="slope is constant", b="the slope") == 0.5
    assert one(spark, text.answer_matches(F.col("a"), F.col("b")), a="42", b="I think 42.001") is True
    assert one(spark, text.skill_by_keyword(t), t="Identifying incorrect steps") == "identifying_correct_steps"
    assert one(spark, text.open_question(t), t="Which of the following (A) is it?") == "is it?"
    assert one(spark, text.confidence(t), t="I am not sure") == "low" and one(spark, text.inferred_action(t), t="Do you understand?") == "Ask_Check_Understanding"


def test_parsers(spark):
    t = F.col("t")
    turn = one(spark, text.teacher_turn(t), t='Thought: think\nmore\nAction: hint\nUtterance: "Look here"')
    assert tuple(turn) == ("think\nmore", "GIVE_HINT", "Look here", True, False)
    fixed = one(spark, text.repaired_turn(t, text.teacher_turn(t)), t="END_STUCK it is\naction: zzz\nWe stop here")
    assert fixed.action == "END_STUCK" and fixed.utterance == "We stop here" and fixed.is_terminal
    assert tuple(one(spark, text.judgement(t), t="JUDGMENT: PASS\nJUDGMENT: FAIL\nEXPLANATION: bad")) == (False, "bad")
    assert one(spark, text.selection(t, 3), t="SELECTED: 9") == 2 and one(spark, text.selection(t, 3), t="none") == 0
    m = one(spark, text.method_analysis(t), t="STUDENT_METHOD: sub\nALTERNATIVE_METHODS: a, b, c, d\nSHOULD_BRANCH: Yes")
    assert (m.student_method, m.alternative_methods, m.should_branch) == ("sub", ["a", "b", "c"], True)
    assert tuple(one(spark, text.legacy_action(t), t='Action: Ask("a (b)")')) == ("Ask", "a (b)")
    assert one(spark, text.fenced_json(t, "score int"), t='x ```json\n{"score": 4}\n```').score == 4
    assert one(spark, text.salvaged_utterance(t), t="Action: GIVE_HINT\nshort\nthis is long enough") == "this is long enough"
    raw = '[{"criteria":"Must not tell","attributes":{"severity":"critical","eval_dimension":"Style Tone, x","tutoring_skill":"Step by step help/ analysis "}}]'
    r = one(spark, rubrics.parsed(t), t=raw)[0]
    assert (r.weight, r.evaluation_dimension, r.tutoring_skill, r.is_objective) == (-5, "style_tone", "step_by_step_help", True)
    assert one(spark, rubrics.parsed(t, "evaluation"), t=raw)[0].weight == 5 and one(spark, rubrics.parsed(t), t="{bad") == []


def test_pes_and_scores(spark):
    names = [*dialogue.PES_DIMENSIONS, "question_depth", "icap"]
    df = spark.createDataFrame([(f"s{v}", *[v] * 10) for v in (2, 3, 5)], "name string, " + ", ".join(f"{n} int" for n in names))
    assert {r.name: (r.pes_score, r.pes_category) for r in dialogue.pes(df).collect()} == {"s2": (25.0, "Very Poor"), "s3": (50.0, "Poor"), "s5": (100.0, "Excellent")}
    assert [round(one(spark, dialogue.ratio_score(F.lit(x))), 6) for x in (0.3, 0.9)] == [0.84, 0.96]
    assert [round(one(spark, dialogue.learning_gain(F.lit(a), F.lit(b))), 6) for a, b in ((0.4, 0.7), (0.99, 1.0), (0.5, 0.2))] == [0.5, 0, 0]
    assert [round(one(spark, dialogue.gain_score(F.lit(x))), 6) for x in (0.3, 0.2, 0.05)] == [1, 0.75, 0.25]
    mp = lambda **kv: F.create_map(*[F.lit(x) for p in kv.items() for x in p])
    assert one(spark, dialogue.damr(mp(a=5, b=3), mp(a=5, b=4, c=1))) == 33.33
    assert one(spark, dialogue.mastery_fold(F.array(F.lit("Ask_Background"), F.lit("?")), F.lit(0.2), F.lit("nobody"))) == pytest.approx(0.209 + 0.03 * (1 - 0.209 / 2))


def test_curation(spark):
    rows = [("s", "p", i, 0.5 + i / 100, 0.6) for i in range(7)] + [("s", "p", 7, 0.9, 0.9)] + [("t", "q", i, 0.1 * i, 0.1) for i in range(3)]
    df = spark.createDataFrame(rows, "sample_id string, persona_name string, pos int, weighted_score double, critical_pass_rate double")
    assert sorted((r.sample_id, r.pos) for r in curation.shortfall(df).collect()) == [("s", 6), ("t", 2)]
    assert tuple(curation.attrition(df).first()) == (11, 10, 0, 1)
    assert {r.edge: r.n for r in curation.histogram(spark.createDataFrame([(0.8,), (0.81,), (1.0,), (0.1,)], "weighted_score double")).collect()} == {0.8: 2, 0.85: 1, 0.9: 0, 0.95: 0, 1.0: 1}


def test_history(spark):
    turns = spark.createDataFrame([("d", 0, "P", "s0", "u0"), ("d", 1, "P", "s1", None), ("d", 2, "P", "s2", "u2"), ("d", 3, "P", "s3", None)], "dialogue_id string, pos int, problem string, system string, user string")
    got = [(r.prompt, r.response, r.history) for r in dialogue.history(turns).orderBy("pos").collect()]
    assert got == [("P", "s0", []), ("u0", "s1", [["P", "s0"]]), ("u0", "s1", [["P", "s0"]]), ("u2", "s3", [["P", "s0"], ["u0", "s1"]])]


def test_greedy_matches_sequential(spark):
    rng = random.Random(7)
    pairs = sorted({(i, j) for i in range(60) for j in rng.sample(range(60), 2) if j < i} | {(100, 101 - 2), (101, 100)})
    nodes = sorted({x for p in pairs for x in p} | {200})
    kept = []
    for i in nodes:
        if not any((i, j) in set(pairs) for j in kept):
            kept.append(i)
    got = dedup.greedy(spark.createDataFrame([(n,) for n in nodes], "pos long"), spark.createDataFrame(pairs, "i long, j long"))
    assert sorted(r.pos for r in got.where("kept").collect()) == kept


def test_sampling(spark):
    rows = spark.range(7).withColumnRenamed("id", "pos")
    assert [r["count"] for r in sampling.chunks(rows, "pos", 3).groupBy("chunk").count().orderBy("chunk").collect()] == [3, 2, 2]
    counts = spark.createDataFrame([("a", 10), ("b", 2)], "category string, available long")
    assert [{r.category: r.target for r in sampling.sizes(counts, m, x).collect()} for m, x in (("fixed", 3), ("percentage", 0.1), ("cap", 7))] == [{"a": 3, "b": 2}, {"a": 1, "b": 1}, {"a": 3, "b": 2}]


def test_flow(spark):
    rubric = [("be kind", 5, "style_tone", None, True, True)]
    df = spark.createDataFrame([("a", "adaptive", "Maths", "", [("user", "hi")], rubric, False, [])], io.SAMPLE)
    got = flows.evaluated(df, providers.with_retry(providers.echo), lambda s, m: "JUDGMENT: PASS").first()
    assert (got.response, got.weighted_score, got.ratings[0].passed) == ("[1] hi", 1.0, True)
    assert flows.evaluated(df, providers.chain(providers.echo, ["x", "y"])).first().pass_rate == 1.0
    assert providers.best_of(lambda s, m: s, lambda ts: 1, 3)("p", []).endswith("2)")


@pytest.mark.parametrize("name", ["report_breakdowns", "dialogue_metrics", "variant_ranking", "rejected_rows"])
def test_catalogue(spark, name):
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
