import re
from collections import Counter

from tessella.llm import rules

TEXTS = [None, "", "  \n\t ", "one two", "a b c a b c", "x x x x x x", "l1 a\nl1 a\n\nl1 a\nq\n", "é ñ　z \x1cq <|> $$", "p q r s t " * 30, "w1 w2 w3 w4 " + " ".join(f"v{i}" for i in range(60)) + " w1 w2 w3", " ".join(f"v{i}" for i in range(70)), " ".join(f"SHOUT{chr(65 + i % 26)}{chr(65 + i // 26)}!!" for i in range(60))]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {j for i, g in enumerate(grams) if n[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    m = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit))
    return (*m, m[0] < 50 or 100 * m[4] > 50 * m[0])


def test_measures(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (3, TEXTS[3]), (None, "z")], "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS failures")
    got = rules.judged(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        assert tuple(r)[1:7] == plain("z" if r.doc_id is None else TEXTS[r.doc_id])
        assert not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in got}
    assert by[10].kept and not by[11].kept and by[11].failures == rules.BIT["shouting"]
    assert rules.judged(docs.limit(0)).count() == 0
    plan = rules.judged(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan.split("Physical Plan")[1] and "Exchange" not in plan.split("Physical Plan")[1]


def test_long_text(spark):
    """A text of 120,000 words, all of whose windows occur once but three; and one that repeats throughout."""
    words = [f"v{i}" for i in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join([*words, *words[:3]])), (2, "x y z w " * 40_000)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words) for r in rules.judged(docs).collect()}
    assert got == {1: (120_003, 6), 2: (160_000, 160_000)}


def test_policy_and_sole_rule(spark):
    got = {r.doc_id: (r.policy, r.only) for r in rules.judged(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()}
    assert {p for p, _ in got.values()} == {"v1"}
    assert got[0][1] == "few_words" and got[10][1] is None and got[11][1] == "shouting"


def test_ablations(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (6,)], "failures int")
    got = {r.rule: (r.rejected, r.failed, r.alone) for r in rules.ablations(rows, "base").collect()}
    assert got == {"few_words": (4, 3, 2), "repeated_windows": (4, 2, 1)}


def test_ablations_of_odd_tables(spark, tmp_path):
    """Null and empty texts, null and repeated ids, and no rows at all."""
    rows = [(None, None), (1, ""), (1, ""), (2, "good words " * 60), (3, " ".join(f"w{i}" for i in range(80)))]
    for name, some in (("full", rows), ("none", [])):
        (tmp_path / name).mkdir()
        spark.createDataFrame([(*r, 1) for r in some], "doc_id long, text string, failures int").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = {(r.policy, r.rule): (r.rejected, r.failed, r.alone) for r in rules.quality_rule_ablations(spark, f"{tmp_path}/full").collect()}
    assert got["base", "few_words"] == (4, 3, 3) and got["base", "repeated_windows"] == (4, 1, 1) and len(got) == 8
    assert {(r.rejected, r.failed, r.alone) for r in rules.quality_rule_ablations(spark, f"{tmp_path}/none").collect()} == {(0, 0, 0)}
