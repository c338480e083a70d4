import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import overlap, prompts
from tessella.operators import dialogue, tuning
from tessella.sources import io


def lcs_length(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_words_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (rng.sample("abcdefghij", rng.randrange(1, 10)) for _ in range(2))
        got = overlap.common_words(a, b)
        assert len(got) == lcs_length(a, b) and got <= set(a) & set(b)
        assert [w for w in a if w in got] == [w for w in b if w in got]


def test_overlap_scores(spark):
    rows = spark.createDataFrame([(1, "the cat sat", "the cat ran"), (2, "same text. twice", "same text. twice"), (3, "", "x"), (4, None, None), (5, "...", "a"), (6, "b", "a")], "id int, predict string, labels string")
    got = {r.id: r for r in overlap.overlaps(rows).collect()}
    assert got[1].rouge_1 == pytest.approx(66.6667, abs=1e-3) and got[1].rouge_2 == pytest.approx(50, abs=1e-3) and got[1].rouge_l == pytest.approx(66.6667, abs=1e-3)
    assert got[2].bleu_4 == 100 and got[2].rouge_l == pytest.approx(100, abs=1e-3)
    for i in (3, 4, 5):
        assert got[i].rouge_1 is None and got[i].rouge_2 is None and got[i].rouge_l is None and got[i].bleu_4 == 0
    assert got[6].rouge_1 == 0 and got[6].bleu_4 == 0
    mean = overlap.means(overlap.overlaps(rows)).first()
    assert mean.rouge_1 == pytest.approx((got[1].rouge_1 + got[2].rouge_1 + 0) / 3) and mean.bleu_4 == pytest.approx(sum(r.bleu_4 for r in got.values()) / 6)
    assert overlap.overlaps(rows.limit(0)).count() == 0


def test_bleu_by_hand():
    # Characters ab|c against abd: 2/3, 1/2, then no trigram hit of one (1/2), no 4-gram of none (1/4).
    assert overlap.bleu("abc", "abd") == pytest.approx(round(100 * math.exp((math.log(2 / 3) + math.log(1 / 2) + math.log(1 / 2) + math.log(1 / 4)) / 4), 4))
    assert overlap.bleu("abcd", "abcdefgh") == pytest.approx(round(100 * math.exp(1 - 8 / 4), 4))


def test_training_and_padding(spark):
    one = spark.createDataFrame([([5, 6, 7, 8], [9, 9], 0)], "a array<int>, b array<int>, batch int")
    ids, labels = tuning.training_ids(F.col("a"), F.col("b"), eos=2, pad=0, max_source=3, max_target=4)
    r = one.select(ids.alias("i"), labels.alias("l")).first()
    assert r.i == [5, 6, 7, 9, 9, 2, 0, 0] and r.l == [-100, -100, -100, 9, 9, 2, -100, -100]
    _, hidden = tuning.training_ids(F.col("a"), F.col("b"), eos=0, pad=0, max_source=3, max_target=1)
    assert one.select(hidden.alias("l")).first().l == [-100, -100, -100, 9, -100]
    whole, plain = tuning.training_ids(F.col("a"), F.col("b"), 2, 0, 1, 1, mask=False, cut_context=False)
    assert one.select(whole.alias("i"), plain.alias("l")).first() == ([5, 6, 7, 8, 9, 2], [0, 0, 0, 0, 9, 2])
    p = one.select(tuning.left_padded(F.col("a"), F.lit(5), 0, 4).alias("p")).first().p
    assert p.input_ids == [0, 0, 0, 0, 5, 6, 7, 8] and p.attention_mask == [0] * 4 + [1] * 4 and p.position_ids == [0, 0, 0, 0, 0, 1, 2, 3]
    rows = spark.createDataFrame([(0, [3, 9, 0, 0, 0], [1, 1, 1, 1, 1]), (0, [9, 4, 3, 0, 0], [2, 2, 2, 2, 2]), (1, [0, 0, 9, 1, 0], [3, 3, 3, 3, 3])], "batch int, input_ids array<int>, labels array<int>")
    got = sorted((r.batch, r.input_ids, r.labels) for r in tuning.collated(rows, "batch", 0).collect())
    assert got == [(0, [3, 9, 0], [1, 1, 1]), (0, [9, 4, 3], [2, 2, 2]), (1, [0, 0, 9, 1], [3, 3, 3, 3])]
    full = spark.createDataFrame([(0, [3, 9], [1, 1])], rows.schema)
    assert tuning.collated(full, "batch", 0).first().input_ids == [3, 9]


def test_message_ids(spark):
    rows = spark.createDataFrame([("user", "hi")], "role string, text string")
    codes = lambda: lambda texts: [[ord(c) for c in t] for t in texts]
    message = tuning.message_ids(F.col("role"), tuning.encoded(F.lit("\n"), codes), tuning.encoded(F.col("text"), codes), {"user": 900, "assistant": 901})
    assert rows.select(tuning.chat_ids(F.array(message), 901).alias("x")).first().x == [900, 10, 104, 105, 901]
    with pytest.raises(Exception, match="unknown role"):
        rows.select(tuning.message_ids(F.lit("teacher"), F.array(F.lit(1)), F.array(F.lit(2)), {"user": 900}).alias("x")).collect()
    usable = spark.createDataFrame([("a", "b"), ("", "b"), (None, "b"), ("a", None)], "p string, r string").where(tuning.usable(F.col("p"), F.col("r")))
    assert usable.count() == 1


def test_prompts(spark):
    rows = spark.createDataFrame([("math", False, [("user", "q"), ("system", "s"), ("assistant", "a")], [("x", "y")])], "subject string, multimodal boolean, messages array<struct<role:string,content:string>>, history array<struct<query:string,response:string>>")
    own = {("math", False): "plain", ("math", True): "images"}
    r = rows.select(
        prompts.filled("{a} and {b}.", a=F.col("subject"), b=F.lit(None)).alias("filled"), prompts.looked_up(F.lit("art"), {"math": "m"}, "else").alias("looked"),
        prompts.system_prompt(F.col("subject"), F.col("multimodal"), own).alias("system"), prompts.judge_context(F.col("messages")).alias("context"),
        prompts.question_prompt(F.lit("1+1?")).alias("qa"), prompts.round_prompt(F.lit("z"), F.col("history")).alias("rounds"), prompts.round_prompt(F.lit("z"), F.lit(None).cast("array<struct<query:string,response:string>>")).alias("first"),
    ).first()
    assert r.filled == "math and ." and r.looked == "else" and r.system == "plain" and r.context == "Student: q\nInitial Response: a"
    assert r.qa == "Question: 1+1?\nAnswer: \nLet's think step by step.\n"
    assert r.rounds == "[Round 1]\n\n问：x\n\n答：y\n\n[Round 2]\n\n问：z\n\n答：" and r.first == "[Round 1]\n\n问：z\n\n答："
    with pytest.raises(KeyError):
        prompts.filled("{missing}")


def test_text_reports(spark, tmp_path):
    names = [*dialogue.PES_DIMENSIONS, "question_depth", "icap"]
    scores = spark.createDataFrame([("one", *[5] * 10), ("two", *[1] * 10)], "name string, " + ", ".join(f"{c} int" for c in names))
    pages = dialogue.pes_report(dialogue.pes(scores))
    io.write_text(pages, str(tmp_path / "r"), "report", "name")
    page = spark.read.text(str(tmp_path / "r" / "name=one"), wholetext=True).first().value
    assert page.startswith("Evaluation of one\nPES 100.00: Excellent\nLayers\n  layer1 (weight 0.8): 1.0000\n") and page.rstrip().endswith("icap: 5/5")


def test_whole_rows(spark, tmp_path):
    """Long texts are not cut to a prefix: rows hold the reference's 1024 and 256, padded rows all of the text."""
    import hashlib

    from tessella import catalog

    talk = [("c", 1, "ab" * 150), ("c", 2, "xyz" * 70), ("c", 3, "q" * 1100), ("d", 1, "short"), ("d", 2, "r" * 300)]
    spark.createDataFrame([(c, t, "user", x) for c, t, x in talk], "conv_id string, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    digest = lambda ids: hashlib.md5(" ".join(map(str, ids)).encode()).hexdigest()
    rows, ids, labels = [(c, t, x, y) for (c, t, x), (e, _, y) in zip(talk, talk[1:], strict=False) if c == e], {}, {}
    for c, t, x, y in rows:
        a, b = [ord(k) for k in x][:1024], [ord(k) for k in y][:256] + [2]
        fill = 1281 - len(a) - len(b)
        ids[c, t], labels[c, t] = a + b + [0] * fill, [-100] * len(a) + b + [-100] * fill
    got = catalog.masked_training_rows(spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): (r.input_ids, r.labels) for r in got} == {k: (digest(ids[k]), digest(labels[k])) for k in ids}
    # The end of a row is its first 0 here, 2 or more ids before it; the longest of a conversation is the width.
    width = {c: max(len(ids[k]) - ids[k][::-1].index(next(i for i in reversed(ids[k]) if i)) for k in ids if k[0] == c) for c in "cd"}
    got = catalog.collated_rows(spark, str(tmp_path)).collect()
    assert {(r.conv_id, r.turn): (r.width, r.input_ids, r.labels) for r in got} == {k: (width[k[0]], digest(ids[k][: width[k[0]]]), digest(labels[k][: width[k[0]]])) for k in ids}
    got = catalog.left_padded_rows(spark, str(tmp_path)).collect()
    want = {}
    for c, t, x, _ in rows:
        gap = -(-max(len(u) for d, _, u, _ in rows if d == c) // 16) * 16 - len(x)
        want[c, t] = tuple(digest([0] * gap + v) for v in ([ord(k) for k in x], [1] * len(x), list(range(len(x)))))
    assert {(r.conv_id, r.turn): (r.input_ids, r.attention_mask, r.position_ids) for r in got} == want


def test_whole_report_is_digested(spark, monkeypatch):
    import hashlib

    from tessella import catalog

    names = [*dialogue.PES_DIMENSIONS, "question_depth", "icap"]
    scores = spark.createDataFrame([("one", *[5] * 10), ("two", *[1] * 10)], "name string, " + ", ".join(f"{c} int" for c in names))
    monkeypatch.setattr(catalog, "judged_parts", lambda spark, d: scores)
    pages = {r.name: r.report for r in dialogue.pes_report(dialogue.pes(scores)).collect()}
    assert all(p.rstrip().endswith(f"icap: {n}/5") for p, n in ((pages["one"], 5), (pages["two"], 1)))
    got = {r.name: r.report_md5 for r in catalog.pes_reports(spark, "").collect()}
    assert got == {k: hashlib.md5(p.encode()).hexdigest() for k, p in pages.items()}
