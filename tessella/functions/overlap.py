"""Overlap of a prediction with a reference text: ROUGE-1, -2 and -L over words, BLEU-4 over characters.

ROUGE-1 and -2 compare sets of n-grams with built-in functions. ROUGE-L (sentences end at full stops; the words of all
longest common subsequences of a sentence pair are united) and BLEU-4 need Python, in Arrow batches. Scores are F
measures times 100, rounded to four places. Null or empty texts: ROUGE is null, so that means leave it out, and BLEU is 0.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-8
Cutter = Callable[[str], list[str]]


def words(text: Column) -> Column:
    """Words between blanks and full stops; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\s.]+"), lambda w: w != "")


def _grams(own: Column, n: int) -> Column:
    if n == 1:
        return F.array_distinct(own)
    if n == 2:
        most = F.greatest(F.size(own) - 1, F.lit(0))
        return F.array_distinct(F.zip_with(F.slice(own, 1, most), F.slice(own, 2, most), lambda a, b: F.concat_ws(" ", a, b)))
    starts = F.sequence(F.lit(1), F.greatest(F.size(own) - n + 1, F.lit(1)))
    return F.when(F.size(own) >= n, F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def _f(hits: Column, predicted: Column, wanted: Column) -> Column:
    p, r = (F.coalesce(F.try_divide(hits, n), F.lit(0.0)) for n in (predicted, wanted))
    return 2 * p * r / (p + r + EPSILON)


def rouge_n(predicted: Column, wanted: Column, n: int = 1) -> Column:
    """ROUGE-n of two arrays of words: columns of their own, as each is used several times (see ``cut``)."""
    a, b = _grams(predicted, n), _grams(wanted, n)
    score = F.round(_f(F.size(F.array_intersect(a, b)), F.size(a), F.size(b)) * 100, 4)
    return F.when((F.size(predicted) > 0) & (F.size(wanted) > 0), score)


def cut(rows: DataFrame, **texts: Column) -> DataFrame:
    """The rows with the words of each text as a column; computed once, where an expression would be at every use."""
    return rows.withColumns({name: words(t) for name, t in texts.items()})


def common_words(a: list[str], b: list[str]) -> set[str]:
    """Words of one longest common subsequence: bits of a row say where the length does not grow; the last match wins."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row, rows = full, []
    for w in b:
        hit = row & places.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    out, i, j = set(), len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        elif j > 1 and not rows[j - 2] >> (i - 1) & 1:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.add(a[i])
    return out


def longest(predicted: str | None, wanted: str | None, cut: Cutter = str.split) -> float | None:
    """ROUGE-L of two texts."""
    a, b = ([s for s in map(cut, (t or "").split(".")) if s] for t in (predicted, wanted))
    if not a or not b:
        return None
    own, other = [set(x) for x in a], [set(y) for y in b]
    hits = len(set().union(*(common_words(x, y) for y, t in zip(b, other, strict=True) for x, s in zip(a, own, strict=True) if not s.isdisjoint(t))))  # pairs without a common word have no common part
    p, r = (hits / len({w for s in side for w in s}) for side in (a, b))
    return round(2 * p * r / (p + r + EPSILON) * 100, 4)


def bleu(predicted: str | None, wanted: str | None) -> float:
    """Sentence BLEU-4 over characters; the k-th precision without a hit counts as 1 / (2^k times its n-grams)."""
    a, b = predicted or "", wanted or ""
    log_sum, misses = 0.0, 0
    for n in range(1, 5):
        own, other = (Counter(t[i : i + n] for i in range(len(t) - n + 1)) for t in (a, b))
        hits, total = sum((own & other).values()), max(1, sum(own.values()))
        if not hits:
            if n == 1:
                return 0.0
            misses += 1
            hits = 2.0**-misses
        log_sum += math.log(hits / total) / 4
    brevity = 1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a))
    return round(brevity * math.exp(log_sum) * 100, 4)


def rouge_l(predicted: Column, wanted: Column, cut: Cutter = str.split) -> Column:
    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([longest(x, y, cut) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return score(predicted, wanted)


def bleu_4(predicted: Column, wanted: Column) -> Column:
    @F.arrow_udf("double")
    def score(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([bleu(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    return score(predicted, wanted)


def overlaps(rows: DataFrame, predicted: str = "predict", wanted: str = "labels", cutter: Cutter | None = None) -> DataFrame:
    """The rows with rouge_1, rouge_2, rouge_l and bleu_4. ``cutter`` parts text that is written without blanks (see ``cutter``): its words are joined by blanks first, BLEU goes by characters."""
    # Scores take longer than their bytes tell: a stated number of partitions is not coalesced.
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a, b = F.col(predicted), F.col(wanted)
    x, y = F.col("_a"), F.col("_b")
    if cutter is not None:
        from .cutter import cut as parted

        both = parted(parted(rows, predicted, cutter, "_p"), wanted, cutter, "_w")
        texts = both.withColumns({c: F.array_join(c, " ") for c in ("_p", "_w")})
        scores = {"rouge_1": rouge_n(x, y, 1), "rouge_2": rouge_n(x, y, 2), "rouge_l": rouge_l(F.col("_p"), F.col("_w")), "bleu_4": bleu_4(a, b)}
        return cut(texts, _a=F.col("_p"), _b=F.col("_w")).withColumns(scores).drop("_a", "_b", "_p", "_w")
    return cut(rows, _a=a, _b=b).withColumns({"rouge_1": rouge_n(x, y, 1), "rouge_2": rouge_n(x, y, 2), "rouge_l": rouge_l(a, b), "bleu_4": bleu_4(a, b)}).drop("_a", "_b")


def means(scored: DataFrame, *keys: str) -> DataFrame:
    """Mean of each score, over the rows that have it."""
    return scored.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu_4")])
