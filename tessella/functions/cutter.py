"""Words of text that is written without blanks: the cut with the largest probability under a dictionary's counts.

A run of letters without a blank is a lattice of the dictionary's words; the best path is found from its end, each word counted by the logarithm of its
share. A dictionary is a table of counts: of spaced text, or learnt from unspaced runs as pieces that hold together.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a dictionary keeps at most: it goes to every task.
MOST = 200_000
#: Scripts without blanks between words, as ranges of a pattern.
UNSPACED = r"㐀-䶿一-鿿぀-ヿ฀-๿"
TOKEN = re.compile(rf"[{UNSPACED}]+|[^\W{UNSPACED}]+|[^\w\s]", re.U)


def spaced(rows: DataFrame, column: str = "text", most: int = MOST) -> DataFrame:
    """(word, n): the ``most`` commonest words of text with blanks, ties by word. Null and empty texts have none."""
    words = rows.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit(r"(?U)\w+"), 0)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most)


def learnt(rows: DataFrame, column: str = "text", longest: int = 4, least: int = 5, bond: float = 8.0, most: int = MOST) -> DataFrame:
    """(word, n): pieces of up to ``longest`` letters of unspaced runs that occur ``least`` times, and in any two parts ``bond`` times as often as chance has it; single letters always.

    Pieces are counted where the texts are; only pieces and counts are shuffled.
    """
    runs = rows.select(F.explode(F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit(rf"[{UNSPACED}]+"), 0)).alias("r"))
    size = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("r")))).alias("k")
    pieces = runs.select("r", size).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("r") - F.col("k") + 1), lambda i: F.substring(F.col("r"), i, F.col("k")))).alias("word"))
    counts = pieces.groupBy("word").agg(F.count("*").alias("n"))
    letters = counts.where(F.length("word") == 1)
    total = letters.agg(F.sum("n").alias("total"))
    often = counts.where((F.length("word") > 1) & (F.col("n") >= least))
    cuts = often.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at")).withColumns({"left": F.substring(F.col("word"), F.lit(1), F.col("at")), "right": F.substring(F.col("word"), F.col("at") + 1, F.length("word"))})
    halves = cuts.join(counts.select(F.col("word").alias("left"), F.col("n").alias("n_left")), "left").join(counts.select(F.col("word").alias("right"), F.col("n").alias("n_right")), "right")
    held = halves.join(F.broadcast(total)).groupBy("word", "n").agg(F.min(F.col("n") * F.col("total") / F.col("n_left") / F.col("n_right")).alias("bond")).where(F.col("bond") >= bond)  # one row broadcast
    return held.select("word", "n").unionByName(letters.select("word", "n")).orderBy(F.desc("n"), "word").limit(most)


class Cutter:
    """A function from text to words, for ``overlap.longest`` and others; runs of spaced scripts stay whole, signs stand alone.

    A letter that is no word of the dictionary counts as a word that occurs once. Of cuts that are equally probable the one with the longer first word is taken.
    """

    def __init__(self, counts: dict[str, int], everywhere: bool = False):
        self.total = math.log(max(1, sum(counts.values())))
        self.share = {w: math.log(n) - self.total for w, n in counts.items() if n > 0 and w}
        self.starts = {w[:i] for w in self.share for i in range(1, len(w))}
        self.everywhere = everywhere  # cut runs of spaced scripts too

    def best(self, run: str) -> list[str]:
        n = len(run)
        worth, to = [0.0] * (n + 1), [0] * n
        for i in range(n - 1, -1, -1):
            worth[i], to[i] = self.share.get(run[i], -self.total) + worth[i + 1], i + 1
            j = i + 1
            while j < n and run[i:j] in self.starts:
                j += 1
                w = self.share.get(run[i:j])
                if w is not None and w + worth[j] >= worth[i]:
                    worth[i], to[i] = w + worth[j], j
        out, i = [], 0
        while i < n:
            out.append(run[i : to[i]])
            i = to[i]
        return out

    def __call__(self, text: str) -> list[str]:
        out: list[str] = []
        for run in TOKEN.findall(text):
            out += self.best(run) if self.everywhere or re.match(rf"[{UNSPACED}]", run) else [run]
        return out


def cutter(dictionary: DataFrame, everywhere: bool = False) -> Callable[[str], list[str]]:
    """A cutter by a dictionary (word, n) of at most MOST words."""
    rows = dictionary.orderBy(F.desc("n"), "word").limit(MOST).collect()
    return Cutter({r.word: r.n for r in rows}, everywhere)


def cut(rows: DataFrame, column: str, by: Callable[[str], list[str]], name: str = "words") -> DataFrame:
    """The rows with ``name``, the words of the column; none for null."""
    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([by(t) if t else [] for t in texts.to_pylist()], pa.list_(pa.string()))

    return rows.withColumn(name, words(F.col(column)))
