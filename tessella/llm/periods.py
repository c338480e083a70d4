"""Periodic runs of words: stretches that repeat with a smallest period, found by heavy/light lag counting.

A run of period q has at least q words that equal the word q further on. So for each text first the matches at every lag are counted,
exactly: of frequent (heavy) words by the autocorrelation of their places through a fast Fourier transform, of rare (light) ones by the differences
of all pairs of places; a word is heavy where its pairs would outnumber the transform's steps. Only lags with enough matches are scanned for islands,
that is, unbroken matches. A scan looks at every q-th word, since an island that is long enough has one of them, and walks on from those
that match. Lags come in ascending order: an island within a known run whose period divides the lag is no run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A run has at least so many words, and twice its period.
LEAST = 12
#: Below this lag all words are compared at once.
NEAR = 16


def lag_matches(codes: np.ndarray) -> np.ndarray:
    """How many words equal the one q further on, for q of 0 (left 0) to half of the words."""
    n = len(codes)
    most = n // 2
    order = np.argsort(codes, kind="stable")
    cut = common.runs(codes[order])
    count = np.diff(cut)
    heavy = count * count > n * np.log2(n + 1) * 4
    total = np.zeros(most + 1, np.int64)
    if heavy.any():
        size = 1 << int(n + most).bit_length()
        power, mark = np.zeros(size // 2 + 1), np.empty(n)
        for g in np.flatnonzero(heavy).tolist():
            mark[:] = 0
            mark[order[cut[g] : cut[g + 1]]] = 1
            f = np.fft.rfft(mark, size)
            power += f.real**2 + f.imag**2
        total += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        total[0] = 0
    group = np.repeat(np.arange(len(count)), count)
    last = cut[1:][group] - 1  # place of the word's last occurrence in the order
    at = np.flatnonzero(~heavy[group] & (last > np.arange(n)))
    k = 1
    while len(at):
        far = order[at + k] - order[at]
        total += np.bincount(far[far <= most], minlength=most + 1)
        at, k = at[(far < most) & (last[at] > at + k)], k + 1
    return total


def walked(codes: np.ndarray, at: int, lag: int, step: int) -> int:
    """The end of the unbroken matches from ``at`` to the right (step 1), or their start to the left (-1)."""
    size, stop = 16, len(codes) - lag
    while 0 <= at < stop if step > 0 else at > 0:
        s, e = (at, min(stop, at + size)) if step > 0 else (max(0, at - size), at)
        differ = codes[s:e] != codes[s + lag : e + lag]
        if differ.any():
            return s + int(differ.argmax()) if step > 0 else e - int(differ[::-1].argmax())
        at, size = (e, size * 2) if step > 0 else (s, size * 2)
    return at


def runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ``codes`` number the words, equal ones alike."""
    n = len(codes)
    if n < LEAST:
        return []
    lags = np.arange(n // 2 + 1)
    lags = np.flatnonzero((lag_matches(codes) >= np.maximum(LEAST - lags, lags)) & (lags > 0)).tolist()
    known: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # starts and ends of the runs of a period, both ascending

    def within(places: np.ndarray, ends: np.ndarray, lag: int) -> np.ndarray:
        """Which [place, end) lie in a known run whose period divides the lag."""
        out = np.zeros(len(places), bool)
        for period, (s, e) in known.items():
            if lag % period == 0:
                i = np.searchsorted(s, places, "right") - 1
                out |= (i >= 0) & (ends <= e[i])
        return out

    for q in lags:
        least = max(LEAST - q, q)
        found: list[tuple[int, int]] = []
        if q < NEAR:
            same = np.zeros(n - q + 2, np.int8)
            same[1:-1] = codes[:-q] == codes[q:]
            edge = np.flatnonzero(np.diff(same))
            s, e = edge[::2], edge[1::2]
            own = e - s >= least
            s, e = s[own], e[own]
            own = ~within(s, e + q, q)
            found = list(zip(s[own].tolist(), e[own].tolist(), strict=True))
        else:
            places = np.arange(0, n - q, q)
            places = places[codes[places] == codes[places + q]]
            places = places[~within(places, places + q + 1, q)]
            done = 0
            for at in places.tolist():
                if at < done:
                    continue
                done = walked(codes, at, q, 1)
                s = walked(codes, at, q, -1)
                if done - s >= least:
                    found.append((s, done))
        if found:
            s, e = np.array(found).T
            known[q] = s, e + q
    return sorted((int(s), int(e - s), q) for q, (starts, ends) in known.items() for s, e in zip(starts, ends, strict=True))


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without its text, and with runs (array of start, length, period, by start and period) and collapsed, the text's words without
    those that any run repeats after its first period, joined by blanks; columns of these two names are replaced.

    Words are parted by the six ASCII blanks. Null and empty texts have no words: no runs and an empty text. Each row is its own; repeated rows
    repeat, an empty table gives none. A very long text is whole in one task's memory (some 100 bytes a word); its time grows as n log n and the matches
    looked at, at worst, for texts that miss being periodic by single words, with the square of n.
    """
    own = [c for c in docs.columns if c not in (text, "runs", "collapsed")]
    schema = docs.select(*own).withColumns({"runs": F.lit(None).cast("array<struct<start:bigint,length:bigint,period:bigint>>"), "collapsed": F.lit("")}).schema
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values, texts = [0], [], []
            for x in b.column(text).cast(pa.binary()).to_pylist():
                words = (x or b"").split()
                found = runs(numbered(words)) if len(words) >= LEAST else []
                values += found
                at.append(len(values))
                if found:
                    drop = np.zeros(len(words) + 1, np.int64)
                    for s, length, q in found:
                        drop[s + q] += 1
                        drop[s + length] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]
                texts.append(b" ".join(words))
            table = np.array(values, np.int64).reshape(-1, 3)
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(c) for c in table.T.copy()], fields=list(kind.value_type)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), spans, pa.array(texts, pa.binary()).cast(pa.string())], [*own, "runs", "collapsed"])

    return docs.select(*own, text).mapInArrow(run, schema)


def rewritten(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The text, of every tenth id by checksum with its words from some place on repeated with some period, 3 to 10 times. Null ids keep their text."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    words = F.expr(rf"regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+', 0)")
    state = F.struct(words.alias("w"), F.floor(h / 10).cast("long").alias("g"))
    placed = F.transform(F.array(state), lambda s: F.struct(s["w"].alias("w"), F.size(s["w"]).cast("long").alias("n"), s["g"].alias("g"), F.pmod(s["g"], F.greatest(F.size(s["w"]), F.lit(1)).cast("long")).alias("a")))
    repeated = F.transform(placed, lambda s: F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % (1 + F.floor((s["n"] - s["a"]) / (3 + s["g"] % 8)))).cast("int")))))
    return F.when(h % 10 == 0, F.array_join(F.get(repeated, 0), " ")).otherwise(F.col(text))


def op13_periods(spark, sf_dir: str) -> DataFrame:
    docs = common.spread(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", rewritten().alias("text"))
    found = collapsed(docs)
    best = F.expr("array_max(transform(runs, r -> named_struct('length', r.length, 'start', -r.start, 'period', -r.period)))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.expr("-_best.start").alias("start"), F.col("_best.length").alias("length"), F.expr("-_best.period").alias("period"),
        F.expr("(1000 * _best.length) div -_best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
