"""Toxicity by compression distance: windows of running text are compressed with a toxic and an ordinary dictionary.

A window is ``size`` words of the lower-cased text, every ``step`` words. Its gain is the number of bytes by which it is
shorter under the toxic dictionary than under the ordinary one. Both dictionaries are trained by Zstandard's own trainer on
windows of labelled documents. As a toxic document is mostly ordinary text, training goes in rounds: with the dictionaries so far,
the windows of toxic documents that gain most train the next part of the toxic dictionary, and the windows of ordinary
documents that gain most train the next part of the ordinary one. The toxic compressor has the ordinary dictionary
beside its own, the ordinary one as many bytes of noise instead, so that gains come from the toxic part alone.

A document's threshold is calibrated on rows kept aside: logistic regression on the sums of its 1, 4 and 16 largest gains
and on the logarithm of its number of windows (the more windows, the larger the largest by chance).

Dictionaries and thresholds are fitted on a bounded sample: at most ``MOST_TOXIC`` and ``MOST_ORDINARY`` labelled
documents, by order of a hash of the id, at most ``FIRST`` windows of each (by hash) in the first round and
``TAKEN`` in the others, and none of over ``LONGEST`` bytes. All documents are scored, over whole texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import means

MOST_TOXIC, MOST_ORDINARY = 4000, 8000
#: Ranks are taken within so many bits of the hash, so that no task ranks a whole class.
SLOT_BITS = 16
#: Words in a window, and from one window to the next.
SIZE, STEP = 24, 12
#: Windows of a document that may train a dictionary: of either kind at first, of toxic and of ordinary ones in a later round.
FIRST, TAKEN, LONGEST = 64, (8, 16), 4096
ROUNDS, LEVEL = 9, 6
#: Rounds whose toxic parts make the toxic dictionary: the last so many. Of the ordinary one all stay.
KEPT = 4
#: Most bytes that a round adds to the toxic and to the ordinary dictionary; segments and d-mers of the trainer.
TOXIC, ORDINARY, SEGMENT, DMER = 8192, 131_072, 16, 6
#: Bytes of text, and windows, that are compressed by one call.
GROUP, CALL = 4 << 20, 65_536
#: A text of one window follows so many bytes that both dictionaries end with; alone it could be too short to be compressed.
CARRIER = 64
TOPS = (1, 4, 16)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def windows(data: bytes, size: int = SIZE, step: int = STEP) -> np.ndarray:
    """(start, length) of each window: every ``step`` words, the last one at the text's end; all of it if it has fewer words."""
    gap = np.concatenate([[True], BLANK[np.frombuffer(data, np.uint8)], [True]])
    first, end = np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])
    last = max(0, len(first) - size)
    at = np.append(np.arange(0, last, step), last) if len(first) else np.zeros(0, np.int64)
    return np.stack([first[at], end[np.minimum(at + size, len(first)) - 1] - first[at]], 1).reshape(-1, 2)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    words.precompute_compress(level=LEVEL)
    bare = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=words, compression_params=bare)


def lengths(by: zstandard.ZstdCompressor, data: bytes, spans: np.ndarray) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for a in range(0, len(spans), CALL):
        part = np.ascontiguousarray(spans[a : a + CALL], np.uint64)
        out.append(np.fromiter(map(len, by.multi_compress_to_buffer(zstandard.BufferWithSegments(data, part.tobytes()))), np.int64, len(part)))
    return np.concatenate(out)


class Scorer:
    """Gains of windows under a pair of dictionaries, and with calibrated weights the score of a text."""

    def __init__(self, toxic: bytes, ordinary: bytes, size: int = SIZE, step: int = STEP, weight: np.ndarray | None = None):
        self.size, self.step, self.weight, self.carrier = size, step, weight, ordinary[-CARRIER:] + b" "
        noise = np.random.default_rng(0).integers(0, 256, len(toxic), np.uint8).tobytes()
        self.by = [compressor(x + ordinary) for x in (noise, toxic)]

    def gains(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and gains of each lower-cased text; texts are compressed in groups of about GROUP bytes."""
        group, held = [], 0
        for text in texts:
            group.append(text)
            held += len(text)
            if held >= GROUP:
                yield from self._group(group)
                group, held = [], 0
        yield from self._group(group)

    def _group(self, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts, spans, places, at = [], [], [], 0
        for text in texts:
            own = windows(text, self.size, self.step)
            if len(own) == 1:
                text = self.carrier + text
                place = np.array([[at, len(text)]])
            else:
                place = own + [at, 0]
            parts.append(text)
            spans.append(own)
            places.append(place)
            at += len(text)
        if not at:
            yield from ((s, np.zeros(0, np.int64)) for s in spans)
            return
        data, place = b"".join(parts), np.concatenate(places)
        gain = lengths(self.by[0], data, place) - lengths(self.by[1], data, place)
        yield from zip(spans, np.split(gain, np.cumsum([len(s) for s in spans])[:-1]), strict=True)

    def features(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: 1, the sums of its largest gains (none below 0), and the logarithm of its windows."""
        rows = []
        for _, gain in self.gains(prepared(texts)):
            top = np.sort(gain)[: -TOPS[-1] - 1 : -1].clip(0)
            rows.append([1.0, *(top[:k].sum() for k in TOPS), np.log1p(len(gain))])
        return np.array(rows, float).reshape(-1, len(TOPS) + 2)

    def score(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.features(texts) @ self.weight)


def prepared(texts: pa.Array) -> list[bytes]:
    return [(t.as_py() or "").encode().translate(LOWER) for t in texts]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


@lru_cache(maxsize=2)
def scorer(packed: bytes) -> Scorer:
    return Scorer(*pickle.loads(packed))


def trained(samples: list[bytes], size: int, segment: int = 0) -> bytes:
    """A dictionary of at most ``size`` bytes by Zstandard's trainer; samples too few for it stand as they are."""
    samples = sorted(set(samples))
    size = min(size, max(256, sum(map(len, samples)) // 4))
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=DMER if segment else 0).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


def mined(rows: DataFrame, pair: bytes | None, size: int, step: int) -> dict[float, list[bytes]]:
    """Windows by label that train the next dictionaries: without a pair those of the least hashes, else those that gain most."""

    def chosen(text: bytes, y: float, spans: np.ndarray, gain: np.ndarray | None) -> list[bytes]:
        short = np.flatnonzero(spans[:, 1] <= LONGEST) if len(spans) else []
        if not len(short):
            return []
        if gain is None:
            own = {text[a : a + n] for a, n in spans[short].tolist()}
            return sorted(own, key=lambda w: (xxhash.xxh64_intdigest(w, 42), w))[:FIRST]
        # Of a toxic document only what gains about most speaks of toxicity; of an ordinary one any gain is an error.
        least = max(1, gain[short].max() - 1) if y else 1
        best = short[np.argsort(-gain[short], kind="stable")][: TAKEN[0 if y else 1]]
        return [text[a : a + n] for a, n in spans[best[gain[best] >= least]].tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ys = prepared(b.column(0)), b.column(1).to_pylist()
            measured = ((windows(t, size, step), None) for t in texts) if pair is None else scorer(pair).gains(texts)
            out = [(y, w) for t, y, (spans, gain) in zip(texts, ys, measured, strict=True) for w in chosen(t, y, spans, gain)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], pa.binary())], ["y", "window"])

    got = rows.select("text", "y").mapInArrow(run, "y double, window binary").distinct().collect()  # bounded by the sample's size and FIRST or TAKEN windows of each
    return {y: [bytes(r.window) for r in got if r.y == y] for y in (0.0, 1.0)}


def last_slot(slots: list, y: float, most: int) -> tuple[int, int]:
    """The slot of hash order in which the first ``most`` rows of a class end, and how many of its rows they take."""
    slot, left = 0, most
    for slot, n in sorted((r.slot, r["count"]) for r in slots if r.y == y):
        if n >= left:
            return slot, left
        left -= n
    return slot, most


def sample(docs: DataFrame, labels: DataFrame, column: str) -> tuple[DataFrame, str]:
    """(text, y, weight, aside) of a bounded sample of the labelled documents that may be learnt from.

    Of rows that repeat an id, the text of the least hash stands for it. Ties of the order are broken by the id."""
    order = F.xxhash64("doc_id")
    known = means(labels, column).select("doc_id", (F.col("y") >= 0.5).cast("double").alias("y"), F.shiftright(order, 64 - SLOT_BITS).alias("slot"))
    slots = known.groupBy("y", "slot").count().collect()  # at most 2 << SLOT_BITS rows
    total = {y: sum(r["count"] for r in slots if r.y == y) for y in (0.0, 1.0)}
    # Rows of the slots before the last are all in; only in the last one do ranks decide.
    toxic, ordinary = last_slot(slots, 1.0, MOST_TOXIC), last_slot(slots, 0.0, MOST_ORDINARY)
    edge, rest = (F.when(F.col("y") == 1, toxic[i]).otherwise(ordinary[i]) for i in range(2))
    top = Window.partitionBy("y", "slot").orderBy(order, "doc_id")
    kept = known.where(F.col("slot") <= edge).withColumn("_n", F.row_number().over(top)).where((F.col("slot") < edge) | (F.col("_n") <= rest))
    weight = F.when(F.col("y") == 1, max(1.0, total.get(1.0, 0) / MOST_TOXIC)).otherwise(max(1.0, total.get(0.0, 0) / MOST_ORDINARY))
    chosen = kept.select("doc_id", "y", weight.alias("weight"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).alias("aside"))
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    met = own.join(F.broadcast(chosen), "doc_id")  # at most MOST_TOXIC + MOST_ORDINARY rows are broadcast
    one = met.groupBy("doc_id", "y", "weight", "aside").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return common.materialise(common.spread(one.select("text", "y", "weight", "aside")), "toxicity-sample")


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method on standardised columns; the first column is 1."""
    mean, scale = x.mean(0), x.std(0)
    mean[0], scale[0] = 0, 1
    z = (x - mean) / np.maximum(scale, 1e-6)
    beta = np.zeros(z.shape[1])
    for _ in range(50):
        p = sigmoid(z @ beta)
        step = np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)), z.T @ (w * (y - p)) - ridge * beta)
        beta += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
    out = beta / np.maximum(scale, 1e-6)
    out[0] -= (out * mean)[1:].sum()
    return out


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", size: int = SIZE, step: int = STEP) -> bytes | None:
    """Pickled arguments of a Scorer; None if there is no toxic or no ordinary document to learn from."""
    rows, path = sample(docs, labels, column)
    train = rows.where("NOT aside")
    n = {r.y: r["count"] for r in train.groupBy("y").count().collect()}
    if len(n) < 2:
        common.discard(rows.sparkSession, path)
        return None
    found = mined(train, None, size, step)
    pair = (trained(found[1.0], TOXIC, SEGMENT), trained(found[0.0], ORDINARY), size, step)
    for _ in range(ROUNDS):
        found = mined(train, pickle.dumps(pair), size, step)
        toxic, ordinary = (trained(found[1.0], TOXIC, SEGMENT) if found[1.0] else b""), (trained(found[0.0], ORDINARY) if found[0.0] else b"")
        pair = ((pair[0] + toxic)[-KEPT * TOXIC :], pair[1] + ordinary, size, step)
    bare = pickle.dumps(pair)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        return pa.array(list(scorer(bare).features(texts)), pa.list_(pa.float64()))

    aside = rows.where("aside")
    if {r.y for r in aside.select("y").distinct().collect()} != {0.0, 1.0}:
        aside = rows  # too few to keep any aside
    tried = aside.select(features("text").alias("x"), "y", "weight").collect()  # a quarter of the sample
    tried.sort(key=lambda r: (r.x, r.y))
    weight = logistic(np.array([r.x for r in tried]), *(np.array([r[k] for r in tried]) for k in ("y", "weight")))
    common.discard(rows.sparkSession, path)
    return pickle.dumps((*pair, weight))


def scored(model: bytes | None, text: Column) -> Column:
    """Calibrated score; without a model every document scores 0."""
    if model is None:
        return F.lit(0.0)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(scorer(model).score(texts))

    return score(text)


def classified(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``.

    Null texts count as empty; a text without words has no window and gets the score of no gain. Very long texts are cut into windows
    whole, 65,536 at a call. Null ids are kept, held out by the checksum of no bytes, and never labelled; repeated rows stay and score alike; other columns
    are ignored; an empty table gives no rows. Without labels of both classes every score is 0.
    """
    model = fit(docs, labels, column)
    score = common.spread(docs.select("doc_id", "text")).select("doc_id", scored(model, F.col("text")).alias("score"))
    return score.select("doc_id", (common.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, column: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns.

    Rows are judged each by its own text, as in ``classified``: null and empty texts and null ids are judged too, repeated rows share their
    fate, other columns stay, an empty table gives no rows. Without labels of both classes all rows stay.
    """
    return common.spread(docs).where(scored(fit(docs, labels, column), F.col("text")) < threshold)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return classified(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
