"""Language-model scoring by deleted interpolation of bigram, unigram and uniform estimates.

p(w | v) = l2[b] c(v w) / c(v) + l1[b] c(w) / N + l0[b] / (V + 1), with b the bucket of the context's frequency c(v).
The weights of each bucket are learned by expectation-maximisation on held-out counts: an eighth of the training documents
(by hash of the id) is deleted from the counts, and the weights are those that make its tokens likeliest under the estimates
of the rest. Scores then use the counts of all training documents. Bigrams are the longest context: the text's trigrams are
as many as its tokens nearly, and would double what is exchanged.

Texts are cut into chunks of whole documents; each chunk is stored once with its tokens as local word numbers. Chunks
then ask for counts: for every distinct word and bigram of a chunk one key (a 64-bit hash) with the chunk's own
counts goes to the key's range, is summed there over all chunks, and what the others have returns to the chunk. So a frequent word or
pair costs each chunk one key, however often it occurs, and no table of counts is collected or broadcast. A chunk sends a row
to each of ``FAN`` ranges at most; if that many ranges are too large, the chunks of a range are merged into bundles, which ask again in
finer ranges (``answered``), so that rows grow with the input, not with its square. Two keys of one hash would share
their counts: of 10^9 distinct keys one pair is expected to in 37 tables, of 10^12 some 27,000 pairs do.
For the weights, chunks count held-out tokens in a fixed grid of log-ratios (half octaves) of the three estimates; a cell keeps
the mean ratios of its tokens, and a test sets the weights beside those of exact expectation-maximisation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Text bytes in a chunk, per range of keys and per task of a shuffle.
CHUNK, BUCKET, TASK = 8 << 20, 16 << 20, 64 << 20
#: Ranges that a chunk or bundle sends rows to (least and most), and the keys of a bundle.
LEAST_FAN, FAN, BUNDLE = 64, 256, 4 << 20
#: Context-frequency buckets: 0, then 1 + floor(log2 c(v)), the last for all above.
CONTEXTS, ROUNDS = 25, 60
#: One training document of so many is deleted from the counts that the weights are learnt by.
DELETED = 8
#: Weights where no held-out token says otherwise.
START_WEIGHTS = np.array([0.4, 0.5, 0.1])
#: Hashes of the end token and of the context before a first word: words hold no blank, so none has these strings.
END, START = (np.uint64(xxhash.xxh64_intdigest(s, 42)) for s in (b" end", b" start"))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def packed(numbers: np.ndarray, kind) -> bytes:
    return zstandard.compress(numbers.astype(kind).tobytes(), 1)


def unpacked(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def packed_keys(keys: np.ndarray) -> bytes:
    """Of sorted keys: differences, byte by byte in planes, so that those of the high bytes vanish."""
    return zstandard.compress(np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpacked(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


CHUNKS = "chunk long, bytes long, doc_id array<long>, held binary, length binary, token binary, word binary"


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of CHUNKS: a chunk's documents, with tokens numbered by the chunk's words; number 0 is the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        ids, held, lengths, flat, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal made, ids, held, lengths, flat, size
            number = dict.fromkeys(flat)
            number.pop(b"", None)
            for i, w in enumerate(number):
                number[w] = i + 1
            own = np.array([END, *(xxhash.xxh64_intdigest(w, 42) for w in number)], np.uint64)
            number[b""] = 0
            token = np.fromiter(map(number.__getitem__, flat), np.uint32, len(flat))
            row = [[first + made], [size], [ids], [np.array(held, np.uint8).tobytes()], [np.array(lengths, np.uint32).tobytes()], [packed(token, np.uint32)], [own.tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            made, ids, held, lengths, flat, size = made + 1, [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], [c.split()[0] for c in CHUNKS.split(", ")])

        for b in batches:
            for key, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                text = text.as_py()
                own = words(text)
                ids.append(key)
                held.append(out)
                lengths.append(len(own) + 1)
                flat += own
                flat.append(b"")  # the end
                size += len(text or "")
                if size >= CHUNK:
                    yield flush()
        if ids:
            yield flush()

    own = docs.select(F.col("doc_id").cast("long"), "text")
    deleted = F.pmod(F.xxhash64("doc_id"), F.lit(DELETED)) == 0
    use = F.when(common.remainder("doc_id", 10) == 0, 1).when(deleted, 2).otherwise(0)  # not trained on; deleted; kept
    return common.spread(own).select("doc_id", use.alias("held"), "text").mapInArrow(run, CHUNKS)


class Chunk:
    """Local view of a chunk: pairs of (context, word) with hashes, and their counts (in training, and deleted ones)."""

    def __init__(self, held: bytes, length: bytes, token: bytes, own: np.ndarray):
        use, self.length = np.frombuffer(held, np.uint8), np.frombuffer(length, np.uint32).astype(np.int64)
        tokens = unpacked(token, np.uint32).astype(np.int64)
        self.held = use == 1
        self.start = np.cumsum(self.length) - self.length
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.start] = len(own)
        self.word = np.append(own, START)
        pairs, self.pair_of_token = np.unique(before * len(self.word) + tokens, return_inverse=True)
        self.left, self.right = pairs // len(self.word), pairs % len(self.word)
        self.n_pair, self.n_word = self.counts(use != 1)
        self.m_pair, self.m_word = self.counts(use == 2)

    def counts(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs, and of words (the last is the start), in some of the documents."""
        pair = np.bincount(self.pair_of_token[np.repeat(documents, self.length)], minlength=len(self.left))
        word = np.bincount(self.right, pair, minlength=len(self.word)).astype(np.int64)
        word[-1] = documents.sum()
        return pair, word

    def keys(self, kind: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and the chunk's counts: of words (kind 0, the last is the start) or of pairs (1)."""
        if kind == 0:
            return self.word, self.n_word, self.m_word
        with np.errstate(over="ignore"):
            x = self.word[self.left] * np.uint64(0x9E3779B97F4A7C15) + self.word[self.right]
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31), self.n_pair, self.m_pair


def ranges(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each key, of ``n`` (at most 2^32) equal ones."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


ASKED = "kind long, bucket long, unit long, keys binary, n binary, m binary"


def asks(kind: int, unit: int, keys: np.ndarray, n: np.ndarray, m: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Rows of ASKED of a unit (a chunk or a bundle) with sorted keys: one for each range that it has keys in."""
    bucket = ranges(keys, buckets)
    at = common.runs(bucket).tolist()
    rows = [(kind, int(bucket[a]), unit, packed_keys(keys[a:b]), packed(n[a:b], np.int64), packed(m[a:b], np.int64)) for a, b in zip(at, at[1:], strict=False) if b > a]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, [pa.int64()] * 3 + [pa.binary()] * 3, strict=True)], [c.split()[0] for c in ASKED.split(", ")])


def asked(chunks: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                own = Chunk(r["held"], r["length"], r["token"], np.frombuffer(r["word"], np.uint64))
                for kind in (0, 1):
                    keys, n, m = own.keys(kind)
                    order = np.argsort(keys)
                    yield asks(kind, r["chunk"], keys[order], n[order], m[order], buckets)

    return chunks.select("chunk", "held", "length", "token", "word").mapInArrow(run, ASKED)


def groups(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches by key, one after the other."""
    rows = (r for b in batches for r in b.to_pylist())
    return groupby(rows, lambda r: tuple(r[k] for k in key))


def merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct keys of some ASKED rows, the sums of their two counts, and where each row's keys are among them."""
    keys = [unpacked_keys(r["keys"]) for r in rows]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    sums = []
    for c in ("n", "m"):
        total = np.zeros(len(every), np.int64)
        np.add.at(total, place, np.concatenate([unpacked(r[c], np.int64) for r in rows]))
        sums.append(total)
    return every, *sums, np.split(place, np.cumsum([len(k) for k in keys])[:-1])


ANSWER = "kind long, bucket long, unit long, n binary, m binary"


def table_of(rows: list[tuple], columns: str) -> pa.RecordBatch:
    kinds = [pa.binary() if c.endswith("binary") else pa.int64() for c in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], [c.split()[0] for c in columns.split(", ")])


def width(spark, size: int) -> int:
    """Tasks of a shuffle of a corpus of so many bytes of text."""
    return max(common.shuffle_width(spark), size // TASK)


def answered(requests: DataFrame, size: int, buckets: int) -> tuple[DataFrame, list[str]]:
    """Rows of ANSWER: for each row asked the sums of its keys over all units, less its own, in the order asked; under unit -1 a
    range's tokens and words (in training, and those kept). And the scratch tables behind it.

    Where a range would hold more than ``BUCKET`` bytes' worth of text, the units of a range are merged into bundles of about ``BUNDLE`` keys,
    which are the units of the next exchange, of ``FAN`` times as many ranges.
    """
    spark = requests.sparkSession
    dealt = requests.repartition(width(spark, size), "kind", "bucket").sortWithinPartitions("kind", "bucket", "unit")
    if buckets * BUCKET >= size:

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (kind, bucket), group in groups(batches, "kind", "bucket"):
                rows = list(group)
                every, n, m, place = merged(rows)
                out = [(kind, bucket, r["unit"], packed(n[p] - unpacked(r["n"], np.int64), np.int64), packed(m[p] - unpacked(r["m"], np.int64), np.int64)) for r, p in zip(rows, place, strict=True)]
                if kind == 0:
                    own = every != START
                    out.append((0, bucket, -1, packed(np.array([n[own].sum(), (n[own] > 0).sum()]), np.int64), packed(np.array([m[own].sum(), 0]), np.int64)))
                yield table_of(out, ANSWER)

        return dealt.mapInArrow(answer, ANSWER), []

    bundle = "kind long, bucket long, unit long, bundle long, keys binary, n binary, m binary, place binary"

    def bundled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        for (kind, bucket), group in groups(batches, "kind", "bucket"):
            rows, held = [], 0

            def flush(kind=kind, bucket=bucket) -> pa.RecordBatch:
                nonlocal made, rows, held
                every, n, m, place = merged(rows)
                out = [(kind, bucket, -1, made, packed_keys(every), packed(n, np.int64), packed(m, np.int64), None)]
                out += [(kind, bucket, r["unit"], made, None, r["n"], r["m"], packed(p, np.uint32)) for r, p in zip(rows, place, strict=True)]
                made, rows, held = made + 1, [], 0
                return table_of(out, bundle)

            for r in group:
                rows.append(r)
                held += len(unpacked(r["n"], np.int64))
                if held >= BUNDLE:
                    yield flush()
            if rows:
                yield flush()

    bundles, at = common.materialise(dealt.mapInArrow(bundled, bundle), "lm-bundles")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield asks(r["kind"], r["bundle"], unpacked_keys(r["keys"]), unpacked(r["n"], np.int64), unpacked(r["m"], np.int64), buckets * FAN)

    finer, paths = answered(bundles.where("unit = -1").select("kind", "bundle", "keys", "n", "m").mapInArrow(ask, ASKED), size, buckets * FAN)
    finer, at_finer = common.materialise(finer, "lm-answers")
    blank = lambda *names: [F.lit(None).cast("binary").alias(c) for c in names]
    parts = finer.where("unit >= 0").select(F.col("unit").alias("bundle"), "kind", F.lit(0).alias("step"), F.col("bucket"), F.lit(-1).cast("long").alias("unit"), "n", "m", *blank("place"))
    whole = bundles.where("unit = -1").select("bundle", "kind", F.lit(1).alias("step"), "bucket", "unit", "n", "m", "place")
    members = bundles.where("unit >= 0").select("bundle", "kind", F.lit(2).alias("step"), "bucket", "unit", "n", "m", "place")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups(batches, "bundle"):
            got: dict[str, list] = {"n": [], "m": []}
            total: dict[str, np.ndarray] = {}
            for r in group:
                if r["step"] == 0:
                    for c in got:
                        got[c].append(unpacked(r[c], np.int64))
                elif r["step"] == 1:
                    total = {c: np.concatenate(got[c]) + unpacked(r[c], np.int64) for c in got}
                else:
                    p = unpacked(r["place"], np.uint32)
                    yield table_of([(r["kind"], r["bucket"], r["unit"], *(packed(total[c][p] - unpacked(r[c], np.int64), np.int64) for c in ("n", "m")))], ANSWER)

    met = parts.unionByName(whole).unionByName(members).repartition(width(spark, size), "bundle").sortWithinPartitions("bundle", "step", "bucket", "unit")
    return met.mapInArrow(back, ANSWER).unionByName(finer.where("unit = -1")), [at, at_finer, *paths]


COUNTED = "doc_id array<long>, held binary, length binary, token binary, n_word binary, m_word binary, n_pair binary, m_pair binary"


def counted(chunks: DataFrame, answers: DataFrame, size: int) -> DataFrame:
    """Rows of COUNTED: chunks with the other chunks' counts of their words and pairs, without the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups(batches, "chunk"):
            got: dict[tuple[int, str], list] = {(kind, c): [] for kind in (0, 1) for c in ("n", "m")}
            for r in group:
                if r["kind"] < 2:  # sorted by range, so by key
                    for c in ("n", "m"):
                        got[r["kind"], c].append(unpacked(r[c], np.int64))
                    continue
                own, counts = Chunk(r["held"], r["length"], r["token"], np.frombuffer(r["word"], np.uint64)), []
                for kind in (0, 1):
                    order = np.argsort(own.keys(kind)[0])
                    for c in ("n", "m"):
                        n = np.empty(len(order), np.int64)
                        n[order] = np.concatenate(got.pop((kind, c)))
                        counts.append(packed(n, np.int64))
                row = [r["doc_id"], r["held"], r["length"], r["token"], *counts]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.list_(pa.int64()) if isinstance(v, list) else None) for v in row], [c.split()[0] for c in COUNTED.split(", ")])

    blank = [F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in CHUNKS.split(", ")[1:]]
    replies = answers.where("unit >= 0").select(F.col("unit").alias("chunk"), "kind", "bucket", "n", "m", *blank)
    asking = chunks.select("chunk", F.lit(2).cast("long").alias("kind"), F.lit(0).cast("long").alias("bucket"), *(F.lit(None).cast("binary").alias(c) for c in ("n", "m")), *(c.split()[0] for c in CHUNKS.split(", ")[1:]))
    dealt = replies.unionByName(asking).repartition(width(chunks.sparkSession, size), "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    return dealt.mapInArrow(run, COUNTED)


class Counts(Chunk):
    """A chunk with the corpus' counts of each pair's context, word and the pair itself, in training and deleted ones."""

    def __init__(self, r: dict):
        n = unpacked(r["n_word"], np.int64)
        super().__init__(r["held"], r["length"], r["token"], np.zeros(len(n) - 1, np.uint64))
        n, m = n + self.n_word, unpacked(r["m_word"], np.int64) + self.m_word
        self.context, self.single, self.both = n[self.left], n[self.right], unpacked(r["n_pair"], np.int64) + self.n_pair
        self.kept = self.context - m[self.left], self.single - m[self.right], self.both - unpacked(r["m_pair"], np.int64) - self.m_pair


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), CONTEXTS - 1), 0)


def estimates(context, single, both, n: int, v: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Bigram and unigram estimates, 0 where there is none, and the uniform one."""
    return both / np.maximum(context, 1), single / max(n, 1), 1 / (v + 1)


def grid(rows: DataFrame, n: int, v: int) -> list:
    """Deleted tokens under the estimates of the ``n`` that are kept: (context bucket, half octaves of the ratios to the uniform estimate, -1000 for 0) -> tokens, summed ratios."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: dict[int, np.ndarray] = {}
        for b in batches:
            for r in b.to_pylist():
                c = Counts(r)
                k = c.m_pair > 0
                context, single, both = (x[k] for x in c.kept)
                bucket, w = bucket_of(context), c.m_pair[k]
                two, one, flat = estimates(context, single, both, n, v)
                two, one = two / flat, one / flat
                half = [np.where(x > 0, np.clip(np.round(2 * np.log2(np.maximum(x, 1e-30))), -200, 200) + 201, 0).astype(np.int64) for x in (two, one)]
                every, at = np.unique((bucket * 512 + half[0]) * 512 + half[1], return_inverse=True)
                sums = np.stack([np.bincount(at, w), np.bincount(at, w * two), np.bincount(at, w * one)], 1)
                for cell, s in zip(every.tolist(), sums, strict=True):
                    cells[cell] = cells[cell] + s if cell in cells else s
        got = np.array(list(cells.values())).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(list(cells), pa.int64()), *(pa.array(got[:, i]) for i in range(3))], ["cell", "n", "two", "one"])

    part = rows.drop("doc_id").mapInArrow(run, "cell long, n double, two double, one double")
    return part.groupBy("cell").agg(F.sum("n"), F.sum("two"), F.sum("one")).orderBy("cell").collect()  # the grid is fixed; a few thousand cells are in use


def weights(cells: list) -> np.ndarray:
    """(context bucket, [l2, l1, l0]) by expectation-maximisation over the grid; buckets without tokens take the sum of all."""
    every = np.array([list(c) for c in cells], float).reshape(-1, 4)
    bucket, n = every[:, 0].astype(np.int64) >> 18, every[:, 1]
    ratio = np.stack([every[:, 2] / n, every[:, 3] / n, np.ones(len(n))], 1) if len(n) else np.zeros((0, 3))

    def learnt(at: np.ndarray) -> np.ndarray:
        lam = START_WEIGHTS
        for _ in range(ROUNDS):
            part = ratio[at] * lam
            lam = (n[at, None] * part / part.sum(1, keepdims=True)).sum(0) / n[at].sum()
            lam = np.maximum(lam, 1e-9)  # none may vanish: unseen words need the last
            lam /= lam.sum()
        return lam

    out = np.zeros((CONTEXTS, 3))
    for b in range(CONTEXTS):
        at = bucket == b if (bucket == b).any() else np.ones(len(n), bool)
        out[b] = learnt(at) if at.any() else START_WEIGHTS
        if b == 0:  # a context that is not there has no bigrams
            out[b] = np.array([0, *out[b][1:]]) / out[b][1:].sum()
    return out


def probability(c, lam: np.ndarray, n: int, v: int) -> np.ndarray:
    two, one, flat = estimates(c.context, c.single, c.both, n, v)
    own = lam[bucket_of(c.context)]
    return own[:, 0] * two + own[:, 1] * one + own[:, 2] * flat


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def model(docs: DataFrame) -> tuple[DataFrame, int, int, np.ndarray]:
    """Chunks with counts, tokens and words in training, and the weights."""
    spark = docs.sparkSession
    chunks, at_chunks = common.materialise(chunked(docs), "lm-chunks")
    size = chunks.agg(F.sum("bytes")).first()[0] or 0
    buckets = min(FAN, max(LEAST_FAN, size // BUCKET + 1))
    answers, paths = answered(asked(chunks, buckets), size, buckets)
    answers, at_answers = common.materialise(answers, "lm-answers")
    common.discard(spark, *paths)
    two = F.udf(lambda x: [int(i) for i in unpacked(x, np.int64)], "array<long>")  # of one row for each range
    sums = answers.where("unit < 0").select(two("n").alias("n"), two("m").alias("m")).select(*(F.sum(F.get(c, F.lit(i))) for c, i in (("n", 0), ("n", 1), ("m", 0)))).first()
    n, v, deleted = (int(x or 0) for x in sums)
    rows, _ = common.materialise(counted(chunks, answers, size), "lm-counted")
    common.discard(spark, at_chunks, at_answers)
    return rows, n, v, weights(grid(rows, n - deleted, v)) if n else np.tile([0.0, 0.0, 1.0], (CONTEXTS, 1))


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document.

    Null texts are empty ones: the end token alone. Null ids stay, with the checksum of no bytes deciding
    held_out; repeated rows count and are scored each; other columns are ignored; an empty table gives no rows. Very long texts are
    a chunk of their own. Without a token to learn from,
    every token has probability 1 / (V + 1) = 1.
    """
    rows, n, v, lam = model(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                c = Counts(r)
                per_pair = np.stack([np.log10((c.single + 0.1) / (n + 0.1 * (v + 1))), np.log10(probability(c, lam, n, v)), c.single > 0])
                base, score, known = (np.add.reduceat(x[c.pair_of_token], c.start) for x in per_pair)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["doc_id"], pa.int64()), pa.array(c.held), pa.array(c.length), pa.array(known.round().astype(np.int64)), pa.array(np.full(len(c.held), n)), pa.array(base), pa.array(score)],
                    [x.split()[0] for x in OUT.split(", ")],
                )

    return rows.mapInArrow(run, OUT)


def op6_lm(spark, sf_dir: str) -> DataFrame:
    return scored(common.table(spark, sf_dir, "documents"))
