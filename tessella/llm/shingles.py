"""Near-duplicates by SimHash and exact similarity of word shingles: Jaccard at least 4/5 over sets of five words.

First the fingerprints of the sets are linked through op5's pivot distance table, and their links are verified on the
whole sets. Sets at the similarity can differ in more bits than any search of 64-bit fingerprints can
afford (their median is six), so prefix filtering finds the rest: under one order of all shingles, two sets that reach the similarity share one of
their first n - ceil(4n/5) + 1. The order is by count: shingles of one set come first (and are of no further use, so a set with enough of
them has no candidates), then those of few; those that a sample of texts repeats come last, by their count there, and are never shuffled
to be counted. Candidates are sets of different components so far that meet under a shingle, unless
their sizes, the shingle's places or their parity bitmaps exclude the similarity (each element flips one of ``BITS`` bits, so
two bitmaps differ in no more bits than the sets in elements). Every candidate is verified on the whole sets, so
the components are those of all pairs at or above
the similarity (but for collisions of 64-bit hashes). A shingle of many sets first gives pairs around four centres;
what these leave in different components is then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

SIZE = 5
#: Bits by which linked fingerprints may differ.
RADIUS = 2
#: Bits of a bitmap, and the count of sets from which shingles rank alike.
BITS, MANY = 512, 1 << 20
#: Texts whose shingles are counted for the order (on average), and the repeated ones that are sent to the tasks.
SAMPLED, REPEATED = 20_000, 262_144
#: Sets of one shingle that are paired at once.
FEW = 8
#: Pairs of one shingle that are made at once.
CUT = 1 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the words' shingles; a text of fewer words is one shingle, an empty one has none."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(b" ".join(words), 42)] if words else [], np.uint64)
    return np.unique(np.array([digest(b" ".join(g), 42) for g in zip(*(words[i:] for i in range(size)))], np.uint64))  # noqa: B905


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard of two sorted sets is at least 4/5, in whole numbers."""
    both = len(x) + len(y) - len(np.union1d(x, y))
    return 9 * both >= 4 * (len(x) + len(y))


def prefix_size(n):
    """How many first shingles of a set of ``n`` (above 0) hold one in common with any similar set."""
    return n - (4 * n + 4) // 5 + 1


def parity(x: np.ndarray) -> bytes:
    """A bitmap in which each element flips a bit."""
    return np.packbits(np.bincount((x >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def split(x: np.ndarray, repeated: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that ``repeated`` (sorted) lacks, and those it has by their rank."""
    if not len(repeated) or not len(x):
        return x, x[:0]
    at = np.minimum(np.searchsorted(repeated, x), len(repeated) - 1)
    has = repeated[at] == x
    return x[~has], x[has][np.argsort(rank[at[has]], kind="stable")]


def repeats(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of at least three distinct texts of a sample, sorted, and their rank by count: at most REPEATED."""
    share = max(1, docs.count() // SAMPLED)
    texts = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).select("text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.concatenate([*(shingles(t.as_py()) for t in b.column(0)), np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], ["h"])

    counts = texts.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    got = counts.orderBy(F.desc("n"), "h").limit(REPEATED).toArrow()
    h, n = (got.column(k).to_numpy() for k in ("h", "n"))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], n.astype(np.int64)[order]


SET = "_sig long, _n long, _few long, _last array<long>, _fp long, _bits binary"


def signed_sets(docs: DataFrame) -> tuple[DataFrame, Broadcast]:
    """The rows with SET: a hash of the shingle set, its size, how many of it the sample does not repeat, those of its prefix that
    the sample repeats, its fingerprint and its bitmap; and the repeated shingles with their ranks."""
    seen = docs.sparkSession.sparkContext.broadcast(repeats(docs))  # at most REPEATED
    at, names = docs.columns.index("text"), [c.split()[0] for c in SET.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, rank = seen.value
        for b in batches:
            rows = []
            for t in b.column(at):
                x = shingles(t.as_py())
                few, many = split(x, repeated, rank)
                last = many[: max(0, prefix_size(len(x)) - len(few))] if len(x) else x
                rows.append((xxhash.xxh64_intdigest(x.tobytes(), 42), len(x), len(few), last.view(np.int64), simhash.majority(x), parity(x)))
            sig, n, few, last, fp, bits = zip(*rows, strict=True) if rows else [()] * 6
            word = lambda v: pa.array(np.array(v, np.uint64).view(np.int64))
            new = [word(sig), pa.array(n, pa.int64()), pa.array(few, pa.int64()), pa.array(last, pa.list_(pa.int64())), word(fp), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return common.spread(docs).mapInArrow(run, f"{kinds}, {SET}"), seen


def counted(rows: DataFrame, seen: Broadcast) -> DataFrame:
    """(sig, c, h): shingles that the sample does not repeat but ``c`` sets hold, two or more; beyond MANY only that many.

    Copies within a task are sent once, so a set reaches a count at most once from each task, and is counted once.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, rank = seen.value
        sent: set[int] = set()
        for b in batches:
            hs, sigs = [np.zeros(0, np.uint64)], []
            for sig, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if sig not in sent:
                    sent.add(sig)
                    hs.append(split(shingles(t.as_py()), repeated, rank)[0])
                    sigs.append(sig)
            n = [len(h) for h in hs[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(np.array(sigs, np.int64), n))], ["h", "sig"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, crowded = np.zeros((0, 2), np.int64), None

        def made(own: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(own[:, 1]), pa.array(c.astype(np.int64)), pa.array(own[:, 0])], ["sig", "c", "h"])

        def runs_of(own: np.ndarray) -> pa.RecordBatch:
            n = np.diff(common.runs(own[:, 0]))
            c = np.minimum(np.repeat(n, n), MANY)
            return made(own[c > 1], c[c > 1])

        for b in batches:
            own = np.vstack([rest, np.column_stack([b.column(k).to_numpy() for k in range(2)])])
            if not len(own):
                continue
            own = own[np.concatenate([[True], (own[1:] != own[:-1]).any(1)])]
            if crowded is not None:
                of = own[:, 0] == crowded
                # The last row of the run is kept to tell a copy of it.
                yield made(own[of][1:], np.full(max(0, of.sum() - 1), MANY))
                if of.all():
                    rest = own[-1:]
                    continue
                own, crowded = own[~of], None
            cut = common.runs(own[:, 0])[-2]
            yield runs_of(own[:cut])
            rest = own[cut:]
            if len(rest) > MANY:
                crowded = rest[0, 0]
                yield made(rest, np.full(len(rest), MANY))
                rest = rest[-1:]
        if crowded is None:
            yield runs_of(rest)

    spark = rows.sparkSession
    sent = rows.select("_sig", "text").mapInArrow(send, "h long, sig long")
    return sent.repartition(common.shuffle_width(spark), "h").sortWithinPartitions("h", "sig").mapInArrow(count, "sig long, c long, h long")


#: A row of a prefix: the shingle, its set, and the two shingles before it in the prefix (the set's own hash where there is none).
PREFIX = "h long, _sig long, _n long, place long, _p long, _q long, _bits binary"


def prefixes(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows of PREFIX: the shingles of a set's prefix that other sets may hold."""
    spark = sets.sparkSession
    before = lambda k: F.coalesce(F.when(F.col("at") >= k, F.get("_last", F.col("at") - k)), "_sig")
    last = sets.select(F.posexplode("_last").alias("at", "h"), "_sig", "_n", "_few", "_last", "_bits").select("h", "_sig", "_n", (F.col("_few") + F.col("at")).alias("place"), before(1).alias("_p"), before(2).alias("_q"), "_bits")
    zero = F.lit(0).cast("long")
    both = sets.select(F.col("_sig").alias("sig"), zero.alias("c"), zero.alias("h"), "_n", "_few", "_bits").unionByName(counts.withColumns({"_n": zero, "_few": zero, "_bits": F.lit(None).cast("binary")}))
    dealt = both.repartition(common.shuffle_width(spark), "sig").sortWithinPartitions("sig", "c", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def made(t: pa.Table) -> pa.RecordBatch:
            sig, h, n, few = (t.column(k).to_numpy() for k in ("sig", "h", "_n", "_few"))
            at = common.runs(sig)
            size = np.diff(at)
            head = np.repeat(at[:-1], size)  # the row of the set itself, with c = 0
            alone = few[head] - (np.repeat(size, size) - 1)  # shingles of no other set
            place = alone + np.arange(len(sig)) - head - 1
            take = np.flatnonzero((np.arange(len(sig)) > head) & (place < prefix_size(n[head])))
            bits = t.column("_bits").combine_chunks().take(pa.array(head[take]))
            before = [pa.array(np.where(take - k > head[take], h[take - k], sig[take])) for k in (1, 2)]
            return pa.RecordBatch.from_arrays([pa.array(h[take]), pa.array(sig[take]), pa.array(n[head[take]]), pa.array(place[take]), *before, bits], [c.split()[0] for c in PREFIX.split(", ")])

        for b in batches:
            t = pa.Table.from_batches([b])
            rest = t if rest is None else pa.concat_tables([rest, t])
            sig = rest.column("sig").to_numpy()
            cut = int(common.runs(sig)[-2]) if len(sig) else 0
            if cut:
                yield made(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None and len(rest):
            yield made(rest)

    return last.unionByName(dealt.mapInArrow(run, PREFIX))


def pairs_of(h: int, sig: np.ndarray, n: np.ndarray, place: np.ndarray, root: np.ndarray, bits: np.ndarray, full: bool, before: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of one shingle's sets of different components that their sizes, places and bitmaps allow: all of a few sets; of many, those
    with one of four centres, or (``full``) all.

    ``before``: the shingles just before this one in each prefix. Where all pairs are made, a pair that shares one of them is left to it: at the first
    shingle of such a run of shared ones it is made, by this round if that has many sets, else by the one before, and similar sets pass the other tests at every shingle.
    """

    def allowed(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.minimum(np.minimum(n[i], n[j]), np.minimum(n[i] - place[i], n[j] - place[j]) + np.minimum(place[i], place[j]))
        keep = 9 * most >= 4 * (n[i] + n[j])
        keep &= root[i] != root[j]
        i, j = i[keep], j[keep]
        if before is not None and (full or m <= FEW):
            keep = ~(before[i][:, :, None] == before[j][:, None, :]).any((1, 2))
            i, j = i[keep], j[keep]
        keep = 9 * np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= n[i] + n[j]
        return i[keep], j[keep]

    m = len(sig)
    if not full and m > FEW:
        centre = int(np.argmin((sig.view(np.uint64) ^ np.uint64((h & 3) * int(ODD) % 2**64)) * ODD))
        yield allowed(np.full(m - 1, centre), np.delete(np.arange(m), centre))
        return
    rows = max(1, CUT // m)
    for a in range(0, m, rows):
        i, j = np.nonzero(np.arange(a, min(a + rows, m))[:, None] < np.arange(m)[None, :])
        yield allowed(i + a, j)


def candidates(prefix: DataFrame, second: bool) -> DataFrame:
    """(a, b) of sets of different components that meet under a shingle of their prefixes (with ``root``); the first round leaves out
    pairs of crowded shingles."""
    met = prefix.select("h", "_sig", "_n", "place", "root", "_p", "_q", "_bits").repartition(common.shuffle_width(prefix.sparkSession), "h").sortWithinPartitions("h", "_sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, rest_bits = np.zeros((0, 7), np.int64), np.zeros((0, BITS // 64), np.uint64)

        def made(rows: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
            at = common.runs(rows[:, 0])
            size = np.diff(at)
            out, held = [], 0
            for start, m in zip(at[:-1][size > 1].tolist(), size[size > 1].tolist(), strict=True):
                g = rows[start : start + m]
                if second and m <= FEW or (g[:, 4] == g[0, 4]).all():
                    continue
                sig = np.ascontiguousarray(g[:, 1])
                for i, j in pairs_of(int(g[0, 0]), sig, g[:, 2], g[:, 3], g[:, 4], bits[start : start + m], second, g[:, 5:]):
                    out.append((sig[i], sig[j]))
                    held += len(i)
                    if held > CUT:
                        yield batch_of(out)
                        out, held = [], 0
            yield batch_of(out)

        for batch in batches:
            if not len(batch):
                continue
            new = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(len(batch), -1)
            rows, bits = np.vstack([rest, np.column_stack([batch.column(k).to_numpy() for k in range(7)])]), np.vstack([rest_bits, new])
            cut = common.runs(rows[:, 0])[-2]
            yield from made(rows[:cut], bits[:cut])
            rest, rest_bits = rows[cut:], bits[cut:]
        yield from made(rest, rest_bits)

    pairs = met.mapInArrow(run, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def batch_of(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate([*(p[k] for p in out), np.zeros(0, np.int64)]).astype(np.int64) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b"])


def verified(pairs: DataFrame, rows: DataFrame) -> tuple[DataFrame, str]:
    """The pairs whose whole sets are similar, and the scratch table of texts. Only texts of candidates are joined."""
    wanted = pairs.select(F.col("a").alias("_sig")).union(pairs.select("b")).distinct()
    texts, path = common.materialise(rows.select("_sig", "text").join(wanted, "_sig", "left_semi").dropDuplicates(["_sig"]), "shingle-texts")
    left = texts.select(F.col("_sig").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("_sig").alias("b"), F.col("text").alias("y"))
    met = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in batches:
            ok = []
            for b, s, t in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if b != last:  # rows come sorted by b
                    last, y = b, shingles(t.as_py())
                ok.append(similar(shingles(s.as_py()), y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return met.mapInArrow(run, "a long, b long"), path


def by_fingerprint(sets: DataFrame) -> tuple[DataFrame, list[str]]:
    """(a, b) of sets whose fingerprints are equal or linked, as chains; and the scratch tables behind them."""
    least, at = common.materialise(simhash.tabled(sets.groupBy(F.col("_fp").alias("fp")).agg(F.min("_sig").alias("least")), RADIUS), "shingle-table")
    near, paths, _ = simhash.links(least, RADIUS)
    side = least.select("fp", "least")
    equal = sets.select(F.col("_sig").alias("b"), F.col("_fp").alias("fp")).join(side, "fp").select(F.col("least").alias("a"), "b").where("a <> b")
    linked = near.join(side.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(side.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    both = equal.unionByName(linked).where("a <> b")
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), [at, *paths]


def links(rows: DataFrame, seen: Broadcast, tag: str = "shingle") -> tuple[DataFrame, DataFrame]:
    """(node, root) over the hashes of sets that have a similar other one, and the links (a, b) these come from."""
    spark = rows.sparkSession
    sets, scratch = common.materialise(rows.groupBy("_sig").agg(*[F.first(c).alias(c) for c in ("_n", "_few", "_last", "_fp", "_bits")]), f"{tag}-sets")
    prefix, at_prefix = common.materialise(prefixes(sets.where("_n > 0"), counted(rows, seen)), f"{tag}-prefix")
    roots, edges, scratch = None, None, [scratch]
    for step in ("fingerprints", "first", "second"):
        if step == "fingerprints":
            pairs, used = by_fingerprint(sets)
        else:
            pairs, used = candidates(prefix.join(roots.withColumnRenamed("node", "_sig"), "_sig", "left").withColumn("root", F.coalesce("root", "_sig")), step == "second"), []
        pairs, at = common.materialise(pairs, f"{tag}-pairs")
        common.discard(spark, *used)
        found, texts = verified(pairs, rows)
        found, path = common.materialise(found if edges is None else edges.unionByName(found), f"{tag}-edges")
        common.discard(spark, at, texts)
        if edges is not None:
            common.discard(spark, *scratch[1:])
            del scratch[1:]
        edges = found
        roots, paths = simhash.components(edges, tag)
        scratch += [path, *paths]
    common.discard(spark, scratch[0], at_prefix)
    return roots, edges


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id and component_id: the smallest doc_id that links reach, null only where no id is reachable.

    Null and empty texts have no shingles and are copies of each other; repeated rows stay; other columns are ignored; an empty table gives no rows.
    Very long texts are compared whole: a text's shingles are an array of one row.
    """
    rows, seen = signed_sets(docs.select(F.col("doc_id").cast("long"), "text"))
    rows, at = common.materialise(rows, "shingle-rows")
    roots, _ = links(rows, seen)
    rooted = rows.select("doc_id", "_sig").join(roots.withColumnRenamed("node", "_sig"), "_sig", "left").select("doc_id", F.coalesce("root", "_sig").alias("root"))
    rooted, _ = common.materialise(rooted, "shingle-rooted")
    common.discard(docs.sparkSession, at)
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(least, "root").select("doc_id", "component_id")
