"""Near-duplicates by SimHash fingerprints and a pivot distance table.

Pairs are sought among distinct fingerprints only. For each of these the distances to 49 reference fingerprints (pivots) are
measured once. Coordinates to 33 of them (a middle one and neighbours of it) key the cells in which
candidates meet: two fingerprints within the radius agree in all but ``radius`` of the groups of these coordinates, so that they share
a cell. As each of these pivots differs from the middle one in two bits of its own, a coordinate tells how far a fingerprint is from it in these two
bits: the cells are a banding over pairs of bits, written as distances. There the table of distances to 16 spread pivots discards every pair whose largest coordinate
difference exceeds the radius (triangle inequality), and survivors are verified bit by bit. Of a cell's links only a
spanning forest of chains is kept, and components come from min-label propagation with pointer jumping.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Groups of coordinates that make a cell, and spread pivots (a byte of two longs each).
PARTS, PIVOTS = 4, 16
#: Cells of more fingerprints than this are split; rows of whole cells, and pairs, that are compared at once.
CROWDED, BUFFER, MOST = 4096, 200_000, 1 << 20


def fingerprint(text: str | None, size: int = 3) -> int:
    """A bit is set if it is in over half the shingles' hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(b" ".join(g), 42) for g in zip(*(words[i:] for i in range(size)))], np.uint64))  # noqa: B905


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; none of no hashes."""
    hashes, total = hashes.astype(">u8"), np.zeros(64, np.int64)
    for a in range(0, len(hashes), 4096):
        total += np.unpackbits(hashes[a : a + 4096].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fp, a long with the fingerprint's bits; null texts are empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), size) for t in b.column(1)), np.uint64, len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return common.spread(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def references() -> tuple[int, list[int], list[int]]:
    """The pivots: one in the middle, its neighbours (each with another two bits flipped), and ones spread at random."""
    draw = lambda name: xxhash.xxh64_intdigest(name.encode(), 42)
    middle = draw("middle")
    return middle, [middle ^ (3 << 2 * j) for j in range(32)], [draw(f"pivot {i}") for i in range(PIVOTS)]


def distance(fp: Column, pivot: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(signed(pivot))))


def tabled(distinct: DataFrame, radius: int) -> DataFrame:
    """The pivot distance table, measured once for each fingerprint: ``groups``, the coordinates to the middle pivot's
    neighbours in ``radius + PARTS`` groups, and ``near`` and ``far``, the distances to the spread pivots, a byte each.

    A coordinate is half the difference of the distances to a neighbour and to the middle: -1, 0 or 1, and a bit that
    changes in the fingerprint changes exactly one of them by one. So ``radius`` bits leave ``PARTS`` groups or more as they are.
    """
    middle, neighbours, spread = references()
    fp, parts = F.col("fp"), radius + PARTS
    turned = [((distance(fp, n) - distance(fp, middle)) / 2).cast("long") + 1 for n in neighbours]
    cut = [32 * i // parts for i in range(parts + 1)]
    groups = [sum((c * 3**k for k, c in enumerate(turned[a:b])), F.lit(0).cast("long")) for a, b in zip(cut, cut[1:])]  # noqa: B905
    packed = [sum((F.shiftleft(distance(fp, p).cast("long"), 8 * k) for k, p in enumerate(spread[a : a + 8])), F.lit(0).cast("long")) for a in (0, 8)]
    return distinct.select("*", F.array(*groups).alias("groups"), packed[0].alias("near"), packed[1].alias("far"))


ROW = ["which", "key", "fp", "near", "far", "home"]


def cells(table: DataFrame, radius: int) -> DataFrame:
    """Rows of ROW: each fingerprint under the cell of every choice of ``PARTS`` groups; within the radius two share one at least."""
    parts = radius + PARTS
    keys = [sum((F.get("groups", F.lit(g)) * 6561**k for k, g in enumerate(own)), F.lit(0).cast("long")) for own in combinations(range(parts), PARTS)]
    return table.select(F.posexplode(F.array(*keys)).alias("which", "key"), "fp", "near", "far").select(F.col("which").cast("long"), "key", "fp", "near", "far", F.lit(1).cast("long").alias("home"))


def finer(crowded: DataFrame, level: int, radius: int) -> DataFrame:
    """Rows of crowded cells under cells of four more pivots: at home in the own one, and a guest where a neighbour within the radius could be."""
    wide, out = 3 * radius + 1, crowded.withColumn("_first", F.lit(1).cast("long"))
    for k in range(4):
        at = (4 * level + k) % 16
        own = F.shiftright("near" if at < 8 else "far", 8 * (at % 8)).bitwiseAND(F.lit(255))
        places = F.sequence(F.floor((own - radius) / wide), F.floor((own + radius) / wide))
        out = out.withColumn("_cell", F.explode(places)).withColumns({"key": F.xxhash64("key", "_cell"), "_first": F.col("_first") * (F.col("_cell") == F.floor(own / wide)).cast("long")}).drop("_cell")
    return out.withColumn("home", F.col("home") * F.col("_first")).select(ROW)


def pairs(rows: np.ndarray, radius: int, tally: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows (of ROW) of one cell and at most ``radius`` bits apart; at least one of a pair is at home.

    Rows come sorted by cell and the first pivot's distance, so a pair that it allows is near in the order; the others
    discard by coordinate difference, and survivors are verified. ``tally`` counts all three kinds of pairs.
    """
    table = np.ascontiguousarray(rows[:, 3:5]).view(np.int8).astype(np.int16)
    fps, home = np.ascontiguousarray(rows[:, 2]).view(np.uint64), rows[:, 5] > 0
    cell = np.cumsum(np.concatenate([[0], (rows[1:, :2] != rows[:-1, :2]).any(1)]))
    order = cell * 256 + table[:, 0]
    n = np.searchsorted(order, order + radius, "right") - np.arange(len(rows)) - 1
    ends = np.cumsum(n)
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MOST, "right")))
        own = n[a:b]
        i = np.repeat(np.arange(a, b), own)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(own) - own, own)
        tally[0] += len(i)
        keep = home[i] | home[j]
        i, j = i[keep], j[keep]
        for k in range(1, PIVOTS):
            keep = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[keep], j[keep]
        tally[1] += len(i)
        keep = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        tally[2] += keep.sum()
        yield i[keep], j[keep]
        a = b


def forest(rows: np.ndarray, radius: int, tally: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A chain of fingerprints through each component of the rows' links within their cells."""
    label = np.arange(len(rows))
    for i, j in pairs(rows, radius, tally):
        while len(i):
            lo, hi = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            if not (differ := lo < hi).any():
                break
            np.minimum.at(label, hi[differ], lo[differ])
            while (jump := label[label] != label).any():
                label[jump] = label[label[jump]]
    order = np.argsort(label, kind="stable")
    same = label[order[1:]] == label[order[:-1]]
    return rows[order[:-1][same], 2], rows[order[1:][same], 2]


FOUND = "kind long, which long, key long, fp long, near long, far long, home long"
LINK, CROWD, TALLY = 0, 1, 2


def met(rows: DataFrame, radius: int, most: int | None) -> DataFrame:
    """Rows of FOUND: links (fp, near) within cells; the rows of cells of more than ``most`` fingerprints; and counts of
    pairs compared, left by the table and verified (which, key, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(3, np.int64)
        whole: list[np.ndarray] = []  # cells that are complete
        last: list[np.ndarray] = []  # the cell that is open
        crowded = False

        def table(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
            n = len(columns[0])
            columns = [np.full(n, kind), *columns, *[np.zeros(n, np.int64)] * (6 - len(columns))]
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], [c.split()[0] for c in FOUND.split(", ")])

        def chains() -> pa.RecordBatch:
            a, b = forest(np.vstack(whole), radius, tally) if whole else [np.zeros(0, np.int64)] * 2
            whole.clear()
            return table(LINK, *[np.zeros(len(a), np.int64)] * 2, a, b)

        for batch in batches:
            if not len(batch):
                continue
            new = np.column_stack([batch.column(k).to_numpy() for k in range(6)])
            at = common.runs(np.cumsum(np.concatenate([[0], (new[1:, :2] != new[:-1, :2]).any(1)])))
            if last and (last[0][0, :2] != new[0, :2]).any():
                whole += [] if crowded else last
                last, crowded = [], False
            for s, e in ((0, at[1]), (at[1], at[-2]), (max(at[1], at[-2]), at[-1])):
                # the rest of the open cell (or the first one), whole cells in between, the last one
                if s >= e:
                    continue
                part = new[s:e]
                if s and s == at[1] and e == at[-2] and most is not None:
                    size = np.repeat(np.diff(at[1:-1]), np.diff(at[1:-1]))
                    if (size > most).any():
                        yield table(CROWD, *part[size > most].T)
                        part = part[size <= most]
                if s and e != at[-1]:
                    whole.append(part)
                    continue
                if s:
                    whole += [] if crowded else last
                    last, crowded = [], False
                if crowded:
                    yield table(CROWD, *part.T)
                    continue
                last.append(part)
                if most is not None and sum(map(len, last)) > most:
                    for x in last:
                        yield table(CROWD, *x.T)
                    last, crowded = [part[:1]], True
            if sum(map(len, whole)) > BUFFER:
                yield chains()
        whole += [] if crowded else last
        yield chains()
        yield table(TALLY, *tally[:, None])

    dealt = rows.repartition(common.shuffle_width(rows.sparkSession), "which", "key").sortWithinPartitions("which", "key", F.col("near").bitwiseAND(F.lit(255)), "fp")
    return dealt.mapInArrow(run, FOUND)


def links(distinct: DataFrame, radius: int = 2, most: int = CROWDED) -> tuple[DataFrame, list[str], np.ndarray]:
    """(a, b): fingerprints of chains whose components are those of all links within the radius; their scratch tables; and how many
    pairs were compared, left by the pivot table, and verified as links.

    The rows of a cell of more than ``most`` fingerprints go to finer cells, by four more pivots a level; what is
    crowded still after all pivots (fingerprints that are close to each other, not only alike in parts) is compared in place.
    """
    rows, out, paths, tally = cells(distinct, radius), None, [], np.zeros(3, np.int64)
    for level in range(PIVOTS // 4 + 1):
        found, path = common.materialise(met(rows, radius, most if level < PIVOTS // 4 else None), "simhash-met")
        paths.append(path)
        kinds = found.groupBy("kind").agg(*[F.sum(F.when(F.col("kind") == TALLY, F.col(c))).alias(c) for c in ("which", "key", "fp")]).collect()  # three rows
        tally += sum((np.array([r.which, r.key, r.fp]) for r in kinds if r.kind == TALLY), np.zeros(3, np.int64))
        own = found.where(F.col("kind") == LINK).select(F.col("fp").alias("a"), F.col("near").alias("b"))
        out = own if out is None else out.unionByName(own)
        if not any(r.kind == CROWD for r in kinds):
            break
        rows = finer(found.where(F.col("kind") == CROWD).select(ROW), level, radius)
    return out.distinct(), paths, tally


def components(edges: DataFrame, tag: str = "components") -> tuple[DataFrame, list[str]]:
    """(node, root) for the nodes of ``edges`` (a, b); root is the smallest node of the component.

    Each round takes the least label around every node and then the label's own label, so that the rounds grow
    with the logarithm of a chain's length. Every round is a table in the shared folder.
    """
    spark = edges.sparkSession
    both, path = common.materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{tag}-edges")
    label, at = common.materialise(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), f"{tag}-label")
    while True:
        around = both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        lower = label.join(around, "node").select("node", "root", F.least("root", "seen").alias("next"))
        jump = label.select(F.col("node").alias("next"), F.col("root").alias("over"))
        after, new = common.materialise(lower.join(jump, "next").select("node", F.least("next", "over").alias("root"), (F.col("root") != F.least("next", "over")).alias("moved")), f"{tag}-label")
        moved = after.where("moved").limit(1).count()
        common.discard(spark, at)
        label, at = after.select("node", "root"), new
        if not moved:
            return label, [path, at]


def grouped(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint and component_id: the smallest doc_id that links of ``radius`` bits reach.

    Null and empty texts have fingerprint zero and link like any other; very long texts are hashed whole. Rows with a null id keep their row and
    count for links; their component_id is null only if no id is reachable. Repeated rows stay, other columns are
    ignored, an empty table gives no rows. A bit that is set in exactly half the hashes (a tie) is 0.
    """
    fps, _ = common.materialise(fingerprints(docs, size), "simhash-fp")
    distinct, at = common.materialise(tabled(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), radius), "simhash-table")
    edges, paths, _ = links(distinct, radius)
    roots, more = components(edges, "simhash")
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp").select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = roots.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    classes, _ = common.materialise(distinct.select("fp", "least").join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "simhash-classes")
    common.discard(docs.sparkSession, at, *paths, *more)
    return fps.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    return grouped(common.table(spark, sf_dir, "documents"))
