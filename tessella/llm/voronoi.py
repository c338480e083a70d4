"""Hard negatives by a Voronoi-partitioned kNN join on norm-augmented vectors.

With M the largest length of any vector, x becomes x' = (x, sqrt(M^2 - |x|^2)) and an anchor q becomes q' = (q, 0), so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x: the nearest vectors are those of the highest scores. Anchors belong to the cell of their nearest pivot; cells that lie
together form groups of about ``GROUP`` anchors. A candidate knows its distance to the pivots of all cells with anchors. An anchor of a
cell of radius u is at least distance - u and at most distance + u away from it, so it goes only to the groups of cells that it might serve: those whose
anchors have a bound as far as the first and one as near as the second. There it is compared with those cells' anchors only, exactly.

Each of the two joins (an anchor's positives, then the negatives of each positive) runs twice. First candidates go to the cell they are nearest to,
which gives each anchor a k-th score so far; then to all other cells that this bound leaves. Large groups are dealt out in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, topk

#: Pivots are fitted on a sample of at most SAMPLE vectors: the square root of the vectors, at most PIVOTS.
SAMPLE, PIVOTS = 4096, 256
#: Anchors of a group, about; candidates of a part, at most about; and at least, where more parts would only serve more tasks.
GROUP, PART, SMALL = 4096, 65_536, 1024
#: Bounds of cells are kept by label up to so many (cell, label) pairs; beyond, one bound serves all labels of a cell.
BOUNDS = 65_536


@dataclass
class Space:
    """Vectors of one length: pivots of the cells that have anchors, ordered by group, and what bounds the cells."""

    most2: float  # M^2
    pivots: np.ndarray  # augmented
    radius: np.ndarray
    group: np.ndarray  # of each cell
    parts: np.ndarray  # of each group
    labels: np.ndarray | None = None  # that ``far`` tells apart
    far: np.ndarray | None = None  # labels x cells: how far a candidate may be from some anchor
    near: np.ndarray | None = None  # of each cell: how near, at least
    cell: dict[int, int] = field(default_factory=dict)  # number of a pivot -> place of its cell

    def distances(self, v: np.ndarray) -> np.ndarray:
        x = augmented(v, self.most2)
        return np.sqrt(np.maximum((x**2).sum(1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(1), 0))

    def needed(self, v: np.ndarray, label: np.ndarray) -> np.ndarray:
        """candidates x cells: where a candidate goes. Without bounds: to the nearest cell; with them, to the others it might serve."""
        d = self.distances(v)
        own = np.zeros(d.shape, bool)
        own[np.arange(len(d)), d.argmin(1)] = True
        if self.far is None:
            return own
        slack = 1e-6 * (np.sqrt(self.most2) + d) + 1e-4  # rounding
        if self.labels is None:
            far = self.far
        else:
            at = np.minimum(np.searchsorted(self.labels, label), len(self.labels) - 1)
            far = np.where((self.labels[at] == label)[:, None], self.far[at], -np.inf)
        return (d - self.radius - slack <= far) & (d + self.radius + slack >= self.near) & ~own


def augmented(v: np.ndarray, most2: float | None) -> np.ndarray:
    """With the coordinate that makes all lengths equal, or 0 for anchors (``most2`` None)."""
    last = np.zeros(len(v)) if most2 is None else np.sqrt(np.maximum(most2 - (v**2).sum(1), 0))
    return np.column_stack([v, last])


def spaces(rows: DataFrame) -> tuple[dict[int, Space], DataFrame, str]:
    """The space of each length of vectors that has anchors; and the anchors with cell and length2, in a scratch table."""
    spark = rows.sparkSession
    length2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = {r.dim: r for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(length2).alias("most2"), F.count_if("_asked").alias("anchors")).where("anchors > 0").collect()}  # a row for each length
    pivots = {}
    for dim, r in sizes.items():
        share = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= (1 << 20) * SAMPLE / r.n)).limit(SAMPLE).select("v")
        sample = np.array([x.v for x in share.collect()] or [[0.0] * max(1, dim)], float)
        pivots[dim] = augmented(topk.choose_pivots(np.unique(sample, axis=0), max(1, min(PIVOTS, int(r.n**0.5)))), r.most2)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, distance, size = np.zeros(len(b), np.int32), np.zeros(len(b)), np.zeros(len(b))
            for dim, at, v in topk.batched(b.column(3).to_numpy(), b.column(4)):
                cell[at], distance[at] = topk.keyed(augmented(v, None), pivots[dim])
                size[at] = (v**2).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(distance), pa.array(size)], [*b.schema.names, "cell", "distance", "length2"])

    asked = rows.where("_asked").select("_row", "vec_id", "label", "dim", "v")
    anchors, path = common.materialise(asked.mapInArrow(near, "_row long, vec_id long, label long, dim int, v array<double>, cell int, distance double, length2 double"), "voronoi-anchors")
    out, width = {}, common.shuffle_width(spark)
    cells = anchors.groupBy("dim", "cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()  # at most PIVOTS rows for each length
    for dim, r in sizes.items():
        own = {x.cell: x for x in cells if x.dim == dim}
        order, rest = [], sorted(own)
        while rest:  # each the nearest to the one before: cells of a group lie together
            at = 0 if not order else int(((pivots[dim][rest] - pivots[dim][order[-1]]) ** 2).sum(1).argmin())
            order.append(rest.pop(at))
        group = np.cumsum([own[c].n for c in order]) // GROUP
        group = np.unique(group, return_inverse=True)[1]
        parts = max(-(-r.n // PART), min(-(-width // int(group.max() + 1)), -(-r.n // SMALL)))
        out[dim] = Space(r.most2, pivots[dim][order], np.array([own[c].radius for c in order]), group, np.full(group.max() + 1, parts), cell={c: i for i, c in enumerate(order)})
    return out, anchors, path


SENT = "dim int, grp int, part int, kind int, _row long, vec_id long, label long, v array<double>, cell int, mask binary, scores array<long>, floors array<long>"
NAMES = [c.split()[0] for c in SENT.split(", ")]


def sent(rows: DataFrame, known: dict[int, Space]) -> DataFrame:
    """The candidates, once for each group that they go to, with the bits of its cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dim, at, v in topk.batched(b.column(3).to_numpy(), b.column(4)):
                if dim not in known:
                    continue
                own, piece = known[dim], b.slice(at.start, at.stop - at.start)
                row = piece.column(0).to_numpy()
                need = own.needed(v, piece.column(2).to_numpy())
                for g, parts in enumerate(own.parts.tolist()):
                    bits = need[:, own.group == g]
                    to = np.flatnonzero(bits.any(1))
                    if len(to):
                        taken, n = piece.take(pa.array(to)), len(to)
                        same = lambda x, n=n: pa.array(np.full(n, x, np.int32))
                        mask = [x.tobytes() for x in np.packbits(bits[to], axis=1)]
                        none = pa.nulls(n, pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([same(dim), same(g), pa.array((row[to] % parts).astype(np.int32)), same(1), *(taken.column(i) for i in (0, 1, 2, 4)), same(0), pa.array(mask, pa.binary()), none, none], NAMES)

    return rows.select("_row", "vec_id", "label", "dim", "v").mapInArrow(run, SENT)


def posted(anchors: DataFrame, known: dict[int, Space]) -> DataFrame:
    """The anchors, once for each part of their group."""
    places = [(d, pivot, at, int(s.group[at]), int(s.parts[s.group[at]])) for d, s in known.items() for pivot, at in s.cell.items()]
    cells = F.broadcast(anchors.sparkSession.createDataFrame(places, "dim int, cell int, _at int, grp int, _parts int"))  # at most PIVOTS rows for each length
    placed = anchors.join(cells, ["dim", "cell"]).withColumn("part", F.explode(F.expr("sequence(0, _parts - 1)")))
    return placed.select("dim", "grp", "part", F.lit(0).alias("kind"), "_row", "vec_id", "label", "v", F.col("_at").alias("cell"), F.lit(None).cast("binary").alias("mask"), "scores", "floors")


FOUND = "_row long, slot int, vec_id long, score long"


class Local:
    """The anchors of a group's part, and the best candidates so far of each of their slots (an anchor, or an anchor and a positive)."""

    def __init__(self, k: int, same: bool, low: int, high: int):
        self.k, self.same, self.low, self.high = k, same, low, high
        self.pieces: list[tuple] = []
        self.cells: dict[int, list[int]] = {}
        self.slots: list[list[list]] = []  # of each anchor: [slot, least, most, scores, ids]

    def add(self, b: pa.RecordBatch) -> None:
        start = len(self.slots)
        v = b.column(7).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        self.pieces.append((v, b.column(4).to_numpy(), b.column(6).to_numpy()))
        for i, (cell, scores, floors) in enumerate(zip(b.column(8).to_pylist(), b.column(10).to_pylist(), b.column(11).to_pylist(), strict=True)):
            self.cells.setdefault(cell, []).append(start + i)
            slots = []
            for slot, (score, floor) in enumerate(zip([None] if self.same else scores or [], floors or [], strict=True)):
                least, most = (-(1 << 63), (1 << 63) - 1) if self.same else (-(-self.low * score // 100), self.high * score // 100)
                if least <= most:
                    slots.append([slot, max(least, floor) if floor is not None else least, most, np.zeros(0, np.int64), np.zeros(0, np.int64)])
            self.slots.append(slots)

    def meet(self, b: pa.RecordBatch, group: np.ndarray) -> None:
        """``group``: places of the group's cells, in the order of the mask's bits."""
        if len(self.pieces) > 1:
            self.pieces = [tuple(np.concatenate(c) for c in zip(*self.pieces, strict=True))]
        if not self.pieces:
            return
        q, rows, labels = self.pieces[0]
        x = b.column(7).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
        row, ids, label = (b.column(i).to_numpy() for i in (4, 5, 6))
        bits = np.unpackbits(np.frombuffer(b"".join(b.column(9).to_pylist()), np.uint8).reshape(len(b), -1), axis=1)
        for bit, cell in enumerate(group.tolist()):
            to = np.flatnonzero(bits[:, bit])
            at = self.cells.get(cell)
            if at is None or not len(to):
                continue
            whole = len(to) == len(x)
            for s, a in zip(topk.products(q[at], x if whole else x[to]), at, strict=True):
                right = label[to] == labels[a] if self.same else label[to] != labels[a]
                for slot in self.slots[a]:
                    ok = np.flatnonzero(right & (s >= slot[1]) & (s <= slot[2]) & (row[to] != rows[a]))
                    if len(ok):
                        self.keep(slot, s[ok], ids[to[ok]])

    def keep(self, slot: list, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > self.k:  # ties of the k-th score are all looked at
            at = score >= np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[at], ids[at]
        score, ids = np.concatenate([slot[3], score]), np.concatenate([slot[4], ids])
        at = np.lexsort((ids, -score))[: self.k]
        slot[3], slot[4] = score[at], ids[at]
        if len(at) == self.k:
            slot[1] = max(slot[1], int(slot[3][-1]))

    def found(self) -> pa.RecordBatch | None:
        rows = np.concatenate([p[1] for p in self.pieces]) if self.pieces else np.zeros(0, np.int64)
        own = [(np.full(len(s[3]), r), np.full(len(s[3]), s[0], np.int32), s[4], s[3]) for r, slots in zip(rows.tolist(), self.slots, strict=True) for s in slots if len(s[3])]
        if not own:
            return None
        row, slot, ids, score = (np.concatenate(c) for c in zip(*own, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(row.astype(np.int64)), pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(score)], [c.split()[0] for c in FOUND.split(", ")])


def joined(rows: DataFrame, anchors: DataFrame, known: dict[int, Space], k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """FOUND: of each slot, the k best of each part's candidates; of equal labels (``same``), or of others with a score of ``low`` to ``high`` hundredths of the slot's."""
    place = ["dim", "grp", "part"]
    both = posted(anchors, known).unionByName(sent(rows, known))
    dealt = both.repartition(common.shuffle_width(rows.sparkSession), *place).sortWithinPartitions(*place, "kind")
    cells = {(d, g): np.flatnonzero(s.group == g) for d, s in known.items() for g in range(len(s.parts))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, local = None, None
        for b in batches:
            keys = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(b)]])
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if e == s:
                    continue
                if here != tuple(keys[s, :3]):
                    if local and (out := local.found()) is not None:
                        yield out
                    here, local = tuple(keys[s, :3]), Local(k, same, low, high)
                if keys[s, 3]:
                    local.meet(b.slice(s, e - s), cells[here[:2]])
                else:
                    local.add(b.slice(s, e - s))
        if local and (out := local.found()) is not None:
            yield out

    return dealt.select(*NAMES).mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("_row", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def floored(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """The anchors with the k-th scores found so far as floors, null where there are fewer."""
    kth = found.where(F.col("rank") == k).groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("_kth"))
    floors = F.transform("floors", lambda x, i: F.try_element_at("_kth", i))
    return anchors.join(kth, "_row", "left").withColumn("floors", F.when(F.col("_kth").isNull(), F.col("floors")).otherwise(floors)).drop("_kth")


def bounded(anchors: DataFrame, known: dict[int, Space], same: bool, low: int, high: int) -> dict[int, Space]:
    """The spaces with bounds for the second pass. Of a slot without k found, scores from ``low`` hundredths on (or all) are wanted."""
    most2 = F.create_map(*(F.lit(x) for d, s in known.items() for x in (d, s.most2)))[F.col("dim")]
    away = lambda score: F.sqrt(F.greatest(F.lit(0.0), F.col("length2") + most2 - 2 * score))
    slot = F.explode(F.arrays_zip("floors") if same else F.arrays_zip("floors", "scores"))
    each = anchors.select("dim", "cell", "label", "length2", slot.alias("s"))
    if same:
        far, near = F.when(F.col("s.floors").isNull(), float("inf")).otherwise(away(F.col("s.floors"))), F.lit(0.0)
    else:
        each = each.where("s.scores >= 0")
        far, near = away(F.greatest(F.col("s.scores") * (low / 100) * (1 - 1e-12) - 1, F.col("s.floors").cast("double"))), away(F.col("s.scores") * (high / 100) * (1 + 1e-12) + 1)
    by = each.withColumns({"_far": far, "_near": near}).groupBy("dim", "cell", *(["label"] if same else [])).agg(F.max("_far").alias("far"), F.min("_near").alias("near"))
    if same and by.count() > BOUNDS:
        same, by = False, by.groupBy("dim", "cell").agg(F.max("far").alias("far"), F.min("near").alias("near"))
    out, table = {}, by.collect()  # at most BOUNDS rows, or PIVOTS for each length
    for dim, s in known.items():
        own = [r for r in table if r.dim == dim]
        labels = np.array(sorted({r.label for r in own}) or [0], np.int64) if same else None
        far, near = np.full((len(labels) if same else 1, len(s.pivots)), -np.inf), np.full(len(s.pivots), np.inf)
        for r in own:
            far[np.searchsorted(labels, r.label) if same else 0, s.cell[r.cell]] = r.far
            near[s.cell[r.cell]] = min(near[s.cell[r.cell]], r.near)
        out[dim] = Space(s.most2, s.pivots, s.radius, s.group, s.parts, labels, far, near, s.cell)
    return out


def twice(rows: DataFrame, anchors: DataFrame, known: dict[int, Space], k: int, same: bool, low: int = 0, high: int = 0) -> tuple[DataFrame, str]:
    """The k best of each slot, in a scratch table: first from the nearest cells, then from all that the bounds leave."""
    first, at = common.materialise(ranked(joined(rows, anchors, known, k, same, low, high), k), "voronoi-first")
    anchors = floored(anchors, first, k)
    rest = joined(rows, anchors, bounded(anchors, known, same, low, high), k, same, low, high)
    out, path = common.materialise(ranked(first.drop("rank").unionByName(rest), k), "voronoi-best")
    common.discard(rows.sparkSession, at)
    return out, path


MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(vectors: DataFrame, asked: Column, scale: int = 256, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """MINED: of each anchor (a row for which ``asked`` holds) and each of its first ``positives`` other rows of its label, the first ``negatives`` rows of
    another label whose score is ``low`` to ``high`` hundredths of the positive's. Scores are inner products of floor(scale * x); higher ones come first, ties by
    smaller vec_id; ranks count from 1.

    ``vectors``: vec_id, embedding, label; other columns are ignored. Rows with a null label or id, a null vector or a null or non-finite component take no
    part. A vector meets those of its own length; one without components scores 0. Equal vectors and repeated rows are rows of their own: a row that has the
    anchor's id is no less a candidate, and a repeated anchor or positive has its own results. A positive with a negative score has none, fewer rows than asked for give fewer,
    an empty table none. Very long vectors are whole in memory, a group's anchors and an Arrow batch at once. Products beyond the range of a long are held to it.
    """
    spark = vectors.sparkSession
    whole = topk.whole(vectors.withColumn("_asked", F.coalesce(asked, F.lit(False))).select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("long"), "_asked").where("vec_id IS NOT NULL AND label IS NOT NULL"), scale)
    rows, at = common.materialise(whole.withColumn("_row", F.monotonically_increasing_id()), "voronoi-rows")
    known, anchors, at_anchors = spaces(rows)
    if not known:
        common.discard(spark, at, at_anchors)
        return spark.createDataFrame([], MINED)
    none = F.array(F.lit(None).cast("long"))
    near, at_near = twice(rows, anchors.withColumns({"scores": F.lit(None).cast("array<bigint>"), "floors": none}), known, positives, True)
    listed = near.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("scores"))
    placed, at_placed = common.materialise(anchors.join(listed, "_row").withColumn("floors", F.transform("scores", lambda _: F.lit(None).cast("long"))), "voronoi-placed")
    far, _ = twice(rows, placed, known, negatives, False, low, high)
    common.discard(spark, at, at_placed)
    slots = near.join(anchors.select("_row", F.col("vec_id").alias("anchor_id")), "_row").select("_row", (F.col("rank") - 1).alias("slot"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(slots, ["_row", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return mined(vectors, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, c.k, c.vec_id, a.label = c.label AS same, CASE WHEN len(a.v) = 0 THEN 0 ELSE CAST(list_inner_product(a.v, c.v) AS BIGINT) END AS score
  FROM v a JOIN v c ON a.k <> c.k AND len(a.v) = len(c.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT * FROM (SELECT anchor, anchor_id, k AS positive, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) AS r FROM s WHERE same)
  WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
