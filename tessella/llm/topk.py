"""Exact top-k by integer inner product over a pivot-distance index.

Every vector is keyed by its nearest pivot (a cell) and by its distance to it, in annuli of equal width. Of an annulus
the index knows the number of vectors, the least and the largest distance and the largest norm; these bounds of all annuli are a
small table. With q the query, p the pivot and r the largest distance, Cauchy-Schwarz gives q.x <= q.p + |q| r, and with the
distance range, the triangle inequality gives |q - x| >= gap and so 2 q.x <= |q|^2 + max|x|^2 - gap^2.

Each query expands the annuli in the order of its own bounds, in waves that grow by ``GROWTH``; after a wave it goes on only to
annuli whose bound reaches its k-th score so far, and stops when none does. Queries reach the annuli of a wave, and
none else, through a shuffle of both; annuli that no query goes to stay where they are, a large one is dealt out in parts. The best of all waves are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Pivots are fitted on a sample of at most SAMPLE vectors; every vector is indexed. As many cells as the square root of the vectors,
#: at most PIVOTS, of up to RINGS annuli, one for each TARGET vectors; an annulus of more than PART vectors is dealt out in parts.
SAMPLE, PIVOTS, RINGS, TARGET, PART = 4096, 256, 16, 4096, 16_384
#: The first wave's annuli, and by how much a wave exceeds the one before.
WAVE, GROWTH = 2, 8
#: Queries that are multiplied at once.
QUERIES = 256
#: Sums below this are exact in double precision.
EXACT = float(1 << 52)


def whole(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """The rows with v: floor(scale * x) of every component, and dim, their number; vectors that are null or hold null or
    non-finite components are left out. A vector without components counts as one zero, of dim 0."""
    ok = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    return vectors.where(ok).withColumns({"v": F.when(F.size("embedding") > 0, v).otherwise(F.array(F.lit(0.0))), "dim": F.size("embedding")}).drop("embedding")


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Spread-out rows of the sample: each the farthest from those before."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; where doubles could round, by Python's integers, held to the range of a long."""
    if not len(q) or not len(x) or np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(1, q.shape[1]) < EXACT:
        return (q @ x.T).astype(np.int64)
    rows = [[int(c) for c in v] for v in x.tolist()]
    out = [[max(-(1 << 63), min((1 << 63) - 1, sum(int(a) * b for a, b in zip(v, r, strict=True)))) for r in rows] for v in q.tolist()]
    return np.array(out, np.int64)


def keyed(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of each vector and the distance to it."""
    distance = np.sqrt(np.maximum(((v**2).sum(1)[:, None] - 2 * v @ pivots.T) + (pivots**2).sum(1), 0))
    cell = distance.argmin(1)
    return cell, distance[np.arange(len(v)), cell]


@dataclass
class Annuli:
    """Bounds of the annuli of one length of vectors."""

    pivots: np.ndarray
    cell: np.ndarray
    ring: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray  # the largest squared length
    count: np.ndarray

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """For each query and annulus, what no inner product exceeds."""
        length2, product = (q**2).sum(1)[:, None], q @ self.pivots.T
        to = np.sqrt(np.maximum(length2 - 2 * product + (self.pivots**2).sum(1), 0))[:, self.cell]
        straight = product[:, self.cell] + np.sqrt(length2) * self.high
        gap = np.maximum(0, np.maximum(to - self.high, self.low - to))
        bound = np.minimum(straight, (length2 + self.norm - gap**2) / 2)
        return bound + 1 + 1e-9 * np.abs(bound) + 1e-9 * (length2 + self.norm)  # rounding of the bounds

    def wave(self, q: np.ndarray, worst: np.ndarray, done: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, annulus) pairs of the next ``n`` annuli in the order of each query's bounds, ``done`` being behind it."""
        bound = self.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")[:, done : done + n]
        row, at = np.nonzero(np.take_along_axis(bound, order, 1) >= worst[:, None])
        return row, order[row, at]


def batched(dims: np.ndarray, column: pa.Array) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Runs of equal length in a batch: the length, the rows and their vectors."""
    flat, width = column.flatten().to_numpy(zero_copy_only=False), np.maximum(dims, 1).astype(np.int64)
    offset, at = np.concatenate([[0], np.cumsum(width)]), common.runs(dims)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if e > s:
            yield int(dims[s]), slice(s, e), flat[offset[s] : offset[e]].reshape(e - s, width[s])


def indexed(rows: DataFrame) -> tuple[DataFrame, dict[int, Annuli], str]:
    """The rows with cell and ring; the bounds of the annuli of each length of vectors; and the scratch table."""
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row for each length of vectors
    pivots = {}
    for dim, n in sizes.items():
        share = rows.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("v"), F.lit(1 << 20)) <= (1 << 20) * SAMPLE / n)).limit(SAMPLE).select("v")
        sample = np.array([r.v for r in share.collect()] or [[0.0] * max(1, dim)], float)
        pivots[dim] = choose_pivots(np.unique(sample, axis=0), max(1, min(PIVOTS, int(n**0.5))))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, distance = np.zeros(len(b), np.int32), np.zeros(len(b))
            norm = np.zeros(len(b))
            for dim, at, v in batched(b.column(2).to_numpy(), b.column(3)):
                cell[at], distance[at] = keyed(v, pivots[dim])
                norm[at] = (v**2).sum(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(distance), pa.array(norm)], [*b.schema.names, "cell", "distance", "norm"])

    known, path = common.materialise(rows.select("_row", "vec_id", "dim", "v").mapInArrow(near, "_row long, vec_id long, dim int, v array<double>, cell int, distance double, norm double"), "topk-index")
    widest = {(r.dim, r.cell): (r.low, r.high, r.n) for r in known.groupBy("dim", "cell").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).collect()}  # at most PIVOTS rows for each length
    table = [(d, c, low, max(high - low, 1e-9), max(1, min(RINGS, n // TARGET))) for (d, c), (low, high, n) in widest.items()]
    cells = rows.sparkSession.createDataFrame(table, "dim int, cell int, _low double, _wide double, _rings int")
    # As many rows as there are cells: at most PIVOTS for each length.
    ringed = known.join(F.broadcast(cells), ["dim", "cell"]).withColumn("ring", F.least(F.floor((F.col("distance") - F.col("_low")) / F.col("_wide") * F.col("_rings")), F.col("_rings") - 1).cast("int")).drop("_low", "_wide", "_rings")
    stats = ringed.groupBy("dim", "cell", "ring").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("norm").alias("norm"), F.count("*").alias("n")).orderBy("dim", "cell", "ring").collect()  # at most PIVOTS * RINGS rows for each length
    annuli = {}
    for dim in sizes:
        own = [r for r in stats if r.dim == dim]
        annuli[dim] = Annuli(pivots[dim], *(np.array([r[k] for r in own], t) for k, t in (("cell", int), ("ring", int), ("low", float), ("high", float), ("norm", float), ("n", int))))
    return ringed, annuli, path


def sent(queries: DataFrame, annuli: dict[int, Annuli], done: int, n: int) -> DataFrame:
    """The queries once for each part of an annulus of the wave. ``queries``: _row, dim, v, worst."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worst = b.column(3).to_numpy(zero_copy_only=False)
            for dim, at, v in batched(b.column(1).to_numpy(), b.column(2)):
                for a in range(0, len(v), QUERIES):
                    own = annuli[dim]
                    row, ring = own.wave(v[a : a + QUERIES], worst[at][a : a + QUERIES], done, n)
                    parts = -(-own.count[ring] // PART)
                    part = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                    row, ring = np.repeat(row, parts), np.repeat(ring, parts)
                    yield b.slice(at.start + a, min(QUERIES, len(v) - a)).take(pa.array(row)).append_column("cell", pa.array(own.cell[ring], pa.int32())).append_column("ring", pa.array(own.ring[ring], pa.int32())).append_column("part", pa.array(part, pa.int32()))

    return queries.select("_row", "dim", "v", "worst").mapInArrow(run, "_row long, dim int, v array<double>, worst double, cell int, ring int, part int")


FOUND = "_row long, vec_id long, score long"


def searched(index: DataFrame, asking: DataFrame, annuli: dict[int, Annuli], k: int) -> DataFrame:
    """Rows of FOUND: for each query that met a part of an annulus, its k best there that are at least its worst so far."""
    counts = [(d, int(c), int(r), -(-int(n) // PART)) for d, own in annuli.items() for c, r, n in zip(own.cell, own.ring, own.count, strict=True)]
    parts = F.broadcast(index.sparkSession.createDataFrame(counts, "dim int, cell int, ring int, _parts int"))  # a row for each annulus
    met = F.broadcast(asking.select("dim", "cell", "ring").distinct())  # no more rows than annuli
    held = index.join(met, ["dim", "cell", "ring"], "left_semi").join(parts, ["dim", "cell", "ring"]).select("_row", "dim", "v", F.lit(0.0).alias("worst"), "cell", "ring", F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int").alias("part"), "vec_id", F.lit(0).alias("kind"))
    both = held.unionByName(asking.withColumns({"vec_id": F.lit(None).cast("long"), "kind": F.lit(1)}))
    place = ["dim", "cell", "ring", "part"]
    dealt = both.repartition(common.shuffle_width(index.sparkSession), *place).sortWithinPartitions(*place, "kind", "_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, waiting = None, [], []

        def answer() -> pa.RecordBatch:
            x, ids, rows = (np.concatenate(c) for c in zip(*held, strict=True))
            held[:] = [(x, ids, rows)]
            q, asked, worst = (np.concatenate(c) for c in zip(*waiting, strict=True))
            waiting.clear()
            out = [[], [], []]
            for a in range(0, len(q), QUERIES):
                score = products(q[a : a + QUERIES], x)
                for s, own, least in zip(score, asked[a : a + QUERIES].tolist(), worst[a : a + QUERIES].tolist(), strict=True):
                    at = np.flatnonzero((s >= least) & (rows != own))
                    if len(at) > k:  # ties of the k-th score are all looked at
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                    at = at[np.lexsort((ids[at], -s[at]))[:k]]
                    for column, values in zip(out, (np.full(len(at), own), ids[at], s[at]), strict=True):
                        column.append(values)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*c, np.zeros(0, np.int64)]).astype(np.int64)) for c in out], [c.split()[0] for c in FOUND.split(", ")])

        for b in batches:
            if not len(b):
                continue
            keys = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in (1, 4, 5, 6, 8)]).astype(np.int64)
            cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1, [len(b)]])
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if here != tuple(keys[s, :4]):
                    if waiting and held:
                        yield answer()
                    here = tuple(keys[s, :4])
                    held.clear()
                    waiting.clear()
                piece = b.slice(s, e - s)
                v = piece.column(2).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1)
                row = piece.column(0).to_numpy()
                if keys[s, 4]:
                    waiting.append((v, row, piece.column(3).to_numpy()))
                    if held and sum(len(w[1]) for w in waiting) >= 8 * QUERIES:
                        yield answer()
                else:
                    held.append((v, piece.column(7).to_numpy(), row))
        if waiting and held:
            yield answer()

    return dealt.select("_row", "dim", "v", "worst", "cell", "ring", "part", "vec_id", "kind").mapInArrow(run, FOUND)


def best(vectors: DataFrame, asked: Column, k: int = 10) -> tuple[DataFrame, dict[str, int]]:
    """query_id, rank, vec_id, score: the k highest integer inner products of each row for which ``asked`` holds, with all rows
    but itself, ties to the smaller vec_id; and how many (query, annulus) pairs there were and were visited.

    ``vectors``: vec_id, embedding; other columns are ignored. A query meets vectors of its own length only. Vectors null or with null or
    non-finite components take no part, nor do null ids; vectors without components have score 0 with each other. Equal vectors and repeated rows are rows of their own:
    a row of the query's id is a candidate like any other, and each row of a repeated query id has its own list. Fewer rows than k give fewer
    results, an empty table none. Very long vectors are whole in memory, some thousands (an annulus part) at once. Components and scores beyond the
    range of a long are held to it, and such scores tie.
    """
    spark = vectors.sparkSession
    own = whole(vectors.withColumn("_asked", F.coalesce(asked, F.lit(False))).select(F.col("vec_id").cast("long"), "embedding", "_asked").where("vec_id IS NOT NULL"))
    rows, at_rows = common.materialise(own.withColumn("_row", F.monotonically_increasing_id()), "topk-rows")
    index, annuli, at_index = indexed(rows)
    queries = rows.where("_asked").select("_row", F.col("vec_id").alias("query_id"), "dim", "v").withColumn("worst", F.lit(float("-inf")))
    most, done, wave, found, paths, visited = max((len(a.cell) for a in annuli.values()), default=0), 0, WAVE, None, [], 0
    top = Window.partitionBy("_row").orderBy(F.desc("score"), "vec_id")
    while done < most:
        asking, at_asking = common.materialise(sent(queries, annuli, done, wave), "topk-asking")
        n = asking.where("part = 0").count()
        visited += n
        if n:
            new = searched(index, asking, annuli, k)
            new = new if found is None else found.unionByName(new)
            found, at = common.materialise(new.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k).drop("rank"), "topk-found")
            paths.append(at)
            worst = found.groupBy("_row").agg(F.count("*").alias("_n"), F.min("score").cast("double").alias("_worst"))
            queries = queries.drop("worst").join(worst, "_row", "left").withColumn("worst", F.when(F.col("_n") >= k, F.col("_worst")).otherwise(float("-inf"))).drop("_n", "_worst")
        common.discard(spark, at_asking)
        done, wave = done + wave, wave * GROWTH
    if found is None:
        common.discard(spark, at_rows, at_index)
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long"), {"pairs": 0, "visited": 0}
    sizes = {r.dim: r["count"] for r in queries.groupBy("dim").count().collect()}
    common.discard(spark, at_index, *paths[:-1])
    ids = rows.where("_asked").select("_row", F.col("vec_id").alias("query_id"))
    out = found.withColumn("rank", F.row_number().over(top).cast("int")).join(ids, "_row").select("query_id", "rank", "vec_id", "score")
    return out, {"pairs": sum(n * len(annuli[d].cell) for d, n in sizes.items()), "visited": visited}


def op10_topk(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return best(vectors, F.col("vec_id") % 100 == 0)[0]


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, CASE WHEN len(q.v) = 0 THEN 0 ELSE CAST(list_inner_product(q.v, c.v) AS BIGINT) END AS score
  FROM v q JOIN v c ON q.k <> c.k AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
