"""Approximate nearest neighbours by stable projections and a kd-tree (operator 9)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm._shared import discard, materialize, tidy
from codeloom.llm.inner_product import matrix

#: Rows the tree is fitted on, about; rows of one search block; leaves at most; rows a leaf, where that makes fewer; leaves that a query visits first.
SAMPLE, BLOCK, LEAVES, LEAF_ROWS, FIRST = 1 << 16, 4096, 1 << 14, 128, 2
#: Part of the squared lengths of two vectors that their squared distance may miss by rounding.
SLACK = 1e-9


def chi_square_quantile(p: float, m: int) -> float:
    """The ``p`` quantile of chi-square with an even number ``m`` of degrees of freedom."""

    def cdf(x):
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 20.0 * m + 200
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree over projected points: equal halves of the widest direction, down to ``leaves``."""

    def __init__(self, points: np.ndarray, leaves: int):
        self.axis, self.cut = [], []  # in heap order
        dims = points.shape[1]
        depth = max(0, int(math.log2(max(1, min(leaves, max(1, len(points) // 4))))))
        cells = [(points, np.full(dims, -np.inf), np.full(dims, np.inf))]
        for _ in range(depth):
            below = []
            for pts, lo, hi in cells:
                axis = int(np.argmax(pts.max(axis=0) - pts.min(axis=0))) if len(pts) else 0
                cut = float(np.median(pts[:, axis])) if len(pts) else 0.0
                self.axis.append(axis), self.cut.append(cut)
                right = pts[:, axis] >= cut
                lo2, hi2 = lo.copy(), hi.copy()
                hi2[axis], lo2[axis] = min(hi[axis], cut), max(lo[axis], cut)
                below += [(pts[~right], lo, hi2), (pts[right], lo2, hi)]
            cells = below
        self.depth, self.lo, self.hi = depth, np.array([c[1] for c in cells]), np.array([c[2] for c in cells])
        self.axis, self.cut = np.array(self.axis, np.int64), np.array(self.cut)

    def leaf(self, y: np.ndarray) -> np.ndarray:
        at = np.zeros(len(y), np.int64)
        for _ in range(self.depth):
            at = 2 * at + 1 + (y[np.arange(len(y)), self.axis[at]] >= self.cut[at])
        return at - ((1 << self.depth) - 1)

    def distances(self, y: np.ndarray) -> np.ndarray:
        """Squared distance from one projected point to every leaf's box."""
        d = np.maximum(np.maximum(self.lo - y, y - self.hi), 0)
        return (d * d).sum(axis=1)


def _projection(dim: int, m: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, m))


def _assigner(tree: Tree, dim: int, m: int, seed: int):
    def assign(batches):
        r = _projection(dim, m, seed)
        for batch in batches:
            ids, vecs = (batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "v"))
            yield pa.record_batch([pa.array(tree.leaf(matrix(vecs, dim).astype(np.float64) @ r), pa.int32()), ids, vecs], names=["cell", "vec_id", "v"])

    return assign


def _projector(dim: int, m: int, seed: int):
    def project(batches):
        r = _projection(dim, m, seed)
        for batch in batches:
            y = (matrix(batch.column(batch.schema.get_field_index("v")), dim).astype(np.float64) @ r).astype(np.float32)
            yield pa.record_batch([pa.array([row.tobytes() for row in y], pa.binary())], names=["y"])

    return project


def _router(tree: Tree, dim: int, m: int, seed: int, limit: float | None):
    """Queries with their distance bound: to the ``FIRST`` nearest leaves without ``limit``, else to every other that the stopping test does not rule out."""

    def route(batches):
        r = _projection(dim, m, seed)
        for batch in batches:
            vecs = batch.column(batch.schema.get_field_index("v"))
            for n, (i, bound, y) in enumerate(zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("vec_id", "bound")), matrix(vecs, dim).astype(np.float64) @ r, strict=True)):
                far = tree.distances(y)
                near = np.argsort(far, kind="stable")
                cells = near[:FIRST]
                if limit is not None:
                    cells = near[FIRST:]
                    cells = cells[far[cells] <= (np.inf if bound is None else limit * bound * bound + SLACK * (y @ y))]
                yield pa.record_batch([pa.array(cells, pa.int32()), pa.array([i] * len(cells), pa.int64()), vecs.take(pa.array([n] * len(cells), pa.int64())), pa.array([bound] * len(cells), pa.float64())], names=["cell", "vec_id", "v", "bound"])

    return route


def _search_block(ids, pts, proj, qids, q, qproj, bound, k, limit, step=256):
    """Verify points in order of projected distance until the chi-square test holds; k best a query."""
    size = (qproj**2).sum(1)[:, None] + (proj**2).sum(1)[None]
    d2 = np.maximum(size - 2 * qproj @ proj.T, 0)
    d2 -= np.minimum(d2, SLACK * size)  # what is only rounding counts as no distance
    order = np.argsort(d2, axis=1)
    best_d, best_i = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    rows = np.arange(len(q))
    for at in range(0, len(ids), step):
        far = np.minimum(best_d[:, -1], bound)
        rows = np.flatnonzero(d2[np.arange(len(q)), order[:, at]] <= limit * far * far)
        if not len(rows):
            break
        pick = order[rows, at : at + step]
        diff = pts[pick] - q[rows][:, None, :]
        d = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        d[ids[pick] == qids[rows][:, None]] = np.inf
        d, i = np.hstack([best_d[rows], d]), np.hstack([best_i[rows], ids[pick]])
        top = np.lexsort((i, d), axis=1)[:, :k]
        best_d[rows], best_i[rows] = np.take_along_axis(d, top, 1), np.take_along_axis(i, top, 1)
    return best_d, best_i


def _searcher(dim: int, m: int, seed: int, k: int, limit: float):
    def search(batches):
        r = _projection(dim, m, seed)
        now, ids, pts, arrays, waiting = None, [], [], None, []

        def answer():
            nonlocal arrays, waiting
            if not waiting or not ids:
                waiting = []
                return None
            if arrays is None:
                x = np.concatenate(pts).astype(np.float64)
                arrays = np.concatenate(ids), x, x @ r
            q = np.array([w[1] for w in waiting], np.float64)
            qi = np.array([w[0] for w in waiting], np.int64)
            bound = np.array([np.inf if w[2] is None else w[2] for w in waiting])
            d, i = _search_block(*arrays, qi, q, q @ r, bound, k, limit)
            waiting = []
            ok = np.isfinite(d) & (d <= bound[:, None])
            return pa.record_batch([pa.array(np.repeat(qi, k)[ok.ravel()], pa.int64()), pa.array(i[ok], pa.int64()), pa.array(d[ok], pa.float64())], names=["query_id", "vec_id", "score"])

        for batch in batches:
            cell, sub, asks, vids = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "sub", "ask", "vec_id"))
            vecs, bounds = matrix(batch.column(batch.schema.get_field_index("v")), dim), batch.column(batch.schema.get_field_index("bound")).to_pylist()
            begins = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1])]).tolist() if len(cell) else []
            for a, b in zip(begins, [*begins[1:], len(cell)], strict=True):
                if (cell[a], sub[a]) != now:
                    if out := answer():
                        yield out
                    now, ids, pts, arrays = (cell[a], sub[a]), [], [], None
                first = a + int(np.searchsorted(asks[a:b], True))  # points come before queries
                if first > a:
                    ids.append(vids[a:first]), pts.append(vecs[a:first])
                for n in range(first, b):
                    waiting.append((vids[n], vecs[n], bounds[n]))
                    if len(waiting) >= 48 and (out := answer()):
                        yield out
        if out := answer():
            yield out

    return search


def nearest(vectors: DataFrame, k: int = 10, every: int = 100, dims: int = 16, confidence: float = 0.97, seed: int = 9) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for every row whose vec_id is divisible by ``every``.

    Gaussian (2-stable) projections to ``dims`` numbers are indexed by a
    kd-tree fitted on about ``SAMPLE`` rows, of which only the projections
    come to the driver; every row is in the index, whose leaves grow in
    number with the rows up to ``LEAVES`` and beyond that in blocks. A
    query first searches the ``FIRST`` nearest leaves, which bound its k-th
    distance d; it then visits each other leaf whose box is nearer than the
    chi-square stopping test allows: a projected squared distance over quantile(``confidence``) x
    d^2 ends the search. Inside a leaf, points are verified by growing
    projected distance until the same test holds, on original vectors in
    double precision. A true neighbour is missed with probability
    1 - ``confidence`` at most. Leaves are searched in blocks of bounded
    rows, so equal vectors in any number make no hot task.

    Vectors that are null, zero, of another length than most, or with null or
    non-finite components take no part, nor do rows without vec_id. Ties go
    to the smaller vec_id; of rows that repeat a vec_id a query uses the
    least vector and a candidate the nearest. Without usable vectors, as in an
    empty table, there are no rows. Other columns are ignored.
    """
    if dims % 2:
        raise ValueError("dims must be even")
    spark = vectors.sparkSession
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    v = F.col("embedding").cast("array<float>")
    valid = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    shape = valid.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    fields = "query_id long, vec_id long, score double"
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, n = shape[0].dim, shape[0].n
    valid = valid.where(F.size("v") == dim)
    share = min(1.0, SAMPLE / n)
    picked = valid.where(F.xxhash64("vec_id", F.lit(seed)) / 2.0**64 + 0.5 < share).select("v").mapInArrow(tidy(_projector(dim, dims, seed)), "y binary").toArrow()["y"].to_pylist()
    sample = np.frombuffer(b"".join(sorted(picked)), np.float32).reshape(-1, dims).astype(np.float64)
    tree = Tree(sample, min(LEAVES, -(-n // LEAF_ROWS)))
    limit = chi_square_quantile(confidence, dims)
    points = materialize(valid.mapInArrow(tidy(_assigner(tree, dim, dims, seed)), "cell int, vec_id long, v array<float>"))
    subs = points.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("subs"))
    there = points.join(subs, "cell").select("cell", F.pmod(F.xxhash64("vec_id"), "subs").cast("int").alias("sub"), F.lit(False).alias("ask"), "vec_id", "v", F.lit(None).cast("double").alias("bound"))
    queries = points.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))

    def visit(asks: DataFrame) -> DataFrame:
        asks = asks.join(subs, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.lit(True).alias("ask"), "vec_id", "v", "bound")
        dealt = there.unionByName(asks).repartition("cell", "sub").sortWithinPartitions("cell", "sub", "ask")
        return dealt.mapInArrow(tidy(_searcher(dim, dims, seed, k, limit)), fields)

    def ranked(found: DataFrame) -> DataFrame:
        once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return once.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)

    routed = lambda asks, test: asks.mapInArrow(tidy(_router(tree, dim, dims, seed, test)), "cell int, vec_id long, v array<float>, bound double")
    first = materialize(ranked(visit(routed(queries.withColumn("bound", F.lit(None).cast("double")), None))).select("query_id", "vec_id", "score", "rank"))
    bounds = first.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
    rest = visit(routed(queries.join(bounds, "vec_id", "left"), limit))
    found = materialize(ranked(first.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", "rank", "vec_id", "score"))
    discard(points), discard(first)
    return found
