"""Exact search for the greatest inner products with two cover trees (operator 12)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm._shared import discard, materialize, tidy

#: Rows that the cells are chosen from, about; cells at most; rows a cell, where there are fewer.
SAMPLE, CELLS, CELL_ROWS = 1 << 14, 1 << 10, 512
#: Rows of one block of a cell; queries looked at together; queries that one task looks at in a block, about; points of a leaf.
BLOCK, TOGETHER, PART, LEAF = 4096, 512, 1 << 16, 16
#: Part of two lengths' product that a bound may miss by rounding.
SLACK = 1e-9


def finite_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """The columns of ``rows``, ``embedding`` as v, floor(``scale`` * x) of each component; without vectors that are null or hold null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    whole = rows.where(x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return whole.withColumn("embedding", F.transform(x, lambda c: F.floor(c * float(scale)))).withColumnRenamed("embedding", "v")


def padded(v: Column, dim: int) -> Column:
    """``v`` with zeros up to ``dim`` components."""
    return F.concat(v, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(v)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def apart(points: np.ndarray, start: int, radius: float, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Farthest-first centres from ``start`` until all points are within ``radius`` of one: (centres, each point's centre's number, its distance)."""
    size = np.einsum("ij,ij->i", points, points)
    centres, owner, near = [], np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    at = start
    while True:
        d = np.maximum(size + size[at] - 2 * (points @ points[at]), 0)
        d[at] = 0
        closer = d < near
        owner[closer], near[closer] = len(centres), d[closer]
        centres.append(at)
        at = int(np.argmax(near))
        if len(centres) >= most or near[at] <= radius * radius:
            return centres, owner, np.sqrt(near)


class CoverTree:
    """Nodes over points: each covers its points within ``radius`` of a centre that is one of them, its children within half of that, their centres further apart than that."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.centre, self.radius, self.below, self.members = points, [], [], [], []
        size = np.sqrt(np.einsum("ij,ij->i", points, points))
        todo = [(np.arange(len(points)), 0, self._add(None))] if len(points) else []
        while todo:
            rows, first, node = todo.pop()
            own = points[rows]
            radius = float(np.sqrt(((own - own[first]) ** 2).sum(axis=1).max()))
            self.centre[node], self.radius[node], self.members[node] = rows[first], radius, rows
            if len(rows) <= leaf or radius == 0:
                continue
            centres, owner, _ = apart(own, first, radius / 2, len(rows))
            if len(centres) == 1:  # rounding: the points are as good as equal
                continue
            order = np.argsort(owner, kind="stable")
            for k, group in enumerate(np.split(order, np.cumsum(np.bincount(owner, minlength=len(centres)))[:-1])):
                todo.append((rows[group], int(np.flatnonzero(group == centres[k])[0]), self._add(node)))
        self.centre, self.radius = np.array(self.centre, np.int64), np.array(self.radius, np.float64)
        self.inner = np.array([bool(b) for b in self.below], bool)
        self.at, self.size = points[self.centre], size[self.centre]

    def _add(self, parent):
        self.centre.append(0), self.radius.append(0.0), self.below.append([]), self.members.append(None)
        if parent is not None:
            self.below[parent].append(len(self.below) - 1)
        return len(self.below) - 1


class Best:
    """The ``k`` greatest products of each query so far; equal ones by the point's id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.score, self.key, self.row = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -1)
        self.worst = floor.copy()

    def take(self, queries: np.ndarray, scores: np.ndarray, keys: np.ndarray, rows: np.ndarray):
        hit = (scores >= self.worst[queries][:, None]).any(axis=1)
        if not hit.any():
            return
        queries, scores = queries[hit], scores[hit]
        n = len(queries)
        s = np.hstack([self.score[queries], scores])
        i = np.hstack([self.key[queries], np.broadcast_to(keys, (n, len(keys)))])
        r = np.hstack([self.row[queries], np.broadcast_to(rows, (n, len(rows)))])
        top = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[queries], self.key[queries], self.row[queries] = (np.take_along_axis(x, top, 1) for x in (s, i, r))
        self.worst[queries] = np.maximum(self.floor[queries], self.score[queries, -1])


def dual_search(asked: CoverTree, tree: CoverTree, keys: np.ndarray, best: Best, products) -> int:
    """Both trees are walked together; a pair of nodes whose greatest possible product is below each query's worst goes. Returns the products computed."""
    if not len(asked.points) or not len(tree.points):
        return 0
    todo, done = [(0, np.zeros(1, np.int64))], 0
    while todo:
        q, nodes = todo.pop()
        queries = asked.members[q]
        reach = tree.at[nodes] @ asked.at[q] + asked.radius[q] * tree.size[nodes] + tree.radius[nodes] * asked.size[q] + tree.radius[nodes] * asked.radius[q]
        reach += SLACK * (asked.size[q] + asked.radius[q]) * (tree.size[nodes] + tree.radius[nodes])
        keep = reach >= best.worst[queries].min()
        nodes, reach = nodes[keep], reach[keep]
        if not len(nodes):
            continue
        inner = tree.inner[nodes]
        if asked.inner[q] and (not inner.any() or asked.radius[q] >= tree.radius[nodes].max()):
            todo += [(c, nodes) for c in asked.below[q]]
        elif inner.any():
            opened = [c for n in nodes[inner] for c in tree.below[n]]
            todo.append((q, np.concatenate([nodes[~inner], np.array(opened, np.int64)])))
        else:
            for n in np.split(nodes := nodes[np.argsort(-reach, kind="stable")], range(8, len(nodes), 64)):
                top = (tree.at[n] @ asked.at[q] + asked.radius[q] * tree.size[n] + tree.radius[n] * (asked.size[q] + asked.radius[q])) + SLACK * (asked.size[q] + asked.radius[q]) * (tree.size[n] + tree.radius[n])
                n = n[top >= best.worst[queries].min()]
                if len(n):
                    rows = np.concatenate([tree.members[x] for x in n])
                    best.take(queries, products(asked.points[queries], tree.points[rows]), keys[rows], rows)
                    done += len(queries) * len(rows)
    return done


def _assigner(centres: np.ndarray):
    def assign(batches):
        size = (centres**2).sum(axis=1)
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("v")), centres.shape[1]).astype(np.float64)
            cell = np.argmin(size[None] - 2 * (x @ centres.T), axis=1)
            far = np.sqrt(((x - centres[cell]) ** 2).sum(axis=1))
            yield pa.record_batch([*batch.columns, pa.array(cell, pa.int32()), pa.array(far, pa.float64())], names=[*batch.schema.names, "cell", "far"])

    return assign


def _searcher(dim: int, k: int, exact: bool):
    """Batches in order of (block, points before queries) to the best points of each query in its block."""
    whole = np.float64 if exact else np.int64
    products = (lambda q, x: q @ x.T) if exact else (lambda q, x: (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.float64))

    def search(batches):
        now, points, ids, tree, asked = None, [], [], None, []

        def answer():
            nonlocal tree
            q, who, floor = (np.concatenate(c) for c in zip(*asked, strict=True))
            asked.clear()
            if not points:
                return None
            if tree is None:
                x = np.concatenate(points).astype(np.float64)
                tree = CoverTree(x), np.array([i[0] for i in ids], np.int64)
            best = Best(len(q), k, floor)
            dual_search(CoverTree(q.astype(np.float64)), tree[0], tree[1], best, products)
            ok = (best.row >= 0) & (best.score >= floor[:, None])
            rows, at = best.row[ok], np.nonzero(ok)[0]
            score = np.einsum("ij,ij->i", q[at].astype(whole), tree[0].points[rows].astype(whole)).astype(np.int64)
            return pa.record_batch([pa.array(who[at], pa.int64()), pa.array(score, pa.int64()), pa.array([ids[r] for r in rows], pa.list_(pa.int64()))], names=["qkey", "score", "ids"])

        for batch in batches:
            cell, sub, part, ask, key, bound = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("cell", "sub", "part", "ask", "qkey", "bound"))
            v, listed = matrix(batch.column(batch.schema.get_field_index("v")), dim), batch.column(batch.schema.get_field_index("ids"))
            new = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (sub[1:] != sub[:-1]) | (part[1:] != part[:-1])]) if len(cell) else []
            for a, b in zip(new, [*new[1:], len(cell)], strict=True):
                if (cell[a], sub[a], part[a]) != now:
                    if asked and (out := answer()):
                        yield out
                    now, points, ids, tree = (cell[a], sub[a], part[a]), [], [], None
                    asked.clear()
                first = a + int(np.searchsorted(ask[a:b], True))
                if first > a:
                    points.append(v[a:first]), ids.extend(listed.slice(a, first - a).to_pylist())
                for s in range(first, b, TOGETHER):
                    e = min(b, s + TOGETHER)
                    asked.append((v[s:e], key[s:e].astype(np.int64), bound[s:e].astype(np.float64)))
                    if sum(len(x[1]) for x in asked) >= TOGETHER and (out := answer()):
                        yield out
        if asked and (out := answer()):
            yield out

    return search


def greatest_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of greatest inner product, for every row whose vec_id is divisible by ``every``.

    Components count as floor(``scale`` * x). Equal vectors are searched once
    and keep their k + 1 least ids, so copies in any number make no hot task.
    About ``SAMPLE`` rows give farthest-first centres of up to ``CELLS`` cells, the tree's
    upper level; every row, query or not, goes to its nearest centre, and a cell's exact
    radius is taken over all its rows. Each cell of queries is first held
    against the most promising cells, which gives a worst k-th score; then against all cells whose
    centres' product and both radii do not rule out a better or equal one. Inside a block
    of a cell, points and queries are each put in a cover tree and both trees
    are walked together, pairs of nodes pruned by the same bound. Nothing is approximate:
    pruning leaves room for rounding, and scores are integers. On vectors
    without structure little is pruned and the work nears queries x rows.

    Rows without vec_id, and vectors that are null or hold null or non-finite
    components, take no part. Shorter vectors count as padded with zeros. Of rows that
    repeat a vec_id the least vector counts. Ties go to the smaller vec_id.
    No usable vectors, as in an empty table: no rows. Other columns are ignored.
    Components that would make a product pass 63 bits are an error.
    """
    spark = vectors.sparkSession
    rows = finite_vectors(vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), scale)
    shape = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("most")).head()
    dim, most = shape.dim or 0, shape.most or 0.0
    if most**2 * dim >= 2**63 or most >= 2**31:
        raise ValueError("inner products would not fit in 63 bits")
    if shape.dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, dim)
    kind = "array<int>"
    points = materialize(rows.select("vec_id", padded(F.col("v"), dim).cast(kind).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v")))
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    different = points.withColumn("n", first).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asking = points.where(F.col("vec_id") % every == 0)
    different, queries = materialize(different), materialize(asking.groupBy("v").agg(F.min("vec_id").alias("qkey")))
    n, n_queries = different.count(), queries.count()
    share = min(1.0, SAMPLE / max(1, n))
    picked = different.where(F.xxhash64("v", F.lit(12)) / 2.0**64 + 0.5 < share).select("v").orderBy("v").toArrow()["v"].combine_chunks()
    sample = matrix(picked, dim).astype(np.float64) if len(picked) else np.zeros((1, dim))
    start = int(np.argmin(((sample - sample.mean(axis=0)) ** 2).sum(axis=1)))
    centres = sample[apart(sample, start, 0.0, min(CELLS, -(-n // CELL_ROWS)))[0]]
    placed = lambda df: materialize(df.mapInArrow(tidy(_assigner(centres)), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cell int, far double"))
    data, asks = placed(different), placed(queries)
    cells = {r.cell: r for r in data.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()}
    groups = {r.cell: r for r in asks.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    subs = {c: -(-r.n // BLOCK) for c, r in cells.items()}
    parts = max(1, -(-n_queries // PART))
    by_sub = spark.createDataFrame(sorted(subs.items()), "cell int, subs int")
    block = data.join(F.broadcast(by_sub), "cell").select("cell", F.pmod(F.xxhash64("v"), "subs").cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("ask"), F.lit(0).cast("long").alias("qkey"), F.lit(0.0).alias("bound"), "v", "ids")

    def visited(asks: DataFrame, pairs: list[tuple]) -> DataFrame:
        """Queries (cell as own, qkey, v, bound) held against blocks low to high of the cells that pairs (own, cell, low, high) name, ``CELLS`` squared of them at most."""
        told = spark.createDataFrame(pairs, "own int, cell int, low int, high int")
        sent = asks.join(F.broadcast(told), "own").select("cell", F.explode(F.sequence("low", "high")).alias("sub"), F.pmod(F.xxhash64("own"), F.lit(parts)).cast("int").alias("part"), F.lit(True).alias("ask"), "qkey", "bound", "v", F.array().cast("array<bigint>").alias("ids"))
        dealt = block.unionByName(sent).repartition("cell", "sub", "part").sortWithinPartitions("cell", "sub", "part", "ask")
        found = dealt.mapInArrow(tidy(_searcher(dim, k + 1, most**2 * dim < 2**52)), "qkey long, score long, ids array<bigint>")
        return found.select("qkey", "score", F.explode("ids").alias("vec_id"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("place", F.row_number().over(Window.partitionBy("qkey").orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)

    own, there = sorted(groups), sorted(cells)
    product = centres[own] @ centres[there].T
    near = {c: [there[j] for j in np.argsort(-product[i], kind="stable")[:2]] for i, c in enumerate(own)}
    asks = asks.select(F.col("cell").alias("own"), "qkey", "v")
    lowest = F.lit(float("-inf"))
    begun = materialize(ranked(visited(asks.withColumn("bound", lowest), [(c, d, 0, 0) for c in own for d in near[c]])))
    worst = begun.where(F.col("place") == k + 1).select("qkey", F.col("score").cast("double").alias("bound"))
    asks = materialize(asks.join(worst, "qkey", "left").withColumn("bound", F.coalesce("bound", lowest)))
    least = {r.own: r.least for r in asks.groupBy("own").agg(F.min("bound").alias("least")).collect()}
    size, far = np.sqrt((centres**2).sum(axis=1)), np.array([cells[c].far for c in there])
    pairs = []
    for i, c in enumerate(own):
        reach = product[i] + groups[c].far * size[there] + far * (size[c] + groups[c].far)
        reach += SLACK * (size[c] + groups[c].far) * (size[there] + far) + 1e-6
        for j in np.flatnonzero(reach >= least[c]):
            low = int(there[j] in near[c])  # the first block was visited
            if low < subs[there[j]]:
                pairs.append((c, there[j], low, subs[there[j]] - 1))
    found = begun.select("qkey", "score", "vec_id")
    if pairs:
        found = found.unionByName(visited(asks, pairs))
    best = ranked(found).groupBy("qkey").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))).alias("best"))
    each = asking.join(queries, "v").select(F.col("vec_id").alias("query_id"), "qkey").join(best, "qkey")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = materialize(each.select("query_id", F.posexplode(others).alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.low")).alias("score")))
    for table in (points, different, queries, data, asks, begun):
        discard(table)
    return out
