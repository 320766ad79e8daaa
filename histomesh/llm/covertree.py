"""Exact top-k by inner product: dual-tree search over cover trees of queries and data.

Vectors are dealt out into blocks of bounded size around pivots, and every block, of queries
and of data alike, is indexed by a cover tree: the children of a node lie within its covering
radius and further than half of it from each other. For two nodes with centres q, d and radii
a, b no inner product between their points exceeds ``qd + |q| b + |d| a + a b``; a pair of nodes is
dropped when that is below the worst kth score of the queries under the query node. First
each query block meets the data block with the best centre, which gives it kth scores to
start from; then it meets those blocks whose bound its worst kth score does not exclude.

Equal data vectors are searched once, with the ``k + 1`` smallest ids that hold them: no query
can return more of them, its own id left out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from histomesh.lineage import cut

LEAF, QUERY_BLOCK, DATA_BLOCK, PIVOTS = 32, 512, 2048, 256
NOTHING = -(1 << 62)


class CoverTree:
    """Points in tree order and nodes with centre, covering radius, own points and children."""

    def __init__(self, points: np.ndarray):
        x = points.astype(np.float64)
        self.nodes: list[tuple[np.ndarray, float, int, int, list[int]]] = []
        order: list[np.ndarray] = []
        self._filled = 0
        self.root = self._build(x, np.arange(len(x)), x[0], order)
        self.order = np.concatenate(order)

    def _leaf(self, x: np.ndarray, own: np.ndarray, centre: np.ndarray, order: list) -> int:
        radius = float(np.sqrt(((x[own] - centre) ** 2).sum(1).max()))
        self.nodes.append((centre, radius, self._filled, self._filled + len(own), []))
        order.append(own)
        self._filled += len(own)
        return len(self.nodes) - 1

    def _build(self, x: np.ndarray, own: np.ndarray, centre: np.ndarray, order: list) -> int:
        away = np.sqrt(((x[own] - centre) ** 2).sum(1))
        radius = float(away.max())
        if len(own) <= LEAF or radius == 0:
            return self._leaf(x, own, centre, order)
        nearest, home, centres = away.copy(), np.zeros(len(own), int), [centre]
        while nearest.max() > radius / 2:
            centres.append(x[own[nearest.argmax()]])
            distance = np.sqrt(((x[own] - centres[-1]) ** 2).sum(1))
            closer = distance < nearest
            nearest[closer], home[closer] = distance[closer], len(centres) - 1
        start, children, single = self._filled, [], []
        for k, middle in enumerate(centres):
            members = own[home == k]
            if len(members) == 1:
                single.append(members)
            elif len(members):
                children.append(self._build(x, members, middle, order))
        rest = np.concatenate(single) if single else own[:0]
        for low in range(0, len(rest), LEAF):
            children.append(self._leaf(x, rest[low : low + LEAF], centre, order))
        self.nodes.append((centre, radius, start, self._filled, children))
        return len(self.nodes) - 1


class Best:
    """The k best (score, id) of every query so far: high scores first, then small ids."""

    def __init__(self, ids: np.ndarray, k: int, worst: np.ndarray | None):
        self.ids, self.k = ids.tolist(), k
        self.found: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        self.worst = np.full(len(ids), NOTHING) if worst is None else worst.copy()

    def offer(self, row: int, scores: list[int], holders: list[list[int]]) -> None:
        own = self.ids[row]
        new = [(-s, i) for s, ids in zip(scores, holders, strict=True) for i in ids if i != own]
        self.found[row] = sorted(set(self.found[row]) | set(new))[: self.k]
        if len(self.found[row]) == self.k:
            self.worst[row] = max(self.worst[row], -self.found[row][-1][0])


def search(queries: dict, data: dict, best: Best) -> None:
    """Walks both trees together, the most promising pairs of nodes first."""
    q, d = queries["points"], data["points"]
    largest = float(np.abs(q).max(initial=0)) * float(np.abs(d).max(initial=0)) * max(q.shape[1], 1)
    if largest < 1 << 53:
        q, d = q.astype(np.float64), d.astype(np.float64)
    slack = 1 + 1e-9 * largest
    holders = data["holders"]
    norm = lambda v: float(np.sqrt(v @ v))

    def bound(a: int, b: int) -> float:
        (u, r, *_), (v, s, *_) = queries["nodes"][a], data["nodes"][b]
        return float(u @ v) + norm(u) * s + norm(v) * r + r * s + slack

    waiting = [(bound(queries["root"], data["root"]), queries["root"], data["root"])]
    while waiting:
        most, a, b = waiting.pop()
        _, r, start, end, below = queries["nodes"][a]
        _, s, first, last, under = data["nodes"][b]
        if most < best.worst[start:end].min():
            continue
        if not below and not under:
            scores = q[start:end] @ d[first:last].T
            for row, mine in enumerate(scores):
                good = np.flatnonzero(mine >= best.worst[start + row])
                if len(good):
                    best.offer(start + row, [int(x) for x in mine[good]], [holders[first + g] for g in good])
        else:
            split_query = below and (not under or r > s)
            pairs = [(x, b) for x in below] if split_query else [(a, y) for y in under]
            waiting += sorted((bound(x, y), x, y) for x, y in pairs)


def _tree_rows():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii, trees = [], [], []
            for row in range(batch.num_rows):
                members = batch.column(1)[row].values
                holders = members.field("ids").to_pylist()
                points = np.array(members.field("point").to_pylist(), np.int64).reshape(len(holders), -1)
                tree = CoverTree(points)
                centre, radius = tree.nodes[tree.root][:2]
                centres.append(centre.tolist())
                radii.append(radius)
                made = {"root": tree.root, "nodes": tree.nodes, "points": points[tree.order], "holders": [holders[k] for k in tree.order]}
                trees.append(pickle.dumps(made))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64()), pa.array(trees, pa.binary())], ["block", "centre", "radius", "tree"])

    return run


def _nearest(pivots: dict[int, np.ndarray]):
    """Adds the number of the nearest pivot of the same length to (point, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0)
            sizes = points.value_lengths().to_numpy()
            flat, at = points.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)))
            near = np.zeros(len(sizes), np.int64)
            for dim, centres in pivots.items():
                rows = np.flatnonzero(sizes == dim)
                for low in range(0, len(rows), 4096):
                    own = rows[low : low + 4096]
                    x = flat[at[own][:, None] + np.arange(dim)].astype(np.float64)
                    near[own] = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
            yield pa.RecordBatch.from_arrays([points, batch.column(1), pa.array(sizes, pa.int32()), pa.array(near)], ["point", "ids", "dim", "near"])

    return run


def trees(points: DataFrame, size: int, pivots: dict[int, np.ndarray], name: str) -> DataFrame:
    """Blocks of at most about ``size`` points (point, ids) around pivots, each with its tree."""
    near = points.select("point", "ids").mapInArrow(_nearest(pivots), "point array<bigint>, ids array<bigint>, dim int, near long")
    near = cut(near)
    parts = near.groupBy("dim", "near").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    placed = near.join(parts, ["dim", "near"]).withColumn("part", F.pmod(F.xxhash64("ids", "point"), F.col("parts")))
    block = F.struct("dim", "near", "part").alias("block")
    grouped = placed.groupBy(block).agg(F.collect_list(F.struct("point", "ids")).alias("members"))
    shape = "block struct<dim:int,near:bigint,part:bigint>, centre array<double>, radius double, tree binary"
    made = grouped.mapInArrow(_tree_rows(), shape)
    return cut(made.toDF(name, f"{name}_centre", f"{name}_radius", f"{name}_tree"))


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group_worst, worst, found = [], [], []
            for row in range(batch.num_rows):
                queries, data = (pickle.loads(batch.column(c)[row].as_py()) for c in (1, 2))
                before = batch.column(3)[row].as_py()
                ids = np.array([h[0] for h in queries["holders"]], np.int64)
                best = Best(ids, k, None if before is None else np.frombuffer(before, np.int64))
                search(queries, data, best)
                group_worst.append(int(best.worst.min()))
                worst.append(best.worst.tobytes())
                found.append([{"query": q, "id": i, "score": -s} for q, own in zip(best.ids, best.found, strict=True) for s, i in own])
            kind = pa.list_(pa.struct([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(group_worst, pa.int64()), pa.array(worst, pa.binary()), pa.array(found, kind)], ["q", "group_worst", "worst", "found"])

    return run


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _norm(a: Column) -> Column:
    return F.sqrt(_dot(a, a))


def top_k(queries: DataFrame, data: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` highest inner products of every query with the data: query, rank, id, score.

    Both frames have ``id`` (long) and ``vector`` (whole numbers, as long). A query's own id is left
    out of its results; ties go to the smaller id. Rows that are null, hold a null or have a null
    id take no part, vectors of another length do not meet; equal rows count once. Scores are exact
    as long as they fit 64 bits. With fewer candidates than ``k`` all are returned; an empty
    table gives no rows.
    """
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    asked = queries.filter(usable).select(F.col("vector").alias("point"), F.array("id").alias("ids")).distinct()
    held = data.filter(usable).select(F.col("vector").alias("point"), "id").distinct()
    first = F.row_number().over(Window.partitionBy("point").orderBy("id"))
    held = held.withColumn("nth", first).filter(F.col("nth") <= k + 1)
    held = cut(held.groupBy("point").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    by_hash = Window.partitionBy("dim").orderBy(F.xxhash64("point"), "point")
    some = held.select("point", F.size("point").alias("dim")).withColumn("nth", F.row_number().over(by_hash))
    wanted = {r["dim"]: min(PIVOTS, -(-r["n"] // DATA_BLOCK)) for r in held.groupBy(F.size("point").alias("dim")).agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots: dict[int, list] = {}
    for r in some.filter(F.col("nth") <= PIVOTS).orderBy("dim", "nth").collect():
        if r["nth"] <= wanted[r["dim"]]:
            pivots.setdefault(r["dim"], []).append(r["point"])
    pivots = {dim: np.array(p, np.float64).reshape(len(p), dim) for dim, p in pivots.items()}
    q, d = trees(asked, QUERY_BLOCK, pivots, "q"), trees(held, DATA_BLOCK, pivots, "d")
    middle = _dot(F.col("q_centre"), F.col("d_centre"))
    reach = _norm(F.col("q_centre")) * F.col("d_radius") + _norm(F.col("d_centre")) * F.col("q_radius") + F.col("q_radius") * F.col("d_radius")
    pairs = q.drop("q_tree").join(d.drop("d_tree"), F.col("q.dim") == F.col("d.dim"))
    pairs = pairs.select("q", "d", middle.alias("middle"), (middle + reach).alias("bound"))
    pairs = cut(pairs.withColumn("bound", F.col("bound") + 2 + 1e-6 * F.abs("bound")))
    start = pairs.groupBy("q").agg(F.max_by("d", F.struct("middle", "d")).alias("d"))
    to_q, to_d = q.select("q", "q_tree"), d.select("d", "d_tree")
    shape = f"q {q.schema['q'].dataType.simpleString()}, group_worst long, worst binary, found array<struct<query:bigint,id:bigint,score:bigint>>"

    def met(chosen: DataFrame) -> DataFrame:
        rows = chosen.join(to_q, "q").join(to_d, "d").select("q", "q_tree", "d_tree", "worst")
        return cut(rows.repartition(F.xxhash64("q", "d_tree")).mapInArrow(_meet(k), shape))

    seeds = met(start.withColumn("worst", F.lit(None).cast("binary")))
    others = pairs.join(start.select("q", F.col("d").alias("done")), "q").filter(F.col("d") != F.col("done"))
    known = seeds.select(F.col("q").alias("of"), "group_worst", "worst")
    others = others.join(known, F.col("q") == F.col("of")).filter(F.col("bound") >= F.col("group_worst")).select("q", "d", "worst")
    found = seeds.union(met(others)).select(F.explode("found").alias("f")).select("f.query", "f.id", "f.score").distinct()
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "rank", "id", "score")
