"""Exact top-k by inner product with two cover trees.

Vectors are dealt into blocks of near neighbours. In each block a cover tree
holds the vectors and another one those that are queries. The two are walked
together: a pair of nodes is skipped when no inner product of what they cover
can reach the worst kth score of the queries. Own blocks come first; their kth
scores rule out whole blocks before anything is shipped to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fpindex.llm.scratch import Scratch

#: Rows of a block, and numbers in it, at most (on average over hashed parts).
BLOCK_ROWS, BLOCK_NUMBERS = 4096, 1 << 20
#: Pivots, and the rows that they are chosen from; they decide where a row is kept, not what is found.
PIVOTS, SAMPLE_ROWS = 32, 2000
#: Vectors below a node that are compared directly, and the most children of a node.
LEAF, FANOUT = 48, 24
#: Query groups that meet a block in one task at a time.
SLAB = 64


class Node:
    """Covers ``points`` within ``radius`` of ``center``; a leaf has no children."""

    def __init__(self, points: np.ndarray, center: np.ndarray, radius: float) -> None:
        self.points, self.center, self.radius = points, center, radius
        self.norm = float(np.sqrt(center @ center))
        self.children: list[Node] = []


def cover_tree(vectors: np.ndarray) -> Node | None:
    """Each level halves the radius: centers are further apart than it, and points within it of one.

    Points that so few centers cannot cover at half the radius stay together
    in a leaf: in that neighbourhood no level could tell them apart.
    """
    if not len(vectors):
        return None

    def distances(points: np.ndarray, center: int) -> np.ndarray:
        d = vectors[points] - vectors[center]
        return np.sqrt(np.einsum("ij,ij->i", d, d))

    def build(points: np.ndarray, center: int, far: np.ndarray) -> Node:
        node = Node(points, vectors[center], float(far.max()))
        if len(points) <= LEAF or node.radius == 0:
            return node
        near, owner, centers = far.copy(), np.zeros(len(points), np.int64), [center]
        while near.max() > node.radius / 2:
            if len(centers) == FANOUT:
                return node
            centers.append(int(points[near.argmax()]))
            d = distances(points, centers[-1])
            closer = d < near
            owner[closer] = len(centers) - 1
            near[closer] = d[closer]
        for i, c in enumerate(centers):
            mine = owner == i
            node.children.append(build(points[mine], c, near[mine]))
        return node

    first = np.arange(len(vectors))
    return build(first, 0, distances(first, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, exact; beyond 64 bits the nearest 64-bit integer."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], object) for m in (a, b)]
    exact = whole[0] @ whole[1].T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Search:
    """The k best of a set of queries; ties go to the smaller id, then to the row met first."""

    def __init__(self, queries: np.ndarray, k: int, floor: np.ndarray | None = None) -> None:
        self.queries, self.k = queries, k
        self.scores = np.full((len(queries), k), np.iinfo(np.int64).min)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.found = np.zeros((len(queries), k), bool)
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.tree = cover_tree(queries)

    def worst(self, points: np.ndarray) -> float:
        """No score below this can be among the k best of any of the queries."""
        kth = np.where(self.found[points, -1], self.scores[points, -1].astype(float), -np.inf)
        return float(np.maximum(kth, self.floor[points]).min())

    def run(self, vectors: np.ndarray, ids: np.ndarray, tree: Node | None, own: np.ndarray | None = None) -> None:
        """Search one block; ``own`` is the place of each query in it, which does not count."""
        if tree is None or self.tree is None:
            return
        waiting = [(self._bound(self.tree, tree), self.tree, tree)]
        while waiting:
            bound, q, p = waiting.pop()
            if bound < self.worst(q.points):
                continue
            if q.children and (not p.children or q.radius > p.radius):
                pairs = [(c, p) for c in q.children]
            elif p.children:
                pairs = [(q, c) for c in p.children]
            else:
                self._compare(q.points, p.points, vectors, ids, own)
                continue
            waiting += sorted(((self._bound(a, b), a, b) for a, b in pairs), key=lambda x: x[0])

    @staticmethod
    def _bound(q: Node, p: Node) -> float:
        best = float(q.center @ p.center) + q.radius * p.norm + p.radius * q.norm + q.radius * p.radius
        return best + 1e-9 * (1 + (q.norm + q.radius) * (p.norm + p.radius))

    def _compare(self, q, p, vectors, ids, own) -> None:
        score = products(self.queries[q], vectors[p])
        found = np.ones(score.shape, bool)
        if own is not None:
            found = p[None, :] != own[q][:, None]
        scores = np.concatenate([self.scores[q], score], 1)
        names = np.concatenate([self.ids[q], np.broadcast_to(ids[p], score.shape)], 1)
        there = np.concatenate([self.found[q], found], 1)
        # by what is there, then score from the largest, then id
        order = np.lexsort((names, ~scores, ~there), axis=1)[:, : self.k]
        for target, values in ((self.scores, scores), (self.ids, names), (self.found, there)):
            target[q] = np.take_along_axis(values, order, 1)


def _lists(column: pa.Array, dim: int) -> np.ndarray:
    return np.floor(256.0 * np.asarray(column.flatten(), float)).reshape(len(column), dim)


_BLOCK = (
    "dim int, block long, n_queries int, center array<double>, radius double, norm double, worst double,"
    " ids binary, vectors binary, query_ids binary, queries binary, floors binary,"
    " best array<struct<query:int,query_id:long,vec_id:long,score:long>>"
)


def _rows(search: Search, query_ids: np.ndarray) -> list[dict]:
    return [
        {"query": int(i), "query_id": int(query_ids[i]), "vec_id": int(search.ids[i, r]), "score": int(search.scores[i, r])}
        for i, r in np.argwhere(search.found)
    ]


def _build(k: int):
    def build(key, table):
        dim, block = key[0].as_py(), key[1].as_py()
        table = table.sort_by([("id", "ascending")])
        vectors = _lists(table.column("vector").combine_chunks(), dim)
        ids = np.asarray(table.column("id"), np.int64)
        is_query = np.flatnonzero(np.asarray(table.column("is_query"), bool))
        search = Search(vectors[is_query], k)
        search.run(vectors, ids, cover_tree(vectors), is_query)
        floors = np.where(search.found[:, -1], search.scores[:, -1].astype(float), -np.inf)
        center = vectors[is_query].mean(0) if len(is_query) else np.zeros(dim)
        reach = np.sqrt(((vectors[is_query] - center) ** 2).sum(1)).max() if len(is_query) else 0.0
        # the block is summed up by a ball around its own mean
        middle = vectors.mean(0)
        radius = np.sqrt(((vectors - middle) ** 2).sum(1)).max()
        row = {
            "dim": dim, "block": block, "n_queries": len(is_query),
            "center": [*center, *middle], "radius": float(reach), "norm": float(radius),
            "worst": float(floors.min()) if len(floors) else 0.0,
            "ids": ids.tobytes(), "vectors": vectors.tobytes(),
            "query_ids": ids[is_query].tobytes(), "queries": vectors[is_query].tobytes(), "floors": floors.tobytes(),
            "best": _rows(search, ids[is_query]),
        }
        return pa.Table.from_pylist([row], schema=_BLOCK_SCHEMA)

    return build


_BEST = pa.list_(pa.struct([("query", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]))
_BLOCK_SCHEMA = pa.schema(
    [("dim", pa.int32()), ("block", pa.int64()), ("n_queries", pa.int32()), ("center", pa.list_(pa.float64())),
     ("radius", pa.float64()), ("norm", pa.float64()), ("worst", pa.float64()),
     *[(c, pa.binary()) for c in ("ids", "vectors", "query_ids", "queries", "floors")], ("best", _BEST)]
)
_FOUND = "dim int, block long, best array<struct<query:int,query_id:long,vec_id:long,score:long>>"
_FOUND_SCHEMA = pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("best", _BEST)])


def _visit(k: int):
    """Query groups from other blocks against one block."""

    def numbers(value, kind=float) -> np.ndarray:
        return np.frombuffer(value.as_buffer(), kind)

    def visit(groups, blocks):
        out = []
        if len(blocks) and len(groups):
            dim = blocks.column("dim_")[0].as_py()
            ids = numbers(blocks.column("ids")[0], np.int64)
            vectors = numbers(blocks.column("vectors")[0]).reshape(len(ids), dim)
            tree = cover_tree(vectors)
            for row in range(len(groups)):
                query_ids = numbers(groups.column("query_ids")[row], np.int64)
                queries = numbers(groups.column("queries")[row]).reshape(len(query_ids), dim)
                search = Search(queries, k, numbers(groups.column("floors")[row]))
                search.run(vectors, ids, tree)
                out.append({"dim": dim, "block": groups.column("block")[row].as_py(), "best": _rows(search, query_ids)})
        return pa.Table.from_pylist(out, schema=_FOUND_SCHEMA)

    return visit


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Far points of a sample of bounded size, by dimension: the top of a cover tree."""
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("dim", "vector").toArrow()
    out = {}
    dims = np.asarray(sample.column("dim"))
    for dim in np.unique(dims):
        rows = sample.filter(pa.array(dims == dim)).column("vector").combine_chunks()
        points = np.asarray(rows.flatten(), float).reshape(len(rows), int(dim))
        chosen = [0]
        near = ((points - points[0]) ** 2).sum(1)
        while len(chosen) < PIVOTS and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, ((points - points[chosen[-1]]) ** 2).sum(1))
        out[int(dim)] = points[chosen]
    return out


def _assigning(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            pivot = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                if int(dim) in pivots and dim:
                    mine = np.flatnonzero(dims == dim)
                    rows = batch.column("vector").take(pa.array(mine))
                    points = np.asarray(rows.flatten(), float).reshape(len(mine), int(dim))
                    p = pivots[int(dim)]
                    pivot[mine] = ((p**2).sum(1)[None] - 2 * points @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pivot)], names=[*batch.schema.names, "pivot"]
            )

    return run


def top_k(
    rows: DataFrame,
    k: int = 5,
    every: int = 50,
    id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query.

    Components are turned into ``floor(256 * x)``. Queries are the rows whose
    id is divisible by ``every``; a query is compared with every other row of
    as many components. Rows with a null id take no part, nor do vectors that
    are null or hold null or non-finite components. Ties go to the smaller id.
    Rows that repeat an id are rows of their own. Other columns play no part.
    """
    scratch = Scratch(rows.sparkSession)
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = (
        rows.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
        .filter(F.col("id").isNotNull() & F.col("vector").isNotNull())
        .filter(finite)
        .select("id", "vector", F.size("vector").alias("dim"), (F.col("id") % every == 0).alias("is_query"))
    )
    dealt = scratch.store(
        vectors.mapInArrow(
            _assigning(_pivots(vectors)), "id long, vector array<double>, dim int, is_query boolean, pivot int"
        )
    )
    room = F.greatest(F.lit(64), F.least(F.lit(BLOCK_ROWS), F.floor(BLOCK_NUMBERS / F.greatest(F.col("dim"), F.lit(1)))))
    parts = dealt.groupBy("dim", "pivot").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / room))
    blocked = dealt.join(parts.select("dim", "pivot", "parts"), ["dim", "pivot"]).withColumn(
        "block", F.pmod(F.xxhash64("id"), "parts") * PIVOTS + F.col("pivot")
    )
    blocks = scratch.store(
        blocked.select("id", "vector", "dim", "is_query", "block")
        .groupBy("dim", "block")
        .applyInArrow(_build(k), _BLOCK)
    )
    slabs = max(1, -(-blocks.count() // SLAB))
    summary = blocks.select(
        "dim", "block", "n_queries", "worst", "radius", F.col("norm").alias("reach"),
        F.expr("slice(center, 1, dim)").alias("center"), F.expr("slice(center, dim + 1, dim)").alias("middle"),
    )
    a = summary.filter("n_queries > 0").select("dim", F.col("block").alias("a"), "worst", "radius", "center")
    b = summary.select("dim", F.col("block").alias("b"), "reach", "middle")

    def dot(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    size = lambda c: F.sqrt(dot(c, c))
    bound = (
        dot("center", "middle") + F.col("radius") * size("middle") + F.col("reach") * size("center")
        + F.col("radius") * F.col("reach")
    )
    slack = (size("center") + F.col("radius")) * (size("middle") + F.col("reach")) * 1e-9 + 1e-9
    pairs = (
        a.join(b, "dim")
        .filter("a <> b")
        .filter(bound + slack >= F.col("worst"))
        .select("dim", "a", "b", F.pmod(F.xxhash64("a"), F.lit(slabs)).alias("slab"))
    )
    groups = pairs.join(
        blocks.select("dim", F.col("block").alias("a"), "query_ids", "queries", "floors"), ["dim", "a"]
    ).select("dim", F.col("a").alias("block"), "b", "slab", "query_ids", "queries", "floors")
    data = blocks.select(
        "dim", F.col("block").alias("b"), "ids", "vectors",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slabs - 1).cast("long"))).alias("slab"),
    )
    data = data.toDF("dim_", "b_", "ids", "vectors", "slab_")
    visited = (
        groups.groupBy("dim", "b", "slab")
        .cogroup(data.groupBy("dim_", "b_", "slab_"))
        .applyInArrow(_visit(k), _FOUND)
    )
    found = blocks.select("dim", "block", "best").unionByName(visited)
    rank = F.row_number().over(
        Window.partitionBy("dim", "block", "query").orderBy(F.desc("score"), "vec_id")
    )
    return (
        found.select("dim", "block", F.explode("best").alias("x"))
        .select("dim", "block", "x.*")
        .withColumn("rank", rank)
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
