"""Approximate nearest neighbours by low-dimensional stable projections and kd-trees, stopped by a chi-square test.

Vectors are projected onto ``m`` Gaussian directions. A projected squared distance over the true one follows a
chi-square law with m degrees of freedom. So once the next projected neighbour is so far away that a vector as near
as the k-th best found would be expected nearer with probability ``sure``, the search stops.

The top of the kd-tree is fitted on a bounded sample and deals all vectors out to leaves; a leaf that holds more than
``leaf_rows`` is split into blocks by row, so equal vectors do not meet in one task. Each query first searches its own
leaf, and then, with that k-th distance, the other leaves that the test does not rule out. Within a block a kd-tree
over projections is walked point by point in order of projected distance, and what it gives is verified on original
vectors in double precision until the test holds. Every candidate is in the index, none is dropped, and ties go to the
smaller id.

Defined cases: null ids, and vectors that are null, zero, or hold null or non-finite components take no part; vectors of
different lengths are never neighbours, each is searched among those of its own; rows with a query's own id are not its
neighbours; a query row that is there twice is two queries, with results of their own; a neighbour row that is there
twice is found twice; with fewer than k candidates all are given; an empty table gives an empty result; other columns
are ignored."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F

from tessera.llm.common import batch_rows, table, written

M, SURE, LEAF_ROWS, SAMPLE, MOST_LEAVES, BUCKET, QUERY_ROWS, VERIFY = 24, 0.9, 8192, 20_000, 4096, 64, 4096, 64
FOUND = "row long, query_id long, vec_id long, score double, verified long"


def best() -> WindowSpec:
    """A query row's neighbours, nearest first; ties to the smaller id."""
    return Window.partitionBy("row").orderBy("score", "vec_id")


def chi_square(x: float, m: int = M) -> float:
    """Chi-square distribution function for an even m."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, m // 2):
        term *= half / i
        total += term
    return 1 - math.exp(-half) * total if half < 700 else 1.0


def reach(sure: float = SURE, m: int = M) -> float:
    """The x at which chi_square(x) is ``sure``."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < sure else (low, mid)
    return high


def directions(dim: int, m: int = M, seed: int = 42) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def split(points: np.ndarray, levels: int) -> list[tuple[int, float]]:
    """A complete kd-tree of ``levels`` levels: axis and cut of each inner node; points at most the cut go left."""
    nodes: list[tuple[int, float]] = [(0, 0.0)] * (2**levels - 1)
    parts = {0: points}
    for node in range(len(nodes)):
        p = parts.pop(node, points[:0])
        if len(p):
            axis = int(np.argmax(p.max(0) - p.min(0)))
            cut = float(np.median(p[:, axis]))
            nodes[node] = (axis, cut)
            left = p[:, axis] <= cut
            parts[2 * node + 1], parts[2 * node + 2] = p[left], p[~left]
    return nodes


def leaf_of(points: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    axis, cut = np.array([a for a, _ in nodes], int), np.array([c for _, c in nodes])
    at = np.zeros(len(points), np.int64)
    for _ in range(int(math.log2(len(nodes) + 1))):
        at = 2 * at + 1 + (points[np.arange(len(points)), axis[at]] > cut[at]) if len(nodes) else at
    return at - len(nodes)


def boxes(nodes: list[tuple[int, float]], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of each leaf's part of the projected space."""
    low, high = {0: np.full(m, -np.inf)}, {0: np.full(m, np.inf)}
    for k, (axis, cut) in enumerate(nodes):
        for child, left in ((2 * k + 1, True), (2 * k + 2, False)):
            low[child], high[child] = low[k].copy(), high[k].copy()
            (high if left else low)[child][axis] = cut
    at = range(len(nodes), 2 * len(nodes) + 1)
    return np.array([low[i] for i in at]), np.array([high[i] for i in at])


class Tree:
    """A kd-tree over projected points with buckets, walked in order of projected distance."""

    def __init__(self, points: np.ndarray):
        self.nodes: list[tuple] = []
        self.points = points
        self._make(np.arange(len(points)))

    def _make(self, rows: np.ndarray) -> int:
        own = self.points[rows]
        here = len(self.nodes)
        self.nodes.append((own.min(0), own.max(0), rows, -1, -1))
        if len(rows) > BUCKET:
            axis = int(np.argmax(own.max(0) - own.min(0)))
            order = np.argpartition(own[:, axis], len(rows) // 2)
            left, right = self._make(rows[order[: len(rows) // 2]]), self._make(rows[order[len(rows) // 2 :]])
            self.nodes[here] = (own.min(0), own.max(0), None, left, right)
        return here

    def _far(self, node: int, q: np.ndarray) -> float:
        low, high = self.nodes[node][:2]
        gap = np.maximum(np.maximum(low - q, q - high), 0)
        return float(gap @ gap)

    def walk(self, q: np.ndarray):
        """(projected squared distances, rows) in batches, nearest first: points of opened buckets wait until no closed node can hold a nearer one."""
        heap = [(self._far(0, q), 0)]
        far, waiting = np.zeros(0), np.zeros(0, np.int64)
        while heap:
            bound, node = heapq.heappop(heap)
            ready = far <= bound
            if ready.any():
                order = np.argsort(far[ready], kind="stable")
                yield far[ready][order], waiting[ready][order]
                far, waiting = far[~ready], waiting[~ready]
            _, _, rows, left, right = self.nodes[node]
            if rows is None:
                for child in (left, right):
                    heapq.heappush(heap, (max(bound, self._far(child, q)), child))
            else:
                gap = self.points[rows] - q
                far, waiting = np.concatenate([far, (gap * gap).sum(1)]), np.concatenate([waiting, rows])
        order = np.argsort(far, kind="stable")
        yield far[order], waiting[order]


def search(ids: np.ndarray, vectors: np.ndarray, tree: Tree, query_id: int, query: np.ndarray, projected: np.ndarray, k: int, bound: float, stop: float) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best of a block by (distance, id) among those the test does not rule out, and how many were verified; ``bound``: a k-th distance known already."""
    best_id, best = np.zeros(0, np.int64), np.zeros(0)
    kth, verified = bound, 0
    for far, batch in tree.walk(projected):
        for i in range(0, len(batch), VERIFY):
            if far[i] > stop * kth * kth:
                return best_id, best, verified
            rows = batch[i : i + VERIFY][far[i : i + VERIFY] <= stop * kth * kth]
            verified += len(rows)
            rows = rows[ids[rows] != query_id]
            d = np.sqrt(((vectors[rows] - query) ** 2).sum(1))
            near = d <= kth
            if near.any():
                best_id, best = np.concatenate([best_id, ids[rows][near]]), np.concatenate([best, d[near]])
                if len(best) > k:
                    keep = np.lexsort((best_id, best))[:k]
                    best_id, best = best_id[keep], best[keep]
                if len(best) == k:
                    kth = min(kth, float(best.max()))
    return best_id, best, verified


def _block_search(k: int, stop: float, m: int, seed: int) -> Callable:
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if data.num_rows and queries.num_rows:
            dim = len(data["embedding"][0])  # one length to a leaf
            w = directions(dim, m, seed)
            vectors, ids = matrix(data["embedding"], dim), data["vec_id"].to_numpy()
            tree = Tree(vectors @ w)
            asked = matrix(queries["asked"], dim)
            projected = asked @ w
            for i, (row, q, bound) in enumerate(zip(queries["row"].to_pylist(), queries["query_id"].to_pylist(), queries["bound"].to_pylist())):
                found, d, verified = search(ids, vectors, tree, q, asked[i], projected[i], k, bound, stop)
                out += zip([row] * len(found), [q] * len(found), found.tolist(), d.tolist(), [None] * len(found))
                out.append((row, q, None, None, verified))
        cols = list(zip(*out)) or [()] * 5
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("row", "query_id", "vec_id", "score", "verified"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()))})

    return run


def searched(vectors: DataFrame, is_query, k: int = 10, sure: float = SURE, m: int = M, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """What all blocks found, as rows FOUND: (row, query_id, vec_id, score) of candidates, and (row, query_id, verified) of each search."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    sound = e.isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", is_query.alias("asks")).where(sound)
    lengths = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], FOUND)
    dim, n = lengths[0]
    share = int(1_000_000 * min(1, sample / n))
    some = rows.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1_000_000)) < share)).select("embedding").toArrow()  # about `sample` rows
    w = directions(dim, m, seed)
    levels = min(int(math.log2(MOST_LEAVES)), max(0, math.ceil(math.log2(n / leaf_rows))))
    nodes = split(matrix(some["embedding"], dim) @ w, levels)
    low, high = boxes(nodes, m)
    stop = reach(sure, m)

    def assign(batches):
        for b in batches:
            size = pc.list_value_length(b.column("embedding")).to_numpy(zero_copy_only=False).astype(np.int64)
            leaf, common = -size, np.flatnonzero(size == dim)  # vectors of another length have a leaf of their own
            if len(common):
                leaf[common] = leaf_of(matrix(b.column("embedding").take(pa.array(common)), dim) @ w, nodes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], [*b.schema.names, "leaf"])

    of = rows.schema["embedding"].dataType.simpleString()
    with batch_rows(spark, 4096):
        rows = rows.withColumn("row", F.monotonically_increasing_id())
        rows = written(rows.mapInArrow(assign, f"vec_id long, embedding {of}, asks boolean, row long, leaf int"), "vectors")
    queries = rows.where("asks").select("row", "vec_id", "embedding", F.col("leaf").alias("home"))
    sizes = written(rows.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", F.ceil(F.col("n") / leaf_rows).cast("int").alias("parts")), "leaves")
    data = rows.join(sizes, "leaf").select("vec_id", "embedding", "leaf", F.pmod(F.xxhash64("row"), "parts").cast("int").alias("part"))

    def blocks(asked: DataFrame) -> DataFrame:
        """Search ``asked`` (row, vec_id, embedding, leaf, bound) in all blocks of their leaves; many queries of a leaf are dealt into groups."""
        groups = asked.groupBy("leaf").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("groups"))
        right = asked.join(groups, "leaf").withColumn("group", F.pmod(F.xxhash64("row"), "groups").cast("int"))
        right = right.join(sizes, "leaf").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        left = data.join(groups, "leaf").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        key = ["leaf", "part", "group"]
        right = right.select("row", F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked"), "bound", *(F.col(c).alias(f"q_{c}") for c in key))
        return left.select("vec_id", "embedding", *key).groupBy(*key).cogroup(right.groupBy(*(f"q_{c}" for c in key))).applyInArrow(_block_search(k, stop, m, seed), FOUND)

    at_home = written(blocks(queries.select("row", "vec_id", "embedding", F.col("home").alias("leaf"), F.lit(float("inf")).alias("bound"))), "neighbours")
    if not levels:
        return at_home
    kth = at_home.where("vec_id is not null").withColumn("r", F.row_number().over(best())).where(F.col("r") == k).select("row", F.col("score").alias("bound"))
    bounded = queries.where("home >= 0").join(kth, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))

    def elsewhere(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, bound, home = matrix(b.column("embedding"), dim) @ w, b.column("bound").to_numpy(), b.column("home").to_numpy()
            for i in range(b.num_rows):
                gap = np.maximum(np.maximum(low - q[i], q[i] - high), 0)
                leaves = np.flatnonzero((gap * gap).sum(1) <= stop * bound[i] * bound[i])
                leaves = leaves[leaves != home[i]]
                take = pa.array(np.full(len(leaves), i, np.int64))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in ("row", "vec_id", "embedding", "bound")), pa.array(leaves.astype(np.int32))], ["row", "vec_id", "embedding", "bound", "leaf"])

    with batch_rows(spark, 4096):
        sent = written(bounded.select("row", "vec_id", "embedding", "bound", "home").mapInArrow(elsewhere, f"row long, vec_id long, embedding {of}, bound double, leaf int"), "searches")
    return at_home.unionByName(blocks(sent))


def nearest(vectors: DataFrame, is_query, k: int = 10, sure: float = SURE, m: int = M, leaf_rows: int = LEAF_ROWS, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row of ``vectors`` (vec_id, embedding) that ``is_query`` (a Column) picks."""
    found = searched(vectors, is_query, k, sure, m, leaf_rows, sample, seed).where("vec_id is not null")
    return found.withColumn("rank", F.row_number().over(best())).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def verified_share(found: DataFrame, candidates: int) -> float:
    """The mean share of ``candidates`` vectors that a query verified, from what ``searched`` gave."""
    sums = found.where("vec_id is null").agg(F.sum("verified").alias("n"), F.count_distinct("row").alias("q")).first()
    return sums["n"] / (sums["q"] * candidates) if sums["q"] else 0.0


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every hundredth id among all embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
