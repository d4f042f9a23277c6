"""Nearest neighbours through a hierarchical k-means tree, searched best bin first.

The tree is fitted on a bounded sample (``SAMPLE_VALUES`` numbers) and indexes every row: each vector
goes down to its leaf.  A query walks the tree with a priority queue, always opening the node whose
centre promises the largest inner product, until it has seen a calibrated number of leaves.  The number
comes from bounded calibration queries whose true neighbours are found by brute force over all rows: it
is widened until the target recall is reached.

Queries meet the rows of their leaves in tiles of bounded size (``TILE`` rows by ``TILE`` queries), so
neither a large leaf nor a leaf that many queries visit lands in one task.  Repeated rows are one.  Of
rows with the same vector only the ``k + 1`` with the smallest ids are indexed; any other has at least
``k`` better ids for every query, so nothing is lost.  Wherever the best are cut, ids are counted.

Defined results: rows with a null id, and vectors that are null, empty, zero, or hold null or non-finite
components, take no part, nor do vectors of another length than the most common one (the shorter on a
tie); a row with the query's id is the query's own; an id with several vectors counts once, by its best
one; a query id that is repeated with different vectors
is searched with the first of them in order; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from revlume.llm.cluster import ship
from revlume.session import staged

K = 20
#: Numbers (rows times dimensions) of the sample that the tree is fitted on.
SAMPLE_VALUES = 2_000_000
BRANCHES = 8
#: Rows of the whole table that a leaf is meant to hold.
LEAF_ROWS = 2000
CALIBRATION_QUERIES = 64
TARGET_RECALL = 0.96
TILE = 2048

_OUT = "query_id long, rank int, vec_id long, score double"


class Tree:
    """Centres of a hierarchical k-means clustering."""

    def __init__(self, sample: np.ndarray, rows: int, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES) -> None:
        random = np.random.default_rng(7)
        share = rows / max(len(sample), 1)
        centers, children, spread = [sample.mean(axis=0)], [[]], [0.0]
        todo = [(0, np.arange(len(sample)))]
        while todo:
            node, members = todo.pop()
            points = sample[members]
            spread[node] = float(np.sqrt(((points - centers[node]) ** 2).sum(axis=1).mean()))
            if len(members) * share <= leaf_rows or len(members) < 2 * branches or spread[node] == 0:
                continue
            means, near = _k_means(points, branches, random)
            for c in range(len(means)):
                child = len(centers)
                centers.append(means[c])
                children.append([])
                spread.append(0.0)
                children[node].append(child)
                todo.append((child, members[near == c]))
        self.centers, self.spread = np.array(centers), np.array(spread)
        self.children = [np.array(c, np.int64) for c in children]
        self.leaf = np.full(len(centers), -1)
        leaves = [i for i, c in enumerate(children) if not c]
        self.leaf[leaves] = np.arange(len(leaves))
        self.leaves = len(leaves)

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, members = todo.pop()
            below = self.children[node]
            if not len(below):
                out[members] = self.leaf[node]
                continue
            near = _nearest(points[members], self.centers[below])
            todo += [(int(child), members[near == c]) for c, child in enumerate(below) if (near == c).any()]
        return out

    def visit(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves, best bin first."""
        promise = self.centers @ query + 0.5 * np.linalg.norm(query) * self.spread
        queue, seen = [(-promise[0], 0)], []
        while queue and len(seen) < leaves:
            _, node = heapq.heappop(queue)
            if self.leaf[node] >= 0:
                seen.append(int(self.leaf[node]))
            for child in self.children[node]:
                heapq.heappush(queue, (-promise[child], int(child)))
        return seen


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.argmin((centers**2).sum(axis=1) - 2 * points @ centers.T, axis=1)


def _k_means(points: np.ndarray, k: int, random: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(points, axis=0)
    centers = distinct[random.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = _nearest(points, centers)
        centers = np.array([points[near == c].mean(axis=0) if (near == c).any() else centers[c] for c in range(len(centers))])
    near = _nearest(points, centers)
    used = np.unique(near)
    return centers[used], np.searchsorted(used, near)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id``, ``v`` of the rows that take part, and their common length (0: no rows)."""
    v = F.col("embedding").cast("array<double>")
    infinite = F.lit(float("inf"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite)) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = common["size"] if common else 0
    return rows.where(F.size("v") == size), size


def _top(scores: np.ndarray, k: int) -> np.ndarray:
    """For each row of scores, the columns that can be among its ``k`` largest."""
    if scores.shape[1] <= k + 8:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    return np.argpartition(-scores, k + 7, axis=1)[:, : k + 8]


def _scored(queries: np.ndarray, points: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int):
    """The ``k`` best ids of each query: their rows and scores, best first and ties to the smaller id.

    A product of matrices selects; what it selects is summed anew in one fixed order, so equal vectors
    have equal scores wherever they stand.
    """
    rough = queries @ points.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    different, place = np.unique(ids, return_inverse=True)
    repeated = len(different) < len(ids)
    if repeated:
        # One column an id, with its best row.
        by_id = np.argsort(place, kind="stable")
        rough = np.maximum.reduceat(rough[:, by_id], np.searchsorted(place[by_id], np.arange(len(different))), axis=1)
    columns = _top(rough, k)
    if rough.shape[1] > columns.shape[1]:
        # More ties at the edge than were selected are settled over all columns.
        edge = np.partition(-rough, k - 1, axis=1)[:, k - 1]
        slack = 1e-9 * (1 + np.abs(edge))
        crowded = np.flatnonzero((rough >= (-edge - slack)[:, None]).sum(axis=1) > columns.shape[1])
    else:
        crowded = []
    for q in range(len(queries)):
        at = np.flatnonzero(rough[q] >= -edge[q] - slack[q]) if q in crowded else columns[q]
        at = at[np.isfinite(rough[q, at])]
        if repeated:
            at = np.flatnonzero(np.isin(place, at))
        exact = np.ascontiguousarray(points[at] * queries[q]).sum(axis=1)
        order = _best_ids(ids[at], exact, k)
        yield q, at[order], exact[order]


def _best_ids(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best different ids, each with its best score."""
    order = np.lexsort((ids, -scores))
    return order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]


def _truth(held, k: int):
    """Brute force: the best ``k`` rows of each batch for the calibration queries, with their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, queries, query_ids = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            points, ids = _matrix(batch.column("v")), batch.column("vec_id").to_numpy()
            leaf = tree.assign(points)
            rows = [
                (int(query_ids[q]), int(ids[i]), float(s), int(leaf[i]))
                for q, best, scores in _scored(queries, points, query_ids, ids, k)
                for i, s in zip(best, scores, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))],
                names=["query_id", "vec_id", "score", "leaf"],
            )

    return run


def _leaves_of(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        for batch in batches:
            leaf = tree.assign(_matrix(batch.column("v"))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), *batch.columns], names=["leaf", *batch.schema.names])

    return run


def _visits_of(held, leaves: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = held.value
        for batch in batches:
            visits = [tree.visit(q, leaves) for q in _matrix(batch.column("v"))] if batch.num_rows else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(visits, pa.list_(pa.int64())), *batch.columns], names=["leaves", *batch.schema.names]
            )

    return run


def _tile(k: int):
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        best: list = []
        if queries.num_rows and rows.num_rows:
            ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
            best = list(_scored(_matrix(queries.column("v")), _matrix(rows.column("v")), query_ids, ids, k))
        return pa.table(
            {
                "query_id": pa.array([int(query_ids[q]) for q, _, _ in best], pa.int64()),
                "ids": pa.array([ids[i].tolist() for _, i, _ in best], pa.list_(pa.int64())),
                "scores": pa.array([s.tolist() for _, _, s in best], pa.list_(pa.float64())),
            }
        )

    return run


def _merge(k: int):
    """The best of all tiles of a query."""

    def run(tiles: pa.Table) -> pa.Table:
        ids = tiles.column("ids").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        scores = tiles.column("scores").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        order = _best_ids(ids, scores, k)
        n = len(order)
        return pa.table(
            {
                "query_id": pa.array(np.full(n, tiles.column("query_id")[0].as_py()), pa.int64()),
                "rank": pa.array(np.arange(1, n + 1), pa.int32()),
                "vec_id": pa.array(ids[order], pa.int64()),
                "score": pa.array(scores[order], pa.float64()),
            }
        )

    return run


def calibrate(rows: DataFrame, queries: DataFrame, tree: Tree, k: int, target: float) -> int:
    """The number of leaves at which the calibration queries reach the target recall."""
    spark = rows.sparkSession
    chosen = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATION_QUERIES).collect()
    if not chosen:
        return 1
    vectors, ids = np.array([r.v for r in chosen]), np.array([r.query_id for r in chosen])
    held = spark.sparkContext.broadcast((tree, vectors, ids))
    near = rows.mapInArrow(_truth(held, k), "query_id long, vec_id long, score double, leaf long")
    near = near.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "leaf")).alias("best")).select("query_id", "vec_id", "best.*")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    truth = near.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "leaf").collect()
    order = {int(i): {leaf: n for n, leaf in enumerate(tree.visit(v, tree.leaves))} for i, v in zip(ids, vectors, strict=True)}
    needed = np.sort([order[r.query_id][r.leaf] + 1 for r in truth])
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) if len(needed) else 1


def search(
    vectors: DataFrame, is_query, k: int = K, leaf_rows: int = LEAF_ROWS, target: float = TARGET_RECALL
) -> DataFrame:
    """The ``k`` nearest rows of each row for which ``is_query`` holds, by largest inner product."""
    spark = vectors.sparkSession
    ship(spark)
    rows, size = usable(vectors)
    if not size:
        return spark.createDataFrame([], _OUT)
    first = Window.partitionBy("vec_id").orderBy("v")
    queries = rows.where(is_query).withColumn("n", F.row_number().over(first)).where("n = 1")
    queries = staged(queries.select(F.col("vec_id").alias("query_id"), "v"), "op9-queries")
    copies = Window.partitionBy("v").orderBy("vec_id")
    rows = staged(rows.distinct().withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1).drop("n"), "op9-rows")

    count = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(max(64, SAMPLE_VALUES // size)).toArrow()
    tree = Tree(_matrix(sample.column("v")), count, leaf_rows)
    leaves = calibrate(rows, queries, tree, k, target)

    held = spark.sparkContext.broadcast(tree)
    indexed = staged(rows.mapInArrow(_leaves_of(held), "leaf long, vec_id long, v array<double>"), "op9-index")
    visits = queries.mapInArrow(_visits_of(held, leaves), "leaves array<long>, query_id long, v array<double>")
    visits = staged(visits, "op9-visits").withColumn("leaf", F.explode("leaves")).drop("leaves")

    # Tiles: the rows of a leaf in blocks, its queries in parts, each block meeting each part.
    part = lambda n: F.ceil(n / TILE).cast("int")
    blocks = indexed.groupBy("leaf").agg(part(F.count(F.lit(1))).alias("blocks"))
    parts = visits.groupBy("leaf").agg(part(F.count(F.lit(1))).alias("parts"))
    # As many rows as the tree has leaves, which the sample bounds.
    tiles = F.broadcast(staged(blocks.join(parts, "leaf"), "op9-tiles"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = visits.join(tiles, "leaf").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int"))
    left = left.withColumn("block", every("blocks")).select("leaf", "block", "part", "query_id", "v")
    right = indexed.join(tiles, "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    right = right.withColumn("part", every("parts")).select("leaf", "block", "part", "vec_id", "v")
    keys = ["leaf", "block", "part"]
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _tile(k), "query_id long, ids array<long>, scores array<double>"
    )
    return met.groupBy("query_id").applyInArrow(_merge(k), _OUT)


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row of ``embeddings`` whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, F.col("vec_id") % 20 == 0)
