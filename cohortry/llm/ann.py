"""Nearest neighbours by inner product: a vantage-point tree per shard.

Vectors get one more component, so that all of a shard have the same length; then a larger
inner product is a smaller distance, and the triangle inequality applies. A tree splits a
shard at the median distance to a vantage point, again and again, down to small leaves.
Queries, in blocks, visit their most promising leaf first and then every leaf that the
inequality does not exclude: a leaf goes when ``relax`` times its lower bound exceeds the
distance of the k-th best so far. ``relax=1`` is exact search; larger values skip more.
Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.llm.common import keep, scratch

#: Vectors of a shard and of a leaf; queries of a block.
SHARD = 8192
LEAF = 256
BLOCK = 1024
#: Default of the pruning factor.
RELAX = 1.5
#: What rounding may do to distances and products of the matrix routine.
SLACK = 1e-9


class VantageTree:
    """Leaves of a vantage-point tree over the rows of ``vectors``, with the distance bounds on the way to each."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF):
        self.vectors = vectors
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max(initial=0.0))
        self.lifted = np.concatenate([vectors, np.sqrt(np.maximum(self.top - norms, 0))[:, None]], axis=1)
        self.points: list[np.ndarray] = []
        self.leaves: list[np.ndarray] = []
        #: Per leaf: (vantage point, least distance, largest distance) of every node above it.
        self.bounds: list[list[tuple[int, float, float]]] = []
        open_nodes = [(np.arange(len(vectors)), [])]
        while open_nodes:
            rows, above = open_nodes.pop()
            if len(rows) <= leaf:
                if len(rows):
                    self.leaves.append(rows)
                    self.bounds.append(above)
                continue
            # The row farthest from an arbitrary one spreads distances well, and is the same every time.
            start = self.lifted[rows[0]]
            point = self.lifted[rows[int(np.argmax(np.linalg.norm(self.lifted[rows] - start, axis=1)))]]
            far = np.linalg.norm(self.lifted[rows] - point, axis=1)
            order = np.argsort(far, kind="stable")
            half = len(rows) // 2
            self.points.append(point)
            for part in (order[:half], order[half:]):
                limits = (len(self.points) - 1, float(far[part].min()), float(far[part].max()))
                open_nodes.append((rows[part], [*above, limits]))

    def lower_bounds(self, lifted_queries: np.ndarray) -> np.ndarray:
        """Queries x leaves: no vector of the leaf is nearer than this."""
        low = np.zeros((len(lifted_queries), len(self.leaves)))
        if not self.points:
            return low
        points = np.array(self.points)
        squares = (
            np.einsum("ij,ij->i", lifted_queries, lifted_queries)[:, None]
            + np.einsum("ij,ij->i", points, points)[None, :]
            - 2 * lifted_queries @ points.T
        )
        far = np.sqrt(np.maximum(squares, 0))
        for leaf, above in enumerate(self.bounds):
            for point, near_limit, far_limit in above:
                d = far[:, point]
                low[:, leaf] = np.maximum(low[:, leaf], np.maximum(d - far_limit, near_limit - d))
        return low

    def search(self, queries: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, relax: float = RELAX) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, (ids, scores) of the k best rows whose id is not the query's own, best first, ties to the smaller id."""
        m = len(queries)
        low = self.lower_bounds(np.concatenate([queries, np.zeros((m, 1))], axis=1)) * relax
        lengths = np.einsum("ij,ij->i", queries, queries)
        best_ids = [np.empty(0, dtype=np.int64)] * m
        best = [np.empty(0)] * m
        worst = np.full(m, -np.inf)
        seen = np.zeros((m, len(self.leaves)), dtype=bool)

        def visit(leaf: int, which: np.ndarray) -> None:
            rows = self.leaves[leaf]
            seen[which, leaf] = True
            near = queries[which] @ self.vectors[rows].T
            scale = SLACK * (1 + np.abs(near).max(initial=0))
            limit = worst[which]
            if len(rows) > k + 1:  # one of them may be the query itself
                limit = np.maximum(limit, np.partition(near, len(rows) - k - 1, axis=1)[:, len(rows) - k - 1])
            q, r = np.nonzero(near >= (limit - scale)[:, None])
            # The same sum for the same pair whatever the block, so equal vectors tie exactly.
            exact = np.einsum("ij,ij->i", queries[which[q]], self.vectors[rows[r]])
            names = ids[rows[r]]
            other = names != own[which[q]]
            q, exact, names = q[other], exact[other], names[other]
            for x, a, b in zip(*_runs(q), strict=True):
                i = which[x]
                both, scores = np.concatenate([best_ids[i], names[a:b]]), np.concatenate([best[i], exact[a:b]])
                order = np.lexsort((both, -scores))[:k]
                best_ids[i], best[i] = both[order], scores[order]
                if len(order) == k:
                    worst[i] = scores[order[-1]]

        if not self.leaves:
            return list(zip(best_ids, best, strict=True))
        first = low.argmin(axis=1)
        for leaf in np.unique(first):
            visit(int(leaf), np.flatnonzero(first == leaf))
        for leaf in range(len(self.leaves)):
            # Distance of the k-th best, from |q - x|^2 = |q|^2 + top - 2 q.x; infinite while there are fewer than k.
            reach = np.sqrt(np.maximum(lengths + self.top - 2 * worst, 0))
            wanted = ~seen[:, leaf] & (low[:, leaf] <= reach * (1 + SLACK) + SLACK)
            if wanted.any():
                visit(leaf, np.flatnonzero(wanted))
        return list(zip(best_ids, best, strict=True))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, first, end) of runs of a sorted array."""
    if not len(values):
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    start = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[start], start, np.append(start[1:], len(values))


def usable(rows: DataFrame, vec: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part: not null, not zero, no null or non-finite component."""
    vector = F.col(vec).cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where(
        F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & some
    )


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 20, relax: float = RELAX) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of ``vectors`` for every row of ``queries`` but the row itself.

    Both: vec_id, vector, as ``usable`` gives. Vectors are spread over shards by a hash of
    their id, so copies of one vector are spread too. Every block of queries meets every
    shard once; each meeting sends k rows per query. Vectors of another length than the
    query's are no candidates. Fewer than k candidates: all of them. Repeated rows are
    candidates each; a query that is repeated is answered once. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    at = scratch(spark, "nearest")
    base = keep(vectors, f"{at}/vectors")
    asked = keep(queries.dropDuplicates(["vec_id"]), f"{at}/queries")
    n, q = base.count(), asked.count()
    shards, blocks = -(-n // SHARD) or 1, -(-q // BLOCK) or 1
    size = F.size("vector").alias("size")
    left = asked.select(
        F.col("vec_id"), "vector", size, F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>")).alias("shard"), F.lit(0).alias("side"),
    )
    right = base.select(
        F.col("vec_id"), "vector", size, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")).alias("block"),
        F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(shards)).alias("shard"), F.lit(1).alias("side"),
    )
    keys = ["size", "shard", "block"]
    rows = right.union(left.select(*right.columns))
    rows = rows.repartition(*keys).sortWithinPartitions("size", "shard", "block", F.desc("side"), "vec_id")

    def answer(part: dict) -> pa.RecordBatch | None:
        ids, asked_ids = np.array(part["ids"][1]), np.array(part["ids"][0])
        if not len(ids) or not len(asked_ids):
            return None
        tree = VantageTree(np.stack(part["vectors"][1]))
        found = tree.search(np.stack(part["vectors"][0]), asked_ids, ids, k, relax)
        counts = [len(x) for x, _ in found]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(asked_ids, counts)),
                pa.array(np.concatenate([x for x, _ in found])),
                pa.array(np.concatenate([s for _, s in found])),
            ],
            names=["query_id", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, part = None, {}
        for batch in batches:
            values = batch.column("vector")
            flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))])
            tags = [batch.column(c).to_pylist() for c in ("size", "shard", "block", "side", "vec_id")]
            for row, (size, shard, block, side, vec) in enumerate(zip(*tags, strict=True)):
                if (size, shard, block) != key:
                    if key is not None and (found := answer(part)) is not None:
                        yield found
                    key, part = (size, shard, block), {"ids": ([], []), "vectors": ([], [])}
                part["ids"][side].append(vec)
                part["vectors"][side].append(flat[ends[row] : ends[row + 1]])
        if key is not None and (found := answer(part)) is not None:
            yield found

    partial = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = partial.withColumn("rank", place).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def every_twentieth(rows: DataFrame) -> DataFrame:
    """The stated query set: rows whose vec_id is divisible by 20."""
    return rows.where("vec_id % 20 = 0")
