"""k-means and Gaussian mixtures for many parameters at once.

Rows are packed once into blocks of vectors. Every iteration is one scan of the blocks that
advances all models that still move: a task works its blocks off with matrix products and
sends one row of sums a model, and those rows are added up by a vector aggregate. The driver
holds what a model is made of (centres, covariances), never rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Numbers of a block, at most: 4 MB.
BLOCK_VALUES = 1 << 19
#: Numbers that tasks send to be added up on the driver, at most (8 MB); more are added up by an aggregate first.
DRIVER_VALUES = 1 << 20
#: Rounds in which starting candidates are drawn, and candidates a round per centre wanted.
START_ROUNDS = 2
OVERSAMPLING = 2
#: Added to the diagonal of every covariance.
RIDGE = 1e-6

Labeller = Callable[[np.ndarray], np.ndarray]


class Blocks:
    """Vectors of a frame in packed blocks, kept for several scans; rows without a vector are left out."""

    def __init__(self, df: DataFrame, vec: str):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[np.ndarray] = []
            for batch in batches:
                if batch.num_rows:
                    flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                    held.append(flat.reshape(batch.num_rows, -1))
                if sum(x.size for x in held) >= BLOCK_VALUES:
                    yield _binary(np.concatenate(held))
                    held = []
            if held:
                yield _binary(np.concatenate(held))

        rows = df.select(F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL")
        self.frame = rows.mapInArrow(pack, "width int, flat binary").persist(StorageLevel.MEMORY_AND_DISK)
        self.parts = rows.rdd.getNumPartitions()
        widths = self.frame.agg(F.max("width"), F.sum(F.length("flat") / (8 * F.col("width")))).first()
        self.width, self.rows = int(widths[0] or 0), int(widths[1] or 0)

    def release(self) -> None:
        self.frame.unpersist()

    def scan(self, work: Callable[[Iterator[np.ndarray]], Iterator[tuple]], schema: str, kinds: list) -> DataFrame:
        """One scan; ``work`` turns a task's blocks into rows."""
        width = self.width
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = (np.frombuffer(b).reshape(-1, width) for batch in batches for b in batch.column(0).to_pylist())
            rows = list(work(blocks))
            if rows:
                columns = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return self.frame.select("flat").mapInArrow(run, schema)

    def sums(self, measure: Callable[[np.ndarray], list[tuple[int, np.ndarray]]], size: int) -> dict[int, np.ndarray]:
        """Totals over all rows of what ``measure`` returns for a block: one array a key, ``size`` numbers in all."""

        def work(blocks: Iterator[np.ndarray]) -> Iterator[tuple]:
            totals: dict[int, np.ndarray] = {}
            for x in blocks:
                for key, values in measure(x):
                    totals[key] = totals[key] + values if key in totals else values
            for key, values in totals.items():
                yield key, values

        parts = self.scan(work, "key int, s array<double>", [pa.int32(), pa.list_(pa.float64())])
        if self.parts * size <= DRIVER_VALUES:
            added: dict[int, np.ndarray] = {}
            for key, values in parts.collect():
                added[key] = added.get(key, 0.0) + np.array(values)
            return added
        total = Summarizer.metrics("sum").summary(array_to_vector("s"))["sum"]
        return {r["key"]: np.array(r["s"]) for r in parts.groupBy("key").agg(vector_to_array(total).alias("s")).collect()}


def _binary(x: np.ndarray) -> pa.RecordBatch:
    flat = np.ascontiguousarray(x, dtype=np.float64)
    columns = [pa.array([x.shape[1]], pa.int32()), pa.array([flat.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["width", "flat"])


def squared_gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, not below zero."""
    gaps = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)[None, :]
    return np.maximum(gaps, 0.0)


# --- starts ---------------------------------------------------------------


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for every row, from the row's own values and the seed, however rows are dealt."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    odd = np.random.default_rng(seed).integers(0, 1 << 63, x.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    # The upper half of a product depends on all bits below: mix before and after adding up.
    mixed = ((bits ^ (bits >> np.uint64(29))) * odd).sum(axis=1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _draw(blocks: Blocks, seeds: Sequence[int], drawn: list[np.ndarray], n: int, turn: int) -> list[np.ndarray]:
    """``n`` more different rows a start, drawn in proportion to the squared distance to those it has."""

    def work(parts: Iterator[np.ndarray]) -> Iterator[tuple]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x in parts:
            for s, seed in enumerate(seeds):
                weight = squared_gaps(x, drawn[s]).min(axis=1) if len(drawn[s]) else np.ones(len(x))
                # Differences that are rounding only are none.
                some = weight > 1e-12 * (x * x).sum(axis=1) if len(drawn[s]) else weight > 0
                rows, weight = x[some], weight[some]
                key = -np.log(_uniform(rows, seed * 1009 + turn)) / weight
                if s in best:
                    key, rows = np.concatenate([best[s][0], key]), np.concatenate([best[s][1], rows])
                key, first = np.unique(key, return_index=True)
                best[s] = key[:n], rows[first[:n]]
        for s, (keys, rows) in best.items():
            for key, row in zip(keys.tolist(), rows, strict=True):
                yield s, key, row

    found = blocks.scan(work, "start int, key double, row array<double>", [pa.int32(), pa.float64(), pa.list_(pa.float64())])
    order = Window.partitionBy("start").orderBy("key")
    found = found.dropDuplicates(["start", "key"]).withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    out = [list(d) for d in drawn]
    for r in found.orderBy("start", "r").collect():
        out[r["start"]].append(np.array(r["row"]))
    return [np.array(d).reshape(-1, blocks.width) for d in out]


def _settle(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Up to ``k`` centres of weighted candidates: spread out one by one, then moved to their means."""
    chosen = [int(rng.choice(len(points), p=weights / weights.sum()))]
    while len(chosen) < min(k, len(points)):
        gap = squared_gaps(points, points[chosen]).min(axis=1) * weights
        gap[chosen] = 0
        if gap.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(points), p=gap / gap.sum())))
    centres = points[chosen].copy()
    for _ in range(30):
        own = squared_gaps(points, centres).argmin(axis=1)
        moved = centres.copy()
        for j in range(len(centres)):
            if weights[own == j].sum() > 0:
                moved[j] = np.average(points[own == j], axis=0, weights=weights[own == j])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def starts(blocks: Blocks, ks: Sequence[int], seeds: Sequence[int]) -> list[list[np.ndarray]]:
    """Starting centres, per seed and k: a few rounds of distance-weighted draws over all rows, weighted by the rows next to them."""
    drawn = _draw(blocks, seeds, [np.empty((0, blocks.width)) for _ in seeds], 1, 0)
    for turn in range(1, START_ROUNDS + 1):
        drawn = _draw(blocks, seeds, drawn, OVERSAMPLING * max(ks), turn)

    def nearest(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        return [(s, np.bincount(squared_gaps(x, d).argmin(axis=1), minlength=len(d)).astype(float)) for s, d in enumerate(drawn)]

    weights = blocks.sums(nearest, sum(map(len, drawn)))
    return [[_settle(d, weights[s] + 1e-9, k, np.random.default_rng([seed, k])) for k in ks] for s, (seed, d) in enumerate(zip(seeds, drawn, strict=True))]


# --- k-means ---------------------------------------------------------------


@dataclass
class Centres:
    """One k-means model."""

    k: int
    seed: int
    centres: np.ndarray
    cost: float = math.inf
    iterations: int = 0

    def label(self, x: np.ndarray) -> np.ndarray:
        return squared_gaps(x, self.centres).argmin(axis=1)


def lloyd(blocks: Blocks, ks: Sequence[int], seeds: Sequence[int], max_iter: int, tol: float) -> list[Centres]:
    """A model per k and seed; each stops when its centres move by less than ``tol`` in all. Empty clusters keep their centre."""
    if not blocks.rows:
        return []
    begun = starts(blocks, ks, seeds)
    models = [Centres(k, seed, begun[s][j]) for s, seed in enumerate(seeds) for j, k in enumerate(ks)]
    moving = list(range(len(models)))
    for step in range(max_iter + 1):
        # The last scan of a model only adds up its cost.
        current = [(m, models[m].centres) for m in moving]

        def measure(x: np.ndarray, current=current) -> list[tuple[int, np.ndarray]]:
            gaps = squared_gaps(x, np.concatenate([c for _, c in current]))
            out, at = [], 0
            for m, c in current:
                mine = gaps[:, at : at + len(c)]
                at += len(c)
                own = mine.argmin(axis=1)
                chosen = np.zeros((len(x), len(c)))
                chosen[np.arange(len(x)), own] = 1
                cost = mine[np.arange(len(x)), own].sum()
                out.append((m, np.concatenate([[cost], chosen.sum(axis=0), (chosen.T @ x).ravel()])))
            return out

        found = blocks.sums(measure, sum(1 + c.size + len(c) for _, c in current))
        still = []
        for m in moving:
            model, k = models[m], len(models[m].centres)
            total = found[m]
            model.cost, model.iterations = float(total[0]), step
            n = total[1 : k + 1, None]
            moved = np.where(n > 0, total[k + 1 :].reshape(k, -1) / np.maximum(n, 1), model.centres)
            if step < max_iter and np.linalg.norm(moved - model.centres) >= tol:
                model.centres = moved
                still.append(m)
        moving = still
        if not moving:
            break
    return models


def cheapest(models: list[Centres], k: int) -> Centres:
    return min((m for m in models if m.k == k), key=lambda m: m.cost)


# --- Gaussian mixtures ---------------------------------------------------------------


@dataclass
class Mixture:
    """One Gaussian mixture; ``trace`` has the log-likelihood before every update."""

    k: int
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    loglik: float = -math.inf
    trace: list[float] = field(default_factory=list)
    failed: bool = False

    def whiteners(self) -> tuple[np.ndarray, np.ndarray]:
        """Inverse Cholesky factors, and the log of each component's weight and density at its mean."""
        factors = np.linalg.cholesky(self.covariances)
        inverse = np.linalg.inv(factors)
        logdet = 2 * np.log(np.diagonal(factors, axis1=1, axis2=2)).sum(axis=1)
        with np.errstate(divide="ignore"):
            return inverse, np.log(self.weights) - 0.5 * (logdet + self.means.shape[1] * math.log(2 * math.pi))

    def label(self, x: np.ndarray) -> np.ndarray:
        inverse, base = self.whiteners()
        return joint(x, self.means, inverse, base).argmax(axis=1)


def joint(x: np.ndarray, means: np.ndarray, inverse: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Log of weight times density, per row and component."""
    out = np.empty((len(x), len(means)))
    for j, (mean, whiten) in enumerate(zip(means, inverse, strict=True)):
        z = (x - mean) @ whiten.T
        out[:, j] = base[j] - 0.5 * (z * z).sum(axis=1)
    return out


def mixtures(blocks: Blocks, begun: list[np.ndarray], ks: Sequence[int], max_iter: int, tol: float) -> list[Mixture]:
    """Expectation maximisation from given means, identity covariances and equal weights, for every k together.

    Stops where the log-likelihood of all rows changes by less than ``tol``. A model whose
    covariance cannot be factored is marked as failed.
    """
    d = blocks.width
    models = [Mixture(k, np.full(len(m), 1 / len(m)), m.copy(), np.stack([np.eye(d)] * len(m))) for k, m in zip(ks, begun, strict=True)]
    moving = list(range(len(models)))
    for step in range(max_iter + 1):
        current = []
        for m in list(moving):
            try:
                current.append((m, models[m].means, *models[m].whiteners()))
            except np.linalg.LinAlgError:
                models[m].failed = True
                moving.remove(m)
        if not moving:
            break

        def measure(x: np.ndarray, current=current) -> list[tuple[int, np.ndarray]]:
            out = []
            for m, means, inverse, base in current:
                log = joint(x, means, inverse, base)
                top = log.max(axis=1)
                share = np.exp(log - top[:, None])
                whole = share.sum(axis=1)
                share /= whole[:, None]
                sums = [[(top + np.log(whole)).sum()], share.sum(axis=0)]
                for j, mean in enumerate(means):
                    # Around the present mean, so that no large numbers cancel.
                    off = x - mean
                    sums += [share[:, j] @ off, ((off * share[:, j, None]).T @ off).ravel()]
                out.append((m, np.concatenate(sums)))
            return out

        found = blocks.sums(measure, sum(1 + len(c[1]) * (1 + d + d * d) for c in current))
        still = []
        for m in moving:
            model, total = models[m], found[m]
            k, before = len(model.means), model.loglik
            model.loglik = float(total[0])
            model.trace.append(model.loglik)
            if step == max_iter or abs(model.loglik - before) < tol:
                continue
            n, moments = total[1 : k + 1], total[k + 1 :].reshape(k, d + d * d)
            model.weights = n / n.sum()
            for j in range(k):
                if n[j] > 0:  # a component that no row belongs to keeps its place
                    shift = moments[j, :d] / n[j]
                    model.means[j] = model.means[j] + shift
                    model.covariances[j] = moments[j, d:].reshape(d, d) / n[j] - np.outer(shift, shift) + RIDGE * np.eye(d)
            still.append(m)
        moving = still
        if not moving:
            break
    return models


# --- scores ---------------------------------------------------------------


def silhouettes(blocks: Blocks, labellers: Sequence[tuple[int, Labeller]]) -> list[float | None]:
    """Mean silhouette on squared distances of all rows, per labelling ``(clusters, labeller)``; None below two clusters.

    Two scans for all labellings: sizes, sums and sums of squares of the clusters, then the
    score of every row from them. A row counts in the mean of its own cluster.
    """

    def cluster_sums(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        out, square = [], (x * x).sum(axis=1)
        for m, (k, label) in enumerate(labellers):
            chosen = np.zeros((len(x), k))
            chosen[np.arange(len(x)), label(x)] = 1
            out.append((m, np.concatenate([chosen.sum(axis=0), square @ chosen, (chosen.T @ x).ravel()])))
        return out

    clusters = {}
    for m, total in blocks.sums(cluster_sums, sum(k for k, _ in labellers) * (2 + blocks.width)).items():
        k = labellers[m][0]
        n = total[:k]
        held = np.flatnonzero(n)
        if len(held) > 1:
            clusters[m] = held, n[held], total[k : 2 * k][held], total[2 * k :].reshape(k, -1)[held]

    def row_scores(x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        out, square = [], (x * x).sum(axis=1)
        for m, (held, n, squares, totals) in clusters.items():
            mean = np.maximum(square[:, None] + (squares[None, :] - 2 * (x @ totals.T)) / n[None, :], 0.0)
            own = np.searchsorted(held, labellers[m][1](x))
            at = np.arange(len(x))
            mine = mean[at, own]
            mean[at, own] = np.inf
            other = mean.min(axis=1)
            larger = np.maximum(mine, other)
            out.append((m, np.array([np.where(larger > 0, (other - mine) / np.where(larger > 0, larger, 1), 0.0).sum(), len(x)])))
        return out

    scores = blocks.sums(row_scores, 2 * len(clusters)) if clusters else {}
    return [float(scores[m][0] / scores[m][1]) if m in scores else None for m in range(len(labellers))]


def assign(df: DataFrame, row_id: str, vec: str, label: Labeller) -> DataFrame:
    """``(row_id, label)`` of every row with a vector."""
    rows = df.select(row_id, F.col(vec).cast("array<double>").alias("v")).where("v IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label(x), pa.int32())], names=[row_id, "label"])

    return rows.mapInArrow(run, f"`{row_id}` {df.schema[row_id].dataType.simpleString()}, label int")
