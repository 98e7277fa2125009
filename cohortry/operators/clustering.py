"""Clusterings and parameter sweeps.

Fits return labels as a DataFrame keyed by the row id. Sweeps loop over parameters on
the driver; every fit and score inside the loop is a Spark job on persisted features.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from cohortry.operators.batched_models import Blocks, assign, cheapest, lloyd, mixtures, silhouettes
from cohortry.operators.evaluation import NOISE, silhouette, squared_distance
from cohortry.operators.neighbors import _Block, _Layout, _low_squares, _pair_distances, _settled, _up_to, knn_graph
from cohortry.operators.relational import bounded_sample, join_heavy
from cohortry.sources.tables import settle

# The sweeps of the analysis.
CLUSTER_COUNTS = range(2, 8)
EPS_VALUES = (0.3, 0.5, 0.7, 1.0, 1.5)
MIN_POINTS = 5
#: Starts of a k-means fit.
RESTARTS = 5
#: Fits of a sweep that run at the same time.
PARALLEL_FITS = 4


@dataclass
class Fit:
    """Labels ``(row_id, label)``, the parameter that won, and one score row per parameter tried."""

    labels: DataFrame | None
    parameter: float
    scores: list[dict] = field(default_factory=list)
    info: dict = field(default_factory=dict)

    def score_table(self, spark) -> DataFrame:
        names = list(self.scores[0])
        rows = [tuple(None if s[n] is None else float(s[n]) for n in names) for s in self.scores]
        return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))


def _features(df: DataFrame, row_id: str, vec: str) -> DataFrame:
    arr = F.col(vec).cast("array<double>")
    return df.select(row_id, arr.alias("vec")).persist(StorageLevel.MEMORY_AND_DISK)


def _score(rows: DataFrame, labels: DataFrame, row_id: str) -> float | None:
    """Silhouette of a labelling over all rows; None for a single cluster."""
    return silhouette(rows.select(row_id, "vec").join(labels, row_id), "vec", "label", row_id).first()[0]


def at_once(work: Callable, items: Iterable, spark: SparkSession, parallelism: int = PARALLEL_FITS) -> list:
    """``work`` of every item, up to ``parallelism`` at the same time; the results in the order of the items."""
    items = list(items)
    if parallelism < 2 or len(items) < 2:
        return [work(i) for i in items]

    def run(item):
        # A thread of its own may know another session, or none.
        spark._jvm.SparkSession.setActiveSession(spark._jsparkSession)
        return work(item)

    with ThreadPool(min(parallelism, len(items))) as pool:
        return pool.map(inheritable_thread_target(spark)(run), items, chunksize=1)


def sweep(
    fit: Callable[[float], dict],
    parameters: Iterable,
    key: str,
    highest: bool = True,
    parallelism: int = PARALLEL_FITS,
) -> tuple[dict, list[dict]]:
    """Run ``fit`` per parameter; the best ``key`` wins, the first one on ties.

    Up to ``parallelism`` fits run at once on the shared, persisted features, so that
    one fit's job overhead is another's run time.
    """
    parameters = list(parameters)
    tried = at_once(fit, parameters, SparkSession.active(), parallelism)
    sign = 1 if highest else -1
    scored = [t for t in tried if t[key] is not None]
    best = max(scored, key=lambda t: sign * t[key]) if scored else tried[0]
    return best, [{k: v for k, v in t.items() if k != "labels"} for t in tried]


def kmeans(
    df: DataFrame,
    row_id: str,
    vec: str,
    k: int,
    seed: int = 42,
    max_iter: int = 50,
    tol: float = 1e-4,
    n_init: int = RESTARTS,
) -> Fit:
    """k-means on an array column, best of ``n_init`` starts; ``info`` has the cost and the centres."""
    blocks = Blocks(df, vec)
    best = cheapest(lloyd(blocks, [k], _seeds(seed, n_init), max_iter, tol), k)
    blocks.release()
    info = {"inertia": best.cost, "centres": best.centres.tolist(), "iterations": best.iterations}
    return Fit(assign(df, row_id, vec, best.label), k, info=info)


def _seeds(seed: int, n_init: int) -> list[int]:
    return [seed + i for i in range(max(1, n_init))]


def _choice(tried: list[dict], key: str, highest: bool = True) -> tuple[dict, list[dict]]:
    """The best of the models tried (the first one on ties), and their scores."""
    sign = 1 if highest else -1
    scored = [t for t in tried if t[key] is not None]
    best = max(scored, key=lambda t: sign * t[key]) if scored else tried[0]
    return best, [{n: v for n, v in t.items() if n != "model"} for t in tried]


def kmeans_sweep(
    df: DataFrame,
    row_id: str,
    vec: str,
    ks: Sequence[int] = CLUSTER_COUNTS,
    seed: int = 42,
    max_iter: int = 50,
    n_init: int = RESTARTS,
) -> Fit:
    """k-means for every k; the best silhouette wins, one cluster scores -1.

    All k and all starts advance together, one scan an iteration; the scores of all k are
    two scans more.
    """
    blocks = Blocks(df, vec)
    models = lloyd(blocks, list(ks), _seeds(seed, n_init), max_iter, 1e-4)
    best = [cheapest(models, k) for k in ks]
    found = silhouettes(blocks, [(len(m.centres), m.label) for m in best])
    blocks.release()
    tried = [
        {"k": m.k, "silhouette": -1.0 if score is None else score, "inertia": m.cost, "model": m}
        for m, score in zip(best, found, strict=True)
    ]
    won, scores = _choice(tried, "silhouette")
    return Fit(assign(df, row_id, vec, won["model"].label), won["k"], scores, {"models": best})


def gmm_parameters(k: int, d: int) -> int:
    """Free parameters of a full-covariance mixture."""
    return k - 1 + k * d + k * d * (d + 1) // 2


def gmm(df: DataFrame, row_id: str, vec: str, k: int, seed: int = 42, max_iter: int = 50, tol: float = 1e-3) -> Fit:
    """Gaussian mixture started from k-means; ``info`` has log-likelihood (and its course), AIC, BIC and the model."""
    fit = gmm_sweep(df, row_id, vec, [k], "bic", seed, max_iter, tol)
    return Fit(fit.labels, k, info={**{n: v for n, v in fit.scores[0].items() if n in ("loglik", "aic", "bic")}, **fit.info})


def gmm_sweep(
    df: DataFrame,
    row_id: str,
    vec: str,
    ks: Sequence[int] = CLUSTER_COUNTS,
    criterion: str = "bic",
    seed: int = 42,
    max_iter: int = 50,
    tol: float = 1e-3,
) -> Fit:
    """Mixture for every k: lowest BIC, or highest silhouette (where a failing k is passed over).

    Every mixture starts from the means of one k-means fit with its k, identity covariances
    and equal weights; all of them advance together, one scan an iteration.
    """
    ks = list(ks)
    blocks = Blocks(df, vec)
    means = lloyd(blocks, ks, [seed], max_iter, 1e-4)
    models = mixtures(blocks, [m.centres for m in means], ks, max_iter, tol)
    if criterion == "bic" and any(m.failed for m in models):
        raise ValueError("a covariance of the mixture has no inverse")
    sound = [m for m in models if not m.failed]
    found = silhouettes(blocks, [(len(m.means), m.label) for m in sound]) if criterion == "silhouette" else [None] * len(sound)
    n, d = blocks.rows, blocks.width
    blocks.release()
    tried = []
    for m in models:
        if m.failed:
            tried.append({"k": m.k, "loglik": None, "aic": None, "bic": None, "silhouette": None, "model": None})
            continue
        p = gmm_parameters(len(m.means), d)
        information = {"loglik": m.loglik, "aic": 2 * p - 2 * m.loglik, "bic": p * math.log(n) - 2 * m.loglik}
        tried.append({"k": m.k, **information, "silhouette": found.pop(0), "model": m})
    won, scores = _choice(tried, criterion, highest=criterion == "silhouette")
    labels = None if won["model"] is None else assign(df, row_id, vec, won["model"].label)
    return Fit(labels, won["k"], scores, {"models": models, "model": won["model"]})


# --- mixed data ---------------------------------------------------------------


def _mixed_cost(nums: dict, cats: dict, gamma: float) -> Column:
    """Squared distance on numbers plus ``gamma`` per differing category (null is a category)."""
    total = F.lit(0.0)
    for c, v in nums.items():
        total = total + (F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v))
    for c, v in cats.items():
        total = total + F.when(F.col(c).eqNullSafe(F.lit(v)), 0.0).otherwise(gamma)
    return total


def _hashed_start(rows: DataFrame, row_id: str, numeric: Sequence[str], categorical: Sequence[str], k: int, seed: int) -> list:
    """Different rows, drawn by a hash of their id."""
    return bounded_sample(rows.dropDuplicates([*numeric, *categorical]), k, row_id, seed=seed).collect()


class _MixedBlocks:
    """Rows in packed blocks, kept for several scans: numbers by column, categories as places in the block's own words."""

    def __init__(self, rows: DataFrame, row_id: str, numeric: Sequence[str], categorical: Sequence[str]):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ids, *columns = batch.columns
                    flat = [c.to_numpy(zero_copy_only=False) for c in columns[: len(numeric)]]
                    coded = [c.dictionary_encode() for c in columns[len(numeric) :]]
                    codes = [c.indices.fill_null(len(c.dictionary)).to_numpy() for c in coded]
                    words = [[*c.dictionary.to_pylist(), None] for c in coded]
                    held = [
                        pa.ListArray.from_arrays([0, len(ids)], ids),
                        pa.array([np.array(flat, dtype=np.float64).tobytes()], pa.binary()),
                        pa.array([np.array(codes, dtype=np.int32).tobytes()], pa.binary()),
                        pa.array([words], pa.list_(pa.list_(pa.string()))),
                    ]
                    yield pa.RecordBatch.from_arrays(held, names=["ids", "flat", "codes", "words"])

        self.id_type = rows.schema[row_id].dataType.simpleString()
        schema = f"ids array<{self.id_type}>, flat binary, codes binary, words array<array<string>>"
        self.frame = rows.select(row_id, *numeric, *categorical).mapInArrow(pack, schema).persist(StorageLevel.MEMORY_AND_DISK)

    def scan(self, work: Callable, schema: str) -> DataFrame:
        """One scan; ``work`` turns a block's ids, numbers, codes and words into the columns of rows."""
        names = [c.split()[0] for c in schema.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, flat, codes, words = (batch.column(c)[r] for c in ("ids", "flat", "codes", "words"))
                    n = len(ids)
                    numbers = np.frombuffer(flat.as_py()).reshape(-1, n)
                    places = np.frombuffer(codes.as_py(), dtype=np.int32).reshape(-1, n)
                    yield pa.RecordBatch.from_arrays(work(ids.values, numbers, places, words.as_py()), names=names)

        return self.frame.mapInArrow(run, schema)


def _mixed_costs(numbers: np.ndarray, codes: np.ndarray, words: list, centre: tuple, gamma: float, n: int) -> np.ndarray:
    """What ``_mixed_cost`` gives for the rows of a block, added up in the same order."""
    total = np.zeros(n)
    for x, v in zip(numbers, centre[0].values(), strict=True):
        total += (x - v) * (x - v)
    for places, known, v in zip(codes, words, centre[1].values(), strict=True):
        total += np.where(places == known.index(v), 0.0, gamma) if v in known else gamma
    return total


def _frequent(rows: DataFrame, categorical: Sequence[str], k: int) -> dict[str, list]:
    """Every column's ``k`` most frequent categories, the most frequent first."""
    frequent: dict[str, list] = {c: [] for c in categorical}
    if categorical:
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")) for c in categorical]))
        counts = rows.select(pairs.alias("p")).groupBy("p.variable", "p.value").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("variable").orderBy(F.desc("n"), F.col("value").asc_nulls_last())
        top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        for r in top.orderBy("variable", "r").collect():
            frequent[r["variable"]].append(r["value"])
    return frequent


def _huang_starts(
    rows: DataFrame, blocks: _MixedBlocks, numeric: Sequence[str], categorical: Sequence[str], ks: Sequence[int],
    moments: Sequence, gamma: float, seed: int,
) -> list[list[tuple[dict, dict]]]:
    """Per k: modes spread over the frequent categories, each replaced by the row nearest to it (Huang 1998).

    Column c's categories, most frequent first, go round the modes with an offset of c, so
    that modes differ in several columns at once. The numbers of a mode are drawn around the
    columns' means. Rows are different from each other: a mode whose nearest row is taken
    gets the nearest of the others. Each scan serves all k and keeps one row a mode.
    """
    frequent = _frequent(rows, categorical, max(ks, default=0))
    wanted: list[list[tuple[dict, dict]]] = []
    for k in ks:
        draws = np.random.default_rng(seed).standard_normal((k, len(numeric)))
        wanted.append([])
        for j in range(k):
            nums = {c: (moments[i] or 0.0) + (moments[len(numeric) + i] or 0.0) * float(draws[j, i]) for i, c in enumerate(numeric)}
            tops = {c: frequent[c][:k] for c in categorical}
            cats = {c: tops[c][(j + i) % len(tops[c])] if tops[c] else None for i, c in enumerate(categorical)}
            wanted[-1].append((nums, cats))
    found: list[dict[int, tuple[dict, dict]]] = [{} for _ in ks]
    open_models = {m for m, k in enumerate(ks) if k > 0}
    while open_models:
        missing = [(m, j) for m in sorted(open_models) for j in range(ks[m]) if j not in found[m]]
        best = {(r["m"], r["j"]): r["row"] for r in _nearest_rows(blocks, missing, wanted, found, gamma).collect()}
        for m in sorted(open_models):
            taken: set = set()
            for j in [j for o, j in missing if o == m]:
                if (m, j) not in best:  # no different rows left
                    open_models.discard(m)
                    break
                nums, cats = (tuple(x) for x in best[m, j])
                if (nums, cats) not in taken:
                    taken.add((nums, cats))
                    found[m][j] = (dict(zip(numeric, nums, strict=True)), dict(zip(categorical, cats, strict=True)))
            if len(found[m]) == ks[m]:
                open_models.discard(m)
    return [[one[j] for j in sorted(one)] for one in found]


def _nearest_rows(blocks: _MixedBlocks, missing: list, wanted: list, found: list, gamma: float) -> DataFrame:
    """``(m, j, row)``: for every missing mode j of a model m the nearest row unlike those the model has, the smallest id on ties."""

    def work(ids: pa.Array, numbers: np.ndarray, codes: np.ndarray, words: list) -> list[pa.Array]:
        n, out = len(ids), []
        free = {}
        for m in {m for m, _ in missing}:
            free[m] = np.ones(n, dtype=bool)
            for nums, cats in found[m].values():
                same = np.ones(n, dtype=bool)
                for x, v in zip(numbers, nums.values(), strict=True):
                    same &= (x == v) | (np.isnan(x) & np.isnan(v))
                for places, known, v in zip(codes, words, cats.values(), strict=True):
                    same &= (places == known.index(v)) if v in known else False
                free[m] &= ~same
        for m, j in missing:
            left = np.flatnonzero(free[m])
            if len(left):
                cost = _mixed_costs(numbers, codes, words, wanted[m][j], gamma, n)[left]
                cost = np.where(np.isnan(cost), np.inf, cost)
                ties = left[cost == cost.min()]
                _, i = min(zip(ids.take(pa.array(ties)).to_pylist(), ties.tolist(), strict=True), key=lambda t: (t[0] is not None, t[0]))
                out.append((m, j, float(cost.min()), i, numbers[:, i], [known[p[i]] for p, known in zip(codes, words, strict=True)]))
        return [
            *[pa.array([r[c] for r in out], t) for c, t in ((0, pa.int32()), (1, pa.int32()), (2, pa.float64()))],
            ids.take(pa.array([r[3] for r in out], pa.int64())),
            pa.array([r[4] for r in out], pa.list_(pa.float64())),
            pa.array([r[5] for r in out], pa.list_(pa.string())),
        ]

    rows = blocks.scan(work, f"m int, j int, cost double, id {blocks.id_type}, nums array<double>, cats array<string>")
    return rows.groupBy("m", "j").agg(F.min_by(F.struct("nums", "cats"), F.struct("cost", "id")).alias("row"))


def _mixed_totals(blocks: _MixedBlocks, models: dict[int, list], gamma: float) -> dict[tuple, Row]:
    """One scan for all models: per model, label and column the sum, or the most frequent category (the smallest on ties).

    Columns -1 and -2 are cost and rows, the numbers go on from -3, the categories up from 0.
    """

    def work(ids: pa.Array, numbers: np.ndarray, codes: np.ndarray, words: list) -> list[pa.Array]:
        n = len(ids)
        keys, sums, values = [], [], []
        for m, centres in models.items():
            costs = np.array([_mixed_costs(numbers, codes, words, c, gamma, n) for c in centres])
            own = np.where(np.isnan(costs), np.inf, costs).argmin(axis=0)
            k = len(centres)
            for at, x in enumerate([costs[own, np.arange(n)], np.ones(n), *numbers]):
                total = np.bincount(own, weights=x, minlength=k)
                seen = np.unique(own)
                keys.append(np.stack([np.full(len(seen), m), seen, np.full(len(seen), -1 - at)]))
                sums.append(total[seen])
                values += [None] * len(seen)
            for at, (places, known) in enumerate(zip(codes, words, strict=True)):
                counts = np.bincount(own * len(known) + places, minlength=k * len(known)).reshape(k, -1)[:, :-1]
                label, place = np.nonzero(counts)
                keys.append(np.stack([np.full(len(label), m), label, np.full(len(label), at)]))
                sums.append(counts[label, place].astype(float))
                values += [known[w] for w in place.tolist()]
        key = np.concatenate(keys, axis=1).astype(np.int32)
        return [*[pa.array(x) for x in key], pa.array(values, pa.string()), pa.array(np.concatenate(sums))]

    parts = blocks.scan(work, "m int, label int, at int, value string, s double")
    counted = parts.groupBy("m", "label", "at", "value").agg(F.sum("s").alias("s"))
    best = F.min_by("value", F.struct(-F.col("s"), F.col("value")))
    # One row a model, label and column.
    found = counted.groupBy("m", "label", "at").agg(best.alias("mode"), F.sum("s").alias("s")).collect()
    return {(r["m"], r["label"], r["at"]): r for r in found}


def _kprototypes(
    df: DataFrame, row_id: str, numeric: Sequence[str], categorical: Sequence[str], ks: Sequence[int],
    gamma: float | None, seed: int, max_iter: int, start: str,
) -> list[Fit | None]:
    """A fit per k, None where there are fewer different rows; all advance together, one scan an iteration."""
    rows = df.select(
        row_id,
        *[F.col(c).cast("double").alias(c) for c in numeric],
        *[F.col(c).cast("string").alias(c) for c in categorical],
    ).persist(StorageLevel.MEMORY_AND_DISK)
    unknown = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in numeric], F.lit(False))
    moments = rows.agg(*[F.avg(c) for c in numeric], *[F.stddev_pop(c) for c in numeric], F.count(F.when(unknown, 1))).first()
    if gamma is None:
        gamma = 0.5 * float(np.mean([s or 0.0 for s in moments[len(numeric) : -1]]))
    blocks = _MixedBlocks(rows, row_id, numeric, categorical)
    if start == "huang":
        begun = _huang_starts(rows, blocks, numeric, categorical, ks, moments, gamma, seed)
    else:
        begun = [
            [({c: r[c] for c in numeric}, {c: r[c] for c in categorical}) for r in _hashed_start(rows, row_id, numeric, categorical, k, seed)]
            for k in ks
        ]
    models = {m: centres for m, centres in enumerate(begun) if len(centres) >= ks[m]}
    if models and moments[-1]:
        raise TypeError("a number is null")
    cost, trace = dict.fromkeys(models, math.inf), {m: [] for m in models}
    moving = set(models)
    for step in range(max_iter + 1):
        if not moving:
            break
        found = _mixed_totals(blocks, {m: models[m] for m in sorted(moving)}, gamma)
        for m in sorted(moving):
            used = [j for j in range(len(models[m])) if (m, j, -1) in found]
            now = sum(found[m, j, -1]["s"] for j in used)
            trace[m].append(now)
            # The last scan of a model only adds up its cost.
            if step == max_iter or now >= cost[m] - 1e-12 * max(1.0, abs(now)):
                if step < max_iter:
                    trace[m].append(now)
                moving.discard(m)
            else:
                models[m] = [
                    (
                        {c: found[m, j, -3 - i]["s"] / found[m, j, -2]["s"] if j in used else nums[c] for i, c in enumerate(numeric)},
                        {c: found[m, j, i]["mode"] if (m, j, i) in found else cats[c] for i, c in enumerate(categorical)},
                    )
                    for j, (nums, cats) in enumerate(models[m])
                ]
            cost[m] = now
    blocks.frame.unpersist()
    rows.unpersist()

    def fit(m: int) -> Fit:
        prices = F.array(*[_mixed_cost(*c, gamma) for c in models[m]])
        label = F.array_position(prices, F.array_min(prices)).cast("int") - 1
        info = {"cost": float(cost[m]), "gamma": gamma, "centres": models[m], "trace": trace[m]}
        return Fit(rows.select(row_id, label.alias("label")), ks[m], info=info)

    return [fit(m) if m in models else None for m in range(len(ks))]


def kprototypes(
    df: DataFrame,
    row_id: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    k: int,
    gamma: float | None = None,
    seed: int = 42,
    max_iter: int = 20,
    start: str = "huang",
) -> Fit:
    """k-prototypes: squared distance on numeric plus ``gamma`` per differing category.

    The driver holds the ``k`` centres; an iteration is one scan of packed rows. ``gamma``
    defaults to half the mean standard deviation of the numeric columns. ``start`` is
    ``huang`` (frequent categories) or ``hashed`` (any rows). ``info`` has the cost, its
    course and the centres.
    """
    fit = _kprototypes(df, row_id, numeric, categorical, [k], gamma, seed, max_iter, start)[0]
    if fit is None:
        raise ValueError(f"fewer than {k} different rows")
    return fit


def kprototypes_sweep(
    df: DataFrame,
    row_id: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    ks: Sequence[int] = CLUSTER_COUNTS,
    gamma: float | None = None,
    seed: int = 42,
) -> Fit:
    """k-prototypes for every k; the lowest cost wins. A k that cannot be fitted has no cost.

    All k advance together, one scan an iteration.
    """
    ks = list(ks)
    fits = _kprototypes(df, row_id, numeric, categorical, ks, gamma, seed, 20, "huang")
    tried = [{"k": k, "cost": None if f is None else f.info["cost"], "model": f} for k, f in zip(ks, fits, strict=True)]
    best, scores = _choice(tried, "cost", highest=False)
    if best["model"] is None:
        return Fit(None, best["k"], scores)
    return Fit(best["model"].labels, best["k"], scores, best["model"].info)


# --- graphs ---------------------------------------------------------------


#: Graphs up to this many edges (16 MB) are finished on the driver.
LOCAL_EDGES = 1_000_000


def _local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a graph and the smallest node that each is connected with."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        for at in (before[a], before[b]):
            np.minimum.at(root, at, least)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            return nodes, nodes[root]


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False)


def connected_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node.

    Alternates the two star operations of Kiveris et al. (2014) until the edges stop
    changing. A node's neighbours are only ever reduced to their minimum. A graph of a
    checked, small size is solved directly.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    head = edges.limit(local_edges + 1).toArrow()
    if head.num_rows <= local_edges and not any(c.null_count for c in head.columns):
        return edges.sparkSession.createDataFrame(pa.table(_local_components(*map(_numbers, head.columns)), names=["node", "root"]), "node long, root long")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct()
    links = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = settle(links)

    def with_least(pairs: DataFrame, total: int) -> DataFrame:
        low = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        return join_heavy(pairs, low, "a", "n", "b", total)

    def large_star(pairs: DataFrame, total: int) -> DataFrame:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = with_least(both, 2 * total).where("b > a")
        return moved.select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()

    def small_star(pairs: DataFrame, total: int) -> DataFrame:
        moved = with_least(pairs, 2 * total)
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        return moved.select(F.inline(ends)).where("a != b").distinct()

    def fingerprint(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    mark = fingerprint(links)
    while True:
        links = settle(small_star(large_star(links, mark[0]), mark[0]))
        now = fingerprint(links)
        if now == mark:
            break
        mark = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _spread_minimum(close: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest name reachable inside one pair of blocks, for both sides."""
    top = np.iinfo(np.int64).max
    few = np.count_nonzero(close) <= close.size // 16
    i, j = np.nonzero(close) if few else (None, None)
    while True:
        right_new, left_new = right.copy(), left.copy()
        if few:
            np.minimum.at(right_new, j, left[i])
            np.minimum.at(left_new, i, right_new[j])
        else:
            right_new = np.minimum(right, np.where(close, left[:, None], top).min(axis=0, initial=top))
            left_new = np.minimum(left, np.where(close, right_new[None, :], top).min(axis=1, initial=top))
        if (left_new == left).all() and (right_new == right).all():
            return left, right
        left, right = left_new, right_new


class _Counts:
    """Work on blocks: rows within each radius of every point, once for every point of a block.

    A point that has ``enough`` rows within a radius is not counted on there: from then on its
    number is too small, never below ``enough``.
    """

    def __init__(self, radii: Sequence[float], enough: int):
        self.radii = radii
        self.enough = enough
        self.held: dict[str, tuple] = {}

    def _frames(self, reps: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        e, i = np.nonzero(counts)
        yield pd.DataFrame({"e": e.astype(np.int32), "rep": reps[i], "near": counts[e, i].astype(np.int64)})

    def _open(self, counts: np.ndarray, live: list[int]) -> np.ndarray:
        """The largest radius at which a point still counts, below zero where there is none."""
        far = np.full(counts.shape[1], -1.0)
        for e in live:
            far = np.maximum(far, np.where(counts[e] < self.enough, self.radii[e], -1.0))
        return far

    def meet(self, right: _Block, lefts: list) -> Iterator[pd.DataFrame]:
        for left, _ in lefts:
            if left.block not in self.held:
                self.held[left.block] = (left.reps, np.zeros((len(self.radii), len(left.reps))))
        at_home = any(left is right for left, _ in lefts)
        mine = self.held[right.block][1] if at_home else np.zeros((len(self.radii), len(right.reps)))
        for left, most in lefts:
            theirs, own = self.held[left.block][1], left is right
            live = [e for e, eps in enumerate(self.radii) if not _surely(most, eps)]
            limits = self._open(theirs, live), self._open(theirs if own else mine, live)
            limit = max(limits[0].max(initial=-1.0), limits[1].max(initial=-1.0))
            live = [e for e in live if self.radii[e] <= limit]
            if not live:
                continue
            low, width = _low_squares(left, right)
            possible = low <= _up_to(low, limit * limit * (1 + 1e-9))
            found = np.count_nonzero(possible)
            if found <= possible.size // 16:
                i, j = np.divmod(np.flatnonzero(possible), len(right.reps))
                # Only what one of the two still counts.
                some = np.maximum(limits[0][i], limits[1][j])
                dist = _pair_distances(left.x, right.x, i, j)
                i, j, dist = i[dist <= some], j[dist <= some], dist[dist <= some]
                for e in live:
                    hit = dist <= self.radii[e]
                    theirs[e] += np.bincount(i[hit], weights=right.sizes[j[hit]], minlength=len(left.reps))
                    if not own:
                        mine[e] += np.bincount(j[hit], weights=left.sizes[i[hit]], minlength=len(right.reps))
                continue
            for e in live:
                close = _settled(low, width, left, right, self.radii[e])
                theirs[e] += self._weighed(close, right.sizes)
                if not own:
                    mine[e] += self._weighed(close.T, left.sizes)
        if not at_home:
            yield from self._frames(right.reps, mine)

    @staticmethod
    def _weighed(close: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.count_nonzero(close, axis=1) if (sizes == 1).all() else close @ sizes.astype(float)

    def rest(self) -> Iterator[pd.DataFrame]:
        for reps, counts in self.held.values():
            yield from self._frames(reps, counts)


class _Links:
    """Work on blocks: links that connect core points as their distances do, and the cores in reach of border points.

    A core point has a name, the smallest point it is known to be connected with. A link is
    written when a name changes, so a group writes about one link a point, not one a pair of blocks.
    Core points of the same name are connected already and not measured again.
    """

    def __init__(self, radii: Sequence[float]):
        self.radii = radii
        self.names: dict[tuple, np.ndarray] = {}

    def _close(self, left: _Block, right: _Block, e: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _settled(*_low_squares(left, right, i, j), left, right, self.radii[e], i, j)

    def _connect(self, left: _Block, right: _Block, e: int, a_names: np.ndarray, b_names: np.ndarray, i: np.ndarray, j: np.ndarray) -> list:
        """Names spread over the core points ``i`` and ``j``; the changes as pairs ``(old names, new names)``."""
        if not len(i) or not len(j):
            return []
        close = self._close(left, right, e, i, j)
        if not close.any():
            return []
        a_old, b_old = a_names[i], b_names[j]
        a_new, b_new = _spread_minimum(close, a_old, b_old)
        a_names[i], b_names[j] = a_new, b_new
        return [(a_old[a_new != a_old], a_new[a_new != a_old]), (b_old[b_new != b_old], b_new[b_new != b_old])]

    def meet(self, right: _Block, lefts: list) -> Iterator[pd.DataFrame]:
        at_home = any(left is right for left, _ in lefts)
        named = {e: self.names.setdefault((e, right.block), right.reps.copy()) if at_home else right.reps.copy() for e in right.cores}
        for left, _ in lefts:
            for e in sorted({*left.cores, *right.cores}):
                a_core, b_core = (np.flatnonzero(b.cores.get(e, ())) for b in (left, right))
                links, reached = [], []
                if len(a_core) and len(b_core):
                    a_names = self.names.setdefault((e, left.block), left.reps.copy())
                    if right is left:
                        if (a_names[a_core] != a_names[a_core[0]]).any():
                            links += self._connect(left, left, e, a_names, a_names, a_core, a_core)
                        links.append((left.reps[a_core], left.reps[a_core]))
                    else:
                        # Only points of different names: those without the most frequent name with all, the others with the rest.
                        names, counts = np.unique(np.concatenate([a_names[a_core], named[e][b_core]]), return_counts=True)
                        common = names[counts.argmax()]
                        if len(names) > 1:
                            a_other, b_other = a_names[a_core] != common, named[e][b_core] != common
                            links += self._connect(left, right, e, a_names, named[e], a_core[a_other], b_core)
                            links += self._connect(left, right, e, a_names, named[e], a_core[~a_other], b_core[b_other])
                a_edge, b_edge = (np.flatnonzero(b.edges.get(e, ())) for b in (left, right))
                if len(a_edge) and len(b_core):
                    i, j = np.nonzero(self._close(left, right, e, a_edge, b_core))
                    reached.append((left.reps[a_edge][i], right.reps[b_core][j]))
                if right is not left and len(b_edge) and len(a_core):
                    i, j = np.nonzero(self._close(left, right, e, a_core, b_edge))
                    reached.append((right.reps[b_edge][j], left.reps[a_core][i]))
                for found, core in ((links, True), (reached, False)):
                    if sum(len(a) for a, _ in found):
                        pairs = np.unique(np.concatenate([np.stack(f) for f in found], axis=1), axis=1)
                        yield pd.DataFrame({"e": np.int32(e), "a": pairs[0], "b": pairs[1], "core": core})

    def rest(self) -> Iterator[pd.DataFrame]:
        yield from ()


def _surely(most, eps: float):
    """Whether points at most ``most`` apart are within ``eps``, rounding included."""
    return most <= eps * (1 - 1e-12)


def _density_links(layout: _Layout, radii: Sequence[float], min_points: int) -> tuple[DataFrame, DataFrame]:
    """``(e, a, b, core)`` for every radius by its place in ``radii``, and the pairs of blocks.

    ``core`` links connect core points, the others a border point with every core point in
    its reach (fewer than ``min_points``). All radii share one pass for the counts and one for the links.
    """
    radii = [float(eps) for eps in radii]
    pairs = layout.pairs_within(np.full(len(layout.pivots), max(radii)))
    unsure = pairs.where(~_surely(F.col("most"), min(radii)))
    counts = layout.meet(unsure, ["reps", "flat", "sizes"], partial(_Counts, radii, min_points), "e int, rep long, near long")
    # Blocks that lie within a radius of each other as a whole are counted without their points.
    places = F.explode(F.filter(F.array(*[F.when(_surely(F.col("most"), eps), F.lit(e)) for e, eps in enumerate(radii)]), lambda e: e.isNotNull()))
    whole = pairs.select(places.alias("e"), "block", "block2")
    both = whole.union(whole.where("block <> block2").select("e", "block2", "block"))
    sums = both.join(layout.blocks.select(F.col("block").alias("block2"), "rows"), "block2").groupBy("e", "block").agg(F.sum("rows").alias("near"))
    counted = layout.blocks.select("block", "reps").join(sums, "block").select("e", F.explode("reps").alias("rep"), "near")
    near = counts.unionByName(counted).groupBy("e", "rep").agg(F.sum("near").alias("near"))
    # A point with nothing but itself in reach is neither core nor border.
    point = F.struct("e", "rep", (F.col("near") >= min_points).alias("core"))
    per_block = (
        layout.blocks.select("block", F.explode("reps").alias("rep"))
        .join(near.where((F.col("near") >= min_points) | (F.col("near") > 1)), "rep")
        .groupBy("block")
        .agg(F.collect_list(point).alias("cores"), F.max(F.col("near") >= min_points).alias("cored"))
        .select("block", F.col("cores.e").alias("core_radius"), F.col("cores.rep").alias("cores"), F.col("cores.core").alias("is_core"), "cored")
    ).checkpoint()
    marked = layout.blocks.join(per_block.drop("cored"), "block", "left")
    # A pair without a core point on either side links nothing.
    cored = per_block.where("cored").select("block")
    first = pairs.join(cored, "block", "left_semi")
    rest = pairs.join(cored, "block", "left_anti").join(cored.toDF("block2"), "block2", "left_semi")
    live = first.unionByName(rest).checkpoint()
    payload = ["reps", "flat", "cores", "core_radius", "is_core"]
    links = layout.meet(live, payload, partial(_Links, radii), "e int, a long, b long, core boolean", marked)
    return links.distinct().checkpoint(), pairs


def _density_labels(df: DataFrame, row_id: str, vec: str, layout: _Layout, links: DataFrame) -> DataFrame:
    """Labels of one radius from its links."""
    roots = connected_components(links.where("core").select("a", "b"))
    border = (
        links.where(~F.col("core"))
        .join(roots, F.col("b") == F.col("node"))
        .groupBy(F.col("a").alias("rep"))
        .agg(F.min("root").alias("label"))
    )
    named = roots.select(F.col("node").alias("rep"), F.col("root").alias("label")).unionByName(border)
    members = df.select(row_id, F.col(vec).cast("array<double>").alias("vec"))
    return (
        members.join(layout.celled.select("vec", "rep"), "vec")
        .join(named, "rep", "left")
        .select(row_id, F.coalesce("label", F.lit(NOISE)).cast("long").alias("label"))
    )


def dbscan(df: DataFrame, row_id: str, vec: str, eps: float, min_points: int = MIN_POINTS, seed: int = 42) -> Fit:
    """Density clustering: ``label`` is the smallest row id of the cluster's core rows, noise is -1.

    The point itself counts as a neighbour. A border row joins the lowest-labelled
    cluster in reach. Neighbour pairs are never written out: a group of blocks yields a
    count per point it meets, then about one link per point. Every
    pair of blocks is measured once for both sides; ``info`` of the result holds the pairs of
    points ``measured`` for the counts and those ``counted`` from sizes alone.
    """
    layout = _Layout(df, row_id, vec, seed=seed)
    links, pairs = _density_links(layout, [eps], min_points)
    labels = _density_labels(df, row_id, vec, layout, links)
    surely = _surely(F.col("most"), eps)
    work = pairs.agg(F.sum(F.when(surely, 0).otherwise(F.col("cost"))), F.sum(F.when(surely, F.col("cost")).otherwise(0))).first()
    return Fit(labels, eps, info={"measured": work[0], "counted": work[1]})


def dbscan_sweep(
    df: DataFrame,
    row_id: str,
    vec: str,
    eps_values: Sequence[float] = EPS_VALUES,
    min_points: int = MIN_POINTS,
    seed: int = 42,
) -> Fit:
    """Density clustering per radius; results with noise or one cluster are rejected, best silhouette wins.

    The radii share one layout of the points and the two passes over pairs of blocks.
    """
    rows = _features(df, row_id, vec)
    eps_values = list(eps_values)
    layout = _Layout(rows, row_id, "vec", seed=seed)
    links, _ = _density_links(layout, eps_values, min_points)

    def one(e: int) -> dict:
        labels = _density_labels(rows, row_id, "vec", layout, links.where(F.col("e") == e)).checkpoint()
        noise, clusters = labels.agg(
            F.count(F.when(F.col("label") == NOISE, 1)), F.count_distinct(F.nullif("label", F.lit(NOISE)))
        ).first()
        fine = noise == 0 and clusters > 1
        score = _score(rows, labels, row_id) if fine else None
        return {"eps": eps_values[e], "clusters": clusters, "noise": noise, "silhouette": score, "labels": labels if fine else None}

    best, scores = sweep(one, range(len(eps_values)), "silhouette")
    return Fit(best["labels"], best["eps"], scores)


# --- Ward on a neighbour graph ---------------------------------------------------------------

#: Clusters left at which the rest of the tree is built on the driver from their centroids.
LOCAL_CLUSTERS = 256
#: Numbers of centroids (64 MB) and links (16 MB) up to which rounds run on the driver.
LOCAL_VALUES = 8_000_000
LOCAL_LINKS = 1_000_000


def _ward_cost(n1, n2, squared) -> Column:
    return n1 * n2 / (n1 + n2) * squared


def _finish_locally(clusters: list, edges: list) -> list[tuple[int, int, float]]:
    """Greedy merges of a bounded number of clusters; unconnected parts are joined by any pair."""
    size = {r["id"]: float(r["n"]) for r in clusters}
    centre = {r["id"]: np.array(r["centre"]) for r in clusters}
    near: dict[int, set] = {i: set() for i in size}
    for r in edges:
        near[r["a"]].add(r["b"])
        near[r["b"]].add(r["a"])

    def entry(a: int, b: int) -> tuple:
        a, b = min(a, b), max(a, b)
        gap = centre[a] - centre[b]
        return (size[a] * size[b] / (size[a] + size[b]) * float(gap @ gap), a, b, size[a], size[b])

    heap = [entry(a, b) for a in near for b in near[a] if a < b]
    heapq.heapify(heap)
    merges = []
    while len(size) > 1:
        while heap:
            cost, a, b, na, nb = heapq.heappop(heap)
            if size.get(a) == na and size.get(b) == nb:
                break
        else:
            ids = sorted(size)
            heap = [entry(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :]]
            for a in ids:
                near[a] = set(ids) - {a}
            heapq.heapify(heap)
            continue
        merges.append((a, b, cost))
        centre[a] = (centre[a] * na + centre[b] * nb) / (na + nb)
        size[a] = na + nb
        near[a] = (near[a] | near.pop(b)) - {a, b}
        for c in near[a]:
            near[c].discard(b)
            near[c].add(a)
        del size[b], centre[b]
        for c in near[a]:
            heapq.heappush(heap, entry(a, c))
    return merges


def _nearest_links(clusters: DataFrame, left: int, k_nn: int, seed: int) -> DataFrame:
    near = knn_graph(clusters, "id", "centre", min(k_nn, left - 1), seed)
    return near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


class _Rounds:
    """Rounds of merges on the driver: a bounded number of clusters and links, in the order and with the sums of the distributed rounds."""

    def __init__(self, clusters: pa.Table, links: pa.Table):
        order = np.argsort(_numbers(clusters["id"]))
        self.ids, self.n = _numbers(clusters["id"])[order], _numbers(clusters["n"])[order].copy()
        self.centre = clusters["centre"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        self.alive = np.ones(len(order), dtype=bool)
        ends = [np.searchsorted(self.ids, _numbers(links[c])) for c in ("a", "b")]
        self.a, self.b = ends
        self.cost = self._costs(*ends)
        self.merges: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def of(clusters: DataFrame, links: DataFrame, left: int) -> _Rounds | None:
        """None where there is too much for the driver, or ids repeat, or a number is missing."""
        width = F.size("centre")
        holes = F.exists("centre", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        odd = F.count(F.when(F.col("id").isNull() | F.col("centre").isNull() | holes, 1))
        least, most, odd, ids = clusters.agg(F.min(width), F.max(width), odd, F.count_distinct("id")).first()
        if odd or least != most or not least or ids < left or left * most > LOCAL_VALUES:
            return None
        found = links.limit(LOCAL_LINKS + 1).toArrow()
        if found.num_rows > LOCAL_LINKS:
            return None
        rounds = clusters.select("id", "n", "centre").toArrow()
        known = pa.compute.and_(*(pa.compute.is_in(found[c], value_set=rounds["id"].combine_chunks()) for c in ("a", "b")))
        return _Rounds(rounds, found.filter(known))

    def _costs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        squared = np.zeros(len(a))
        for column in self.centre.T:
            gap = column[a] - column[b]
            squared = squared + gap * gap
        return self.n[a] * self.n[b] / (self.n[a] + self.n[b]) * squared

    def merge(self) -> int:
        """One round: every pair of clusters that are each other's cheapest neighbour, the smaller id on ties."""
        ends, others, costs = np.concatenate([self.a, self.b]), np.concatenate([self.b, self.a]), np.tile(self.cost, 2)
        least = np.full(len(self.ids), np.inf)
        np.minimum.at(least, ends, costs)
        best = np.full(len(self.ids), len(self.ids))
        tied = costs == least[ends]
        np.minimum.at(best, ends[tied], others[tied])
        a = np.flatnonzero(best < len(self.ids))
        a = a[(best[best[a]] == a) & (a < best[a])]
        b = best[a]
        if not len(a):
            return 0
        self.merges.append((self.ids[a], self.ids[b], least[a]))
        na, nb = self.n[a, None], self.n[b, None]
        self.centre[a] = (self.centre[a] * na + self.centre[b] * nb) / (na + nb)
        self.n[a] += self.n[b]
        self.alive[b] = False
        target, moved = np.arange(len(self.ids)), np.zeros(len(self.ids), dtype=bool)
        target[b], moved[a] = a, True
        ends = target[self.a], target[self.b]
        fresh = moved[ends[0]] | moved[ends[1]]
        pairs = np.minimum(*ends)[fresh] * len(self.ids) + np.maximum(*ends)[fresh]
        one, two = np.divmod(np.unique(pairs), len(self.ids))
        one, two = one[one < two], two[one < two]
        # What did not move costs what it did.
        self.cost = np.concatenate([self.cost[~fresh], self._costs(one, two)])
        self.a, self.b = np.concatenate([ends[0][~fresh], one]), np.concatenate([ends[1][~fresh], two])
        return len(a)

    def clusters(self) -> pa.Table:
        centre = self.centre[self.alive]
        steps = np.arange(len(centre) + 1, dtype=np.int32) * centre.shape[1]
        return pa.table({"id": self.ids[self.alive], "n": self.n[self.alive], "centre": pa.ListArray.from_arrays(steps, centre.ravel())})

    def links(self) -> pa.Table:
        return pa.table({"a": self.ids[self.a], "b": self.ids[self.b]})

    def tree(self) -> pa.Table:
        return pa.table([np.concatenate(c) for c in zip(*self.merges, strict=True)], names=["a", "b", "cost"])


def ward_knn(
    df: DataFrame,
    row_id: str,
    vec: str,
    n_clusters: int = 5,
    k_nn: int = 10,
    edges: DataFrame | None = None,
    local_clusters: int = LOCAL_CLUSTERS,
    seed: int = 42,
) -> Fit:
    """Ward clustering restricted to a neighbour graph (built here unless ``edges(a, b)`` is given).

    A round merges every pair of clusters that are each other's cheapest neighbour, so
    the number of rounds grows with the logarithm of the rows. On a full graph this is
    the greedy tree; on a sparse one the order of merges may differ from the greedy one.
    Parts without a link are joined through their centroids. The tree is cut into
    ``n_clusters``; labels count from 0 in order of the smallest row id.
    """
    clusters = df.select(
        F.col(row_id).cast("long").alias("id"), F.lit(1.0).alias("n"), F.col(vec).cast("array<double>").alias("centre")
    )
    clusters = settle(clusters)
    rows = clusters.select("id")
    if edges is None:
        near = knn_graph(df, row_id, vec, k_nn, seed)
        edges = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    links = settle(links)
    spark = df.sparkSession
    merge_schema = "a long, b long, cost double"
    done: list[DataFrame] = []
    left = clusters.count()
    while left > max(local_clusters, 1):
        # Rows that share an id meet in the first round.
        rounds = _Rounds.of(clusters, links, left)
        if rounds is not None:
            while left > max(local_clusters, 1) and (merged := rounds.merge()):
                left -= merged
            if rounds.merges:
                done.append(spark.createDataFrame(rounds.tree(), merge_schema))
            clusters = spark.createDataFrame(rounds.clusters(), "id long, n double, centre array<double>")
            links = spark.createDataFrame(rounds.links(), "a long, b long")
            if left <= max(local_clusters, 1):
                break
            links = settle(_nearest_links(settle(clusters), left, k_nn, seed))
            continue
        one = clusters.toDF("a", "na", "ca")
        two = clusters.toDF("b", "nb", "cb")
        priced = links.join(one, "a").join(two, "b").select(
            "a", "b", _ward_cost(F.col("na"), F.col("nb"), squared_distance("ca", "cb")).alias("cost")
        )
        sides = F.array(F.struct("a", "b", "cost"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
        cheapest = priced.select(F.inline(sides)).groupBy("a").agg(F.min(F.struct("cost", "b")).alias("m")).select("a", "m.b", "m.cost")
        # A pair that both sides chose is there twice, with the same cost.
        chosen = cheapest.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        mutual = chosen.agg(F.min("cost").alias("cost"), F.count(F.lit(1)).alias("n")).where("n = 2")
        merges = settle(mutual.select("a", "b", "cost"))
        merged = merges.count()
        if merged == 0:
            # No links left between the parts: connect them by the centroids' neighbours.
            links = settle(_nearest_links(clusters, left, k_nn, seed))
            continue
        done.append(merges)
        left -= merged
        into = merges.select(F.col("b").alias("id"), F.col("a").alias("target"))
        moved = clusters.join(into, "id", "left").withColumn("id", F.coalesce("target", "id"))
        # At most two old clusters meet in a new one, and in the first round the rows that share an id.
        pair = moved.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "centre"))).alias("p"), F.sum("n").alias("n"))
        weighted = F.aggregate(
            F.slice("p", 2, F.size("p")),
            F.transform(F.col("p")[0]["centre"], lambda x: x * F.col("p")[0]["n"]),
            lambda acc, q: F.zip_with(acc, q["centre"], lambda x, y: x + y * q["n"]),
        )
        # A cluster that did not merge keeps its centre to the last digit.
        mean = F.when(F.size("p") == 1, F.col("p")[0]["centre"]).otherwise(F.transform(weighted, lambda x: x / F.col("n")))
        joined = pair.select("id", "n", mean.alias("centre"))
        ends = links
        for side in ("a", "b"):
            renamed = into.toDF(side, "__t")
            ends = ends.join(renamed, side, "left").withColumn(side, F.coalesce("__t", side)).drop("__t")
        ends = ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        clusters, links = at_once(settle, [joined, ends], spark)
    if left > 1:
        rest = _finish_locally(clusters.collect(), links.collect())
        done.append(spark.createDataFrame(rest, merge_schema))
    tree = spark.createDataFrame([], merge_schema)
    for part in done:
        tree = tree.unionByName(part)
    tree = tree.checkpoint()
    cut = tree.orderBy(F.desc("cost"), "a", "b").limit(n_clusters - 1)
    kept = tree.join(cut.select("a", "b"), ["a", "b"], "left_anti")
    roots = connected_components(kept.select("a", "b")) if n_clusters > 1 else connected_components(tree.select("a", "b"))
    rooted = rows.join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    # At most n_clusters roots.
    order = sorted(r["root"] for r in rooted.select("root").distinct().collect())
    numbers = spark.createDataFrame([(r, i) for i, r in enumerate(order)], "root long, label int")
    labels = rooted.join(F.broadcast(numbers), "root").select(F.col("id").alias(row_id), "label")
    return Fit(labels, n_clusters, info={"tree": tree})
