"""Exact nearest-neighbour and radius joins over vectors.

Points are put into cells around a bounded set of pivots. A cell is cut into blocks of
bounded size: rings by distance to the pivot, slabs along a projection, then a hash where
points still share both. Two bounds rule out pairs of blocks that cannot hold a neighbour:
the triangle inequality on the pivots, and the gap between the blocks' boxes in a few
orthonormal projections. A pair that is left is met once, for both of its sides. Blocks
meet by groups: a task holds one group's blocks while those they meet pass by, so a point is
sent once a group, not once a block, and a task answers once per point. Copies of one vector
are collapsed first, so a vector owning a third of the rows is one point.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import cached_property, partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from cohortry.operators.relational import bounded_sample

#: Pivots are at most this many, so tables over pairs of cells have a fixed bound.
MAX_PIVOTS = 1_024
#: Points per block, rings per cell and slabs per ring at most, and projections of a box.
BLOCK = 1_024
RINGS = 64
PROJECTIONS = 8
#: Groups of blocks a layout has at least (with enough points), points a group holds at most
#: (about), and parts the blocks a group meets are dealt into, each with the group's own blocks.
GROUPS = 16
GROUP_POINTS = 65_536
SLICES = 4
#: Slack on every bound, against rounding in the distances.
SLACK = 1e-9


def collapse_copies(df: DataFrame, row_id: str, vec: str, ids: int) -> DataFrame:
    """Distinct vectors: ``rep`` (smallest row id), ``n``, the ``ids`` smallest row ids, ``vec``.

    The id list is cut to the smallest ones by a ranking that is applied before the
    shuffle too; the count is complete. Rows without a vector are left out.
    """
    rows = df.select(F.col(row_id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec"))
    rows = rows.where(F.col("vec").isNotNull())
    sizes = rows.groupBy("vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    if ids <= 1:
        return sizes.select("rep", "n", F.array("rep").alias("ids"), "vec")
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
    heads = ranked.where(F.col("__r") <= ids).groupBy("vec").agg(
        F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("rep")
    )
    return sizes.select("rep", "n").join(heads.select("rep", "ids", "vec"), "rep")


def _pivots(points: DataFrame, total: int, seed: int) -> np.ndarray:
    """A bounded sample of the points, at most ``MAX_PIVOTS`` rows."""
    wanted = min(MAX_PIVOTS, max(1, total * 2 // BLOCK))
    rows = bounded_sample(points.select("rep", "vec"), wanted, "rep", seed=seed).orderBy("rep").collect()
    return np.array([r["vec"] for r in rows], dtype=float)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by explicit differences, a slice at a time (no cancellation)."""
    out = np.empty((len(a), len(b)))
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        gap = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _rough_squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a bound on their rounding error."""
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    size = na[:, None] + nb[None, :]
    return size - 2 * (a @ b.T), 1e-12 * size + 1e-300


def _low_squares(left: _Block, right: _Block, i=slice(None), j=slice(None)) -> tuple[np.ndarray, float]:
    """No more than the squared distances of points ``i`` of one block to ``j`` of the other, and how much more they are at most.

    Single precision where the numbers allow it: one matrix product, with the rounding error
    of every pair already taken off. What is too close to call is for the caller to measure.
    """
    if not (left.small and right.small):
        rough, error = _rough_squares(left.x[i], right.x[j])
        width = 2 * float(error.max(initial=0.0))
        return rough - error, width if np.isfinite(width) else np.inf
    return left.ahead[i] @ right.behind[j].T, 2.1 * left.share * (left.top + right.top) + 1e-30


def _up_to(low: np.ndarray, squares) -> np.ndarray:
    """Squares in the precision of ``low``, never below what they were."""
    if low.dtype != np.float32:
        return np.asarray(squares, dtype=float)
    with np.errstate(over="ignore"):
        return np.nextafter(np.asarray(np.asarray(squares) * (1 + 1e-6) + 1e-30, dtype=np.float32), np.float32(np.inf))


def _settled(low: np.ndarray, width: float, left: _Block, right: _Block, eps: float, i=slice(None), j=slice(None)) -> np.ndarray:
    """Which pairs lie within ``eps``, from what ``_low_squares`` gave for them; pairs too close to call are measured exactly."""
    possible = low <= _up_to(low, eps * eps * (1 + 1e-9))
    sure = eps * eps * (1 - 1e-6) - width
    doubtful = possible & (low > sure) if sure > 0 else possible
    q, r = np.nonzero(doubtful)
    if len(q):
        rows, columns = np.arange(len(left.x))[i], np.arange(len(right.x))[j]
        possible[q, r] = _pair_distances(left.x, right.x, rows[q], columns[r]) <= eps
    return possible


def _pair_distances(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact distances of chosen pairs."""
    out = np.empty(len(i))
    step = max(1, 4_000_000 // max(1, a.shape[1]))
    for s in range(0, len(i), step):
        gap = a[i[s : s + step]] - b[j[s : s + step]]
        out[s : s + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def within(a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs lie within ``eps``; pairs too close to call are measured exactly."""
    rough, error = _rough_squares(a, b)
    return settled_within(rough, error, a, b, eps)


def settled_within(rough: np.ndarray, error: np.ndarray, a: np.ndarray, b: np.ndarray, eps: float) -> np.ndarray:
    """As ``within``, from rough squares at hand."""
    near = rough <= eps * eps
    i, j = np.nonzero(np.abs(rough - eps * eps) <= error + 1e-12 * eps * eps)
    near[i, j] = _pair_distances(a, b, i, j) <= eps
    return near


def _directions(pivots: np.ndarray) -> np.ndarray:
    """A few orthonormal directions along which the pivots spread most."""
    _, _, axes = np.linalg.svd(pivots - pivots.mean(axis=0), full_matrices=False)
    return axes[:PROJECTIONS]


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's nearest pivot, the first one on ties, and its distance; exact where rough squares are too close to call."""
    nearest, radius = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    step = max(1, 2_000_000 // len(pivots))
    for s in range(0, len(x), step):
        part = x[s : s + step]
        rough, error = _rough_squares(part, pivots)
        least = (rough + error).min(axis=1)
        if not np.isfinite(least).all():
            dist = _distances(part, pivots)
            best = dist.argmin(axis=1)
            nearest[s : s + step], radius[s : s + step] = best, dist[np.arange(len(part)), best]
            continue
        q, j = np.nonzero(rough - error <= least[:, None])
        dist = _pair_distances(part, pivots, q, j)
        order = np.lexsort((j, dist, q))
        first = order[np.searchsorted(q[order], np.arange(len(part)))]
        nearest[s : s + step], radius[s : s + step] = j[first], dist[first]
    return nearest, radius


def _to_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot (``cell``), the distance to it (``radius``) and the projections (``at``)."""
    axes = _directions(pivots)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows) == 0:
                continue
            x = np.stack(rows["vec"].to_numpy())
            nearest, radius = _nearest_pivot(x, pivots)
            yield rows.assign(cell=nearest.astype(np.int32), radius=radius, at=list(x @ axes.T))

    added = [("cell", T.IntegerType()), ("radius", T.DoubleType()), ("at", T.ArrayType(T.DoubleType()))]
    schema = T.StructType([*points.schema.fields, *[T.StructField(n, t) for n, t in added]])
    return points.mapInPandas(assign, schema)


def _blocks(celled: DataFrame) -> DataFrame:
    """One row per block: its points as parallel arrays, its range of distances to the pivot and its box.

    Rings and slabs follow the cell's size; points that share ring and slab are counted and
    spread by hash, so no block grows with the data.
    """
    probs = [i / RINGS for i in range(1, RINGS)]
    lead = F.get("at", F.lit(0))
    cells = celled.groupBy("cell").agg(
        F.ceil(F.count(F.lit(1)) / BLOCK).alias("__want"),
        F.percentile_approx("radius", probs).alias("__cuts"),
        F.percentile_approx(lead, probs).alias("__edges"),
    )
    sized = celled.join(F.broadcast(cells), "cell")  # one row per pivot, at most MAX_PIVOTS

    def step(cuts: str, value: Column, most: Column) -> Column:
        depth = F.size(F.filter(cuts, lambda c: c < value))
        return F.coalesce(F.floor(depth * most / RINGS), F.lit(0)).cast("int")

    rings = F.least(F.lit(RINGS), F.ceil(F.sqrt("__want")))
    slabs = F.least(F.lit(RINGS), F.ceil(F.col("__want") / rings))
    placed = sized.withColumns({"ring": step("__cuts", F.col("radius"), rings), "slab": step("__edges", lead, slabs)})
    crowds = placed.groupBy("cell", "ring", "slab").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("__parts"))
    # Mostly empty, and then adaptive execution drops the join.
    crowded = crowds.where(F.col("__parts") > 1)
    spread = placed.join(crowded, ["cell", "ring", "slab"], "left").withColumn(
        "part", F.pmod(F.xxhash64("rep"), F.coalesce("__parts", F.lit(1))).cast("int")
    )
    packed = spread.groupBy("cell", "ring", "slab", "part").agg(
        F.collect_list(F.struct("rep", "n", "ids", "vec", "at")).alias("items"),
        F.min("radius").alias("near"),
        F.max("radius").alias("far"),
    )
    axes = F.sequence(F.lit(0), F.size(F.col("items")[0]["at"]) - 1)

    def edge(pick) -> Column:
        return F.transform(axes, lambda d: pick(F.transform("items", lambda i: F.get(i["at"], d))))

    return packed.select(
        F.concat_ws("-", "cell", "ring", "slab", "part").alias("block"),
        "cell",
        "near",
        "far",
        edge(F.array_min).alias("low"),
        edge(F.array_max).alias("high"),
        F.size("items").alias("points"),
        F.aggregate("items", F.lit(0).cast("bigint"), lambda t, i: t + i["n"]).alias("rows"),
        F.col("items.rep").alias("reps"),
        F.col("items.n").alias("sizes"),
        F.col("items.ids").alias("ids"),
        F.flatten("items.vec").alias("flat"),
    )


class _Layout:
    """Collapsed points in blocks around the pivots; checkpointed once, read by every pass."""

    def __init__(self, df: DataFrame, row_id: str, vec: str, ids: int = 1, seed: int = 42):
        points = collapse_copies(df, row_id, vec, ids).checkpoint()
        self.total = points.count()
        if self.total == 0:
            raise ValueError("no vectors")
        self.pivots = _pivots(points, self.total, seed)
        self.celled = _to_cells(points, self.pivots).checkpoint()
        self.blocks = _blocks(self.celled).checkpoint()
        self.between = _distances(self.pivots, self.pivots)
        spans = self.blocks.groupBy("cell").agg(F.max("far").alias("far"), F.sum("points").alias("points")).collect()
        self.far = {r["cell"]: r["far"] for r in spans}
        self.blocks = self.blocks.withColumn("group", self._group({r["cell"]: r["points"] for r in spans}))

    def _group(self, points: dict[int, int]) -> Column:
        """Number of a block's group: cells in the order of their pivots along the widest axis, cut by points.

        A cell that crosses a cut spreads its blocks over its groups by hash.
        """
        room = max(BLOCK, min(GROUP_POINTS, -(-self.total // GROUPS)))
        along = self.pivots @ _directions(self.pivots)[0]
        first, span, before = [0] * len(self.pivots), [1] * len(self.pivots), 0
        for cell in sorted(points, key=lambda c: (along[c], c)):
            first[cell] = before // room
            before += points[cell]
            span[cell] = (before - 1) // room - first[cell] + 1
        part = F.pmod(F.xxhash64("block"), F.get(F.lit(span), F.col("cell")))
        return (F.get(F.lit(first), F.col("cell")) + part).cast("int")

    def pairs_within(self, bounds: np.ndarray, own: DataFrame | None = None) -> DataFrame:
        """``(block, block2, group, cost, most)``: pairs of blocks that can hold points within the bounds, each once.

        ``bounds`` has a distance per cell; ``own`` may have a smaller one per block (``block,
        reach``). A block also meets itself (``block2`` equal). ``cost`` is the number of point
        pairs, ``most`` a distance that no pair of their points exceeds. Cells are compared first (a table
        bounded by the pivots), then their blocks by id and box; no points are read here. Which
        of two blocks comes first is settled by their groups, the same way for all pairs of two
        groups, so that a block is sent to about half of them; ``group`` is that of the first.
        """
        cells = np.array(sorted(self.far))
        far = np.array([self.far[c] for c in cells])
        gap = self.between[np.ix_(cells, cells)]
        limit = np.maximum(bounds[cells][:, None], bounds[cells][None, :])
        i, j = np.nonzero(np.triu(gap - far[:, None] - far[None, :] <= limit + SLACK))
        spark = self.blocks.sparkSession
        table = spark.createDataFrame(
            pd.DataFrame({"cell": cells[i], "cell2": cells[j], "gap": gap[i, j], "bound": bounds[cells][i], "bound2": bounds[cells][j]}),
            "cell int, cell2 int, gap double, bound double, bound2 double",
        )
        keys = self.blocks.select("block", "cell", "near", "far", "low", "high", "points", "group")
        keys = keys.withColumn("reach", F.lit(float("inf"))) if own is None else keys.join(own, "block")
        other = keys.toDF(*[f"{c}2" for c in keys.columns])
        away = F.zip_with(
            F.zip_with("low2", "high", lambda a, b: a - b), F.zip_with("low", "high2", lambda a, b: a - b),
            lambda a, b: F.greatest(a, b, F.lit(0.0)),
        )
        nearest = F.greatest(
            F.col("gap") - F.col("far") - F.col("far2"),
            F.col("near") - F.col("gap") - F.col("far2"),
            F.col("near2") - F.col("gap") - F.col("far"),
            F.sqrt(F.aggregate(away, F.lit(0.0), lambda t, x: t + x * x)),
        )
        bound = F.greatest(F.least("bound", "reach"), F.least("bound2", "reach2"))
        once = (F.col("cell") < F.col("cell2")) | (F.col("block") <= F.col("block2"))
        met = keys.join(table, "cell").join(other, "cell2").where(once & (nearest <= bound + SLACK))
        swap = (F.col("group") > F.col("group2")) == ((F.col("group") + F.col("group2")) % 2 == 0)
        swap = swap & (F.col("group") != F.col("group2"))
        same = F.col("block") == F.col("block2")
        return met.select(
            F.when(swap, F.col("block2")).otherwise(F.col("block")).alias("block"),
            F.when(swap, F.col("block")).otherwise(F.col("block2")).alias("block2"),
            F.when(swap, F.col("group2")).otherwise(F.col("group")).alias("group"),
            F.when(same, F.col("points") * (F.col("points") - 1) / 2).otherwise(F.col("points") * F.col("points2")).cast("long").alias("cost"),
            (F.col("gap") + F.col("far") + F.col("far2") + SLACK).alias("most"),
        ).checkpoint()

    def meet(self, pairs: DataFrame, payload: Sequence[str], work: Callable, schema: str, blocks: DataFrame | None = None) -> DataFrame:
        """Every pair of blocks, by ``work()``: one object a group and slice, with the frames it gives.

        The blocks of the group come first and are held (about ``GROUP_POINTS`` points). Then
        ``meet(right, lefts)`` is called once for every block that is met, with the held blocks it
        meets as ``(left, most)``; ``right`` is ``left`` where a block meets itself. ``rest()`` ends the
        slice. A block held is the same object in all calls. ``pairs`` is a stored frame, as it is read twice.
        """
        blocks = self.blocks if blocks is None else blocks
        part = F.pmod(F.xxhash64("block2"), F.lit(SLICES)).cast("int")
        keyed = pairs.select("group", part.alias("slice"), "block", "block2", "most")
        points = blocks.select("block", *payload)
        none = F.lit(None).cast("array<struct<block:string,most:double>>")
        lefts = keyed.select("group", "slice", "block").distinct().join(points, "block").select("group", "slice", F.lit(0).alias("turn"), none.alias("met"), "block", *payload)
        met = keyed.groupBy("group", "slice", F.col("block2").alias("block")).agg(F.collect_list(F.struct("block", "most")).alias("met"))
        rights = met.join(points, "block").select("group", "slice", F.lit(1).alias("turn"), "met", "block", *payload)
        rows = lefts.unionByName(rights).repartition("group", "slice").sortWithinPartitions("group", "slice", "turn")
        rows = rows.select("group", "slice", "turn", F.col("met.block").alias("met"), F.col("met.most").alias("most"), "block", *payload)
        centre = self.pivots.mean(axis=0)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            key, held, job = None, {}, None
            for batch in batches:
                for r in batch.itertuples(index=False):
                    if (r.group, r.slice) != key:
                        if job is not None:
                            yield from job.rest()
                        key, held, job = (r.group, r.slice), {}, work()
                    block = _Block(r, centre)
                    if r.turn == 0:
                        held[block.block] = block
                    else:
                        yield from job.meet(held.get(block.block, block), [(held[b], most) for b, most in zip(r.met, r.most, strict=True)])
            if job is not None:
                yield from job.rest()

        return rows.mapInPandas(run, schema)


class _Block:
    """A block's points in a task: name, ids, vectors, and what else the work asked for."""

    def __init__(self, row, centre: np.ndarray):
        self.block = row.block
        self.reps, self.x = _points(row.reps, row.flat)
        self.sizes = np.asarray(row.sizes, dtype=np.int64) if hasattr(row, "sizes") else None
        with np.errstate(over="ignore", invalid="ignore"):
            self._around = self.x - centre
            self._squares = np.einsum("ij,ij->i", self._around, self._around)
        self.top = float(self._squares.max(initial=0.0))
        self.small = self.top < 1e30  # in single precision nothing overflows; not so for what is not a number
        # Of the two squares of a pair, what single precision can lose at most.
        self.share = 2 * (self.x.shape[1] + 8) * 2.0**-24
        if hasattr(row, "ids"):
            # Own copies, so that no whole batch stays in memory behind a held block.
            self.copies = np.array([len(ids) for ids in row.ids])
            self.starts = np.cumsum(self.copies) - self.copies
            self.ids = np.concatenate(row.ids).astype(np.int64)
        if hasattr(row, "cores"):
            none = row.cores is None
            places = np.asarray([] if none else row.core_radius, dtype=np.int64)
            points, core = np.asarray([] if none else row.cores, dtype=np.int64), np.asarray([] if none else row.is_core, dtype=bool)
            found = {e: (places == e, core) for e in np.unique(places).tolist()}
            self.cores = {e: np.isin(self.reps, points[at & core]) for e, (at, core) in found.items() if (at & core).any()}
            self.edges = {e: np.isin(self.reps, points[at & ~core]) for e, (at, core) in found.items() if (at & ~core).any()}
        if hasattr(row, "last"):
            # How far a point must look at most, in the order of the points.
            order = np.argsort(self.reps)
            self.reach = np.full(len(self.reps), np.inf)
            known = np.asarray([] if row.last is None else row.known, dtype=np.int64)
            self.reach[order[np.searchsorted(self.reps, known, sorter=order)]] = np.asarray([] if row.last is None else row.last, dtype=float)

    def _packed(self, *parts: np.ndarray) -> np.ndarray:
        return np.concatenate(parts, axis=1).astype(np.float32)

    @cached_property
    def ahead(self) -> np.ndarray:
        """With ``behind`` of another block, one matrix product gives the squared distances."""
        return self._packed(-2 * self._around, self._less, np.ones_like(self._less))

    @cached_property
    def behind(self) -> np.ndarray:
        return self._packed(self._around, np.ones_like(self._less), self._less)

    @property
    def _less(self) -> np.ndarray:
        return (self._squares * (1 - self.share))[:, None]


def _points(reps, flat) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(reps, dtype=np.int64)
    return ids, np.array(flat, dtype=float).reshape(len(ids), -1)


class _Lists:
    """The ``k + 1`` nearest of every point of a block: entries ``(q, dist, dst)``, sorted, and those still to be taken in."""

    def __init__(self, own: _Block, k: int):
        self.reps, self.k = own.reps, k
        self.reach = getattr(own, "reach", np.full(len(own.reps), np.inf))
        self.best = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64))
        self.far = self.reach**2 * (1 + 1e-9) + 1e-300
        self.waiting: list[tuple] = []

    def offer(self, own: _Block, other: _Block, low: np.ndarray, width: float) -> None:
        """Takes the points of ``other`` that may be among the nearest, with their exact distances."""
        wanted = min(self.k + 1, len(other.reps))
        near = low <= _up_to(low, self.far)[:, None]
        if np.count_nonzero(near) > 8 * wanted * len(self.reps):
            last = np.partition(low, wanted - 1, axis=1)[:, wanted - 1].astype(float) + width
            near = low <= _up_to(low, np.minimum(self.far, np.where(np.isnan(last), np.inf, np.maximum(last, 0.0))))[:, None]
        q, j = np.divmod(np.flatnonzero(near), len(other.reps))
        dist = _pair_distances(own.x, other.x, q, j)
        some = dist <= self.reach[q] * (1 + 1e-9)
        q, j, dist = q[some], j[some], dist[some]
        n = other.copies[j]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.waiting.append((np.repeat(q, n), np.repeat(dist, n), other.ids[np.repeat(other.starts[j], n) + place]))
        if sum(len(w[0]) for w in self.waiting) >= (self.k + 1) * len(self.reps):
            self.merge()

    def merge(self) -> None:
        q, dist, dst = (np.concatenate(c) for c in zip(self.best, *self.waiting, strict=True))
        self.waiting, self.best = [], _first(q, dist, dst, self.k + 1)
        # Nothing beyond the last entry of a full list enters it.
        ends = np.cumsum(np.bincount(self.best[0], minlength=len(self.reps)))
        full = np.diff(ends, prepend=0) > self.k
        self.far[full] = np.minimum(self.far[full], self.best[1][ends[full] - 1] ** 2 * (1 + 1e-9) + 1e-300)

    def frame(self, name: str) -> pd.DataFrame:
        """One row with all lists of the block."""
        self.merge()
        q, dist, dst = self.best
        return pd.DataFrame({"block": [name], "rep": [self.reps[q].tobytes()], "dst": [dst.tobytes()], "dist": [dist.tobytes()]})


def _first(q: np.ndarray, dist: np.ndarray, dst: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` entries of every ``q`` by distance, the smaller id on ties; sorted."""
    order = np.lexsort((dst, dist, q))
    q, dist, dst = q[order], dist[order], dst[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[keep], dist[keep], dst[keep]


class _Nearest:
    """Work on blocks: the ``k + 1`` nearest points met so far, one row for every block."""

    schema = "block string, rep binary, dst binary, dist binary"

    def __init__(self, k: int):
        self.k = k
        self.held: dict[str, _Lists] = {}

    def meet(self, right: _Block, lefts: list) -> Iterator[pd.DataFrame]:
        mine = _Lists(right, self.k)
        for left, _ in lefts:
            low, width = _low_squares(left, right)
            self.held.setdefault(left.block, _Lists(left, self.k)).offer(left, right, low, width)
            if left is not right:
                mine.offer(right, left, low.T, width)
        if any(left is not right for left, _ in lefts):
            yield mine.frame(right.block)

    def rest(self) -> Iterator[pd.DataFrame]:
        for name, lists in self.held.items():
            yield lists.frame(name)


def _merged_lists(found: DataFrame, k: int) -> DataFrame:
    """``(block, rep, near)``: the lists that several tasks have of a block made one."""

    def merge(table: pa.Table) -> pa.Table:
        rep, dst = (np.concatenate([np.frombuffer(b, dtype=np.int64) for b in table[c].to_pylist()]) for c in ("rep", "dst"))
        dist = np.concatenate([np.frombuffer(b) for b in table["dist"].to_pylist()])
        rep, dist, dst = _first(rep, dist, dst, k + 1)
        reps, starts = np.unique(rep, return_index=True)
        near = pa.ListArray.from_arrays(np.append(starts, len(rep)).astype(np.int32), pa.StructArray.from_arrays([dist, dst], ["dist", "dst"]))
        return pa.table({"block": pa.repeat(table["block"][0], len(reps)), "rep": reps, "near": near})

    return found.groupBy("block").applyInArrow(merge, "block string, rep long, near array<struct<dist:double,dst:bigint>>")


def knn_graph(df: DataFrame, row_id: str, vec: str, k: int = 10, seed: int = 42) -> DataFrame:
    """``(src, dst, dist, rank)``: the ``k`` nearest other rows of every row, exactly.

    Ties go to the smaller id. Every block is searched by itself first; the k-th distances
    found there bound how far its points must still look.
    """
    lists, layout, _ = _knn_lists(df, row_id, vec, k, seed)
    # Copies share the list of their representative; each row skips itself.
    members = df.select(F.col(row_id).cast("long").alias("src"), F.col(vec).cast("array<double>").alias("vec"))
    mine = members.join(layout.celled.select("vec", "rep"), "vec").select("src", "rep").join(lists, "rep")
    own = F.slice(F.filter("near", lambda c: c["dst"] != F.col("src")), 1, k)
    return mine.select("src", F.posexplode(own).alias("pos", "c")).select(
        "src", F.col("c.dst").alias("dst"), F.col("c.dist").alias("dist"), (F.col("pos") + 1).alias("rank")
    )


def knn_work(df: DataFrame, row_id: str, vec: str, k: int = 10, seed: int = 42) -> DataFrame:
    """What ``knn_graph`` does on these rows: one row ``points, blocks, settled, compared, possible``.

    ``settled`` points are exact after the search of their own block, ``compared`` counts pairs
    of points that were measured, of all ``possible`` ones.
    """
    _, layout, pairs = _knn_lists(df, row_id, vec, k, seed)
    away = pairs.where("block <> block2")
    open_blocks = away.select("block").union(away.select("block2")).distinct()
    settled = layout.blocks.join(open_blocks, "block", "left_anti").agg(F.coalesce(F.sum("points"), F.lit(0)).alias("settled"))
    sizes = layout.blocks.agg(F.sum("points").alias("points"), F.count(F.lit(1)).alias("blocks"))
    compared = pairs.agg(F.sum("cost").alias("compared"))
    # Three aggregates of one row each.
    out = sizes.join(F.broadcast(settled)).join(F.broadcast(compared))
    possible = (F.col("points") * (F.col("points") - 1) / 2).cast("long")
    return out.select("points", "blocks", "settled", "compared", possible.alias("possible"))


def _knn_lists(df: DataFrame, row_id: str, vec: str, k: int, seed: int) -> tuple[DataFrame, _Layout, DataFrame]:
    """``(rep, near)`` with the ``k + 1`` nearest of every point, the layout, and the pairs of blocks met."""
    layout = _Layout(df, row_id, vec, k + 1, seed)
    payload, search = ["reps", "ids", "flat"], partial(_Nearest, k)
    # ``most`` plays no part in the search.
    selves = layout.blocks.select("block", F.col("block").alias("block2"), "group", F.lit(0.0).alias("most"))
    home = layout.meet(selves, payload, search, _Nearest.schema).checkpoint()
    last = F.when(F.size("near") > k, F.element_at("near", -1)["dist"]).otherwise(F.lit(float("inf")))
    lasts = _merged_lists(home, k).select("block", "rep", last.alias("last")).groupBy("block")
    own = lasts.agg(F.max("last").alias("reach"), F.collect_list(F.struct("rep", "last")).alias("lasts")).checkpoint()
    pairs = layout.pairs_within(_knn_bounds(layout, k), own.select("block", "reach"))
    away = pairs.where("block <> block2")
    # What a point found in its own block bounds how far it looks in the others.
    bounded = layout.blocks.join(own.select("block", F.col("lasts.rep").alias("known"), F.col("lasts.last").alias("last")), "block", "left")
    found = home
    if not away.isEmpty():
        found = home.unionByName(layout.meet(away, [*payload, "known", "last"], search, _Nearest.schema, bounded))
    return _merged_lists(found, k).drop("block"), layout, pairs


def _knn_bounds(layout: _Layout, k: int) -> np.ndarray:
    """Per cell, a distance within which every point of it surely has k others.

    From the k + 1 points nearest each pivot (bounded): distance to a point of another
    cell is at most own reach + pivot distance + that point's distance to its pivot.
    """
    order = Window.partitionBy("cell").orderBy("radius", "rep")
    near = (
        layout.celled.select("cell", "rep", "radius", "n")
        .withColumn("__r", F.row_number().over(order))
        .where(F.col("__r") <= k + 1)
        .collect()
    )
    cell = np.array([r["cell"] for r in near], dtype=int)
    radius = np.array([r["radius"] for r in near])
    copies = np.array([min(r["n"], k + 1) for r in near])
    bounds = np.full(len(layout.pivots), np.inf)
    for i, far in layout.far.items():
        upper = far + layout.between[i, cell] + radius
        by_bound = np.argsort(upper, kind="stable")
        enough = np.searchsorted(np.cumsum(copies[by_bound]), k + 1)
        if enough < len(by_bound):
            bounds[i] = upper[by_bound[enough]]
    return bounds


class _Close:
    """Work on blocks: every pair of different points within ``eps``, both ways."""

    def __init__(self, eps: float):
        self.eps = eps

    def meet(self, right: _Block, lefts: list) -> Iterator[pd.DataFrame]:
        for left, _ in lefts:
            low, width = _low_squares(left, right)
            near = _settled(low, width, left, right, self.eps) & (left.reps[:, None] < right.reps[None, :] if right is left else True)
            i, j = np.nonzero(near)
            found = {"src": left.reps[i], "dst": right.reps[j], "dist": _pair_distances(left.x, right.x, i, j)}
            one = pd.DataFrame({**found, "src_rows": left.sizes[i], "dst_rows": right.sizes[j]})
            yield pd.concat([one, one.set_axis(["dst", "src", "dist", "dst_rows", "src_rows"], axis=1)])

    def rest(self) -> Iterator[pd.DataFrame]:
        yield from ()


def range_neighbors(df: DataFrame, row_id: str, vec: str, eps: float, seed: int = 42) -> DataFrame:
    """Pairs of different vectors within ``eps``: ``(src, dst, dist, src_rows, dst_rows)``.

    Rows with the same vector are one point, named by the smallest id; ``*_rows`` says
    how many rows it stands for.
    """
    layout = _Layout(df, row_id, vec, seed=seed)
    pairs = layout.pairs_within(np.full(len(layout.pivots), float(eps)))

    schema = "src long, dst long, dist double, src_rows long, dst_rows long"
    return layout.meet(pairs, ["reps", "flat", "sizes"], partial(_Close, float(eps)), schema)
