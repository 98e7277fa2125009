"""Neighbour joins and clusterings against brute force, with copies and crowded cells."""

from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.operators import clustering as K
from cohortry.operators import evaluation as V
from cohortry.operators import neighbors as N
from cohortry.operators import relational as R


def _frame(spark, x, parts=4):
    pdf = pd.DataFrame({"id": np.arange(len(x)), "vec": [list(map(float, r)) for r in x]})
    return spark.createDataFrame(pdf).repartition(parts)


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(c, 0.4, (60, 3)) for c in ((0, 0, 0), (6, 0, 0), (0, 6, 3))])
    x[100:160] = x[100]  # a third of the rows is one vector
    return x


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)


def _brute(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))


@pytest.mark.parametrize("k", [1, 5])
def test_knn_equals_brute_force(spark, points, small_blocks, k):
    got = {}
    for r in N.knn_graph(_frame(spark, points), "id", "vec", k).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"], r["dist"]))
    dist = _brute(points)
    for i in range(len(points)):
        order = sorted((dist[i, j], j) for j in range(len(points)) if j != i)[:k]
        mine = sorted(got[i])
        assert [d for _, d, _ in mine] == [j for _, j in order]
        assert [d for _, _, d in mine] == pytest.approx([d for d, _ in order])


def test_knn_with_fewer_rows_than_k(spark):
    got = N.knn_graph(_frame(spark, np.array([[0.0, 0], [1, 0], [3, 0]])), "id", "vec", 10).collect()
    assert sorted((r["src"], r["dst"]) for r in got) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]


def test_range_join_equals_brute_force(spark, points, small_blocks):
    eps = 0.6
    got = {(r["src"], r["dst"]): (r["src_rows"], r["dst_rows"]) for r in N.range_neighbors(_frame(spark, points), "id", "vec", eps).collect()}
    _, first, counts = np.unique(points, axis=0, return_index=True, return_counts=True)
    rows = dict(zip(first, counts, strict=True))
    dist = _brute(points)
    want = {(i, j): (rows[i], rows[j]) for i in rows for j in rows if i != j and dist[i, j] <= eps}
    assert got == want


def _dbscan_brute(x, eps, min_points):
    near = _brute(x) <= eps
    core = near.sum(1) >= min_points
    label = np.full(len(x), -1)
    for i in np.flatnonzero(core):
        if label[i] != -1:
            continue
        label[i], stack = i, [i]
        while stack:
            for q in np.flatnonzero(near[stack.pop()] & core):
                if label[q] == -1:
                    label[q] = i
                    stack.append(q)
    for p in np.flatnonzero(~core):
        found = label[near[p] & core]
        label[p] = found.min() if len(found) else -1
    return label


@pytest.mark.parametrize("eps", [0.25, 0.45])
def test_dbscan_equals_brute_force(spark, points, small_blocks, eps):
    x = np.vstack([points, [[30.0, 30, 30]]])
    for parts in (1, 5):  # independent of the order of rows
        got = {r["id"]: r["label"] for r in K.dbscan(_frame(spark, x, parts), "id", "vec", eps, 5).labels.collect()}
        assert [got[i] for i in range(len(x))] == _dbscan_brute(x, eps, 5).tolist()


@pytest.mark.parametrize("local_edges", [0, 10**6])
def test_components(spark, local_edges):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(20)] + [(50, int(j)) for j in range(51, 80)] + [(90, 90)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in K.connected_components(df, local_edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{j: 50 for j in range(50, 80)}, 90: 90}


def test_components_with_hubs_spread(spark, monkeypatch):
    """Edges of heavy nodes take the other path of the join; nothing else changes."""
    monkeypatch.setattr(R, "HEAVY_ROWS", 3)
    rng = np.random.default_rng(8)
    pairs = [(0, i) for i in range(1, 60)] + [(200 + i, 200 + i + 1) for i in range(20)] + [(90, 300), (90, 301), (90, 302), (90, 59)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in pairs], "a long, b long")
    got = {r["node"]: r["root"] for r in K.connected_components(df, 0).collect()}
    assert got == {n: (200 if 200 <= n < 221 else 0) for p in pairs for n in map(int, p)}


def test_heavy_join_keeps_every_row(spark, monkeypatch):
    monkeypatch.setattr(R, "HEAVY_ROWS", 3)
    df = spark.createDataFrame([(1, i) for i in range(10)] + [(2, 0), (3, 1), (3, 2)], "k int, v int")
    low = df.groupBy("k").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    got = sorted(tuple(r) for r in R.join_heavy(df, low, "k", "n", "v", 13).collect())
    assert got == [(1, i, 0) for i in range(10)] + [(2, 0, 0), (3, 1, 1), (3, 2, 1)]
    # The rows of a heavy key meet the shuffle with many values of its second key.
    plan = R.join_heavy(df, low, "k", "n", "v", 13)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(k" in plan


def _ward_brute(x, k):
    clusters = {i: [i] for i in range(len(x))}
    while len(clusters) > k:
        best = None
        ids = sorted(clusters)
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                ca, cb = x[clusters[a]].mean(0), x[clusters[b]].mean(0)
                na, nb = len(clusters[a]), len(clusters[b])
                cost = na * nb / (na + nb) * ((ca - cb) ** 2).sum()
                if best is None or cost < best[0]:
                    best = (cost, a, b)
        clusters[best[1]] += clusters.pop(best[2])
    label = np.empty(len(x), dtype=int)
    for n, a in enumerate(sorted(clusters, key=lambda c: min(clusters[c]))):
        label[clusters[a]] = n
    return label


@pytest.mark.parametrize("local_clusters", [12, 1000])
def test_ward_on_full_graph_is_greedy_ward(spark, local_clusters):
    x = np.random.default_rng(4).normal(size=(40, 2))
    full = spark.createDataFrame([(i, j) for i in range(40) for j in range(i)], "a long, b long")
    fit = K.ward_knn(_frame(spark, x), "id", "vec", 4, edges=full, local_clusters=local_clusters)
    got = {r["id"]: r["label"] for r in fit.labels.collect()}
    assert [got[i] for i in range(40)] == _ward_brute(x, 4).tolist()


def test_ward_joins_unconnected_parts(spark, points):
    fit = K.ward_knn(_frame(spark, points), "id", "vec", 3, k_nn=4)
    got = {r["id"]: r["label"] for r in fit.labels.collect()}
    assert len({got[i] for i in range(60)}) == 1 and len(set(got.values())) == 3


def test_kmeans_and_mixture_find_blobs(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 5), (0, 8))])
    df = _frame(spark, x)
    truth = np.repeat([0, 1, 2], 40)
    sweep = K.kmeans_sweep(df, "id", "vec", ks=(2, 3, 4))
    assert sweep.parameter == 3
    for labels in (sweep.labels, K.gmm(df, "id", "vec", 3).labels):
        got = {r["id"]: r["label"] for r in labels.collect()}
        assert len({(truth[i], got[i]) for i in range(120)}) == 3
    assert K.gmm_sweep(df, "id", "vec", ks=(2, 3)).parameter == 3
    assert K.gmm_parameters(3, 2) == 17


def test_kprototypes(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": np.arange(90), "x": np.repeat([0.0, 10, 20], 30) + rng.normal(0, 0.3, 90), "c": np.repeat(["u", "v", "w"], 30)})
    df = spark.createDataFrame(pdf)
    fit = K.kprototypes_sweep(df, "id", ["x"], ["c"], ks=(2, 3))
    assert fit.parameter == 3
    got = {r["id"]: r["label"] for r in fit.labels.collect()}
    assert all(len({got[i] for i in range(s, s + 30)}) == 1 for s in (0, 30, 60))


def test_kprototypes_sweep_advances_all_k_together(spark):
    """The fits are those of every k by itself, and six of them start no more than twice the jobs of one."""
    rng = np.random.default_rng(1)
    rows = [
        (i, float(rng.integers(0, 12)), float(rng.integers(20, 60)), None if i % 13 == 0 else "abcde"[int(rng.integers(0, 5))], "xyz"[int(rng.integers(0, 3))])
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "id long, n double, m double, c string, d string").repartition(3)
    tracker = spark.sparkContext.statusTracker()

    def counted(group: str, work):
        spark.sparkContext.setJobGroup(group, group)
        try:
            return work(), len(tracker.getJobIdsForGroup(group))
        finally:
            spark.sparkContext._jsc.clearJobGroup()

    alone = [counted(f"alone-{k}", lambda k=k: K.kprototypes(df, "id", ["n", "m"], ["c", "d"], k)) for k in range(2, 8)]
    fit, jobs = counted("sweep", lambda: K.kprototypes_sweep(df, "id", ["n", "m"], ["c", "d"], range(2, 8)))
    assert [s["cost"] for s in fit.scores] == pytest.approx([f.info["cost"] for f, _ in alone])
    assert jobs <= 2 * max(n for _, n in alone)


def test_kprototypes_ends_with_plain_python_s_steps(spark):
    """Costs of every step, with an unknown category and repeated ids, against a loop over rows."""
    rng = np.random.default_rng(5)
    rows = [(int(i % 90), float(rng.integers(0, 9)), "ab"[int(rng.integers(0, 2))] if i % 7 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, n double, c string").repartition(4)
    fit = K.kprototypes(df, "id", ["n"], ["c"], 3, gamma=2.0)
    begun = K.kprototypes(df, "id", ["n"], ["c"], 3, gamma=2.0, max_iter=0).info["centres"]
    centres, trace = [(n["n"], c["c"]) for n, c in begun], []
    while len(trace) < 2 or trace[-1] < trace[-2] - 1e-12:
        prices = [[(x - n) ** 2 + (2.0 if c != w else 0.0) for n, w in centres] for _, x, c in rows]
        own = [p.index(min(p)) for p in prices]
        trace.append(sum(map(min, prices)))
        for j in range(3):
            mine = [r for r, o in zip(rows, own) if o == j]
            words = [c for _, _, c in mine if c is not None]
            centres[j] = (np.mean([x for _, x, _ in mine]), max(sorted(set(words)), key=words.count) if words else centres[j][1])
    assert fit.info["trace"] == pytest.approx([*trace, trace[-1]])
    assert fit.labels.count() == 120


def test_silhouette_forms(spark):
    x = np.array([[0.0], [1.0], [10.0], [12.0], [30.0]])
    label = [0, 0, 1, 1, 2]
    df = _frame(spark, x).join(spark.createDataFrame(list(enumerate(label)), "id long, label int"), "id")
    dist, want = _brute(x) ** 2, {True: [], False: []}
    for i, own in enumerate(label):
        mine = [dist[i, j] for j in range(5) if label[j] == own]
        b = min(np.mean([dist[i, j] for j in range(5) if label[j] == c]) for c in set(label) - {own})
        want[True].append((b - np.mean(mine)) / max(b, np.mean(mine)))
        a = sum(mine) / (len(mine) - 1) if len(mine) > 1 else None
        want[False].append(0 if a is None else (b - a) / max(a, b))
    for form in (True, False):
        got = V.silhouette(df, "vec", "label", "id", self_in_mean=form).first()[0]
        assert got == pytest.approx(np.mean(want[form]))
    assert V.silhouette(df.withColumn("label", F.lit(1)), "vec", "label", "id").first()[0] is None


def test_silhouette_uses_every_row_and_any_number_of_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(3_500, 2)), rng.integers(0, 9, 3_500)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, label, strict=True))]
    df = spark.createDataFrame(rows, "id long, vec array<double>, label int")
    square = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    means = np.array([square[:, label == c].mean(axis=1) for c in range(9)]).T
    own = means[np.arange(len(x)), label]
    means[np.arange(len(x)), label] = np.inf
    other = means.min(axis=1)
    want = ((other - own) / np.maximum(own, other)).mean()
    for slice_size in (1_000, 4):
        monkeypatch.setattr(V, "SLICE", slice_size)
        assert V.silhouette(df, "vec", "label", "id").first()[0] == pytest.approx(want)


def test_restarts_take_the_cheapest_fit(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (1, 0), (0, 9), (1, 9), (50, 0), (51, 0))])
    costs = [K.kmeans(_frame(spark, x), "id", "vec", 6, seed=42 + i, n_init=1).info["inertia"] for i in range(4)]
    assert K.kmeans(_frame(spark, x), "id", "vec", 6, n_init=4).info["inertia"] == pytest.approx(min(costs))


def test_evaluation_leaves_noise_out(spark, points):
    labels = spark.createDataFrame([(i, -1 if i == 0 else int(i >= 60)) for i in range(180)], "id long, label int")
    df = _frame(spark, points).join(labels, "id")
    assert V.evaluate(df, "vec", "label", "id", "x").first()["n_clusters"] == 2
    assert V.evaluate(df.where("label < 1"), "vec", "label", "id", "x").count() == 0


def test_models_advance_alike_alone_and_together(spark):
    """A sweep's models are those of single fits, and sums added up by Spark or on the driver agree."""
    from cohortry.operators import batched_models as B

    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.5, (60, 3)) for c in (0, 4, 9)])
    df = _frame(spark, x).repartition(3)
    whole = K.kmeans_sweep(df, "id", "vec", ks=(2, 3, 5), n_init=2)
    for m in whole.info["models"]:
        assert K.kmeans(df, "id", "vec", m.k, n_init=2).info["inertia"] == pytest.approx(m.cost)
    limit, B.DRIVER_VALUES = B.DRIVER_VALUES, 0
    try:
        added = K.kmeans_sweep(df, "id", "vec", ks=(2, 3, 5), n_init=2)
    finally:
        B.DRIVER_VALUES = limit
    assert [s["inertia"] for s in added.scores] == pytest.approx([s["inertia"] for s in whole.scores])
    assert [s["silhouette"] for s in added.scores] == pytest.approx([s["silhouette"] for s in whole.scores])


def test_mixture_is_expectation_maximisation(spark):
    """The course of the log-likelihood is that of plain EM from the same means; labels are the likeliest components."""
    from cohortry.operators import batched_models as B

    rng = np.random.default_rng(6)
    x = np.vstack([rng.multivariate_normal(m, s, 80) for m, s in (((0, 0), ((1, 0.8), (0.8, 1))), ((4, 1), ((0.3, 0), (0, 2))))])
    blocks = B.Blocks(_frame(spark, x), "vec")
    begun = np.array([[0.0, 1.0], [3.0, 0.0]])
    fit = B.mixtures(blocks, [begun], [2], 12, 0.0)[0]
    mean, cov, weight, trace = begun.copy(), np.stack([np.eye(2)] * 2), np.array([0.5, 0.5]), []
    for _ in range(13):
        density = np.stack([w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / np.sqrt(np.linalg.det(c)) / (2 * np.pi)
                            for w, m, c in zip(weight, mean, cov, strict=True)], axis=1)
        trace.append(np.log(density.sum(axis=1)).sum())
        share = density / density.sum(axis=1, keepdims=True)
        n = share.sum(axis=0)
        weight, mean = n / n.sum(), (share.T @ x) / n[:, None]
        cov = np.stack([((x - mean[j]).T * share[:, j]) @ (x - mean[j]) / n[j] + B.RIDGE * np.eye(2) for j in range(2)])
    assert fit.trace == pytest.approx(trace)
    assert all(b >= a - 1e-9 for a, b in zip(fit.trace, fit.trace[1:]))


def test_more_centres_than_different_rows(spark):
    fit = K.kmeans(_frame(spark, np.array([[0.0], [0.0], [1.0], [1.0]])), "id", "vec", 5)
    assert fit.info["inertia"] == 0 and {r["label"] for r in fit.labels.collect()} == {0, 1}


def test_huang_start_spreads_over_frequent_categories(spark):
    """Three frequent combinations and many rare ones: the start takes the frequent ones, a hashed start need not."""
    rows = [(i, 0.0, "abc"[i % 3], "xyz"[i % 3]) for i in range(300)] + [(300 + i, 0.0, f"r{i}", f"s{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, n double, c string, d string")
    costs = [K.kprototypes(df, "id", ["n"], ["c", "d"], 3, gamma=1.0, seed=s, start="hashed").info["cost"] for s in range(4)]
    huang = [K.kprototypes(df, "id", ["n"], ["c", "d"], 3, gamma=1.0, seed=s).info["cost"] for s in range(4)]
    assert set(huang) == {80.0} and max(costs) > 80.0
    with pytest.raises(ValueError):
        K.kprototypes(df.where("id < 300"), "id", ["n"], ["c", "d"], 4)


# --- blocks that meet once ---------------------------------------------------------------


def test_points_on_one_radius_stay_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    monkeypatch.setattr(N, "MAX_PIVOTS", 1)
    angle = np.linspace(0, 2 * np.pi, 500, endpoint=False)
    x = np.vstack([np.zeros((1, 2)), np.stack([np.cos(angle), np.sin(angle)], axis=1)])
    layout = N._Layout(_frame(spark, x), "id", "vec")
    sizes = [r["points"] for r in layout.blocks.select("points").collect()]
    assert sum(sizes) == 501 and max(sizes) <= 3 * 16


def test_pairs_of_blocks_are_met_once_and_pruned(spark, small_blocks):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(c, 0.3, (80, 4)) for c in (0, 10, 20, 30)])
    layout = N._Layout(_frame(spark, x), "id", "vec")
    pairs = layout.pairs_within(np.full(len(layout.pivots), 0.5)).collect()
    seen = [tuple(sorted((r["block"], r["block2"]))) for r in pairs]
    assert len(seen) == len(set(seen))
    assert sum(r["cost"] for r in pairs) < 320 * 320 / 4


def test_separate_groups_settle_in_their_own_block(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 64)
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, (30, 5)) for c in range(0, 100, 10)])
    work = N.knn_work(_frame(spark, x), "id", "vec", 3).first()
    assert work["points"] == 300 and work["possible"] == 300 * 299 // 2
    assert work["settled"] > 0 and work["compared"] < work["possible"] / 4


def test_density_clustering_counts_tight_blocks_without_distances(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(c, 0.05, (60, 3)) for c in (0, 8, 16)])
    fit = K.dbscan(_frame(spark, x), "id", "vec", 2.0, 5)
    got = {r["id"]: r["label"] for r in fit.labels.collect()}
    assert [got[i] for i in range(180)] == [60 * (i // 60) for i in range(180)]
    assert fit.info["counted"] > fit.info["measured"]


def test_border_rows_on_either_side_of_a_pair(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rng = np.random.default_rng(6)
    x = np.round(rng.uniform(0, 4, (120, 2)), 2)
    for eps in (0.3, 0.45):
        got = {r["id"]: r["label"] for r in K.dbscan(_frame(spark, x), "id", "vec", eps, 5).labels.collect()}
        assert [got[i] for i in range(120)] == list(_dbscan_brute(x, eps, 5))


def test_worst_partners_over_many_slices(spark, monkeypatch):
    rng = np.random.default_rng(8)
    mean, scatter = rng.normal(0, 5, (60, 3)), rng.uniform(0.1, 2, 60)
    mean[7] = mean[8]  # two clusters on one centre
    rows = [(i, list(map(float, m)), float(s)) for i, (m, s) in enumerate(zip(mean, scatter, strict=True))]
    summary = spark.createDataFrame(rows, "label long, mean array<double>, scatter double")
    gap = _brute(mean)
    with np.errstate(divide="ignore"):
        ratio = np.where(gap > 0, (scatter[:, None] + scatter[None, :]) / gap, 0)
    for size in (1000, 7):
        monkeypatch.setattr(V, "SLICE", size)
        found = V._worst_partners(summary)
        got = {r["label"]: r["worst"] for r in found.collect()}
        assert [got[i] for i in range(60)] == pytest.approx(ratio.max(axis=1).tolist())
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_component_rounds_do_not_pile_up_size_estimates(spark):
    """A round joins the last one's result with itself; its estimate must come from the rows, not from all rounds."""
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = K.connected_components(path, local_edges=10)
    size = str(roots._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    assert len(size) < 15
    assert roots.agg(F.count(F.lit(1)), F.max("root")).first()[:] == (301, 0)


def test_ward_centres_count_every_row_of_a_repeated_id(spark):
    """Row 0 stands there three times: its cluster with row 1 has its centre at 1/4, whatever order the rows come in."""
    rows = [(0, [0.0]), (0, [0.0]), (0, [0.0]), (1, [1.0]), (2, [3.0])]
    links = spark.createDataFrame([(0, 1), (1, 2)], "a long, b long")
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "id long, vec array<double>").coalesce(1)
        tree = K.ward_knn(df, "id", "vec", 1, edges=links, local_clusters=4).info["tree"]
        assert tree.orderBy(F.desc("cost")).first()["cost"] == pytest.approx(4 * 1 / 5 * 2.75**2)


# --- groups of blocks ---------------------------------------------------------------


def test_a_block_is_sent_once_a_group_and_not_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "GROUPS", 4)
    x = np.random.default_rng(8).normal(0, 1, (600, 3))
    layout = N._Layout(_frame(spark, x), "id", "vec")
    pairs = layout.pairs_within(np.full(len(layout.pivots), 100.0))  # every block meets every other

    class Calls:
        def meet(self, right, lefts):
            yield pd.DataFrame({"block": [right.block], "pairs": [len(lefts)], "held": [len({left.block for left, _ in lefts})]})

        def rest(self):
            yield from ()

    seen = layout.meet(pairs, ["reps", "flat"], Calls, "block string, pairs long, held long").toPandas()
    blocks = layout.blocks.count()
    assert blocks > 60 and seen["pairs"].sum() == pairs.count() == blocks * (blocks + 1) // 2
    # One call for each group that a block meets as the second one: its own and, over all blocks, half of the others.
    assert seen.groupby("block").size().max() <= 5 and len(seen) <= blocks * 3.5


def test_links_of_many_radii_are_those_of_each(spark, points, small_blocks):
    radii = [0.45, 0.25, 3.0]
    layout = N._Layout(_frame(spark, points), "id", "vec")
    links, _ = K._density_links(layout, radii, 5)
    for e, eps in enumerate(radii):
        found = K._density_labels(_frame(spark, points), "id", "vec", layout, links.where(F.col("e") == e)).collect()
        got = {r["id"]: r["label"] for r in found}
        assert [got[i] for i in range(len(points))] == _dbscan_brute(points, eps, 5).tolist()


def test_links_of_core_points_do_not_grow_with_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "GROUPS", 2)
    x = np.random.default_rng(9).normal(0, 1, (800, 3))
    layout = N._Layout(_frame(spark, x), "id", "vec")
    links, pairs = K._density_links(layout, [2.5], 5)
    assert pairs.count() > 2_000 and links.where("core").count() < 10 * len(x)


def _block(name, x, centre=0.0, **more):
    given = {"reps": np.arange(len(x)), "flat": x.ravel(), "sizes": np.ones(len(x), dtype=int)} | more
    return N._Block(SimpleNamespace(block=name, **given), np.full(x.shape[1], centre))


@pytest.mark.parametrize("scale, offset", [(1, 0), (1e-25, 0), (1e20, 0), (1, 1e6), (1, np.nan)])
def test_low_squares_bound_the_distances_at_any_scale(scale, offset):
    rng = np.random.default_rng(12)
    a, b = (_block(n, rng.normal(0, 1, (50, 8)) * scale + (0 if np.isnan(offset) else offset), offset or 0.0) for n in "ab")
    if np.isnan(offset):
        a.x[3, 2] = offset
    dist = N._distances(a.x, b.x)
    low, width = N._low_squares(a, b)
    some = ~np.isnan(dist)
    assert (low[some] <= dist[some] ** 2 * (1 + 1e-6) + 1e-30).all() and (dist[some] ** 2 <= (low[some].astype(float) + width) * (1 + 1e-6)).all()
    for q in (0.1, 0.5):
        eps = float(np.nanquantile(dist, q))
        assert (N._settled(low, width, a, b, eps) == (dist <= eps)).all()


@pytest.mark.parametrize("scale, offset", [(1e20, 0), (1, 1e7)])
def test_knn_far_from_the_origin(spark, points, small_blocks, scale, offset):
    x = np.round(points, 3) * scale + offset
    dist = _brute(x)
    got = {}
    for r in N.knn_graph(_frame(spark, x), "id", "vec", 4).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    for i in range(len(x)):
        assert [d for _, d in sorted(got[i])] == [j for _, j in sorted((dist[i, j], j) for j in range(len(x)) if j != i)[:4]]


def test_neighbour_lists_are_one_row_a_block(spark, points, small_blocks, monkeypatch):
    """A task answers with one row for a block, not one for every neighbour it found."""
    seen = []
    meet = N._Layout.meet

    def counted(self, *args):
        found = meet(self, *args)
        seen.append((found.groupBy("block").count().agg(F.max("count")).first()[0], self.blocks.count()))
        return found

    monkeypatch.setattr(N._Layout, "meet", counted)
    assert N.knn_graph(_frame(spark, points), "id", "vec", 5).count() == 5 * len(points)
    assert len(seen) == 2 and all(most <= N.GROUPS + N.SLICES for most, _ in seen)


def test_settled_points_are_not_measured_again(monkeypatch):
    """Points that are core, and core points that are connected, need no further distances."""
    calls = []
    monkeypatch.setattr(K, "_low_squares", lambda *a: calls.append(1) or N._low_squares(*a))
    x = np.random.default_rng(3).normal(0, 0.1, (20, 3))
    mark = {"cores": np.arange(60), "core_radius": np.zeros(60), "is_core": np.ones(60, dtype=bool)}
    blocks = [_block(str(i), x + 0.01 * i, reps=np.arange(20 * i, 20 * i + 20), **mark) for i in range(3)]
    for work in (K._Counts([5.0], 5), K._Links([5.0])):
        calls.clear()
        frames = [*work.meet(blocks[0], [(blocks[0], 9.0)]), *work.meet(blocks[1], [(blocks[0], 9.0), (blocks[1], 9.0)])]
        first = len(calls)
        frames += [*work.meet(blocks[2], [(blocks[0], 9.0), (blocks[1], 9.0)]), *work.rest()]
        assert first <= 3 and len(calls) == first + 1
        got = pd.concat(frames)
        if "near" in got:
            assert (got.groupby("rep")["near"].sum() >= 5).all() and got["rep"].nunique() == 60
        else:
            links = got[got["core"]]
            nodes, roots = K._local_components(links["a"].to_numpy(), links["b"].to_numpy())
            assert len(nodes) == 60 and (roots == 0).all()


@pytest.mark.parametrize("kind", ["normal", "grid", "parts"])
def test_ward_rounds_on_the_driver_are_those_on_executors(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    x = {"normal": rng.normal(0, 1, (90, 3)), "grid": rng.integers(0, 4, (90, 2)).astype(float), "parts": np.repeat(rng.normal(0, 1, (12, 2)), 8, axis=0)}[kind]
    stored, found = [], []
    settle = K.settle
    monkeypatch.setattr(K, "settle", lambda df: stored.append(1) or settle(df))
    for most in (K.LOCAL_VALUES, 0):
        monkeypatch.setattr(K, "LOCAL_VALUES", most)
        stored.clear()
        fit = K.ward_knn(_frame(spark, x), "id", "vec", 4, k_nn=4, local_clusters=3)
        found.append((sorted(map(tuple, fit.info["tree"].collect())), sorted(map(tuple, fit.labels.collect())), len(stored)))
    assert found[0][:2] == found[1][:2] and len(found[0][1]) == len(x)
    assert found[0][2] < found[1][2] / 2
