"""Reports and the clustering run over the small tables."""

import pytest

from checks.registry import Tables
from checks.shared import clinical
from cohortry.plans.clustering_run import ClusteringSpec, run_clustering
from cohortry.plans.reports import compare_two, describe_groups


@pytest.fixture(scope="module")
def people(spark, sf):
    return clinical(Tables(spark, sf)).persist()


def test_compare_two_with_flag(people):
    found = compare_two(people, "number_drugs", "died_in_hospital", "gender_name")
    n = people.count()
    assert found["overview"].first()["total"] == n
    assert sum(r["n"] for r in found["boxes"].collect()) == n
    low, high = found["limits_v2"].first()
    assert (low, high) == (-0.05, 1.05)
    totals = found["totals"].first()
    assert totals["positives"] + totals["negatives"] == n


def test_compare_two_numbers(people):
    found = compare_two(people, "number_drugs", "number_interventions")
    assert sum(r["n"] for r in found["grid"].collect()) == people.count()
    assert found["max_cell"].first()[0] == max(r["n"] for r in found["grid"].collect())
    assert found["describe"].count() == 2 and "breakdown" not in found


def test_describe_groups(people):
    found = describe_groups(people, "gender_name")
    assert sum(r["n"] for r in found["sizes"].collect()) == people.count()
    assert found["numeric"].count() == 4 and found["flags"].count() == 24
    tests = {r["variable"]: r["p_value"] for r in found["tests"].collect()}
    assert {r["variable"] for r in found["significant"].collect()} == {v for v, p in tests.items() if p is not None and p < 0.05}


def test_clustering_run(people, spark):
    spec = ClusteringSpec(features="onehot", methods=("kmeans", "kprototypes", "dbscan", "ward"), ks=(2, 3), eps_values=(0.5, 50.0))
    found = run_clustering(people, spec)
    rows = found.comparison.collect()
    assert {"K-Means", "K-Prototypes", "Hierarchical (k-NN)"} <= {r["algorithm"] for r in rows}
    scores = [r["silhouette_score"] for r in rows]
    assert scores == sorted(scores, reverse=True)
    # Every radius leaves noise or a single cluster here, so no density result is kept.
    assert found.fits["DBSCAN"].labels is None
    profile = found.profiles["K-Means"].collect()
    assert sum(r["n"] for r in profile) == people.count()
    points, sizes, explained = found.maps["K-Means"]
    assert points.count() == people.count() and len(explained) == 2


def test_scatter_bins_share_one_grid(spark):
    from cohortry.plans.reports import scatter_bins

    rows = [("a", 0.0, 5.0), ("a", 0.1, 5.0), ("b", 10.0, 5.0), ("b", None, 5.0), (None, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {(r["g"], r["bin_x"], r["bin_y"]): (r["n"], r["mean_x"]) for r in scatter_bins(df, "x", "y", "g", bins=10).collect()}
    assert got == {("a", 0, 0): (2, pytest.approx(0.05)), ("b", 9, 0): (1, 10.0)}
    assert scatter_bins(df.limit(0), "x", "y", bins=10).count() == 0
