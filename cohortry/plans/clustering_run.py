"""The clustering run: impute, encode, fit every method, score, profile, compare."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from cohortry.operators.clustering import (
    CLUSTER_COUNTS,
    EPS_VALUES,
    Fit,
    at_once,
    dbscan_sweep,
    gmm_sweep,
    kmeans_sweep,
    kprototypes_sweep,
    ward_knn,
)
from cohortry.operators.evaluation import cluster_map, cluster_profile, compare_algorithms, evaluate
from cohortry.operators.features import feature_array, impute, numeric_feature_names, one_hot
from cohortry.plans.reports import DEATH_FLAGS, DEVICE_FLAGS, DRUG_FLAGS, NUMERIC, PROCEDURE_FLAGS

# Columns used by the run.
CATEGORICAL = ("race_name", "gender_name", "site_location", "ethnicity_name")


@dataclass
class ClusteringSpec:
    """What to run. ``features`` is ``numeric`` (numeric columns only) or ``onehot`` (with indicators)."""

    row_id: str = "person_id"
    features: str = "numeric"
    categorical: Sequence[str] = CATEGORICAL
    numeric: Sequence[str] = tuple(NUMERIC)
    flags: Sequence[str] = (*DRUG_FLAGS, *DEVICE_FLAGS, *PROCEDURE_FLAGS)
    labels: Sequence[str] = tuple(DEATH_FLAGS)
    methods: Sequence[str] = ("kmeans", "gmm_silhouette", "gmm_bic", "kprototypes", "ward")
    ks: Sequence[int] = CLUSTER_COUNTS
    eps_values: Sequence[float] = EPS_VALUES
    ward_clusters: int = 5
    k_nn: int = 10
    seed: int = 42


@dataclass
class ClusteringResult:
    comparison: DataFrame
    fits: dict[str, Fit] = field(default_factory=dict)
    profiles: dict[str, DataFrame] = field(default_factory=dict)
    maps: dict[str, tuple] = field(default_factory=dict)


def prepare_features(df: DataFrame, spec: ClusteringSpec) -> tuple[DataFrame, DataFrame]:
    """Imputed rows, and one standardised vector per row."""
    columns = [spec.row_id, *spec.categorical, *spec.numeric, *spec.flags, *spec.labels]
    clean = impute(df.select(*columns), spec.categorical, spec.numeric, [*spec.flags, *spec.labels])
    wide = one_hot(clean, spec.categorical) if spec.features == "onehot" else clean
    names = numeric_feature_names(wide, spec.row_id, spec.categorical)
    return clean, feature_array(wide, names, spec.row_id)


def run_clustering(df: DataFrame, spec: ClusteringSpec | None = None) -> ClusteringResult:
    """Fit the chosen methods on standardised features and compare them by silhouette."""
    spec = spec or ClusteringSpec()
    clean, vectors = prepare_features(df, spec)
    clean, vectors = clean.persist(StorageLevel.MEMORY_AND_DISK), vectors.persist(StorageLevel.MEMORY_AND_DISK)
    numeric = numeric_feature_names(clean, spec.row_id, spec.categorical)
    seed = spec.seed
    runs = {
        "kmeans": ("K-Means", lambda: kmeans_sweep(vectors, spec.row_id, "vec", spec.ks, seed)),
        "gmm_silhouette": (
            "Gaussian Mixture (silhouette)",
            lambda: gmm_sweep(vectors, spec.row_id, "vec", spec.ks, "silhouette", seed),
        ),
        "gmm_bic": ("Gaussian Mixture (BIC)", lambda: gmm_sweep(vectors, spec.row_id, "vec", spec.ks, "bic", seed)),
        "kprototypes": (
            "K-Prototypes",
            lambda: kprototypes_sweep(clean, spec.row_id, numeric, spec.categorical, spec.ks, seed=seed),
        ),
        "dbscan": ("DBSCAN", lambda: dbscan_sweep(vectors, spec.row_id, "vec", spec.eps_values, seed=seed)),
        "ward": (
            "Hierarchical (k-NN)",
            lambda: ward_knn(vectors, spec.row_id, "vec", spec.ward_clusters, spec.k_nn, seed=seed),
        ),
    }

    def one(method: str) -> tuple:
        """Name, fit, scores, profile and map; None for what there is not."""
        name, fit_it = runs[method]
        fit = fit_it()
        if fit.labels is None:
            return name, fit, None, None, None
        labels = fit.labels = fit.labels.checkpoint()
        scored = evaluate(vectors.join(labels, spec.row_id), "vec", "label", spec.row_id, name)
        if scored.isEmpty():
            return name, fit, scored, None, None
        labelled = clean.join(labels, spec.row_id)
        profile = cluster_profile(
            labelled, "label", spec.numeric, [*spec.labels, *spec.flags], ["race_name", "gender_name"]
        )
        return name, fit, scored, profile, cluster_map(labelled, "label", list(spec.numeric), spec.row_id)

    result = ClusteringResult(comparison=None)
    scores = []
    # Most of a method's time is that of many short jobs, so the methods run beside each other.
    for name, fit, scored, profile, mapped in at_once(one, spec.methods, df.sparkSession, len(spec.methods)):
        result.fits[name] = fit
        if scored is not None:
            scores.append(scored)
        if profile is not None:
            result.profiles[name], result.maps[name] = profile, mapped
    result.comparison = compare_algorithms(scores, df.sparkSession)
    vectors.unpersist()
    clean.unpersist()
    return result
