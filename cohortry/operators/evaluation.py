"""Scores, profiles and maps of a labelled set of vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expr import as_number
from cohortry.operators.features import as_array, standardize
from cohortry.operators.relational import mode_of, sized_broadcast, union_all

NOISE = -1
#: Cluster centres that are broadcast at most.
CENTRES = 10_000
#: Clusters a row is compared with at a time.
SLICE = 1_000


def squared_distance(a: str, b: str) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda total, x: total + x)


def _cluster_sums(df: DataFrame, vec: str, label: str) -> DataFrame:
    """``(label, n, total[], squares)``: all that squared distances to a whole cluster need."""
    stats = Summarizer.metrics("sum", "count").summary(array_to_vector("vec"))
    rows = df.select(F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    square = F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x)
    grouped = rows.groupBy("label").agg(stats.alias("s"), F.sum(square).alias("squares"))
    return grouped.select("label", F.col("s.count").cast("double").alias("n"), vector_to_array("s.sum").alias("total"), "squares")


def _against_clusters(df: DataFrame, vec: str, label: str, row_id: str) -> tuple[DataFrame, int]:
    """Every row against slices of the clusters: ``(id, label, vec, square, slice[])``, and the number of slices.

    A slice holds about ``SLICE`` clusters. With one slice, its single row is broadcast; with
    more, rows and slices meet on the slice's number.
    """
    sums = _cluster_sums(df, vec, label).checkpoint()
    slices = max(1, -(-sums.count() // SLICE))
    part = F.pmod(F.xxhash64("label"), F.lit(slices))
    sliced = sums.groupBy(part.alias("__slice")).agg(F.collect_list(F.struct("label", "n", "total", "squares")).alias("clusters"))
    rows = df.select(
        F.col(row_id).alias("id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec")
    ).withColumn("square", F.aggregate("vec", F.lit(0.0), lambda t, x: t + x * x))
    numbers = F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<bigint>")
    met = rows.withColumn("__slice", F.explode(numbers)).join(F.broadcast(sliced) if slices == 1 else sliced, "__slice")
    return met.drop("__slice"), slices


def _mean_square(cluster: Column) -> Column:
    """Mean squared distance of the row's vector to the rows of a cluster."""
    product = F.aggregate(F.zip_with("vec", cluster["total"], lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return F.greatest(F.col("square") + (cluster["squares"] - 2 * product) / cluster["n"], F.lit(0.0))


def cluster_distances(df: DataFrame, vec: str, label: str, row_id: str) -> DataFrame:
    """``(row_id, cluster, mean_squared_distance)``: every row against the rows of each cluster."""
    met, _ = _against_clusters(df, vec, label, row_id)
    each = F.transform(
        "clusters", lambda c: F.struct(c["label"].alias("cluster"), _mean_square(c).alias("mean_squared_distance"))
    )
    return met.select(F.col("id").alias(row_id), F.inline(each))


def silhouette(df: DataFrame, vec: str, label: str, row_id: str, self_in_mean: bool = True) -> DataFrame:
    """Mean silhouette of all rows, on squared Euclidean distances: one row ``silhouette_score``.

    A row's mean squared distance to a cluster follows from the cluster's size, sum and sum
    of squares, so the work is rows times clusters. ``self_in_mean`` divides the distance
    within the own cluster by its full size, the row itself included. Null with fewer than
    two clusters.
    """
    met, slices = _against_clusters(df, vec, label, row_id)
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("own"), none.alias("n"), none.alias("other"))

    def nearer(state: Column, c: Column) -> Column:
        gap, mine = _mean_square(c), c["label"] == F.col("label")
        return F.struct(
            F.when(mine, gap).otherwise(state["own"]).alias("own"),
            F.when(mine, c["n"]).otherwise(state["n"]).alias("n"),
            F.when(mine, state["other"]).otherwise(F.least(state["other"], gap)).alias("other"),
        )

    seen = met.select("id", F.aggregate("clusters", start, nearer).alias("s")).select("id", "s.*")
    if slices > 1:
        seen = seen.groupBy("id").agg(F.max("own").alias("own"), F.max("n").alias("n"), F.min("other").alias("other"))
    alone = F.col("n") <= (0 if self_in_mean else 1)
    own = F.col("own") if self_in_mean else F.col("own") * F.col("n") / (F.col("n") - 1)
    score = F.when(alone | (F.greatest(own, "other") == 0), 0.0).otherwise((F.col("other") - own) / F.greatest(own, "other"))
    return seen.agg(F.avg(F.when(F.col("other").isNotNull(), score)).alias("silhouette_score"))


def _cluster_moments(df: DataFrame, vec: str, label: str) -> DataFrame:
    """``(label, n, mean[], spread)`` where ``spread`` is the summed squared distance to the mean."""
    stats = Summarizer.metrics("mean", "variance", "count").summary(
        array_to_vector(F.col(vec).cast("array<double>"))
    )
    grouped = df.groupBy(F.col(label).alias("label")).agg(stats.alias("s"))
    variance = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda t, x: t + x)
    return grouped.select(
        "label",
        F.col("s.count").alias("n"),
        vector_to_array("s.mean").alias("mean"),
        (variance * (F.col("s.count") - 1)).alias("spread"),
    )


def calinski_harabasz(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Between- over within-cluster dispersion: one row ``calinski_harabasz_score``."""
    clusters = _cluster_moments(df, vec, label).checkpoint()
    parts = clusters.select("n", F.posexplode("mean").alias("dim", "m"))
    centre = parts.groupBy("dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("centre"))
    # One row per dimension, so the side is as wide as a vector.
    off = parts.join(F.broadcast(centre), "dim").agg(
        F.sum(F.col("n") * (F.col("m") - F.col("centre")) * (F.col("m") - F.col("centre"))).alias("between")
    )
    sizes = clusters.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("spread").alias("within"))
    total = sizes.join(F.broadcast(off))
    n, k = F.col("n"), F.col("k")
    score = F.try_divide(F.col("between") * (n - k), F.col("within") * (k - 1))
    return total.select(F.when(F.col("within") == 0, F.lit(1.0)).otherwise(score).alias("calinski_harabasz_score"))


def davies_bouldin(df: DataFrame, vec: str, label: str) -> DataFrame:
    """Mean worst ratio of summed scatter to centre distance: one row ``davies_bouldin_score``."""
    centres = sized_broadcast(_cluster_moments(df, vec, label).select("label", "mean"), CENTRES)
    points = df.select(F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    scatter = (
        points.join(centres, "label")
        .groupBy("label")
        .agg(F.avg(F.sqrt(squared_distance("vec", "mean"))).alias("scatter"))
    )
    summary = centres.join(scatter, "label").checkpoint()
    return _worst_partners(summary).agg(F.avg("worst").alias("davies_bouldin_score"))


def _worst_partners(summary: DataFrame) -> DataFrame:
    """``(label, worst)``: every cluster's largest ratio of summed scatter to centre distance.

    Clusters lie in slices of about ``SLICE`` along the coordinate in which their centres spread
    most. A cluster searches its own slice, then only those where the slice's largest scatter
    over the distance to its box can still exceed what was found. A partner with the same centre counts 0.
    """
    count, widest = summary.count(), F.lit(0)
    slices = max(1, -(-count // SLICE))
    if slices > 1:
        spread = summary.select(F.posexplode("mean").alias("dim", "m")).groupBy("dim").agg(F.variance("m").alias("v"))
        widest = F.lit(spread.agg(F.max_by("dim", "v")).first()[0])
        # As many cut points as slices, for one broadcast row.
        cuts = summary.agg(F.percentile_approx(F.get("mean", widest), [i / slices for i in range(1, slices)], 10 * SLICE).alias("__cuts"))
        placed = summary.join(F.broadcast(cuts)).withColumn("__slice", F.size(F.filter("__cuts", lambda c: c < F.get("mean", widest)))).drop("__cuts")
    else:
        placed = summary.withColumn("__slice", F.lit(0))
    placed = placed.checkpoint()
    lists = placed.groupBy("__slice").agg(F.collect_list(F.struct("label", "mean", "scatter")).alias("partners"))

    def ratio(other: Column) -> Column:
        gaps = F.zip_with("mean", other["mean"], lambda x, y: (x - y) * (x - y))
        gap = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda t, x: t + x))
        found = F.coalesce(F.try_divide(F.col("scatter") + other["scatter"], gap), F.lit(0.0))
        return F.when(other["label"] == F.col("label"), None).otherwise(found)

    def search(rows: DataFrame) -> DataFrame:
        met = rows.join(lists, "__slice")
        return met.select("label", F.array_max(F.transform("partners", ratio)).alias("worst"))

    first = search(placed)
    if slices > 1:
        first = first.checkpoint()
        axes = F.sequence(F.lit(0), F.size(F.col("partners")[0]["mean"]) - 1)

        def edge(pick) -> Column:
            return F.transform(axes, lambda d: pick(F.transform("partners", lambda p: F.get(p["mean"], d))))

        boxes = lists.select(
            "__slice", edge(F.array_min).alias("low"), edge(F.array_max).alias("high"),
            F.array_max(F.transform("partners", lambda p: p["scatter"])).alias("most"),
        )
        outside = F.zip_with(
            F.zip_with("low", "mean", lambda a, b: F.greatest(a - b, F.lit(0.0))),
            F.zip_with("mean", "high", lambda a, b: F.greatest(a - b, F.lit(0.0))),
            lambda a, b: F.greatest(a, b),
        )
        away = F.sqrt(F.aggregate(outside, F.lit(0.0), lambda t, x: t + x * x))
        hope = (F.col("scatter") + F.col("most")) * (1 + 1e-9) >= F.coalesce("worst", F.lit(0.0)) * away
        numbers = F.sequence(F.lit(0), F.lit(slices - 1))
        rest = placed.join(first, "label").withColumnRenamed("__slice", "__own").withColumn("__slice", F.explode(numbers))
        open_slices = rest.where("__slice <> __own").join(boxes, "__slice").where(hope)
        first = first.unionByName(search(open_slices.select("label", "mean", "scatter", "__slice")))
    return first.groupBy("label").agg(F.max("worst").alias("worst"))


EVALUATION_SCHEMA = (
    "algorithm string, n_clusters long, silhouette_score double, "
    "calinski_harabasz_score double, davies_bouldin_score double"
)


def evaluate(df: DataFrame, vec: str, label: str, row_id: str, name: str) -> DataFrame:
    """One row with the number of clusters and the three scores.

    Noise is left out first; no row if fewer than two clusters remain.
    """
    kept = df.where(F.col(label).isNotNull() & (F.col(label) != NOISE))
    n = kept.agg(F.count_distinct(label)).first()[0]
    if n < 2:
        return df.sparkSession.createDataFrame([], EVALUATION_SCHEMA)
    scores = [
        silhouette(kept, vec, label, row_id).first()[0],
        calinski_harabasz(kept, vec, label).first()[0],
        davies_bouldin(kept, vec, label).first()[0],
    ]
    return df.sparkSession.createDataFrame([(name, n, *scores)], EVALUATION_SCHEMA)


def compare_algorithms(evaluations: Sequence[DataFrame], spark) -> DataFrame:
    """Evaluation rows, best silhouette first."""
    frames = list(evaluations)
    empty = spark.createDataFrame([], EVALUATION_SCHEMA)
    return union_all(frames, spark, empty.schema).orderBy(F.desc_nulls_last("silhouette_score"), "algorithm")


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))


def cluster_profile(
    df: DataFrame, label: str, numeric: Sequence[str], flags: Sequence[str], categorical: Sequence[str]
) -> DataFrame:
    """Per cluster: size, mean and std, flag rates, most frequent category. Noise is skipped."""
    rows = df.where(F.col(label).isNotNull() & (F.col(label) != NOISE)).withColumnRenamed(label, "cluster")
    basic = rows.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(F.col(c).cast("double")).alias(f"{c}_mean") for c in numeric],
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"{c}_std") for c in numeric],
        *[F.avg(as_number(c)).alias(f"{c}_rate") for c in flags],
    )
    if not categorical:
        return basic
    modes = mode_of(rows, categorical, ["cluster"])
    wide = modes.groupBy("cluster").agg(
        *[F.max(F.when(F.col("variable") == c, F.col("mode"))).alias(f"{c}_mode") for c in categorical]
    )
    return basic.join(wide, "cluster", "left")


def pca2(df: DataFrame, columns: Sequence[str], row_id: str) -> tuple[DataFrame, list[float]]:
    """``(row_id, pc1, pc2)`` of the standardised columns, and the explained variance ratios.

    The sign of a component is arbitrary.
    """
    scaled = standardize(df, columns).select(row_id, array_to_vector(as_array(columns)).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="pc").fit(scaled)
    parts = vector_to_array("pc")
    mapped = model.transform(scaled).select(row_id, parts[0].alias("pc1"), parts[1].alias("pc2"))
    return mapped, [float(v) for v in model.explainedVariance]


def cluster_map(
    df: DataFrame, label: str, columns: Sequence[str], row_id: str
) -> tuple[DataFrame, DataFrame, list[float]]:
    """Points in two dimensions with their cluster, cluster sizes, and explained variance."""
    mapped, explained = pca2(df, columns, row_id)
    points = mapped.join(df.select(row_id, F.col(label).alias("cluster")), row_id)
    return points, cluster_sizes(df, label), explained
