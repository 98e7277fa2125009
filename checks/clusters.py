"""Neighbours, features, clusterings, scores."""

from functools import reduce

from pyspark.sql import functions as F

from checks.registry import Tables, check
from checks.shared import clinical, vectors
from cohortry.operators import clustering as K
from cohortry.operators import evaluation as V
from cohortry.operators import features as Q
from cohortry.operators.batched_models import assign
from cohortry.operators.neighbors import knn_graph, range_neighbors
from cohortry.plans.clustering_run import CATEGORICAL, ClusteringSpec, prepare_features, run_clustering
from cohortry.plans.reports import BINARY, DRUG_FLAGS, NUMERIC

_DIST = "list_distance(a.e, b.e)"


@check(
    "j17_knn_exact",
    f"""SELECT src, dst, ROUND(dist, 4) AS dist, CAST(rn AS INT) AS rank FROM (
          SELECT a.vec_id AS src, b.vec_id AS dst, {_DIST} AS dist,
            row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DIST}, b.vec_id) AS rn
          FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id) t WHERE rn <= 10""",
)
def _(t: Tables):
    return knn_graph(vectors(t), "vec_id", "vec", 10).withColumn("dist", F.round("dist", 4))


@check(
    "j18_cluster_distances",
    f"""SELECT a.vec_id, b.label AS cluster, ROUND(AVG(power({_DIST}, 2)), 4) AS mean_squared_distance
        FROM vecs a CROSS JOIN (SELECT label, list(e) AS all_e, COUNT(*) AS n FROM vecs GROUP BY 1) g
        JOIN vecs b ON b.label = g.label GROUP BY 1, 2""",
)
def _(t: Tables):
    found = V.cluster_distances(vectors(t), "vec", "label", "vec_id")
    return found.withColumn("mean_squared_distance", F.round("mean_squared_distance", 4))


_EPS = 1.2


@check(
    "j19_range_join",
    f"""WITH u AS (SELECT MIN(vec_id) AS id, COUNT(*) AS n, e FROM vecs GROUP BY e)
        SELECT a.id AS src, b.id AS dst, ROUND({_DIST}, 4) AS dist, a.n AS src_rows, b.n AS dst_rows
        FROM u a JOIN u b ON a.id <> b.id WHERE {_DIST} <= {_EPS}""",
)
def _(t: Tables):
    return range_neighbors(vectors(t), "vec_id", "vec", _EPS).withColumn("dist", F.round("dist", 4))


# --- features ---------------------------------------------------------------


@check(
    "m1_impute",
    """WITH mode_site AS (SELECT CAST(care_site_id AS VARCHAR) AS m FROM person WHERE care_site_id IS NOT NULL
         GROUP BY care_site_id ORDER BY COUNT(*) DESC, CAST(care_site_id AS VARCHAR) LIMIT 1),
       med AS (SELECT quantile_cont(provider_id, 0.5) AS m FROM person)
       SELECT person_id, COALESCE(CAST(care_site_id AS VARCHAR), (SELECT m FROM mode_site)) AS site,
         COALESCE(provider_id::DOUBLE, (SELECT m FROM med)) AS provider_id,
         COALESCE(CASE WHEN race_concept_id = 9000 THEN 1 END, 0) AS flag FROM person""",
)
def _(t: Tables):
    rows = t.person.select(
        "person_id",
        F.col("care_site_id").cast("string").alias("site"),
        "provider_id",
        F.when(F.col("race_concept_id") == 9000, 1).alias("flag"),
    )
    return Q.impute(rows, ["site"], ["provider_id"], ["flag"])


@check(
    "m2_label_encode",
    """SELECT c_custkey, c_mktsegment, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INT) AS c_mktsegment_encoded FROM customer""",
)
def _(t: Tables):
    return Q.label_encode(t.customer.select("c_custkey", "c_mktsegment"), ["c_mktsegment"])


@check(
    "m3_one_hot",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "o_orderstatus_F",
         CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
         CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P" FROM orders""",
)
def _(t: Tables):
    return Q.one_hot(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderstatus"])


@check(
    "m4_standardize",
    """SELECT o_orderkey, ROUND((o_totalprice - AVG(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER (), 6) AS o_totalprice,
         0.0::DOUBLE AS constant FROM orders""",
)
def _(t: Tables):
    rows = t.orders.select("o_orderkey", "o_totalprice", F.lit(7).alias("constant"))
    return Q.standardize(rows, ["o_totalprice", "constant"]).withColumn("o_totalprice", F.round("o_totalprice", 6))


def _clean(t: Tables):
    return Q.impute(clinical(t), CATEGORICAL, NUMERIC, BINARY)


def _small(t: Tables):
    """Standardised clinical features: one vector per person."""
    return Q.feature_array(_clean(t), [*NUMERIC, *DRUG_FLAGS, "ecmo", "dialysis"], "person_id")


# --- clusterings ---------------------------------------------------------------


@check(
    "m5_kmeans",
    """SELECT COUNT(*) AS n, 10::BIGINT AS clusters, 0::BIGINT AS misplaced, TRUE AS cost_adds_up FROM embeddings""",
)
def _(t: Tables):
    """No row is nearer to another centre than to its own, and the cost is the sum of squares to the own ones."""
    fit = K.kmeans(vectors(t), "vec_id", "vec", 10)
    gaps = F.array(*[V.squared_distance("vec", F.array(*[F.lit(x) for x in c])) for c in fit.info["centres"]])
    rows = vectors(t).drop("label").join(fit.labels, "vec_id").select("label", gaps.alias("gaps"))
    own = F.element_at("gaps", F.col("label") + 1)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("label").alias("clusters"),
        F.count(F.when(own > F.array_min("gaps") + 1e-9, 1)).alias("misplaced"),
        (F.abs(F.sum(own) - fit.info["inertia"]) <= 1e-6 * F.sum(own)).alias("cost_adds_up"),
    )


@check("m6_kmeans_sweep")
def _(t: Tables):
    return K.kmeans_sweep(vectors(t), "vec_id", "vec").score_table(t.spark)


def _per_k(rows, labels, models: list, cost: dict, make):
    """For every k: rows, rows that some other centre would suit better, and whether the fit's own total is right.

    ``make`` turns a model into one row ``(k, label, ...)`` a centre; ``cost`` prices a row at it.
    """
    centres = F.broadcast(make(models))
    priced = rows.join(centres).select("k", "id", "label", cost["row"].alias("price"))
    best = priced.groupBy("k", "id").agg(F.min("price").alias("least"), cost["total"].alias("whole"))
    own = priced.join(labels, ["k", "id", "label"]).select("k", "id", F.col("price").alias("mine"))
    return best.join(own, ["k", "id"], "left").groupBy("k").agg(
        F.count("mine").alias("n"),
        F.count(F.when(F.col("mine") > F.col("least") + 1e-9 * (1 + F.abs("least")), 1)).alias("misplaced"),
        F.sum("whole").alias("whole"),
    )


def _labels_of(t: Tables, rows, models: list, row_id: str):
    found = [
        assign(rows, row_id, "vec", m.label).select(F.lit(m.k).alias("k"), F.col(row_id).alias("id"), "label") for m in models
    ]
    return reduce(lambda x, y: x.unionByName(y), found)


@check(
    "m6_sweep_invariants",
    """SELECT k::INT AS k, COUNT(*) AS n, 0::BIGINT AS misplaced, TRUE AS cost_adds_up, TRUE AS score_agrees
       FROM embeddings CROSS JOIN range(2, 8) r(k) GROUP BY k""",
)
def _(t: Tables):
    """For every k no row is nearer to another centre, the cost is that of the labels, and the score theirs."""
    fit = K.kmeans_sweep(vectors(t), "vec_id", "vec")
    models = fit.info["models"]
    rows = vectors(t).select(F.col("vec_id").alias("id"), "vec")

    def make(found: list):
        return t.spark.createDataFrame(
            [(m.k, j, c.tolist()) for m in found for j, c in enumerate(m.centres)], "k int, label int, centre array<double>"
        )

    labels = _labels_of(t, vectors(t), models, "vec_id").persist()
    cost = {"row": V.squared_distance("vec", "centre"), "total": F.min("price")}
    per_k = _per_k(rows, labels, models, cost, make)
    told = t.spark.createDataFrame([(m.k, m.cost, s["silhouette"]) for m, s in zip(models, fit.scores, strict=True)], "k int, cost double, told double")
    scores = [
        V.silhouette(rows.join(labels.where(F.col("k") == m.k), "id"), "vec", "label", "id").withColumn("k", F.lit(m.k)) for m in models
    ]
    joined = per_k.join(told, "k").join(reduce(lambda x, y: x.unionByName(y), scores), "k")
    return joined.select(
        "k", "n", "misplaced", (F.abs(F.col("whole") - F.col("cost")) <= 1e-6 * F.col("cost")).alias("cost_adds_up"),
        (F.abs(F.col("silhouette_score") - F.col("told")) < 1e-6).alias("score_agrees"),
    )


def _mixture_invariants(t: Tables, fit):
    """Labels are those of the largest responsibility, densities add up to the log-likelihood, and it never falls."""
    models = [m for m in fit.info["models"] if not m.failed]
    rows = _small(t).select(F.col("person_id").alias("id"), "vec")

    def make(found: list):
        out = []
        for m in found:
            inverse, base = m.whiteners()
            out += [(m.k, j, m.means[j].tolist(), inverse[j].tolist(), float(base[j])) for j in range(len(m.means))]
        return t.spark.createDataFrame(out, "k int, label int, mean array<double>, whitener array<array<double>>, base double")

    off = F.zip_with("vec", "mean", lambda x, y: x - y)
    dots = F.transform("whitener", lambda w: F.aggregate(F.zip_with(w, off, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x))
    price = 0.5 * F.aggregate(dots, F.lit(0.0), lambda a, x: a + x * x) - F.col("base")
    top = F.min("price")
    total = -top + F.log(F.aggregate(F.collect_list("price"), F.lit(0.0), lambda a, x: a + F.exp(F.array_min(F.collect_list("price")) - x)))
    labels = _labels_of(t, _small(t), models, "person_id")
    per_k = _per_k(rows, labels, models, {"row": price, "total": total}, make)
    falls = [(m.k, m.loglik, min([b - a for a, b in zip(m.trace, m.trace[1:])], default=0.0)) for m in models]
    told = t.spark.createDataFrame(falls, "k int, loglik double, fall double")
    return per_k.join(told, "k").select(
        "k", "n", "misplaced", (F.abs(F.col("whole") - F.col("loglik")) <= 1e-6 * F.abs("loglik")).alias("adds_up"),
        (F.col("fall") >= -1e-6 * F.abs("loglik")).alias("never_falls"),
    )


@check(
    "m7_gmm",
    """SELECT 3::INT AS k, COUNT(*) AS n, 0::BIGINT AS misplaced, TRUE AS adds_up, TRUE AS never_falls FROM flags""",
)
def _(t: Tables):
    return _mixture_invariants(t, K.gmm(_small(t), "person_id", "vec", 3))


@check(
    "m8_gmm_sweep",
    """SELECT k::INT AS k, COUNT(*) AS n, 0::BIGINT AS misplaced, TRUE AS adds_up, TRUE AS never_falls
       FROM flags CROSS JOIN range(2, 8) r(k) GROUP BY k""",
)
def _(t: Tables):
    return _mixture_invariants(t, K.gmm_sweep(_small(t), "person_id", "vec"))


@check(
    "m8_gmm_silhouette_sweep",
    """SELECT 6::BIGINT AS tried, COUNT(*) AS n, TRUE AS score_agrees, TRUE AS is_the_best FROM flags""",
)
def _(t: Tables):
    """The score of the model that won is that of its labels, and no other model's is higher."""
    fit = K.gmm_sweep(_small(t), "person_id", "vec", criterion="silhouette")
    told = {s["k"]: s["silhouette"] for s in fit.scores}
    rows = _small(t).join(fit.labels, "person_id")
    score = V.silhouette(rows, "vec", "label", "person_id")
    return rows.agg(F.count(F.lit(1)).alias("n")).join(score).select(
        F.lit(len(told)).cast("long").alias("tried"),
        "n",
        (F.abs(F.col("silhouette_score") - told[fit.parameter]) < 1e-6).alias("score_agrees"),
        F.lit(told[fit.parameter] == max(x for x in told.values() if x is not None)).alias("is_the_best"),
    )


def _prototype_invariants(t: Tables, fit):
    """No row is cheaper at another centre, costs add up, and they never rise."""
    rows = _clean(t).select("person_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC], *CATEGORICAL)
    prices = F.array(*[K._mixed_cost(nums, cats, fit.info["gamma"]) for nums, cats in fit.info["centres"]])
    own = F.element_at("prices", F.col("label") + 1)
    trace = fit.info["trace"]
    return rows.withColumn("prices", prices).join(fit.labels, "person_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(own > F.array_min("prices") + 1e-9, 1)).alias("misplaced"),
        (F.abs(F.sum(own) - fit.info["cost"]) <= 1e-6 * fit.info["cost"]).alias("cost_adds_up"),
        F.lit(all(b <= a * (1 + 1e-9) for a, b in zip(trace, trace[1:]))).alias("never_rises"),
    )


_PROTOTYPES = "SELECT COUNT(*) AS n, 0::BIGINT AS misplaced, TRUE AS cost_adds_up, TRUE AS never_rises"


@check("m9_kprototypes", f"{_PROTOTYPES} FROM flags")
def _(t: Tables):
    return _prototype_invariants(t, K.kprototypes(_clean(t), "person_id", NUMERIC, CATEGORICAL, 4))


@check("m9_kprototypes_sweep", f"{_PROTOTYPES}, 6::BIGINT AS tried, TRUE AS is_the_cheapest FROM flags")
def _(t: Tables):
    fit = K.kprototypes_sweep(_clean(t), "person_id", NUMERIC, CATEGORICAL)
    costs = {s["k"]: s["cost"] for s in fit.scores}
    cheapest = fit.parameter == min((k for k in costs if costs[k] is not None), key=lambda k: costs[k])
    return _prototype_invariants(t, fit).withColumns(
        {"tried": F.lit(len(costs)).cast("long"), "is_the_cheapest": F.lit(cheapest)}
    )


def _density_sql(eps: float) -> str:
    """Labels of density clustering: the smallest core row reached over core rows; -1 for noise."""
    return f"""near AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM vecs a JOIN vecs b ON {_DIST} <= {eps}),
  core AS MATERIALIZED (SELECT a FROM near GROUP BY a HAVING COUNT(*) >= 5),
  reach AS (SELECT a, a AS root FROM core UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.a JOIN core ON core.a = near.b),
  named AS MATERIALIZED (SELECT a, MIN(root) AS root FROM reach GROUP BY a)
  SELECT vec_id, COALESCE(n.root, MIN(m.root), -1)::BIGINT AS label FROM vecs LEFT JOIN named n ON n.a = vec_id
  LEFT JOIN near ON near.a = vec_id LEFT JOIN named m ON m.a = near.b GROUP BY vec_id, n.root"""


@check(
    "m10_dbscan_sweep",
    f"""WITH RECURSIVE eps AS (SELECT unnest([{", ".join(map(str, K.EPS_VALUES))}])::DOUBLE AS eps),
  gap AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, {_DIST} AS dist FROM vecs a CROSS JOIN vecs b),
  near AS MATERIALIZED (SELECT eps, a, b FROM gap JOIN eps ON dist <= eps),
  core AS MATERIALIZED (SELECT eps, a FROM near GROUP BY ALL HAVING COUNT(*) >= {K.MIN_POINTS}),
  reach AS (SELECT eps, a, a AS root FROM core UNION SELECT eps, near.b, root FROM reach JOIN near USING (eps, a) JOIN core ON core.eps = near.eps AND core.a = near.b),
  found AS (SELECT near.eps, near.a, MIN(root) AS label FROM near LEFT JOIN reach ON reach.eps = near.eps AND reach.a = near.b GROUP BY ALL)
  SELECT eps, COUNT(DISTINCT label)::DOUBLE AS clusters, COUNT(*) FILTER (WHERE label IS NULL)::DOUBLE AS noise FROM found GROUP BY eps""",
)
def _(t: Tables):
    """Clusters and noise of every radius; the score column belongs to labellings without noise only."""
    return K.dbscan_sweep(vectors(t), "vec_id", "vec").score_table(t.spark).drop("silhouette")


@check("m10_dbscan", f"WITH RECURSIVE {_density_sql(1.0)}")
def _(t: Tables):
    return K.dbscan(vectors(t), "vec_id", "vec", 1.0).labels


@check("m11_ward")
def _(t: Tables):
    return K.ward_knn(vectors(t), "vec_id", "vec", 5, 10).labels


def _map_invariants(points, explained: list, columns: list):
    """Axes are uncorrelated, as wide as the explained variance says, and no column is wider than the first."""
    cov = F.covar_pop("pc1", "pc2") / F.sqrt(F.var_pop("pc1") * F.var_pop("pc2"))
    return [
        F.count(F.lit(1)).alias("n"),
        (F.abs(F.var_pop("pc1") / len(columns) - explained[0]) < 1e-6).alias("first_fits"),
        (F.abs(F.var_pop("pc2") / len(columns) - explained[1]) < 1e-6).alias("second_fits"),
        (F.abs(cov) < 1e-6).alias("uncorrelated"),
        (F.var_pop("pc1") >= 1).alias("widest"),
    ]


_MAP = "TRUE AS first_fits, TRUE AS second_fits, TRUE AS uncorrelated, TRUE AS widest FROM flags"


@check("m12_pca", f"SELECT COUNT(*) AS n, {_MAP}")
def _(t: Tables):
    columns = _varying(t, NUMERIC + DRUG_FLAGS)
    points, explained = V.pca2(_clean(t), columns, "person_id")
    return points.agg(*_map_invariants(points, explained, columns))


def _varying(t: Tables, columns: list) -> list:
    spread = _clean(t).agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return [c for c in columns if spread[c]]


# --- scores: the labels of the table, so that SQL can follow ---------------------------------------------------------------



def _silhouette_sql(vecs: str) -> str:
    return f"""WITH s AS ({vecs}), d AS (SELECT a.vec_id, a.label AS own, b.label AS other, SUM(power({_DIST}, 2)) AS s, COUNT(*) AS n
    FROM s AS a CROSS JOIN s AS b GROUP BY 1, 2, 3),
  p AS (SELECT vec_id, MAX(CASE WHEN own = other THEN s / n END) AS x, MIN(CASE WHEN own <> other THEN s / n END) AS y FROM d GROUP BY 1)
  SELECT ROUND(AVG((y - x) / greatest(x, y)), 6) AS silhouette_score FROM p"""


_SILHOUETTE = _silhouette_sql("SELECT * FROM vecs")


@check("m14_silhouette", _SILHOUETTE)
def _(t: Tables):
    return V.silhouette(vectors(t), "vec", "label", "vec_id").select(
        F.round("silhouette_score", 6).alias("silhouette_score")
    )


_CENTRES = """SELECT label, dim, AVG(x) AS m, COUNT(*) AS n, SUM(x * x) - COUNT(*) * AVG(x) * AVG(x) AS w FROM dims GROUP BY 1, 2"""


def _calinski_sql(dims: str) -> str:
    return f"""WITH e AS ({dims}), c AS ({_CENTRES.replace("FROM dims", "FROM e")}), o AS (SELECT dim, AVG(x) AS g FROM e GROUP BY 1),
        z AS (SELECT SUM(n * power(m - g, 2)) AS b, SUM(w) AS w FROM c JOIN o ON c.dim = o.dim)
        SELECT ROUND(b / (k - 1) / (w / (n - k)), 5) AS calinski_harabasz_score FROM z
        CROSS JOIN (SELECT COUNT(DISTINCT vec_id) AS n, COUNT(DISTINCT label) AS k FROM e) s"""


@check("m15_calinski_harabasz", _calinski_sql("SELECT * FROM dims"))
def _(t: Tables):
    return V.calinski_harabasz(vectors(t), "vec", "label").select(
        F.round("calinski_harabasz_score", 5).alias("calinski_harabasz_score")
    )


def _davies_sql(dims: str) -> str:
    return f"""WITH e AS ({dims}), c AS ({_CENTRES.replace("FROM dims", "FROM e")}), s AS (SELECT label, AVG(d) AS s FROM (
          SELECT d.vec_id, d.label, sqrt(SUM(power(d.x - c.m, 2))) AS d FROM e d
          JOIN c ON c.label = d.label AND c.dim = d.dim GROUP BY 1, 2) q GROUP BY 1),
        g AS (SELECT a.label AS l1, b.label AS l2, sqrt(SUM(power(a.m - b.m, 2))) AS gap FROM c a
          JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY 1, 2)
        SELECT ROUND(AVG(worst), 6) AS davies_bouldin_score FROM (
          SELECT l1, MAX((s1.s + s2.s) / gap) AS worst FROM g JOIN s s1 ON s1.label = l1 JOIN s s2 ON s2.label = l2 GROUP BY 1) w"""


@check("m16_davies_bouldin", _davies_sql("SELECT * FROM dims"))
def _(t: Tables):
    return V.davies_bouldin(vectors(t), "vec", "label").select(
        F.round("davies_bouldin_score", 6).alias("davies_bouldin_score")
    )


def _evaluation_sql(name: str, vecs: str) -> str:
    dims = f"SELECT vec_id, label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS dim FROM ({vecs})"
    return f"""SELECT '{name}' AS algorithm, (SELECT COUNT(DISTINCT label) FROM ({vecs})) AS n_clusters,
        ({_silhouette_sql(vecs)}) AS silhouette_score, ({_calinski_sql(dims)}) AS calinski_harabasz_score,
        ({_davies_sql(dims)}) AS davies_bouldin_score"""


def _rounded(found):
    places = {"silhouette_score": 6, "calinski_harabasz_score": 5, "davies_bouldin_score": 6}
    return found.withColumns({c: F.round(c, n) for c, n in places.items()})


# Noise: every seventh row is labelled -1 and must be left out.
_NOISY = "SELECT vec_id, label, e FROM vecs WHERE vec_id % 7 <> 0"
_FOLDED = "SELECT vec_id, label % 3 AS label, e FROM vecs"


@check("m13_noise_removal", _evaluation_sql("noisy", _NOISY))
def _(t: Tables):
    noisy = vectors(t).withColumn("label", F.when(F.col("vec_id") % 7 == 0, V.NOISE).otherwise(F.col("label")))
    return _rounded(V.evaluate(noisy, "vec", "label", "vec_id", "noisy"))


@check("m17_evaluate", _evaluation_sql("given", "SELECT * FROM vecs"))
def _(t: Tables):
    return _rounded(V.evaluate(vectors(t), "vec", "label", "vec_id", "given"))


@check(
    "m18_cluster_profile",
    """SELECT l.label AS cluster, COUNT(*) AS n, AVG(o.o_totalprice) AS o_totalprice_mean, stddev_samp(o.o_totalprice) AS o_totalprice_std,
         AVG(CASE WHEN o.o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS finished_rate,
         MAX(m.mode) AS o_orderpriority_mode
       FROM orders o JOIN embeddings l ON l.vec_id = o.o_orderkey
       JOIN (SELECT label, o_orderpriority AS mode FROM (SELECT label, o_orderpriority, row_number() OVER (PARTITION BY label
           ORDER BY COUNT(*) DESC, o_orderpriority) AS rn FROM orders JOIN embeddings ON vec_id = o_orderkey GROUP BY 1, 2) r WHERE rn = 1) m
         ON m.label = l.label GROUP BY 1""",
)
def _(t: Tables):
    rows = t.orders.join(t.embeddings.select(F.col("vec_id").alias("o_orderkey"), "label"), "o_orderkey")
    rows = rows.withColumn("finished", F.col("o_orderstatus") == "F")
    return V.cluster_profile(rows, "label", ["o_totalprice"], ["finished"], ["o_orderpriority"])


@check(
    "m19_compare_algorithms",
    f"""{_evaluation_sql("given", "SELECT * FROM vecs")} UNION ALL {_evaluation_sql("folded", _FOLDED)} ORDER BY silhouette_score DESC""",
)
def _(t: Tables):
    points = vectors(t)
    folded = points.withColumn("label", F.col("label") % 3)
    found = [V.evaluate(p, "vec", "label", "vec_id", n) for n, p in (("given", points), ("folded", folded))]
    return _rounded(V.compare_algorithms(found, t.spark))


@check(
    "m20_clustering_run",
    """SELECT unnest(['K-Means', 'Gaussian Mixture (silhouette)', 'Gaussian Mixture (BIC)', 'K-Prototypes', 'Hierarchical (k-NN)']) AS algorithm,
         TRUE AS clusters_agree, TRUE AS score_agrees, (SELECT COUNT(*) FROM flags) AS profiled""",
)
def _(t: Tables):
    """Every method is compared, with the clusters and the score of its own labels, and profiles all rows."""
    run = run_clustering(clinical(t), ClusteringSpec())
    vecs = prepare_features(clinical(t), ClusteringSpec())[1]
    rows = []
    for r in run.comparison.collect():
        labels = run.fits[r["algorithm"]].labels
        score = V.silhouette(vecs.join(labels, "person_id"), "vec", "label", "person_id").first()[0]
        sizes = [c["count"] for c in labels.groupBy("label").count().collect()]
        same = r["silhouette_score"] is not None and abs(score - r["silhouette_score"]) < 1e-6
        rows.append((r["algorithm"], r["n_clusters"] == len(sizes), same, sum(sizes)))
    return t.spark.createDataFrame(rows, "algorithm string, clusters_agree boolean, score_agrees boolean, profiled long")


@check("v6_cluster_map", f"SELECT COUNT(*) AS n, 3::BIGINT AS clusters, COUNT(*) AS in_sizes, {_MAP}")
def _(t: Tables):
    clean = _clean(t)
    columns = _varying(t, NUMERIC)
    labels = K.kmeans(Q.feature_array(clean, NUMERIC, "person_id"), "person_id", "vec", 3).labels
    points, sizes, explained = V.cluster_map(clean.join(labels, "person_id"), "label", columns, "person_id")
    told = sizes.agg(F.sum(sizes.columns[1])).first()[0]
    return points.agg(
        *_map_invariants(points, explained, columns), F.count_distinct("cluster").alias("clusters"), F.lit(told).cast("long").alias("in_sizes")
    )
