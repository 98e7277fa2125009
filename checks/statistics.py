"""Hypothesis tests and effect sizes. Statistics are compared; p-values have unit tests."""

from pyspark.sql import functions as F

from checks.registry import Tables, check
from checks.shared import clinical, rates
from cohortry.functions import expr as E
from cohortry.operators import tests_of_difference as T
from cohortry.operators.relational import count_by
from cohortry.plans.rates import AGES, GENDERS, drug_rate_analysis

# A 2x2 table per site: late orders (shipped in the second half-year) by return flag.
_SITE_TABLES = """SELECT l_suppkey, COUNT(CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 1 END) AS a,
    COUNT(CASE WHEN l_returnflag = 'R' AND l_quantity <= 25 THEN 1 END) AS b,
    COUNT(CASE WHEN l_returnflag <> 'R' AND l_quantity > 25 THEN 1 END) AS c,
    COUNT(CASE WHEN l_returnflag <> 'R' AND l_quantity <= 25 THEN 1 END) AS d FROM lineitem GROUP BY 1"""


def _site_tables(t: Tables):
    r, q = F.col("l_returnflag") == "R", F.col("l_quantity") > 25
    cells = {"a": r & q, "b": r & ~q, "c": ~r & q, "d": ~r & ~q}
    return t.lineitem.groupBy("l_suppkey").agg(*[F.count(F.when(w, F.lit(1))).alias(n) for n, w in cells.items()])


@check(
    "t1_chi2_yates",
    f"""SELECT l_suppkey, a, b, c, d, 1 AS dof, ROUND((a + b + c + d)::DOUBLE
          * power(greatest(0, abs(a * d - b * c) - (a + b + c + d) / 2.0), 2)
          / ((a + b)::DOUBLE * (c + d) * (a + c) * (b + d)), 6) AS statistic FROM ({_SITE_TABLES}) s""",
)
def _(t: Tables):
    return T.chi2_2x2(_site_tables(t), "a", "b", "c", "d").drop("p_value").withColumn("statistic", F.round("statistic", 6))


@check(
    "t2_chi2_table",
    """WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS c, COUNT(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
       r AS (SELECT r, SUM(n) AS rn FROM o GROUP BY 1), k AS (SELECT c, SUM(n) AS cn FROM o GROUP BY 1),
       t AS (SELECT SUM(n) AS tn FROM o)
       SELECT ROUND(SUM(power(COALESCE(o.n, 0) - rn * cn / tn, 2) / (rn * cn / tn)), 6) AS statistic, MAX(tn) AS n,
         CAST((COUNT(DISTINCT r.r) - 1) * (COUNT(DISTINCT k.c) - 1) AS INT) AS dof
       FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN o ON o.r = r.r AND o.c = k.c""",
)
def _(t: Tables):
    cells = count_by(t.orders, ["o_orderstatus", "o_orderpriority"])
    found = T.chi2_rxc(cells, "o_orderstatus", "o_orderpriority")
    return found.select("n", F.round("statistic", 6).alias("statistic"), "dof")


# Every table with the margins of the observed one, and its probability by log gamma.
_FISHER = f"""WITH s AS ({_SITE_TABLES}),
    x AS (SELECT s.*, unnest(range(greatest(0, a + c - (c + d))::BIGINT, (least(a + b, a + c) + 1)::BIGINT)) AS cell FROM s),
    w AS (SELECT x.*, lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1)
        - lgamma(cell + 1) - lgamma(a + b - cell + 1) - lgamma(a + c - cell + 1) - lgamma(d - a + cell + 1) AS logp FROM x),
    o AS (SELECT l_suppkey, logp AS seen FROM w WHERE cell = a)
    SELECT w.l_suppkey, ROUND(least(1.0, SUM(CASE WHEN logp <= seen + 1e-7 THEN exp(logp) ELSE 0 END)), 6) AS p_value
    FROM w JOIN o ON o.l_suppkey = w.l_suppkey GROUP BY 1"""


@check("t3_fisher_exact", _FISHER)
def _(t: Tables):
    found = T.fisher_2x2(_site_tables(t), "a", "b", "c", "d")
    return found.select("l_suppkey", F.round("p_value", 6).alias("p_value"))


@check(
    "t4_test_choice_by_size",
    f"""SELECT l_suppkey, CASE WHEN least(a + b, c + d) < 150 THEN 'Fisher''s exact' ELSE 'Chi-square' END AS test_used
        FROM ({_SITE_TABLES}) s""",
)
def _(t: Tables):
    return T.auto_test_2x2(_site_tables(t), "a", "b", "c", "d", cutoff=150).select("l_suppkey", "test_used")


# Small tables, one per customer, and large ones, one per market segment.
_CELLS = """SELECT {by} AS k, o_orderpriority < '3' AS urgent, o_orderstatus, COUNT(*) AS n
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3"""
_CHOICE = """WITH cells AS ({cells}), g AS (SELECT k, COUNT(DISTINCT urgent) AS r, COUNT(DISTINCT o_orderstatus) AS c,
      COUNT(*) AS seen, MIN(n) AS m FROM cells GROUP BY 1)
    SELECT k, CASE WHEN seen = r * c AND m >= 5 THEN 'Chi-square test'
      WHEN r = 2 AND c = 2 THEN 'Fisher''s exact test' ELSE 'Chi-square test (small cells)' END AS test_used
    FROM g WHERE r > 1 AND c > 1"""


def _choices(t: Tables, by: str):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col(by).alias("k"), (F.col("o_orderpriority") < "3").alias("urgent"), "o_orderstatus"
    )
    cells = count_by(rows, ["k", "urgent", "o_orderstatus"])
    return T.auto_test_counts(cells, "urgent", "o_orderstatus", by=["k"]).select("k", "test_used")


@check("t5_test_choice_small_tables", _CHOICE.format(cells=_CELLS.format(by="c_custkey")))
def _(t: Tables):
    return _choices(t, "c_custkey")


@check("t5_test_choice_large_tables", _CHOICE.format(cells=_CELLS.format(by="c_mktsegment")))
def _(t: Tables):
    return _choices(t, "c_mktsegment")


_YATES = """(got1 + n1 + got2 + n2)::DOUBLE * power(greatest(0, abs(got1 * n2 - n1 * got2) - (got1 + n1 + got2 + n2) / 2.0), 2)
    / ((got1 + n1)::DOUBLE * (got2 + n2) * (got1 + got2) * (n1 + n2))"""


@check(
    "t6_rate_difference_by_race",
    f"""SELECT name, race_name, got1 * 100.0::DOUBLE / total1 AS rate1, got2 * 100.0::DOUBLE / total2 AS rate2,
          got1 * 100.0::DOUBLE / total1 - got2 * 100.0::DOUBLE / total2 AS difference,
          CASE WHEN least(total1, total2) < 50 THEN 'Fisher''s exact' ELSE 'Chi-square' END AS test_used,
          ROUND(CASE WHEN least(total1, total2) >= 50 THEN {_YATES} END, 6) AS statistic
        FROM (SELECT *, total1 - got1 AS n1, total2 - got2 AS n2 FROM arms_g WHERE total1 IS NOT NULL AND total2 IS NOT NULL) t""",
)
def _(t: Tables):
    found = T.stratified_rate_diff(rates(t), ["name", "race_name"], "gender_name", GENDERS)
    return found.select(
        "name", "race_name", "rate1", "rate2", "difference", "test_used", F.round("statistic", 6).alias("statistic")
    )


@check(
    "t7_odds_ratio",
    """SELECT name, race_name, got1::DOUBLE / greatest(1, total1 - got1) AS odds1, got2::DOUBLE / greatest(1, total2 - got2) AS odds2,
         (got1::DOUBLE / greatest(1, total1 - got1)) / (got2::DOUBLE / greatest(1, total2 - got2)) AS odds_ratio
       FROM arms_a WHERE total1 IS NOT NULL AND total2 IS NOT NULL AND got2 > 0""",
)
def _(t: Tables):
    return T.stratum_odds_ratio(rates(t), ["name", "race_name"], "age_group", AGES)


_INTERACTION = """WITH o AS (SELECT name, race_name, unnest(['g1', 'n1', 'g2', 'n2']) AS cell,
    unnest([got1, total1 - got1, got2, total2 - got2])::DOUBLE AS n FROM arms_g WHERE total1 > 0 AND total2 > 0),
  r AS (SELECT name, race_name, SUM(n) AS rn FROM o GROUP BY 1, 2), k AS (SELECT name, cell, SUM(n) AS cn FROM o GROUP BY 1, 2),
  s AS (SELECT name, SUM(n) AS tn FROM o GROUP BY 1)
  SELECT o.name, COUNT(DISTINCT o.race_name) AS n_strata, ROUND(SUM(power(o.n - rn * cn / tn, 2) / (rn * cn / tn)), 6) AS statistic,
    CAST((COUNT(DISTINCT o.race_name) - 1) * 3 AS INT) AS dof
  FROM o JOIN r ON r.name = o.name AND r.race_name = o.race_name JOIN k ON k.name = o.name AND k.cell = o.cell
  JOIN s ON s.name = o.name GROUP BY 1"""


@check("t8_interaction", _INTERACTION)
def _(t: Tables):
    found = T.interaction_test(rates(t), "race_name", "gender_name", GENDERS, ["name"])
    return found.drop("p_value").withColumn("statistic", F.round("statistic", 6))


_PAIR = " + ".join(
    f"power({s}{i} - r{s} * (p{i} + q{i}) / (rp + rq), 2) / (r{s} * (p{i} + q{i}) / (rp + rq))" for s in "pq" for i in range(1, 5)
)


@check(
    "t9_pairwise_strata",
    f"""WITH w AS (SELECT name, race_name, got1::DOUBLE AS g1, (total1 - got1)::DOUBLE AS n1, got2::DOUBLE AS g2,
          (total2 - got2)::DOUBLE AS n2, total1::DOUBLE + total2 AS tot,
          got1 * 100.0::DOUBLE / total1 - got2 * 100.0::DOUBLE / total2 AS diff FROM arms_g WHERE total1 > 0 AND total2 > 0),
        j AS (SELECT a.name, a.race_name AS stratum1, b.race_name AS stratum2, a.diff AS diff1, b.diff AS diff2,
          a.g1 AS p1, a.n1 AS p2, a.g2 AS p3, a.n2 AS p4, b.g1 AS q1, b.n1 AS q2, b.g2 AS q3, b.n2 AS q4, a.tot AS rp, b.tot AS rq
          FROM w a JOIN w b ON a.name = b.name AND a.race_name < b.race_name)
        SELECT name, stratum1, stratum2, diff1, diff2, abs(diff1 - diff2) AS diff_of_diffs, 3 AS dof,
          ROUND({_PAIR}, 6) AS statistic FROM j""",
)
def _(t: Tables):
    found = T.pairwise_strata(rates(t), "race_name", "gender_name", GENDERS, ["name"])
    return found.drop("p_value", "significant").withColumn("statistic", F.round("statistic", 6))


@check(
    "t10_bonferroni",
    """WITH strata AS (
         SELECT name, 'g' || race_name AS s FROM arms_g WHERE total1 IS NOT NULL AND total2 IS NOT NULL
         UNION ALL SELECT name, 'ga' || age_group FROM rates GROUP BY name, age_group HAVING COUNT(DISTINCT gender_name) = 2
         UNION ALL SELECT name, 'ag' || gender_name FROM rates GROUP BY name, gender_name HAVING COUNT(DISTINCT age_group) = 2
         UNION ALL SELECT a.name, a.race_name || b.race_name FROM arms_g a JOIN arms_g b ON a.name = b.name
           AND a.race_name < b.race_name WHERE a.total1 > 0 AND a.total2 > 0 AND b.total1 > 0 AND b.total2 > 0
         UNION ALL SELECT a.name, 'a' || a.race_name || b.race_name FROM arms_a a JOIN arms_a b ON a.name = b.name
           AND a.race_name < b.race_name WHERE a.total1 > 0 AND a.total2 > 0 AND b.total1 > 0 AND b.total2 > 0)
       SELECT name, COUNT(*) AS n_tests, 0.05::DOUBLE / COUNT(*) AS corrected_alpha FROM strata GROUP BY 1""",
)
def _(t: Tables):
    from checks.shared import drug_seeds, stored_cohort

    found = drug_rate_analysis(
        stored_cohort(t), drug_seeds(t), t.concept_relationship, t.concept, t.drug_exposure, t.visit_occurrence
    )
    return found["corrected"].select("name", "n_tests", "corrected_alpha").distinct()


def _horner(coefficients: tuple, x: str) -> str:
    text = f"{coefficients[0]!r}::DOUBLE"
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}::DOUBLE)"
    return text


def _ratio(parts: tuple, x: str) -> str:
    return f"({_horner(parts[0], x)} / {_horner(parts[1], x)})"


def _shapiro(values: str) -> str:
    """W of every (variable, grp) of ``values``, position by position."""
    return f"""WITH l AS ({values}),
      r AS (SELECT *, row_number() OVER (PARTITION BY variable, grp ORDER BY x) AS i, COUNT(*) OVER (PARTITION BY variable, grp) AS n,
        AVG(x) OVER (PARTITION BY variable, grp) AS mean FROM l WHERE x IS NOT NULL AND grp IS NOT NULL),
      q AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM r),
      t AS (SELECT *, p - 0.5::DOUBLE AS q, 0.180625::DOUBLE - (p - 0.5::DOUBLE) * (p - 0.5::DOUBLE) AS c, sqrt(-ln(least(p, 1 - p))) AS u FROM q),
      z AS (SELECT *, CASE WHEN abs(q) <= 0.425 THEN q * {_ratio(E.NORMAL_CENTRE, "c")}
        WHEN u <= 5 THEN sign(q) * {_ratio(E.NORMAL_TAIL, "(u - 1.6::DOUBLE)")}
        ELSE sign(q) * {_ratio(E.NORMAL_FAR, "(u - 5)")} END AS m FROM t),
      s AS (SELECT variable, grp, MAX(n) AS n, SUM(m * m) AS norm, SUM(power(x - mean, 2)) AS squares, 1 / sqrt(MAX(n)) AS v,
        MAX(CASE WHEN i = n THEN m END) AS m1, MAX(CASE WHEN i = n - 1 THEN m END) AS m2,
        MAX(x) - MIN(x) AS d1, MAX(CASE WHEN i = n - 1 THEN x END) - MAX(CASE WHEN i = 2 THEN x END) AS d2,
        SUM(CASE WHEN i BETWEEN 3 AND n - 2 THEN m * (x - mean) ELSE 0 END) AS inner_sum FROM z GROUP BY 1, 2),
      e AS (SELECT *,
        m1 / sqrt(norm) + 0.221157::DOUBLE * v - 0.147981::DOUBLE * power(v, 2) - 2.071190::DOUBLE * power(v, 3)
          + 4.434685::DOUBLE * power(v, 4) - 2.706056::DOUBLE * power(v, 5) AS a1,
        m2 / sqrt(norm) + 0.042981::DOUBLE * v - 0.293762::DOUBLE * power(v, 2) - 1.752461::DOUBLE * power(v, 3)
          + 5.682633::DOUBLE * power(v, 4) - 3.582633::DOUBLE * power(v, 5) AS a2 FROM s)
    SELECT variable, grp, n, ROUND(power(a1 * d1 + a2 * d2
      + inner_sum / sqrt((norm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)), 2) / squares, 5) AS statistic
    FROM e WHERE n > 5"""


def _w(found):
    return found.where("n > 5").select("variable", "grp", "n", F.round("statistic", 5).alias("statistic"))


@check(
    "t11_normality_shapiro",
    _shapiro("""SELECT 'age' AS variable, gender_name AS grp, age::DOUBLE AS x FROM clinical
      UNION ALL SELECT 'los', gender_name, los::DOUBLE FROM clinical"""),
)
def _(t: Tables):
    return _w(T.normality_gate(clinical(t), "gender_name", ["age", "los"], "shapiro"))


@check(
    "t11_normality_shapiro_ties",
    _shapiro("""SELECT 'l_quantity' AS variable, l_returnflag AS grp, l_quantity::DOUBLE AS x FROM lineitem
      UNION ALL SELECT 'l_extendedprice', l_returnflag, l_extendedprice::DOUBLE FROM lineitem"""),
)
def _(t: Tables):
    return _w(T.normality_gate(t.lineitem, "l_returnflag", ["l_quantity", "l_extendedprice"], "shapiro"))


@check(
    "t11_normality_moments",
    """SELECT variable, grp, n, ROUND(n / 6.0 * (power(g1, 2) + power(g2, 2) / 4), 4) AS statistic FROM (
         SELECT 'o_totalprice' AS variable, o_orderstatus AS grp, COUNT(*) AS n,
           AVG(power(o_totalprice - m, 3)) / power(AVG(power(o_totalprice - m, 2)), 1.5) AS g1,
           AVG(power(o_totalprice - m, 4)) / power(AVG(power(o_totalprice - m, 2)), 2) - 3 AS g2
         FROM (SELECT *, AVG(o_totalprice) OVER (PARTITION BY o_orderstatus) AS m FROM orders) o GROUP BY 2) t""",
)
def _(t: Tables):
    found = T.normality_gate(t.orders, "o_orderstatus", ["o_totalprice"])
    return found.select("variable", "grp", "n", F.round("statistic", 4).alias("statistic"))


# Two groups of orders; the rank tests run over every row.
_TWO = "SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END AS grp, o_totalprice AS v FROM orders"


def _two(t: Tables):
    return t.orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("other").alias("grp"),
        F.col("o_totalprice").alias("price"),
        "o_custkey",
    )


_SIDES = f"""SELECT MAX(CASE WHEN grp = 'F' THEN n END) AS n1, MAX(CASE WHEN grp = 'other' THEN n END) AS n2,
    MAX(CASE WHEN grp = 'F' THEN m END) AS m1, MAX(CASE WHEN grp = 'other' THEN m END) AS m2,
    SUM((n - 1) * s) / (SUM(n) - 2) AS pooled
  FROM (SELECT grp, COUNT(*) AS n, AVG(v) AS m, var_samp(v) AS s FROM ({_TWO}) o GROUP BY 1) g"""


@check(
    "t12_t_test",
    f"""SELECT 'price' AS variable, n1, n2, ROUND((m1 - m2) / sqrt(pooled * (1.0 / n1 + 1.0 / n2)), 6) AS statistic, n1 + n2 - 2 AS dof FROM ({_SIDES}) s""",
)
def _(t: Tables):
    found = T.t_test(_two(t), "grp", ["price"])
    return found.select("variable", "n1", "n2", F.round("statistic", 6).alias("statistic"), "dof")


_RANKED = """SELECT grp, v, rank() OVER (ORDER BY v) + (COUNT(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r,
    COUNT(*) OVER (PARTITION BY v) AS t FROM"""


@check(
    "t13_mann_whitney",
    f"""SELECT 'o_custkey' AS variable, COUNT(CASE WHEN grp = 'F' THEN 1 END) AS n1, COUNT(CASE WHEN grp <> 'F' THEN 1 END) AS n2,
          SUM(CASE WHEN grp = 'F' THEN r END) - COUNT(CASE WHEN grp = 'F' THEN 1 END)::DOUBLE * (COUNT(CASE WHEN grp = 'F' THEN 1 END) + 1) / 2 AS statistic
        FROM ({_RANKED} (SELECT CASE WHEN o_orderstatus = 'F' THEN 'F' ELSE 'other' END AS grp, o_custkey AS v FROM orders) o) q""",
)
def _(t: Tables):
    return T.mann_whitney(_two(t), "grp", ["o_custkey"]).select("variable", "n1", "n2", "statistic")


@check(
    "t14_kruskal",
    f"""WITH q AS ({_RANKED} (SELECT o_orderpriority AS grp, o_custkey AS v FROM orders) o),
        g AS (SELECT grp, COUNT(*)::DOUBLE AS n, SUM(r) AS s FROM q GROUP BY 1),
        x AS (SELECT SUM(n) AS n, SUM(s * s / n) AS z, COUNT(*) AS k FROM g),
        y AS (SELECT SUM(t * (t::DOUBLE * t - 1)) AS ties FROM (SELECT DISTINCT v, t FROM q) d)
        SELECT 'o_custkey' AS variable, k AS n_groups, CAST(k - 1 AS INT) AS dof,
          ROUND((12.0 / (n * (n + 1)) * z - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 5) AS statistic FROM x CROSS JOIN y""",
)
def _(t: Tables):
    found = T.kruskal(t.orders, "o_orderpriority", ["o_custkey"])
    return found.select("variable", "n_groups", "dof", F.round("statistic", 5).alias("statistic"))


@check("t15_cohens_d", f"SELECT 'price' AS variable, ROUND(abs(m1 - m2) / sqrt(pooled), 6) AS cohens_d FROM ({_SIDES}) s")
def _(t: Tables):
    return T.cohens_d(_two(t), "grp", ["price"]).select("variable", F.round("cohens_d", 6).alias("cohens_d"))


@check(
    "t16_cramers_v",
    """WITH o AS (SELECT o_orderstatus AS r, o_orderpriority AS c, COUNT(*)::DOUBLE AS n FROM orders GROUP BY 1, 2),
       r AS (SELECT r, SUM(n) AS rn FROM o GROUP BY 1), k AS (SELECT c, SUM(n) AS cn FROM o GROUP BY 1)
       SELECT ROUND(sqrt((SUM(o.n * o.n / (rn * cn)) - 1) / (least(COUNT(DISTINCT o.r), COUNT(DISTINCT o.c)) - 1)), 6) AS v
       FROM o JOIN r ON r.r = o.r JOIN k ON k.c = o.c""",
)
def _(t: Tables):
    cells = count_by(t.orders, ["o_orderstatus", "o_orderpriority"])
    found = T.chi2_rxc(cells, "o_orderstatus", "o_orderpriority")
    return found.select(F.round(T.cramers_v("statistic", "n", "n_rows", "n_cols"), 6).alias("v"))


@check("t17_compare_groups")
def _(t: Tables):
    from cohortry.plans.reports import BINARY, NUMERIC

    return T.compare_groups(clinical(t), "race_name", NUMERIC, BINARY)


@check(
    "x2_grouped_tests",
    """SELECT name, age_group, SUM(CASE WHEN gender_name = 'MALE' THEN cnt END) * 100.0::DOUBLE
           / SUM(CASE WHEN gender_name = 'MALE' THEN base_count END) AS rate1,
         SUM(CASE WHEN gender_name = 'FEMALE' THEN cnt END) * 100.0::DOUBLE
           / SUM(CASE WHEN gender_name = 'FEMALE' THEN base_count END) AS rate2
       FROM rates GROUP BY 1, 2 HAVING COUNT(DISTINCT gender_name) = 2""",
)
def _(t: Tables):
    found = T.stratified_rate_diff(rates(t), ["name", "age_group"], "gender_name", GENDERS)
    return found.select("name", "age_group", "rate1", "rate2")
