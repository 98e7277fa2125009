"""Tests of difference on small tables with known results."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortry.functions import tails
from cohortry.operators import order_stats
from cohortry.operators import tests_of_difference as T

RATES = "name string, race_name string, gender_name string, age_group string, cnt long, base_count long"


@pytest.fixture(scope="module")
def rates(spark):
    rows = [
        ("d", "White", "MALE", "65+", 40, 100),
        ("d", "White", "FEMALE", "65+", 20, 100),
        ("d", "Black", "MALE", "65+", 5, 20),
        ("d", "Black", "FEMALE", "65+", 9, 30),
        ("d", "Asian", "MALE", "65+", 4, 60),  # no women
        ("d", "Other", "MALE", "65+", 70, 60),  # more exposed than people
        ("d", "Other", "FEMALE", "65+", 6, 60),
    ]
    return spark.createDataFrame(rows, RATES)


def test_chi2_with_correction(spark):
    df = spark.createDataFrame([(10, 20, 30, 40), (0, 0, 3, 4)], "a long, b long, c long, d long")
    first, empty = T.chi2_2x2(df, "a", "b", "c", "d").collect()
    assert first["statistic"] == pytest.approx(0.446428571, abs=1e-8)
    assert first["p_value"] == pytest.approx(0.504035, abs=1e-5)
    assert empty["statistic"] is None and empty["p_value"] is None


def test_chi2_table_with_absent_cell_and_correction(spark):
    df = spark.createDataFrame([("x", "p", 10), ("x", "q", 20), ("y", "q", 30)], "r string, c string, n long")
    row = T.chi2_rxc(df, "r", "c").first()
    assert row["statistic"] == pytest.approx(12.0) and row["dof"] == 1 and row["min_cell"] == 0
    yates = T.chi2_rxc(df, "r", "c", yates_2x2=True).first()
    assert yates["statistic"] == pytest.approx(60 * (300 - 30) ** 2 / (30 * 30 * 10 * 50))


def test_test_choice_by_size(rates):
    rows = {r["race_name"]: r for r in T.stratified_rate_diff(rates, ["race_name"], "gender_name", ("MALE", "FEMALE")).collect()}
    assert set(rows) == {"White", "Black", "Other"}
    assert rows["White"]["test_used"] == "Chi-square" and rows["White"]["difference"] == pytest.approx(20.0)
    assert rows["Black"]["test_used"] == "Fisher's exact" and rows["Black"]["statistic"] is None
    assert rows["Other"]["clamped"] and rows["Other"]["not1"] == 0


def test_interaction_and_pairs(rates):
    row = T.interaction_test(rates, "race_name", "gender_name", ("MALE", "FEMALE"), ["name"]).first()
    assert (row["n_strata"], row["dof"]) == (3, 6)
    table = np.array([[40, 60, 20, 80], [5, 15, 9, 21], [60, 0, 6, 54]], dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert row["statistic"] == pytest.approx(((table - expected) ** 2 / expected).sum())
    pairs = T.pairwise_strata(rates, "race_name", "gender_name", ("MALE", "FEMALE"), ["name"]).collect()
    assert {(p["stratum1"], p["stratum2"]) for p in pairs} == {("Black", "Other"), ("Black", "White"), ("Other", "White")}
    two = next(p for p in pairs if p["stratum1"] == "Black" and p["stratum2"] == "White")
    part = table[[1, 0]]
    expected = part.sum(1, keepdims=True) * part.sum(0) / part.sum()
    assert two["statistic"] == pytest.approx(((part - expected) ** 2 / expected).sum())
    assert two["diff_of_diffs"] == pytest.approx(25.0)


def test_pair_with_an_empty_column_has_no_p(spark):
    rows = [("d", r, g, "x", 10, 10) for r in ("A", "B") for g in ("MALE", "FEMALE")]
    pair = T.pairwise_strata(spark.createDataFrame(rows, RATES), "race_name", "gender_name", ("MALE", "FEMALE")).first()
    assert pair["p_value"] is None


def test_odds_ratio_skips_zero_reference(spark):
    rows = [("d", "A", "MALE", "x", 5, 10), ("d", "A", "FEMALE", "x", 0, 10), ("d", "B", "MALE", "x", 5, 10), ("d", "B", "FEMALE", "x", 10, 10)]
    found = T.stratum_odds_ratio(spark.createDataFrame(rows, RATES), ["race_name"], "gender_name", ("MALE", "FEMALE")).collect()
    assert [(r["race_name"], r["odds_ratio"]) for r in found] == [("B", 0.1)]


def test_bonferroni_ignores_untested(spark):
    df = spark.createDataFrame([("d", 0.001), ("d", 0.02), ("d", None), ("e", 0.04)], "name string, p_value double")
    rows = T.bonferroni(df, ["name"]).orderBy("name", "p_value").collect()
    assert [r["n_tests"] for r in rows] == [2, 2, 2, 1]
    assert [r["significant_corrected"] for r in rows] == [None, True, True, True]
    assert T.bonferroni(df).first()["n_tests"] == 3


def test_auto_counts_choices(spark):
    rows = []
    for variable, cells in {
        "large": [("a", 0, 20), ("a", 1, 9), ("b", 0, 15), ("b", 1, 30)],
        "small": [("a", 0, 3), ("a", 1, 1), ("b", 0, 1), ("b", 1, 3)],
        "wide": [("a", 0, 3), ("a", 1, 9), ("b", 0, 15), ("b", 1, 30), ("c", 0, 8), ("c", 1, 8)],
        "one": [("a", 0, 3), ("b", 0, 9)],
    }.items():
        rows += [(variable, *c) for c in cells]
    df = spark.createDataFrame(rows, "variable string, g string, v int, n long")
    found = {r["variable"]: r for r in T.auto_test_counts(df, "g", "v", "n", ["variable"]).collect()}
    assert set(found) == {"large", "small", "wide"}
    assert found["small"]["test_used"] == "Fisher's exact test"
    assert found["small"]["p_value"] == pytest.approx(0.4857142857) and found["small"]["effect_size"] == pytest.approx(9.0)
    assert found["large"]["test_used"] == "Chi-square test"
    assert found["wide"]["test_used"] == "Chi-square test (small cells)"


@pytest.fixture(scope="module")
def people(spark):
    rng = np.random.default_rng(5)
    n = 400
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "g": np.where(np.arange(n) % 2 == 0, "a", "b"),
            "g3": np.array(["x", "y", "z"])[np.arange(n) % 3],
            "normal": rng.normal(size=n) + (np.arange(n) % 2) * 0.5,
            "skewed": np.round(rng.exponential(size=n), 1),
            "constant": 1.0,
            "flag": (rng.random(n) < 0.3).astype(int),
        }
    )
    return pdf, spark.createDataFrame(pdf)


def test_rank_tests(people):
    pdf, df = people
    u = T.mann_whitney(df, "g", ["skewed"]).first()
    ranks = pdf["skewed"].rank()
    first = (pdf["g"] == "a").to_numpy()
    n1 = first.sum()
    assert u["statistic"] == pytest.approx(ranks[first].sum() - n1 * (n1 + 1) / 2)
    h = T.kruskal(df, "g3", ["skewed"]).first()
    n = len(pdf)
    sums = ranks.groupby(pdf["g3"]).agg(["sum", "size"])
    raw = 12 / (n * (n + 1)) * (sums["sum"] ** 2 / sums["size"]).sum() - 3 * (n + 1)
    ties = pdf["skewed"].value_counts().astype(float)
    assert h["statistic"] == pytest.approx(raw / (1 - (ties**3 - ties).sum() / (n**3 - n)))


def test_small_untied_samples_use_the_exact_tail(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    assert T.mann_whitney(df, "g", ["v"]).first()["p_value"] == pytest.approx(0.1)


def test_battery(people):
    _, df = people
    rows = {r["variable"]: r for r in T.compare_groups(df, "g", ["normal", "skewed", "constant"], ["flag"]).collect()}
    assert rows["normal"]["test_used"] == "Independent t-test" and rows["normal"]["significant"]
    assert rows["skewed"]["test_used"] == "Mann-Whitney U test"
    # A constant passes the normality gate; its t statistic is undefined.
    assert rows["constant"]["p_value"] is None and rows["constant"]["effect_size"] == 0
    tied = T.mann_whitney(df, "g", ["constant"]).first()
    assert tied["p_value"] == pytest.approx(1.0)
    assert rows["flag"]["groups"] == "Groups by g"


def test_battery_with_three_groups(people):
    _, df = people
    rows = {r["variable"]: r for r in T.compare_groups(df, "g3", ["normal"], ["flag"]).collect()}
    assert rows["normal"]["test_used"] == "Kruskal-Wallis test" and rows["normal"]["groups"] == "All 3 groups"
    assert rows["normal"]["effect_size"] is None


def test_battery_with_one_group_gives_nothing(people):
    _, df = people
    assert T.compare_groups(df.withColumn("g", F.lit("a")), "g", ["normal"], ["flag"]).count() == 0


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_shapiro_over_all_rows_is_that_of_the_values(spark, monkeypatch, small):
    """Ties, runs beyond the summed ends, tiny groups, a constant; both ways of ranking."""
    monkeypatch.setattr(T, "rank_values", lambda df, v, by: order_stats.rank_values(df, v, by, small_rows=small))
    rng = np.random.default_rng(3)
    groups = {
        "normal": rng.normal(100, 5, 3000), "skewed": rng.exponential(size=900), "tied": np.round(rng.normal(size=4000)),
        "third": np.where(rng.random(4900) < 0.33, 7.0, rng.normal(size=4900)), "same": np.ones(20),
        **{f"n{k}": rng.normal(size=k) for k in (1, 2, 3, 4, 5, 6, 11, 12)},
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["grp"]: r for r in T.normality_gate(df, "g", ["v"], "shapiro").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        w, p = tails.shapiro_wilk(values)
        assert got[g]["statistic"] == pytest.approx(w, abs=1e-6), g
        assert got[g]["p_value"] == pytest.approx(p, abs=1e-3), g
