"""Vocabulary expansion, flags and rates on a hand-written vocabulary."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cohortry.plans import exposures as X
from cohortry.plans.rates import drug_rate_analysis, drug_rates
from cohortry.plans.reports import figure_table, stratum_report
from cohortry.sources.tables import seed_relation


@pytest.fixture(scope="module")
def v(spark):
    concept = [(1, None), (11, None), (12, None), (21, None), (22, None), (31, "S"), (32, "S"), (33, None), (41, "S")]
    links = [
        (1, 11, "Subsumes"),
        (1, 12, "Subsumes"),
        (1, 41, "Is a"),  # wrong type
        (11, 21, "SNOMED - RxNorm eq"),
        (12, 22, "SNOMED - RxNorm eq"),
        (12, 99, "SNOMED - RxNorm eq"),  # unknown concept
        (21, 31, "Maps to"),
        (21, 33, "Maps to"),  # not standard
        (22, 31, "Has form"),  # second way to the same concept
        (22, 32, "Maps to"),
    ]
    start = datetime(2020, 3, 1)
    cohort = [
        (1, 100, 1940, start, "White", "MALE"),
        (2, 200, 1990, start, "White", "FEMALE"),
        (3, 300, 1990, start, "Mixed", "MALE"),
        (4, 400, 1990, start, None, "MALE"),
        (5, 500, None, start, "Asian", "FEMALE"),
    ]
    visits = [(100, 1), (101, 1), (200, 2), (300, 3), (400, 4), (500, 6)]
    exposures = [(31, 100), (31, 100), (32, 101), (32, 200), (33, 300), (41, 300), (31, 400), (31, 500)]
    return {
        "concept": spark.createDataFrame([(i, f"c{i}", s) for i, s in concept], "concept_id long, concept_name string, standard_concept string"),
        "links": spark.createDataFrame(links, "concept_id_1 long, concept_id_2 long, relationship_id string"),
        "cohort": spark.createDataFrame(
            cohort,
            "person_id long, visit_occurrence_id long, year_of_birth int, visit_start_datetime timestamp_ntz, race_name string, gender_name string",
        ),
        "visit": spark.createDataFrame(
            [(a, b, date(2020, 3, 1)) for a, b in visits], "visit_occurrence_id long, person_id long, visit_start_date date"
        ),
        "exposure": spark.createDataFrame(exposures, "drug_concept_id long, visit_occurrence_id long"),
        "person": spark.createDataFrame([(1, 1940), (2, 1990), (3, 1990), (4, 2010), (6, 1950)], "person_id long, year_of_birth int"),
        "seeds": seed_relation(spark, {"d": [1, 1, 77]}, "name"),
    }


def test_expansion(v):
    got = sorted(r["concept_id"] for r in X.expand_concepts(v["seeds"], v["links"], v["concept"], "name").collect())
    assert got == [31, 32]


def test_exposed_visits_and_age(v):
    expanded = X.expand_concepts(v["seeds"], v["links"], v["concept"], "name")
    got = X.exposed_visits(expanded, v["exposure"], v["visit"], label="name")
    assert sorted(r["visit_occurrence_id"] for r in got.collect()) == [100, 101, 200, 400, 500]
    adults = X.exposed_visits(expanded, v["exposure"], v["visit"], v["person"], 18, label="name")
    assert sorted(r["visit_occurrence_id"] for r in adults.collect()) == [100, 101, 200, 500]


def test_flags_default_to_zero(v, spark):
    seeds = v["seeds"].withColumnRenamed("name", "drug_class")
    got = X.drug_flags(v["cohort"], seeds, v["links"], v["concept"], v["exposure"], v["visit"], v["person"], ["d"])
    assert {r["person_id"]: r["d_flag"] for r in got.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0}


def _rates(v, **options):
    found = drug_rates(v["cohort"], v["seeds"], v["links"], v["concept"], v["exposure"], v["visit"], **options)
    return {(r["race_name"], r["gender_name"], r["age_group"]): (r["cnt"], r["base_count"]) for r in found.collect()}


def test_rates_lump_races_once(v):
    # A race outside the list and an unknown race make one group; visit 500 belongs to somebody else.
    assert _rates(v) == {("White", "MALE", "65+"): (1, 1), ("White", "FEMALE", "<65"): (1, 1), ("Other", "MALE", "<65"): (1, 2)}


def test_rates_with_empty_groups(v):
    got = _rates(v, keep_empty_groups=True)
    assert got[("Asian", "FEMALE", "<65")] == (0, 1) and len(got) == 4


def test_analysis_returns_every_part(v):
    found = drug_rate_analysis(v["cohort"], v["seeds"], v["links"], v["concept"], v["exposure"], v["visit"])
    assert {"rates", "margins", "overall_gender", "overall_age", "pairs_gender", "pairs_age", "interaction_race_gender", "corrected"} <= set(found)
    white = found["gender_within_race"].where("race_name = 'White'").first()
    assert white["test_used"] == "Fisher's exact" and white["difference"] == 0
    by_gender = drug_rate_analysis(v["cohort"], v["seeds"], v["links"], v["concept"], v["exposure"], v["visit"], by_age=False)
    assert "pairs_gender" not in by_gender and by_gender["corrected"].count() == 1


def test_device_flags_keep_or_drop_unmatched(v, spark):
    devices = spark.createDataFrame([(1, 100, 9), (2, 201, 9), (3, 300, 8)], "person_id long, visit_occurrence_id long, device_concept_id long")
    sets = X.device_sets(spark.createDataFrame([(9, "4"), (8, "2"), (7, "5")], "concept_id long, Mapping string"))
    kept = X.device_flags(v["cohort"], devices, sets, exclude=[8])
    assert kept.count() == v["cohort"].count()
    assert [r["person_id"] for r in kept.where("mechanical_ventilation = 1").collect()] == [1]
    assert X.device_flags(v["cohort"], devices, sets, exclude=[8], keep_unmatched=False).count() == 1


def test_conditions_match_exact_pairs(v, spark):
    rows = [(1, 100, 32901.0), (1, 200, 32890.0), (2, 200, None), (3, 300, 5.0)]
    condition = spark.createDataFrame(rows, "person_id long, visit_occurrence_id long, condition_status_concept_id double")
    got = sorted((r["person_id"], r["condition_status_concept_id"]) for r in X.cohort_conditions(v["cohort"], condition).collect())
    assert got == [(1, 32890), (2, 0), (3, 5)]


def test_enrichment(v, spark):
    cohort = v["cohort"].withColumn("ethnicity_concept_id", F.when(F.col("person_id") < 3, F.lit(1)).otherwise(F.lit(5)))
    names = spark.createDataFrame([(1, "No matching concept")], "concept_id int, concept_name string")
    sites = spark.createDataFrame([(1, "SITE-3"), (2, "SITE-9")], "person_id long, src_name string")
    got = {r["person_id"]: r for r in X.enrich_site(cohort, names, sites).collect()}
    assert (got[1]["ethnicity_name"], got[1]["site_location"], got[2]["site_location"]) == ("Unknown", "SW", None)
    assert got[3]["ethnicity_name"] is None and got[3]["race_name"] == "Other" and got[4]["race_name"] is None


def test_exposure_scan_is_not_shuffled_before_filtering(v):
    expanded = X.expand_concepts(v["seeds"], v["links"], v["concept"], "name")
    plan = X.exposed_visit_ids(expanded, v["exposure"], "name")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_stratum_report_levels(spark):
    flags = spark.sql(
        """SELECT 'Mixed' AS race_name, 'MALE' AS gender_name, 'SW' AS site_location,
             TIMESTAMP_NTZ '1950-01-01' AS birth_datetime, TIMESTAMP_NTZ '2020-01-01' AS visit_start_datetime,
             TIMESTAMP_NTZ '2020-01-02 23:00' AS visit_end_datetime, true AS died_in_hospital, false AS died_in_30_days,
             1 AS steroid_flag, 0 AS narcotic_flag, 0 AS sedative_flag, 0 AS vasopressor_flag, CAST(NULL AS INT) AS nasal_canula_mask,
             1 AS hiflo_oximyzer, 0 AS cpap_bipap, 0 AS mechanical_ventilation, 0 AS ecmo, 0 AS dialysis"""
    )
    means = stratum_report(flags)
    row = means.first()
    assert (row["race_name"], row["gender_name"], row["site_location"]) == (None, "Male", "SW")
    assert (row["mean_age"], row["mean_los"], row["mean_total"], row["mean_de"]) == (70.0, 1.0, 2.0, None)
    table = figure_table(means, ["race_name"])
    assert table.count() == 17 and table.where("metric = 'mean_age'").first()["bar_label"] == 7000.0
