"""Cohort building on a hand-written fixture."""

from datetime import date, datetime, timedelta

import pytest

from cohortry.operators import relational as R
from cohortry.plans.cohort import adult_persons, attrition, build_cohort, outcome_summary, surviving_visits

AS_OF = datetime(2020, 12, 31)
NTZ = "timestamp_ntz"
D0 = datetime(2020, 1, 10)


@pytest.fixture(scope="module")
def tables(spark):
    person = []
    visit = []
    death = []

    def add(pid, born=1950, provider=1, site=1, race=10, gender=20):
        person.append((pid, gender, born, datetime(born, 7, 1), race, 30, provider, site))

    def stay(vid, pid, start, days=2, provider=1, site=1, end="auto"):
        finish = start + timedelta(days=days) if end == "auto" else end
        visit.append((vid, pid, start, finish, provider, site))

    end = D0 + timedelta(days=2)
    # Days from discharge to death, one person each.
    for i, gap in enumerate([-3, -2, -1.5, -1, 0, 0.5, 30, 30.5]):
        add(100 + i)
        stay(1000 + i, 100 + i, D0)
        death.append((100 + i, (end + timedelta(days=gap)).date(), end + timedelta(days=gap)))
    add(1, born=2005)  # one visit at 14, one at 20
    stay(1, 1, datetime(2019, 5, 1))
    stay(2, 1, datetime(2020, 5, 1))
    add(2)  # null discharge survives
    stay(3, 2, D0, end=None)
    add(3)  # only visit ends in the future
    stay(4, 3, D0, end=datetime(2021, 2, 1))
    add(4)  # three visits: first flag and the last one
    for k in range(3):
        stay(10 + k, 4, D0 + timedelta(days=30 * k))
    add(5)  # too many visits
    for k in range(5):
        stay(20 + k, 5, D0 + timedelta(days=k))
    add(6)  # a null start counts as latest
    stay(30, 6, D0)
    stay(31, 6, None, end=D0)
    add(7)  # tied starts: the larger id is last
    stay(40, 7, D0)
    stay(41, 7, D0)
    add(8, provider=None)  # null matches null
    stay(50, 8, D0, provider=None)
    add(9, site=1)  # sites differ
    stay(60, 9, D0, site=2)
    add(10, race=None)
    stay(70, 10, D0)
    death += [(10, date(2019, 1, 1), None), (10, date(2020, 1, 14), None)]
    add(11)  # first visit in the future of the last surviving one is gone; flag stays false
    stay(80, 11, datetime(2019, 1, 1), end=datetime(2021, 3, 1))
    stay(81, 11, D0)
    return {
        "person": spark.createDataFrame(
            person,
            f"person_id long, gender_concept_id long, year_of_birth int, birth_datetime {NTZ}, race_concept_id long, "
            "ethnicity_concept_id long, provider_id long, care_site_id long",
        ),
        "visit": spark.createDataFrame(
            visit,
            f"visit_occurrence_id long, person_id long, visit_start_datetime {NTZ}, visit_end_datetime {NTZ}, "
            "provider_id long, care_site_id long",
        ),
        "death": spark.createDataFrame(death, f"person_id long, death_date date, death_datetime {NTZ}"),
        "concept": spark.createDataFrame(
            [(10, "African American", "S"), (20, "FEMALE", "S")],
            "concept_id long, concept_name string, standard_concept string",
        ),
    }


@pytest.fixture(scope="module")
def cohort(tables):
    t = tables
    made = build_cohort(t["person"], t["visit"], t["death"], t["concept"], AS_OF, max_visits=4)
    return {r["person_id"]: r for r in made.collect()}


def test_adults(tables):
    ids = {r[0] for r in adult_persons(tables["person"], tables["visit"]).select("person_id").collect()}
    assert 1 not in ids and {2, 3, 4}.issubset(ids)


def test_exclusions(cohort):
    # Under age, future discharge, too many visits, other site, death too early.
    assert not {1, 3, 5, 9, 100, 101, 10} & set(cohort)
    assert {2, 4, 6, 7, 8, 11} <= set(cohort)


@pytest.mark.parametrize(
    ("person", "hospital", "month"),
    [(102, False, False), (103, True, False), (104, True, False), (105, False, True), (106, False, True), (107, False, False)],
)
def test_mortality_labels(cohort, person, hospital, month):
    row = cohort[person]
    assert (row["died_in_hospital"], row["died_in_30_days"]) == (hospital, month)


def test_last_and_first_visit(cohort):
    assert (cohort[4]["visit_occurrence_id"], cohort[4]["first_visit"]) == (12, False)
    assert cohort[6]["visit_occurrence_id"] == 31
    assert cohort[7]["visit_occurrence_id"] == 41
    assert (cohort[11]["visit_occurrence_id"], cohort[11]["first_visit"]) == (81, False)
    assert cohort[2]["first_visit"] is True


def test_names_and_counts(cohort):
    assert (cohort[4]["race_name"], cohort[4]["gender_name"], cohort[4]["num_visits"]) == ("Black", "FEMALE", 1)


def test_missing_race_and_all_visits(tables):
    t = tables
    made = build_cohort(
        t["person"], t["visit"], t["death"].where("person_id <> 10"), t["concept"], AS_OF, 4, count_all_visits=True
    )
    rows = {r["person_id"]: r for r in made.collect()}
    assert rows[10]["race_name"] == "Not Reported"
    assert rows[4]["num_visits"] == 3


def test_site_match_can_be_switched_off(tables):
    t = tables
    made = build_cohort(t["person"], t["visit"], t["death"], t["concept"], AS_OF, 4, match_site=False)
    assert made.where("person_id = 9").count() == 1


def test_cohort_is_the_same_when_a_person_is_split(tables, cohort, monkeypatch):
    from cohortry.plans import cohort as plan

    split = []

    def forced(fact, dim, key, row_id, how="inner"):
        split.append(R.hot_keys(fact, key, min_rows=1))
        return R.skew_join(fact, dim, key, row_id, how, min_rows=1)

    monkeypatch.setattr(plan, "skew_join", forced)
    t = tables
    made = build_cohort(t["person"], t["visit"], t["death"], t["concept"], AS_OF, max_visits=4)
    assert {r["person_id"]: r for r in made.collect()} == cohort and split[0]


def test_attrition(tables):
    t = tables
    rows = {r["step_no"]: r for r in attrition(t["person"], t["visit"], t["death"], AS_OF, 4).collect()}
    assert (rows[1]["rows_removed"], rows[1]["people_affected"]) == (2, 2)
    assert (rows[2]["rows_removed"], rows[2]["people_affected"]) == (3, 3)
    assert (rows[3]["rows_removed"], rows[3]["people_affected"]) == (5, 1)


def test_outcomes_by_group(tables):
    from pyspark.sql import functions as F

    t = tables
    visits = surviving_visits(t["person"], t["visit"], t["death"], AS_OF).withColumn("race_name", F.lit("Black"))
    row = outcome_summary(visits).first()
    assert row["readmitted"] == 4 and row["max_readmissions"] == 4
    assert row["died_hospital"] == 2 and row["died_30_days"] == 2 and row["died_total"] == 4


def test_visit_table_is_shuffled_once(tables):
    t = tables
    made = build_cohort(t["person"], t["visit"], t["death"], t["concept"], AS_OF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
