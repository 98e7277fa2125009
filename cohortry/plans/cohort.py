"""Cohort building: adults, demographics, exclusions, mortality labels, last visit per person."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expr import day_diff, death_timing, frac_days, mortality_labels, recode
from cohortry.operators.relational import first_per_key, last_per_key, lookup, skew_join

# Source race name -> reporting group.
RACE_GROUPS: dict[str, str] = {
    "White": "White",
    "Race not stated": "Not Reported",
    "Asian Indian": "Asian",
    "African American": "Black",
    "Other": "Not Reported",
    "No matching concept": "Not Reported",
    "American Indian or Alaska Native": "American Indian or Alaska Native",
    "Other Pacific Islander": "Native Hawaiian or Other Pacific Islander",
    "More than one race": "Mixed",
    "Black or African American": "Black",
    "Asian": "Asian",
    "American Indian": "American Indian or Alaska Native",
    "Native Hawaiian or Other Pacific Islander": "Native Hawaiian or Other Pacific Islander",
    "Unknown racial group": "Not Reported",
}

MAX_VISITS = 50
MIN_AGE = 18


def adult_persons(person: DataFrame, visit: DataFrame, min_age: int = MIN_AGE) -> DataFrame:
    """Persons with at least one visit and no visit under ``min_age``.

    The year of birth is fixed per person, so the earliest visit year decides; visits
    are reduced to one row per person before they meet the person table.
    """
    seen = visit.groupBy("person_id").agg(F.min(F.year("visit_start_datetime")).alias("__year"))
    under = F.coalesce(F.col("__year") - F.col("year_of_birth") < min_age, F.lit(False))
    return person.distinct().join(seen, "person_id").where(~under).select(person.columns)


def add_demographics(
    person: DataFrame,
    concept: DataFrame,
    race_map: Mapping[str, str] = RACE_GROUPS,
    missing_race: str | None = "Not Reported",
    codes_from: DataFrame | None = None,
) -> DataFrame:
    """Add ``race_name`` (grouped) and ``gender_name``; ``codes_from`` as in :func:`lookup`.

    A person without a race concept gets ``missing_race``; with ``None`` such a person,
    like any name outside ``race_map``, has a null race.
    """
    columns = {"race_concept_id": "__race", "gender_concept_id": "gender_name"}
    named = lookup(person, columns, concept, "concept_id", "concept_name", codes_from)
    grouped = recode("__race", race_map)
    if missing_race is not None:
        grouped = F.when(F.col("__race").isNull(), F.lit(missing_race)).otherwise(grouped)
    head = [c for c in named.columns if c not in columns.values()]
    return named.select(*head, grouped.alias("race_name"), "gender_name")


def first_death(death: DataFrame) -> DataFrame:
    """Earliest death record per person and the moment it stands for."""
    one = first_per_key(
        death.select("person_id", "death_date", "death_datetime"),
        ["person_id"],
        ["death_date", "death_datetime"],
        nulls_first=True,
    )
    return one.withColumn("death_at", F.coalesce("death_datetime", F.col("death_date").cast("timestamp_ntz")))


def _moment(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def _judged_visits(person: DataFrame, visit: DataFrame, death: DataFrame, as_of) -> DataFrame:
    """Visits of adults with the outcome of every exclusion as columns; nothing removed yet.

    Persons and deaths form one row per person, so the visit table is shuffled once, on
    ``person_id``, and the aggregates that follow reuse that layout.
    """
    subject = adult_persons(person, visit).select("person_id").join(
        first_death(death).select("person_id", "death_at"), "person_id", "left"
    )
    limit = F.current_timestamp() if as_of is None else F.lit(as_of)
    days = frac_days(F.col("death_at"), _moment("visit_end_datetime"))
    rows = skew_join(visit, subject, "person_id", "visit_occurrence_id").withColumn("__days", days)
    future = F.coalesce(_moment("visit_end_datetime") > limit.cast("timestamp_ntz"), F.lit(False))
    early = F.coalesce(F.col("__days") <= -2, F.lit(False))
    return rows.withColumns({"__future": future, "__early": ~future & early})


def surviving_visits(person: DataFrame, visit: DataFrame, death: DataFrame, as_of=None) -> DataFrame:
    """Visits left after the two date exclusions, with mortality labels and ``first_visit``.

    The visit-count limit is not applied: it needs the whole person.
    """
    rows = _judged_visits(person, visit, death, as_of)
    order = F.struct(F.col("visit_start_datetime").isNull(), "visit_start_datetime", "visit_occurrence_id")
    firsts = (
        visit.groupBy("person_id")
        .agg(F.min_by("visit_occurrence_id", order).alias("visit_occurrence_id"))
        .select("visit_occurrence_id", F.lit(True).alias("first_visit"))
    )
    kept = rows.where(~F.col("__future") & ~F.col("__early")).join(firsts, "visit_occurrence_id", "left")
    return (
        kept.withColumns(
            {"first_visit": F.coalesce("first_visit", F.lit(False)), **mortality_labels("__days")}
        ).drop("__days", "__future", "__early", "death_at")
    )


def build_cohort(
    person: DataFrame,
    visit: DataFrame,
    death: DataFrame,
    concept: DataFrame,
    as_of=None,
    max_visits: int = MAX_VISITS,
    min_age: int = MIN_AGE,
    race_map: Mapping[str, str] = RACE_GROUPS,
    missing_race: str | None = "Not Reported",
    match_site: bool = True,
    count_all_visits: bool = False,
) -> DataFrame:
    """One row per adult: the person joined to the last surviving visit.

    Order of the exclusions: discharge after ``as_of`` (default now), death two or more
    days before discharge, more than ``max_visits`` remaining visits. Null dates never
    exclude. ``first_visit`` is decided before the exclusions. With ``match_site`` the
    person's provider and care site must equal the visit's, nulls matching nulls.

    ``num_visits`` counts the visits of the final table, hence 1; ``count_all_visits``
    gives the number of surviving visits instead.

    One join and one aggregate on ``person_id`` do all of it: the visit table is read
    once and shuffled once. A person with very many visits is split over tasks, and the
    aggregate then reduces the parts before it shuffles.
    """
    subject = (
        person.select("person_id", F.col("year_of_birth").alias("__yob"))
        .distinct()
        .join(first_death(death).select("person_id", "death_at"), "person_id", "left")
    )
    limit = (F.current_timestamp() if as_of is None else F.lit(as_of)).cast("timestamp_ntz")
    end = _moment("visit_end_datetime")
    rows = skew_join(visit, subject, "person_id", "visit_occurrence_id")
    rows = rows.withColumn("__days", frac_days("death_at", end))
    gone = F.coalesce(end > limit, F.lit(False)) | F.coalesce(F.col("__days") <= -2, F.lit(False))
    start_order = F.struct(
        F.col("visit_start_datetime").isNull().alias("n"),
        F.col("visit_start_datetime").alias("v"),
        F.col("visit_occurrence_id").alias("t"),
    )
    visit_columns = [c for c in visit.columns if c != "person_id"]
    last = F.max_by(
        F.struct(*visit_columns, "__days"), F.when(~gone, start_order)
    )
    per_person = rows.groupBy("person_id").agg(
        F.min(F.year("visit_start_datetime") - F.col("__yob")).alias("__age"),
        F.count(F.when(~gone, F.lit(1))).alias("__n"),
        F.min_by("visit_occurrence_id", start_order).alias("__first"),
        last.alias("__last"),
    )
    kept = per_person.where(
        ~F.coalesce(F.col("__age") < min_age, F.lit(False)) & F.col("__n").between(1, max_visits)
    )
    clash = [c for c in visit_columns if c in person.columns]
    picked = kept.select(
        "person_id",
        (F.col("__n") if count_all_visits else F.lit(1).cast("long")).alias("num_visits"),
        *[F.col(f"__last.{c}").alias(f"__v_{c}" if c in clash else c) for c in visit_columns],
        (F.col("__first") == F.col("__last.visit_occurrence_id")).alias("first_visit"),
        *[flag.alias(name) for name, flag in mortality_labels(F.col("__last.__days")).items()],
    )
    joined = add_demographics(person.distinct().join(picked, "person_id"), concept, race_map, missing_race, person)
    if match_site:
        for name in clash:
            joined = joined.where(F.col(name).eqNullSafe(F.col(f"__v_{name}")))
    joined = joined.drop(*[f"__v_{c}" for c in clash])
    head = [*person.columns, "race_name", "gender_name", "num_visits"]
    return joined.select(*head, *[c for c in joined.columns if c not in head])


def attrition(
    person: DataFrame, visit: DataFrame, death: DataFrame, as_of=None, max_visits: int = MAX_VISITS
) -> DataFrame:
    """Rows and people touched by every exclusion, in the order they apply."""
    per_person = _judged_visits(person, visit, death, as_of).groupBy("person_id").agg(
        F.sum(F.col("__future").cast("long")).alias("future"),
        F.sum(F.col("__early").cast("long")).alias("early"),
        F.sum((~F.col("__future") & ~F.col("__early")).cast("long")).alias("left"),
    )
    many = F.when(F.col("left") > max_visits, F.col("left")).otherwise(0)
    steps = {
        "discharge in the future": F.col("future"),
        "death two or more days before discharge": F.col("early"),
        "too many visits": many,
    }
    totals = per_person.agg(
        *[F.coalesce(F.sum(v), F.lit(0)).alias(f"r{i}") for i, v in enumerate(steps.values())],
        *[F.count(F.when(v > 0, F.lit(1))).alias(f"p{i}") for i, v in enumerate(steps.values())],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_no"),
                F.lit(name).alias("step"),
                F.col(f"r{i}").alias("rows_removed"),
                F.col(f"p{i}").alias("people_affected"),
            )
            for i, name in enumerate(steps)
        ]
    )
    return totals.select(F.explode(rows).alias("s")).select("s.*")


def outcome_summary(visits: DataFrame, by: str = "race_name") -> DataFrame:
    """People, readmissions and mortality per group, from one row per visit.

    Everything is counted per person first. The median runs over visit counts, which
    take few distinct values, so the built-in exact aggregate stays small.
    """
    def ever(condition: Column) -> Column:
        return F.max(condition.cast("int"))

    hospital, month = F.col("died_in_hospital"), F.col("died_in_30_days")
    people = visits.where(F.col(by).isNotNull()).groupBy(by, "person_id").agg(
        F.count(F.lit(1)).alias("visits"),
        ever(F.col("first_visit") & (hospital | month)).alias("first"),
        ever(hospital).alias("hospital"),
        ever(month).alias("month"),
        ever(hospital | month).alias("total"),
    )
    again = F.col("visits") - 1
    counts = people.groupBy(by).agg(
        F.sum("visits").alias("visits"),
        F.count(F.lit(1)).alias("people"),
        F.sum("first").alias("first_visit_deaths"),
        F.count(F.when(again > 0, F.lit(1))).alias("readmitted"),
        F.avg(again).alias("mean_readmissions"),
        F.median(again).alias("median_readmissions"),
        F.max(again).alias("max_readmissions"),
        F.sum("hospital").alias("died_hospital"),
        F.sum("month").alias("died_30_days"),
        F.sum("total").alias("died_total"),
    )
    shares = ["first_visit_deaths", "readmitted", "died_hospital", "died_30_days", "died_total"]
    return counts.withColumns({f"{c}_pct": F.col(c) / F.col("people") * 100 for c in shares})


def death_after_latest_discharge(
    visits: DataFrame, deaths: DataFrame, persons: DataFrame, min_age: int = MIN_AGE
) -> DataFrame:
    """Latest adult visit against latest death: days between and a timing label."""
    people = persons.select("person_id", "year_of_birth")
    old_enough = skew_join(visits, people, "person_id", "visit_occurrence_id").where(
        F.year("visit_start_datetime") - F.col("year_of_birth") >= min_age
    )
    columns = ["person_id", "visit_occurrence_id", "visit_start_datetime", "visit_end_datetime"]
    latest = last_per_key(
        old_enough.select(columns), ["person_id"], ["visit_end_datetime", "visit_occurrence_id"], nulls_last=False
    )
    died = deaths.where(F.col("death_datetime").isNotNull()).groupBy("person_id").agg(
        F.max("death_datetime").alias("death_datetime")
    )
    joined = latest.join(died, "person_id")
    return joined.select(
        "person_id",
        "visit_occurrence_id",
        "visit_start_datetime",
        F.col("visit_end_datetime").alias("latest_discharge_datetime"),
        "death_datetime",
        day_diff("death_datetime", "visit_end_datetime").alias("days_to_death"),
        death_timing("visit_start_datetime", "visit_end_datetime", "death_datetime").alias("death_timing"),
    )
