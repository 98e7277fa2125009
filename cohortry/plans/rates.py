"""Stratified treatment rates and the tests on them, for many named concept lists at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expr import age_band, age_year_diff, lump_other, rate
from cohortry.operators.relational import add_rate, count_distinct_by, margins, sized_broadcast
from cohortry.operators.tests_of_difference import (
    bonferroni,
    interaction_test,
    pairwise_strata,
    stratified_rate_diff,
    stratum_odds_ratio,
)
from cohortry.plans.exposures import expand_concepts, exposed_cohort_rows

# Race groups that keep their name, and the compared levels.
KEPT_RACES = ("White", "Black", "Asian", "Not Reported")
GENDERS = ("MALE", "FEMALE")
AGES = ("65+", "<65")

STRATA = ("race_name", "gender_name", "age_group")


def with_age_group(cohort: DataFrame, cut: int = 65) -> DataFrame:
    age = age_year_diff("visit_start_datetime", "year_of_birth")
    return cohort.withColumns({"age_at_visit": age, "age_group": age_band(age, cut)})


def drug_rates(
    cohort: DataFrame,
    seeds: DataFrame,
    relationship: DataFrame,
    concept: DataFrame,
    exposure: DataFrame,
    visit: DataFrame,
    strata: Sequence[str] = STRATA,
    label: str = "name",
    lump_races: Sequence[str] | None = KEPT_RACES,
    keep_empty_groups: bool = False,
    distinct_base: bool = False,
) -> DataFrame:
    """People exposed (``cnt``) against cohort size (``base_count``) per list and stratum.

    ``seeds`` has one row per (list name, concept). Races outside ``lump_races`` are
    lumped before counting, so "Other" is one group. A stratum without an exposed person
    only appears with ``keep_empty_groups``.
    """
    people = with_age_group(cohort)
    if lump_races is not None:
        people = people.withColumn("race_name", lump_other("race_name", lump_races, null_as_other=True))
    slim = people.select("person_id", "visit_occurrence_id", *strata).dropna(subset=list(strata))
    expanded = expand_concepts(seeds, relationship, concept, label)
    exposed = exposed_cohort_rows(slim, expanded, exposure, visit, label)
    counts = count_distinct_by(exposed, [label, *strata], "person_id", "cnt")
    if distinct_base:
        base = count_distinct_by(slim, strata, "person_id", "base_count")
    else:
        base = slim.groupBy(*strata).agg(F.count(F.lit(1)).alias("base_count"))
    base = sized_broadcast(base)
    if keep_empty_groups:
        every = seeds.select(label).distinct().withColumn("__k", F.lit(1))
        grid = base.withColumn("__k", F.lit(1)).join(every, "__k").drop("__k")
        joined = grid.join(counts, [label, *strata], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    else:
        joined = counts.join(base, list(strata), "left").withColumn(
            "base_count", F.coalesce("base_count", F.lit(0))
        )
    return add_rate(joined.select(label, *strata, "cnt", "base_count"))


def rate_margins(rates: DataFrame, sets: Sequence[Sequence[str]], label: str = "name") -> DataFrame:
    """Roll-ups of the counts over several groupings, with rates."""
    rolled = margins(rates, sets, ["cnt", "base_count"], [label])
    return rolled.withColumn("percentage", rate("cnt", "base_count"))


def _test_rows(df: DataFrame, family: str, label: str, first, second=None) -> DataFrame:
    return df.select(
        label,
        F.lit(family).alias("family"),
        first.alias("stratum"),
        (second if second is not None else F.lit(None).cast("string")).alias("stratum2"),
        F.col("difference" if "difference" in df.columns else "diff_of_diffs").alias("difference"),
        "p_value",
        "significant",
    )


def drug_rate_analysis(
    cohort: DataFrame,
    seeds: DataFrame,
    relationship: DataFrame,
    concept: DataFrame,
    exposure: DataFrame,
    visit: DataFrame,
    label: str = "name",
    by_age: bool = True,
    alpha: float = 0.05,
    **options,
) -> Mapping[str, DataFrame]:
    """The whole analysis for every named list in one job.

    The rates are computed once and checkpointed (a row per list and stratum); margins,
    differences within strata, interactions, pairs and the correction run on that.
    ``by_age=False`` leaves out the age dimension.
    """
    strata = STRATA if by_age else STRATA[:2]
    options.setdefault("lump_races", KEPT_RACES if by_age else None)
    rates = drug_rates(
        cohort, seeds, relationship, concept, exposure, visit, strata=strata, label=label, **options
    ).checkpoint()
    race, gender, age = STRATA
    by = [label]

    def diff(stratum: str, arm: str, levels) -> DataFrame:
        return stratified_rate_diff(rates, [label, stratum], arm, levels, alpha=alpha)

    out: dict[str, DataFrame] = {"rates": rates}
    overall = rates.withColumn("scope", F.lit("all"))
    arms = {"gender": (gender, GENDERS)} | ({"age": (age, AGES)} if by_age else {})
    for name, (arm, levels) in arms.items():
        out[f"overall_{name}"] = stratified_rate_diff(
            overall, [label, "scope"], arm, levels, cutoff=0, alpha=alpha
        )
    sets = [[gender], [race, gender]] + ([[age], [gender, age], [race, age]] if by_age else [])
    out["margins"] = rate_margins(rates, sets, label)
    families = {"gender within race": diff(race, gender, GENDERS)}
    if by_age:
        families["gender within age"] = diff(age, gender, GENDERS)
        families["age within gender"] = diff(gender, age, AGES)
    inner = {"gender within race": race, "gender within age": age, "age within gender": gender}
    tests = [_test_rows(df, family, label, F.col(inner[family])) for family, df in families.items()]
    if by_age:  # the comparison between races belongs to the age-stratified form
        for name, (arm, levels) in arms.items():
            out[f"odds_{name}_by_race"] = stratum_odds_ratio(rates, [label, race], arm, levels)
            out[f"interaction_race_{name}"] = interaction_test(rates, race, arm, levels, by)
            out[f"pairs_{name}"] = pairwise_strata(rates, race, arm, levels, by, alpha=alpha)
            tests.append(
                _test_rows(
                    out[f"pairs_{name}"], f"{name} between races", label, F.col("stratum1"), F.col("stratum2")
                )
            )
    out |= {family.replace(" ", "_"): df for family, df in families.items()}
    every = reduce(lambda a, b: a.unionByName(b), tests)
    out["corrected"] = bonferroni(every, by, alpha)
    return out
