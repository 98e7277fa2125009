"""Vocabulary expansion and treatment flags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expr import fill_cast, recode
from cohortry.operators.relational import (
    attach_flags,
    attribute,
    join_flags,
    lookup,
    pivot_flags,
    restrict_to,
    semi_join,
    sized_broadcast,
)

# Relationship type of each hop; None leaves it unrestricted.
DRUG_PATH: tuple[str | None, ...] = ("Subsumes", "SNOMED - RxNorm eq", None)
# Seed concepts of the drug classes.
DRUG_SEEDS: dict[str, list[int]] = {
    "steroid": [36681928, 4228567, 36682298],
    "narcotic": [36681676, 36681935],
    "sedative": [36682329, 4252075],
    "vasopressor": [4276507, 4183404, 4009018, 4322956, 4132146],
}
# Output flag -> category in the mapping file.
PROCEDURE_SETS = {"ecmo": "ECMO", "dialysis": "dialysis"}
DEVICE_SETS = {"nasal_canula_mask": "1", "hiflo_oximyzer": "2", "cpap_bipap": "3", "mechanical_ventilation": "4"}
EXCLUDED_DEVICES = (4164918,)
# Condition status codes that mean the same.
CONDITION_STATUS = {32890: 32890, 32901: 32890, 32907: 32890}
# Site -> region, and the coarse race groups of the enriched table.
SITE_REGION = {
    "SITE-1": "MW",
    "SITE-2": "SE",
    "SITE-3": "SW",
    "SITE-4": "MW",
    "SITE-5": "NE",
    "SITE-6": "NE",
    "SITE-7": "SE",
    "SITE-8": "SE",
}
COARSE_RACE = {
    "American Indian or Alaska Native": "Other",
    "Native Hawaiian or Other Pacific Islander": "Other",
    "Asian": "Asian",
    "Black": "Black",
    "White": "White",
    "Not Reported": "Not Reported",
    "Mixed": "Other",
}
VISIT_KEY = ("person_id", "visit_occurrence_id")


def expand_concepts(
    seeds: DataFrame,
    relationship: DataFrame,
    concept: DataFrame,
    label: str = "drug_class",
    path: Sequence[str | None] = DRUG_PATH,
) -> DataFrame:
    """Follow ``path`` from the seed concepts to standard concepts: ``(label, concept_id)``.

    Every hop is a join from the small side, reduced to distinct rows before the next
    one. Each concept reached must exist; the last one must be standard.
    """
    known = concept.select("concept_id")
    reached = seeds.select(label, "concept_id").distinct().join(known, "concept_id", "left_semi")
    for hop, kind in enumerate(path, start=1):
        links = relationship if kind is None else relationship.where(F.col("relationship_id") == kind)
        links = links.select(F.col("concept_id_1").alias("concept_id"), F.col("concept_id_2").alias("__next"))
        target = known if hop < len(path) else concept.where(F.col("standard_concept") == "S").select("concept_id")
        reached = (
            reached.join(links, "concept_id")
            .select(label, F.col("__next").alias("concept_id"))
            .distinct()
            .join(target, "concept_id", "left_semi")
        )
    return reached.select(label, "concept_id")


def exposed_visit_ids(
    expanded: DataFrame, exposure: DataFrame, label: str = "drug_class", concept: str = "drug_concept_id"
) -> DataFrame:
    """Distinct ``(label, visit_occurrence_id)`` with an exposure to one of the concepts.

    The concept list is broadcast once its size is checked, so the exposure table is
    filtered where it is read; repeats collapse before anything else is joined.
    """
    wanted = sized_broadcast(expanded.withColumnRenamed("concept_id", concept))
    return exposure.select(concept, "visit_occurrence_id").join(wanted, concept).select(
        label, "visit_occurrence_id"
    ).distinct()


def exposed_visits(
    expanded: DataFrame,
    exposure: DataFrame,
    visit: DataFrame,
    person: DataFrame | None = None,
    min_age: int | None = None,
    start: str = "visit_start_date",
    label: str = "drug_class",
    concept: str = "drug_concept_id",
) -> DataFrame:
    """Distinct ``(person, visit, label)``; with ``min_age`` only visits at that age or above."""
    columns = [*VISIT_KEY] + ([start] if min_age is not None else [])
    found = exposed_visit_ids(expanded, exposure, label, concept).join(visit.select(*columns), "visit_occurrence_id")
    if min_age is not None:
        born = person.select("person_id", "year_of_birth")
        found = found.join(born, "person_id").where(F.year(start) - F.col("year_of_birth") >= min_age)
    return found.select(*VISIT_KEY, label).distinct()


def exposed_cohort_rows(
    cohort: DataFrame, expanded: DataFrame, exposure: DataFrame, visit: DataFrame, label: str
) -> DataFrame:
    """Distinct cohort rows per label whose visit had such an exposure.

    Only cohort visits matter, so the exposures meet the cohort, not the visit table;
    a cohort row counts only if its (person, visit) pair is a recorded visit.
    """
    recorded = restrict_to(cohort, visit, VISIT_KEY)
    hits = exposed_visit_ids(expanded, exposure, label)
    return recorded.join(hits, "visit_occurrence_id").distinct()


def drug_flags(
    cohort: DataFrame,
    seeds: DataFrame,
    relationship: DataFrame,
    concept: DataFrame,
    exposure: DataFrame,
    visit: DataFrame,
    person: DataFrame,
    classes: Sequence[str] = tuple(DRUG_SEEDS),
    min_age: int = 18,
) -> DataFrame:
    """Cohort plus one 0/1 flag per drug class."""
    expanded = expand_concepts(seeds, relationship, concept)
    if {"visit_start_date", "year_of_birth"} <= set(cohort.columns):
        # Only visits of the cohort can carry a flag, and the cohort knows their age.
        aged = F.year("visit_start_date") - F.col("year_of_birth") >= min_age
        visits = restrict_to(cohort.where(aged).select(*VISIT_KEY), visit, VISIT_KEY)
        found = exposed_visit_ids(expanded, exposure).join(visits, "visit_occurrence_id")
    else:
        found = exposed_visits(expanded, exposure, visit, person, min_age)
    wide = pivot_flags(found, VISIT_KEY, "drug_class", {f"{c}_flag": c for c in classes})
    return attach_flags(cohort, wide, VISIT_KEY, default=0)


def event_flags(
    cohort: DataFrame,
    events: DataFrame,
    event_concept: str,
    sets: DataFrame,
    names: Sequence[str],
    exclude: Sequence[int] = (),
    keep_unmatched: bool = True,
    carry: Sequence[str] = ("race_name", "gender_name"),
) -> DataFrame:
    """Flags from an event table, one row per cohort visit, 0 where nothing matched.

    ``sets`` has ``(label, concept_id)``. Events are reduced to one row per visit before
    they meet the cohort. ``keep_unmatched=False`` keeps only visits with an event whose
    concept is listed (and not excluded).
    """
    listed = sized_broadcast(sets.withColumnRenamed("concept_id", event_concept))
    rows = events.select(*VISIT_KEY, event_concept)
    if exclude:
        rows = rows.where(~F.col(event_concept).isin(list(exclude)))
    visits = cohort.select(*VISIT_KEY, *carry).distinct()
    found = rows.join(listed, event_concept).join(visits.select(*VISIT_KEY), list(VISIT_KEY), "left_semi")
    wide = pivot_flags(found, VISIT_KEY, "label", {n: n for n in names}, absent=0)
    if not keep_unmatched:
        return visits.join(wide, list(VISIT_KEY))
    return attach_flags(visits, wide, VISIT_KEY, default=0)


def procedure_flags(cohort: DataFrame, procedures: DataFrame, sets: DataFrame) -> DataFrame:
    """``sets``: ``concept_sets(mapping, "mapping", wanted=PROCEDURE_SETS)`` or alike."""
    return event_flags(cohort, procedures, "procedure_concept_id", sets, list(PROCEDURE_SETS))


def device_flags(
    cohort: DataFrame,
    devices: DataFrame,
    sets: DataFrame,
    exclude: Sequence[int] = EXCLUDED_DEVICES,
    keep_unmatched: bool = True,
) -> DataFrame:
    """``sets`` should label every mapped device; labels outside the four levels only count as listed."""
    return event_flags(cohort, devices, "device_concept_id", sets, list(DEVICE_SETS), exclude, keep_unmatched)


def device_sets(mapping: DataFrame, category: str = "Mapping") -> DataFrame:
    """Every mapped device with its level name, ``"unlisted"`` for other categories."""
    level = recode(category, {v: k for k, v in DEVICE_SETS.items()}, default="unlisted")
    return mapping.select(level.alias("label"), "concept_id").distinct()


def final_flags(cohort: DataFrame, devices: DataFrame, procedures: DataFrame) -> DataFrame:
    """Cohort with device and procedure flags; a visit missing from a flag table keeps nulls."""
    return join_flags(
        cohort,
        devices.select(*VISIT_KEY, *DEVICE_SETS),
        procedures.select(*VISIT_KEY, *PROCEDURE_SETS),
        keys=VISIT_KEY,
    )


def enrich_site(
    cohort: DataFrame,
    concept: DataFrame,
    person_site: DataFrame,
    region_map: Mapping[str, str] = SITE_REGION,
    race_map: Mapping[str, str] | None = COARSE_RACE,
) -> DataFrame:
    """Add ``ethnicity_name``, ``site_id`` and ``site_location``; coarsen the race."""
    named = lookup(cohort, {"ethnicity_concept_id": "ethnicity_name"}, concept, "concept_id", "concept_name")
    named = named.withColumn(
        "ethnicity_name", recode("ethnicity_name", {"No matching concept": "Unknown"}, F.col("ethnicity_name"))
    )
    placed = attribute(named, "person_id", person_site, "person_id", "src_name", "site_id")
    placed = placed.withColumn("site_location", recode("site_id", region_map))
    if race_map is not None:
        placed = placed.withColumn("race_name", recode("race_name", race_map))
    head = [c for c in cohort.columns]
    return placed.select(*head, "ethnicity_name", "site_id", "site_location")


def cohort_conditions(
    cohort: DataFrame, condition: DataFrame, status_map: Mapping[int, int] = CONDITION_STATUS
) -> DataFrame:
    """Condition records of the cohort's visits with normalised status codes (missing -> 0)."""
    status = fill_cast("condition_status_concept_id", 0, "long")
    rows = semi_join(condition, cohort, VISIT_KEY)
    return rows.withColumn("condition_status_concept_id", recode(status, status_map, status).cast("long"))


def named_counts(rows: DataFrame, code: str, concept: DataFrame) -> DataFrame:
    """``(code, concept_name, count)`` of the codes in use that have a name.

    Counted before the names are looked up, so the join sees one row per code.
    """
    counts = rows.groupBy(code).agg(F.count(F.lit(1)).alias("count"))
    names = concept.where(F.col("concept_name").isNotNull()).select(F.col("concept_id").alias(code), "concept_name")
    return counts.join(names, code).select(code, "concept_name", "count")
