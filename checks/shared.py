"""Frames several checks start from."""

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.registry import AS_OF, EXCLUDED_DEVICE, MAX_VISITS, SEEDS, Tables
from cohortry.plans import exposures as X
from cohortry.plans.cohort import build_cohort
from cohortry.plans.rates import drug_rates
from cohortry.plans.reports import clinical_columns
from cohortry.session import ensure_checkpoint_dir
from cohortry.sources.tables import concept_sets, materialize, seed_relation


def drug_seeds(t: Tables, label: str = "name") -> DataFrame:
    return seed_relation(t.spark, SEEDS, label)


def expanded(t: Tables) -> DataFrame:
    return X.expand_concepts(drug_seeds(t), t.concept_relationship, t.concept, "name")


def cohort(t: Tables) -> DataFrame:
    return build_cohort(t.person, t.visit_occurrence, t.death, t.concept, AS_OF, MAX_VISITS)


def cohort_drugs(t: Tables) -> DataFrame:
    return X.drug_flags(
        cohort(t),
        drug_seeds(t, "drug_class"),
        t.concept_relationship,
        t.concept,
        t.drug_exposure,
        t.visit_occurrence,
        t.person,
    )


def stored(t: Tables, name: str, build) -> DataFrame:
    """A table of the flow (cohort, cohort with drugs, final flags), written once per session and folder.

    The analyses start from these tables, as a user's would; the checks of the cohort and
    of the drug flags (``c3``, ``c4``) compute theirs afresh.
    """
    ensure_checkpoint_dir(t.spark)
    root = t.spark.sparkContext.getCheckpointDir()
    key = hashlib.md5(t.folder.encode()).hexdigest()[:12]
    return materialize(t.spark, lambda: build(t), f"{root}/stored/{name}-{key}")


def stored_cohort(t: Tables) -> DataFrame:
    return stored(t, "cohort", cohort)


def flags(t: Tables) -> DataFrame:
    people = stored(t, "cohort_drugs", cohort_drugs)
    devices = X.device_flags(people, t.device_exposure, X.device_sets(t.device_mapping), [EXCLUDED_DEVICE])
    procedures = X.procedure_flags(
        people, t.procedure_occurrence, concept_sets(t.procedure_mapping, "mapping", wanted=X.PROCEDURE_SETS)
    )
    enriched = X.enrich_site(people, t.concept, t.person_per_site)
    return X.final_flags(enriched, devices, procedures)


def stored_flags(t: Tables) -> DataFrame:
    return stored(t, "flags", flags)


def clinical(t: Tables) -> DataFrame:
    return clinical_columns(stored_flags(t))


def rates(t: Tables) -> DataFrame:
    return drug_rates(
        stored_cohort(t), drug_seeds(t), t.concept_relationship, t.concept, t.drug_exposure, t.visit_occurrence
    )


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
