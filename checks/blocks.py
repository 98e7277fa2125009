"""SQL building blocks shared by the oracles: cohort, flags and rates, written independently of the Spark plans."""

from checks.registry import BLOCKS, MAX_VISITS, SEEDS
from cohortry.plans.cohort import RACE_GROUPS
from cohortry.plans.exposures import COARSE_RACE, DEVICE_SETS, DRUG_PATH, PROCEDURE_SETS, SITE_REGION


def _recoded(column: str, names: dict[str, str]) -> str:
    """A ``CASE`` over the fixed values of the plans."""
    arms = " ".join(f"WHEN '{old}' THEN '{new}'" for old, new in names.items())
    return f"CASE {column} {arms} END"


# The youngest a person was at any visit follows from the earliest year.
BLOCKS["earliest_year"] = """
SELECT person_id AS who, MIN(year(visit_start_datetime)) AS first_year FROM visit_occurrence GROUP BY ALL"""

BLOCKS["adult"] = """
SELECT DISTINCT person.* FROM person JOIN earliest_year ON person_id = who
WHERE COALESCE(first_year >= year_of_birth + 18, TRUE)"""

BLOCKS["adult_named"] = f"""
SELECT adult.*, CASE WHEN race.concept_name IS NULL THEN 'Not Reported' ELSE {_recoded("race.concept_name", RACE_GROUPS)} END AS race_name,
  gender.concept_name AS gender_name
FROM adult LEFT JOIN concept AS race ON race.concept_id = race_concept_id
LEFT JOIN concept AS gender ON gender.concept_id = gender_concept_id"""

BLOCKS["death_one"] = """
SELECT person_id, COALESCE(death_datetime, CAST(death_date AS TIMESTAMP)) AS death_at FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY death_date NULLS FIRST, death_datetime NULLS FIRST) AS rn
  FROM death) t WHERE rn = 1"""

BLOCKS["visit_judged"] = """
SELECT v.*, (epoch_us(d.death_at) - epoch_us(v.visit_end_datetime)) / 86400e6 AS days,
  row_number() OVER (PARTITION BY v.person_id ORDER BY v.visit_start_datetime NULLS LAST, v.visit_occurrence_id) = 1 AS first_visit
FROM visit_occurrence v JOIN adult a ON v.person_id = a.person_id LEFT JOIN death_one d ON v.person_id = d.person_id"""

BLOCKS["visit_kept"] = """
SELECT *, COALESCE(days >= -1 AND days <= 0, FALSE) AS died_in_hospital,
  COALESCE(days > 0 AND days <= 30, FALSE) AS died_in_30_days
FROM visit_judged
WHERE NOT COALESCE(visit_end_datetime > TIMESTAMP '2001-08-01', FALSE) AND NOT COALESCE(days <= -2, FALSE)"""

BLOCKS["visit_last"] = f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY visit_start_datetime DESC NULLS FIRST, visit_occurrence_id DESC) AS rn,
    COUNT(*) OVER (PARTITION BY person_id) AS n_all FROM visit_kept) t
WHERE rn = 1 AND n_all <= {MAX_VISITS}"""

BLOCKS["cohort"] = """
SELECT a.*, CAST(1 AS BIGINT) AS num_visits, v.visit_occurrence_id, v.visit_concept_id, v.visit_start_datetime,
  v.visit_end_datetime, v.visit_start_date, v.visit_end_date, v.first_visit, v.died_in_hospital, v.died_in_30_days
FROM adult_named a JOIN visit_last v ON a.person_id = v.person_id
  AND a.provider_id IS NOT DISTINCT FROM v.provider_id AND a.care_site_id IS NOT DISTINCT FROM v.care_site_id"""

_SEEDS = ", ".join(f"('{name}', {i})" for name, ids in SEEDS.items() for i in ids)

BLOCKS["seeds"] = f"SELECT * FROM (VALUES {_SEEDS}) AS t(name, concept_id)"

# A hop leads from an existing concept along one relationship to an existing concept.
BLOCKS["hop"] = """
SELECT link.concept_id_1 AS origin, link.relationship_id AS kind, link.concept_id_2 AS target, bool_or(goal.standard_concept = 'S') AS standard
FROM concept_relationship AS link
JOIN concept AS goal ON goal.concept_id = link.concept_id_2
WHERE link.concept_id_1 IN (SELECT concept_id FROM concept) GROUP BY ALL"""

_STEPS = ["", "first_reach", "second_reach", "expanded"]
for _n, _kind in enumerate(DRUG_PATH, start=1):
    BLOCKS[_STEPS[_n]] = f"""
SELECT DISTINCT name, target AS concept_id FROM {_STEPS[_n - 1] or "seeds"} JOIN hop ON origin = concept_id
WHERE {f"kind = '{_kind}'" if _kind else "TRUE"} AND {"standard" if _n == len(DRUG_PATH) else "TRUE"}"""

BLOCKS["exposed"] = """
SELECT hits.name, visit.person_id, visit.visit_occurrence_id, year(visit.visit_start_date) - person.year_of_birth AS age
FROM (SELECT DISTINCT name, visit_occurrence_id FROM drug_exposure JOIN expanded ON concept_id = drug_concept_id) AS hits
JOIN visit_occurrence AS visit USING (visit_occurrence_id) JOIN person USING (person_id)
GROUP BY ALL"""


def _exposed(name: str) -> str:
    return f"""EXISTS (FROM exposed WHERE name = '{name}' AND age >= 18 AND exposed.person_id = cohort.person_id
    AND exposed.visit_occurrence_id = cohort.visit_occurrence_id)::INT AS {name}_flag"""


BLOCKS["cohort_drugs"] = f"SELECT cohort.*, {', '.join(map(_exposed, SEEDS))} FROM cohort"

# Events are summed up per visit before they meet the cohort.
BLOCKS["procedure_events"] = f"""
SELECT person_id, visit_occurrence_id, {", ".join(f"MAX((mapping = '{v}')::INT) AS {k}" for k, v in PROCEDURE_SETS.items())}
FROM procedure_occurrence JOIN procedure_mapping ON concept_id = procedure_concept_id GROUP BY ALL"""

BLOCKS["device_events"] = f"""
SELECT person_id, visit_occurrence_id, {", ".join(f"MAX((Mapping = '{v}')::INT) AS {k}" for k, v in DEVICE_SETS.items())}
FROM device_exposure JOIN device_mapping ON concept_id = device_concept_id WHERE device_concept_id <> 600003 GROUP BY ALL"""


def _with_events(events: str, names: dict[str, str]) -> str:
    flags = ", ".join(f"COALESCE({n}, 0) AS {n}" for n in names)
    return f"""
SELECT visit.*, {flags} FROM (SELECT DISTINCT person_id, visit_occurrence_id, race_name, gender_name FROM cohort) AS visit
LEFT JOIN {events} USING (person_id, visit_occurrence_id)"""


BLOCKS["cohort_procedures"] = _with_events("procedure_events", PROCEDURE_SETS)
BLOCKS["cohort_devices"] = _with_events("device_events", DEVICE_SETS)

BLOCKS["enriched"] = f"""
SELECT cohort_drugs.* EXCLUDE (race_name), {_recoded("race_name", COARSE_RACE)} AS race_name,
  COALESCE(NULLIF(concept_name, 'No matching concept'), CASE WHEN concept_name IS NOT NULL THEN 'Unknown' END) AS ethnicity_name,
  src_name AS site_id, {_recoded("src_name", SITE_REGION)} AS site_location
FROM cohort_drugs LEFT JOIN concept ON concept_id = ethnicity_concept_id
LEFT JOIN person_per_site USING (person_id)"""

BLOCKS["flags"] = """
SELECT c.*, d.nasal_canula_mask, d.hiflo_oximyzer, d.cpap_bipap, d.mechanical_ventilation, p.ecmo, p.dialysis
FROM enriched c
LEFT JOIN cohort_devices d ON c.person_id = d.person_id AND c.visit_occurrence_id = d.visit_occurrence_id
LEFT JOIN cohort_procedures p ON c.person_id = p.person_id AND c.visit_occurrence_id = p.visit_occurrence_id"""

BLOCKS["clinical"] = """
SELECT *, age >= 65 AS medicare,
  nasal_canula_mask + hiflo_oximyzer + cpap_bipap + mechanical_ventilation + ecmo AS number_interventions,
  steroid_flag + narcotic_flag + sedative_flag + vasopressor_flag AS number_drugs
FROM (SELECT *, (epoch_us(visit_start_datetime) - epoch_us(birth_datetime)) / (365 * 86400e6) AS age,
  (epoch_us(visit_end_datetime) - epoch_us(visit_start_datetime)) / 3600e6 AS los FROM flags) t"""

BLOCKS["people"] = """
SELECT person_id, visit_occurrence_id, gender_name,
  CASE WHEN race_name IN ('White', 'Black', 'Asian', 'Not Reported') THEN race_name ELSE 'Other' END AS race_name,
  CASE WHEN year(visit_start_datetime) - year_of_birth >= 65 THEN '65+' ELSE '<65' END AS age_group
FROM cohort"""

BLOCKS["rates"] = """
SELECT r.*, b.base_count, r.cnt * 100.0 / b.base_count AS percentage FROM (
  SELECT v.name, c.race_name, c.gender_name, c.age_group, COUNT(DISTINCT c.person_id) AS cnt
  FROM exposed v JOIN people c ON v.person_id = c.person_id AND v.visit_occurrence_id = c.visit_occurrence_id
  GROUP BY 1, 2, 3, 4) r
JOIN (SELECT race_name, gender_name, age_group, COUNT(*) AS base_count FROM people GROUP BY 1, 2, 3) b
  ON r.race_name = b.race_name AND r.gender_name = b.gender_name AND r.age_group = b.age_group"""

# One row per list and race: got / not-got for both genders (g) and both age bands (a).
BLOCKS["arms_g"] = """
SELECT name, race_name, SUM(CASE WHEN gender_name = 'MALE' THEN cnt END) AS got1,
  SUM(CASE WHEN gender_name = 'MALE' THEN base_count END) AS total1,
  SUM(CASE WHEN gender_name = 'FEMALE' THEN cnt END) AS got2,
  SUM(CASE WHEN gender_name = 'FEMALE' THEN base_count END) AS total2
FROM rates GROUP BY 1, 2"""
BLOCKS["arms_a"] = """
SELECT name, race_name, SUM(CASE WHEN age_group = '65+' THEN cnt END) AS got1,
  SUM(CASE WHEN age_group = '65+' THEN base_count END) AS total1,
  SUM(CASE WHEN age_group = '<65' THEN cnt END) AS got2,
  SUM(CASE WHEN age_group = '<65' THEN base_count END) AS total2
FROM rates GROUP BY 1, 2"""

BLOCKS["vecs"] = "SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings"
BLOCKS["dims"] = "SELECT vec_id, label, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS dim FROM vecs"
