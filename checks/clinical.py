"""End-to-end plans: cohort, flags, rates, reports, figure tables."""

from pyspark.sql import functions as F

from checks.registry import AS_OF, EXCLUDED_DEVICE, Tables, check
from checks.shared import clinical, cohort, cohort_drugs, drug_seeds, flags, rates, stored, stored_cohort, stored_flags
from cohortry.functions import expr as E
from cohortry.plans import exposures as X
from cohortry.plans import reports as P
from cohortry.plans.cohort import add_demographics, adult_persons
from cohortry.plans.rates import drug_rate_analysis, drug_rates
from cohortry.sources.tables import concept_sets


@check("c1_adult_persons", "SELECT * FROM adult")
def _(t: Tables):
    return adult_persons(t.person, t.visit_occurrence)


@check("c2_demographics", "SELECT person_id, race_name, gender_name FROM adult_named")
def _(t: Tables):
    people = adult_persons(t.person, t.visit_occurrence)
    return add_demographics(people, t.concept, codes_from=t.person).select("person_id", "race_name", "gender_name")


@check("c3_cohort", "SELECT * FROM cohort")
def _(t: Tables):
    return cohort(t)


@check("c4_drug_flags", "SELECT * FROM cohort_drugs")
def _(t: Tables):
    return cohort_drugs(t)


@check("c5_procedure_flags", "SELECT * FROM cohort_procedures")
def _(t: Tables):
    sets = concept_sets(t.procedure_mapping, "mapping", wanted=X.PROCEDURE_SETS)
    return X.procedure_flags(stored_cohort(t), t.procedure_occurrence, sets)


@check("c6_device_flags", "SELECT * FROM cohort_devices")
def _(t: Tables):
    return X.device_flags(stored_cohort(t), t.device_exposure, X.device_sets(t.device_mapping), [EXCLUDED_DEVICE])


@check("c7_final_flags", "SELECT * FROM flags")
def _(t: Tables):
    return flags(t)


@check("c8_enrich_site", "SELECT * FROM enriched")
def _(t: Tables):
    return X.enrich_site(stored(t, "cohort_drugs", cohort_drugs), t.concept, t.person_per_site)


_RATES = "SELECT name, race_name, gender_name, age_group, cnt, base_count, percentage::DOUBLE AS percentage FROM rates"


@check("c9_drug_rates", _RATES)
def _(t: Tables):
    return rates(t)


@check(
    "c9_drug_rates_all_groups",
    """SELECT s.name, b.race_name, b.gender_name, b.age_group, COALESCE(r.cnt, 0) AS cnt, b.base_count,
         COALESCE(r.cnt, 0) * 100.0::DOUBLE / b.base_count AS percentage
       FROM (SELECT race_name, gender_name, age_group, COUNT(DISTINCT person_id) AS base_count FROM people GROUP BY 1, 2, 3) b
       CROSS JOIN (SELECT DISTINCT name FROM seeds) s LEFT JOIN rates r ON r.name = s.name AND r.race_name = b.race_name
         AND r.gender_name = b.gender_name AND r.age_group = b.age_group""",
)
def _(t: Tables):
    return drug_rates(
        stored_cohort(t),
        drug_seeds(t),
        t.concept_relationship,
        t.concept,
        t.drug_exposure,
        t.visit_occurrence,
        keep_empty_groups=True,
        distinct_base=True,
    )


@check(
    "c9_drug_rates_by_gender",
    """SELECT r.*, b.base_count, r.cnt * 100.0::DOUBLE / b.base_count AS percentage FROM (
         SELECT v.name, c.race_name, c.gender_name, COUNT(DISTINCT c.person_id) AS cnt FROM exposed v
         JOIN cohort c ON v.person_id = c.person_id AND v.visit_occurrence_id = c.visit_occurrence_id GROUP BY 1, 2, 3) r
       JOIN (SELECT race_name, gender_name, COUNT(*) AS base_count FROM cohort GROUP BY 1, 2) b
         ON r.race_name = b.race_name AND r.gender_name = b.gender_name""",
)
def _(t: Tables):
    found = drug_rate_analysis(
        stored_cohort(t),
        drug_seeds(t),
        t.concept_relationship,
        t.concept,
        t.drug_exposure,
        t.visit_occurrence,
        by_age=False,
    )
    return found["rates"]


@check("c9_corrected_tests")
def _(t: Tables):
    found = drug_rate_analysis(
        stored_cohort(t), drug_seeds(t), t.concept_relationship, t.concept, t.drug_exposure, t.visit_occurrence
    )
    return found["corrected"]


@check(
    "c10_cohort_conditions",
    """SELECT c.person_id, c.visit_occurrence_id, CAST(CASE WHEN c.condition_status_concept_id IN (32901, 32907) THEN 32890
         ELSE COALESCE(c.condition_status_concept_id, 0) END AS BIGINT) AS condition_status_concept_id
       FROM condition_occurrence c JOIN cohort h ON h.person_id = c.person_id AND h.visit_occurrence_id = c.visit_occurrence_id""",
)
def _(t: Tables):
    return X.cohort_conditions(stored_cohort(t), t.condition_occurrence)


_DESCRIBED = " UNION ALL ".join(
    f"""SELECT gender_name, '{c}' AS variable, ROUND(AVG({c}), 4) AS mean, ROUND(stddev_samp({c}), 4) AS std,
        ROUND(quantile_cont({c}, 0.5), 4) AS median FROM clinical GROUP BY 1"""
    for c in ("age", "los")
)


@check("c11_numeric_by_group", _DESCRIBED)
def _(t: Tables):
    found = P.describe_by(clinical(t), ["gender_name"], P.NUMERIC)
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


@check("c11_tests_by_group")
def _(t: Tables):
    return P.describe_groups(clinical(t), "gender_name")["tests"]


@check(
    "c12_breakdown",
    """SELECT gender_name, COUNT(number_drugs) AS number_drugs_count, ROUND(AVG(number_drugs), 2) AS number_drugs_mean,
         ROUND(stddev_samp(number_drugs), 2) AS number_drugs_std,
         CAST(SUM(CAST(died_in_hospital AS INT)) AS DOUBLE) AS died_in_hospital_sum,
         ROUND(AVG(CAST(died_in_hospital AS INT)), 2) AS died_in_hospital_mean FROM clinical GROUP BY 1""",
)
def _(t: Tables):
    return P.compare_two(clinical(t), "number_drugs", "died_in_hospital", "gender_name")["breakdown"]


@check(
    "c12_totals",
    """SELECT COUNT(*) AS total, CAST(SUM(CAST(died_in_hospital AS INT)) AS BIGINT) AS positives,
         AVG(CAST(died_in_hospital AS INT)) * 100 AS positive_pct,
         COUNT(*) - CAST(SUM(CAST(died_in_hospital AS INT)) AS BIGINT) AS negatives,
         (1 - AVG(CAST(died_in_hospital AS INT))) * 100 AS negative_pct FROM clinical""",
)
def _(t: Tables):
    return P.binary_totals(clinical(t), "died_in_hospital")


_COMPLETED = """SELECT *, datesub('year', birth_datetime, visit_start_datetime) AS a,
    CAST(trunc((epoch_us(visit_end_datetime) - epoch_us(visit_start_datetime)) / 86400e6) AS INT) AS l,
    COALESCE(steroid_flag, 0) + COALESCE(narcotic_flag, 0) + COALESCE(sedative_flag, 0) + COALESCE(vasopressor_flag, 0)
    + COALESCE(nasal_canula_mask, 0) + COALESCE(hiflo_oximyzer, 0) + COALESCE(cpap_bipap, 0)
    + COALESCE(mechanical_ventilation, 0) + COALESCE(ecmo, 0) + COALESCE(dialysis, 0) AS total FROM flags"""
_MEANS = ", ".join(
    f"AVG(CAST({c} AS INT)) AS {m}"
    for m, c in {**P.STRATUM_METRICS, "mean_age": "a", "mean_los": "l", "mean_total": "total"}.items()
)
_LEVELS = "CASE race_name WHEN 'White' THEN 1 WHEN 'Black' THEN 2 WHEN 'Asian' THEN 3 WHEN 'Other' THEN 4 WHEN 'Not Reported' THEN 5 END"
_STRATA = f"""SELECT CASE WHEN {_LEVELS} IS NOT NULL THEN race_name END AS race_name,
    CASE gender_name WHEN 'MALE' THEN 'Male' WHEN 'FEMALE' THEN 'Female' END AS gender_name,
    CASE site_location WHEN 'MW' THEN 'Midwest' WHEN 'NE' THEN 'Northeast' WHEN 'SE' THEN 'Southeast' ELSE site_location END AS site_location,
    CAST({_LEVELS} AS INT) AS race_level, CAST(CASE gender_name WHEN 'MALE' THEN 1 WHEN 'FEMALE' THEN 2 END AS INT) AS gender_level,
    s.* EXCLUDE (race_name, gender_name, site_location),
    mean_steroid_dr + mean_narcotic_dr + mean_sedative_dr + mean_vasopressor_dr AS mean_dr,
    mean_nasal_canula_mask_de + mean_hiflo_oximyzer_de + mean_cpap_bipap_de + mean_mechanical_ventilation_de AS mean_de
  FROM (SELECT race_name, gender_name, site_location, COUNT(*) AS count, {_MEANS} FROM ({_COMPLETED}) c GROUP BY 1, 2, 3) s"""


@check("c13_stratum_report", _STRATA)
def _(t: Tables):
    return P.stratum_report(stored_flags(t))


@check(
    "c14_condition_status_counts",
    """FROM (SELECT condition_status_concept_id AS status, COUNT(*) AS records FROM condition_occurrence GROUP BY ALL)
       JOIN concept ON concept_id = status
       SELECT status AS condition_status_concept_id, concept_name, SUM(records)::BIGINT AS count GROUP BY ALL""",
)
def _(t: Tables):
    return X.named_counts(t.condition_occurrence, "condition_status_concept_id", t.concept)


@check("c14_visit_types", "SELECT concept_name FROM concept WHERE concept_id IN (SELECT visit_concept_id FROM visit_occurrence) AND concept_name IS NOT NULL GROUP BY ALL")
def _(t: Tables):
    return X.named_counts(t.visit_occurrence, "visit_concept_id", t.concept).select("concept_name").distinct()


@check(
    "c14_race_counts",
    """WITH sizes AS (SELECT race_concept_id, COUNT(person_id) AS people FROM person GROUP BY ALL)
       SELECT race_concept_id, (SELECT MIN(concept_name) FROM concept WHERE concept_id = race_concept_id) AS concept_name, people AS count
       FROM sizes WHERE race_concept_id IN (SELECT concept_id FROM concept WHERE concept_name IS NOT NULL)""",
)
def _(t: Tables):
    return X.named_counts(t.person, "race_concept_id", t.concept)


@check(
    "c14_length_of_stay",
    """SELECT visit_occurrence_id, person_id, visit_start_date, visit_end_date,
         CAST((epoch(visit_end_date::DATE) - epoch(visit_start_date::DATE)) / 86400 AS INT) AS los FROM visit_occurrence""",
)
def _(t: Tables):
    return t.visit_occurrence.select(
        "visit_occurrence_id", "person_id", "visit_start_date", "visit_end_date",
        E.day_diff("visit_end_date", "visit_start_date").cast("int").alias("los"),
    )


# --- figure tables ---------------------------------------------------------------

_BOX = """WITH q AS (SELECT gender_name, CAST(died_in_hospital AS INT) AS side, quantile_cont(los, 0.25) AS q1,
    quantile_cont(los, 0.5) AS median, quantile_cont(los, 0.75) AS q3 FROM clinical GROUP BY 1, 2)
  SELECT q.gender_name, q.side AS died_in_hospital, COUNT(*) AS n, AVG(c.los) AS mean, q.q1, q.median, q.q3,
    MIN(CASE WHEN c.los BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN c.los END) AS whisker_low,
    MAX(CASE WHEN c.los BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN c.los END) AS whisker_high
  FROM clinical c JOIN q ON c.gender_name = q.gender_name AND CAST(c.died_in_hospital AS INT) = q.side GROUP BY 1, 2, 5, 6, 7"""


@check("v1_box_stats", _BOX)
def _(t: Tables):
    return P.box_stats(clinical(t), "gender_name", "los", "died_in_hospital")


@check(
    "v2_axis_limits",
    """SELECT MIN(o_totalprice) - (MAX(o_totalprice) - MIN(o_totalprice)) * 0.05 AS low,
         MAX(o_totalprice) + (MAX(o_totalprice) - MIN(o_totalprice)) * 0.05 AS high FROM orders""",
)
def _(t: Tables):
    return P.axis_limits(t.orders, "o_totalprice")


@check(
    "v3_grid_and_maximum",
    """WITH c AS (SELECT gender_name, number_drugs, number_interventions, COUNT(*) AS n FROM clinical GROUP BY 1, 2, 3)
       SELECT g.gender_name, x.number_drugs, y.number_interventions, COALESCE(c.n, 0) AS n, (SELECT MAX(n) FROM c) AS max_count
       FROM (SELECT DISTINCT gender_name FROM c) g
       JOIN (SELECT DISTINCT gender_name, number_drugs FROM c) x ON x.gender_name = g.gender_name
       JOIN (SELECT DISTINCT gender_name, number_interventions FROM c) y ON y.gender_name = g.gender_name
       LEFT JOIN c ON c.gender_name = g.gender_name AND c.number_drugs = x.number_drugs
         AND c.number_interventions = y.number_interventions""",
)
def _(t: Tables):
    found = P.compare_two(clinical(t), "number_drugs", "number_interventions", "gender_name")
    top = found["max_cell"].withColumn("k", F.lit(1))
    return found["grid"].withColumn("k", F.lit(1)).join(top, "k").drop("k")


_FIGURE = " UNION ALL ".join(
    f"""SELECT race_name, gender_name, site_location, '{m}' AS metric, '{title}' AS title, {m}::DOUBLE AS value,
        (MAX({m}) OVER ()) * 1.15 AS upper_limit FROM s"""
    for m, title in P.FIGURE_TITLES.items()
)


@check(
    "v4_figure_table",
    f"SELECT metric, title, race_name, gender_name, site_location, ROUND(value, 6) AS value, ROUND(upper_limit, 6) AS upper_limit FROM (WITH s AS ({_STRATA}) {_FIGURE}) f",
)
def _(t: Tables):
    means = P.stratum_report(stored_flags(t)).checkpoint()
    found = P.figure_table(means, ["race_name", "gender_name", "site_location"])
    return found.withColumns({c: F.round(c, 6) for c in ("value", "upper_limit")}).drop("bar_label")


@check(
    "v5_scatter_points",
    """SELECT o_orderpriority, o_totalprice AS x, o_custkey AS y, COUNT(*) OVER (PARTITION BY o_orderpriority) AS group_size FROM orders""",
)
def _(t: Tables):
    return P.scatter_points(t.orders, "o_totalprice", "o_custkey", "o_orderpriority")


@check(
    "v5_scatter_bins",
    """WITH pts AS (SELECT o_orderpriority, o_totalprice::DOUBLE AS x, o_custkey::DOUBLE AS y FROM orders WHERE o_orderpriority IS NOT NULL AND o_totalprice IS NOT NULL AND o_custkey IS NOT NULL),
       span AS (SELECT MIN(x) - (MAX(x) - MIN(x)) * 0.05 AS x0, MAX(x) + (MAX(x) - MIN(x)) * 0.05 AS x1,
                  MIN(y) - (MAX(y) - MIN(y)) * 0.05 AS y0, MAX(y) + (MAX(y) - MIN(y)) * 0.05 AS y1 FROM pts)
       SELECT o_orderpriority, least(floor((x - x0) / (x1 - x0) * 20), 19)::INT AS bin_x, least(floor((y - y0) / (y1 - y0) * 20), 19)::INT AS bin_y,
         COUNT(*) AS n, ROUND(SUM(x), 2) AS sum_x, ROUND(SUM(y), 2) AS sum_y FROM pts CROSS JOIN span GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    found = P.scatter_bins(t.orders, "o_totalprice", "o_custkey", "o_orderpriority", bins=20)
    # Means of cents fall on the middle between two roundings; their sums do not.
    sums = [F.round(F.col(f"mean_{c}") * F.col("n"), 2).alias(f"sum_{c}") for c in ("x", "y")]
    return found.select("o_orderpriority", "bin_x", "bin_y", "n", *sums)
