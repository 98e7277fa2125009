"""Sources, filters, joins, aggregates, windows, ordering, set operations."""

from pyspark.sql import functions as F

from checks.registry import EXCLUDED_DEVICE, SEEDS, Tables, check, scratch
from checks.shared import drug_seeds, expanded, stored_cohort, stored_flags
from cohortry.functions.expr import exists_flag, name_contains
from cohortry.operators import relational as R
from cohortry.operators.order_stats import describe, describe_by, rank_values, summarize
from cohortry.plans import exposures as X
from cohortry.plans.cohort import attrition, death_after_latest_discharge, first_death, outcome_summary, surviving_visits
from cohortry.sources import tables as S

# --- sources ---------------------------------------------------------------


@check("s1_table_scan", "SELECT * FROM orders")
def _(t: Tables):
    return S.read_table(t.spark, f"{t.folder}/orders.parquet")


@check(
    "s2_sql_text",
    "SELECT gender_concept_id, COUNT(*) AS n FROM person WHERE year_of_birth >= 1950 GROUP BY gender_concept_id",
)
def _(t: Tables):
    t.person.createOrReplaceTempView("s2_person")
    text = "SELECT gender_concept_id, COUNT(*) AS n FROM s2_person WHERE year_of_birth >= :y GROUP BY gender_concept_id"
    return S.run_sql(t.spark, text, {"y": 1950})


@check("s3_materialize", "SELECT person_id, COUNT(*) AS n FROM visit_occurrence GROUP BY person_id")
def _(t: Tables):
    path = scratch(t.spark, "s3")
    S.materialize(t.spark, lambda: R.count_by(t.visit_occurrence, ["person_id"]), path)
    # The second call must find the stored table and not build again.
    return S.materialize(t.spark, lambda: t.person.where("false").select("person_id", F.lit(0).alias("n")), path)


@check("s4_csv_source", "SELECT concept_id, mapping FROM procedure_mapping")
def _(t: Tables):
    path = scratch(t.spark, "s4")
    S.write_csv(t.procedure_mapping, path)
    return S.read_csv(t.spark, path, "concept_id long, mapping string")


@check("s5_csv_sink", "SELECT person_id, src_name FROM person_per_site")
def _(t: Tables):
    path = scratch(t.spark, "s5")
    S.write_csv(t.person_per_site, path)
    return S.read_csv(t.spark, path, t.person_per_site.schema)


@check("s6_replace_table", "SELECT concept_id, Mapping FROM device_mapping")
def _(t: Tables):
    path = scratch(t.spark, "s6")
    S.write_table(t.procedure_mapping, path)
    S.write_table(t.device_mapping, path, "overwrite")
    return t.spark.read.parquet(path)


@check(
    "s7_append_table",
    "SELECT concept_id, Mapping FROM device_mapping UNION ALL SELECT concept_id, Mapping FROM device_mapping",
)
def _(t: Tables):
    path = scratch(t.spark, "s7")
    for _ in range(2):
        S.write_table(t.device_mapping, path, "append")
    return t.spark.read.parquet(path)


_DISTINCT_SEEDS = ", ".join(f"('{k}', {i})" for k, v in SEEDS.items() for i in dict.fromkeys(v))


@check(
    "s8_inline_relation",
    f"""SELECT s.name AS drug_class, CAST(s.cid AS BIGINT) AS concept_id, c.concept_name
        FROM (VALUES {_DISTINCT_SEEDS}) AS s(name, cid) JOIN concept c ON c.concept_id = s.cid""",
)
def _(t: Tables):
    return drug_seeds(t, "drug_class").join(t.concept.select("concept_id", "concept_name"), "concept_id")


@check(
    "s9_query_frame_by_name",
    "SELECT race_concept_id, AVG(year_of_birth) AS avg_year FROM person GROUP BY race_concept_id",
)
def _(t: Tables):
    text = "SELECT race_concept_id, AVG(year_of_birth) AS avg_year FROM {people} GROUP BY race_concept_id"
    return S.sql_over(t.spark, text, people=t.person)


@check(
    "s10_mapping_id_lists",
    """SELECT CASE mapping WHEN 'ECMO' THEN 'ecmo' ELSE 'dialysis' END AS label, concept_id
       FROM procedure_mapping WHERE mapping IN ('ECMO', 'dialysis')""",
)
def _(t: Tables):
    return S.concept_sets(t.procedure_mapping, "mapping", wanted=X.PROCEDURE_SETS)


# --- projections and filters ---------------------------------------------------------------


@check("p1_select", "SELECT person_id, visit_start_datetime, care_site_id FROM visit_occurrence")
def _(t: Tables):
    return t.visit_occurrence.select("person_id", "visit_start_datetime", "care_site_id")


@check(
    "p2_star_plus_columns",
    """SELECT v.*, year(visit_start_datetime) AS start_year,
         CASE WHEN care_site_id IS NULL THEN 1 ELSE 0 END AS no_site FROM visit_occurrence v""",
)
def _(t: Tables):
    return t.visit_occurrence.withColumns(
        {"start_year": F.year("visit_start_datetime").cast("long"), "no_site": F.col("care_site_id").isNull().cast("int")}
    )


@check("p3_drop", "SELECT person_id, year_of_birth, birth_datetime, race_concept_id FROM person")
def _(t: Tables):
    return t.person.drop("gender_concept_id", "ethnicity_concept_id", "provider_id", "care_site_id")


@check(
    "p4_rename",
    "SELECT person_id AS subject_id, death_date AS date_of_death, death_datetime FROM death",
)
def _(t: Tables):
    return t.death.withColumnsRenamed({"person_id": "subject_id", "death_date": "date_of_death"})


@check(
    "p5_negated_mask_keeps_null",
    "SELECT person_id, race_concept_id FROM person WHERE race_concept_id IS NULL OR NOT (race_concept_id > 9002)",
)
def _(t: Tables):
    return R.drop_where(t.person.select("person_id", "race_concept_id"), F.col("race_concept_id") > 9002)


@check(
    "p6_filter",
    """SELECT person_id FROM person WHERE gender_concept_id = 8507 AND (race_concept_id = 9000 OR year_of_birth < 1930)""",
)
def _(t: Tables):
    return t.person.where(
        (F.col("gender_concept_id") == 8507) & ((F.col("race_concept_id") == 9000) | (F.col("year_of_birth") < 1930))
    ).select("person_id")


@check(
    "p7_in_list",
    "SELECT person_id, race_concept_id FROM person WHERE race_concept_id IN (9000, 9001, 9004)",
)
def _(t: Tables):
    return R.filter_in(t.person.select("person_id", "race_concept_id"), "race_concept_id", [9000, 9001, 9004])


@check(
    "p7_in_list_long",
    "SELECT * FROM drug_exposure WHERE drug_concept_id BETWEEN 100001 AND 101500",
)
def _(t: Tables):
    return R.filter_in(t.drug_exposure, "drug_concept_id", list(range(100001, 101501)))


@check(
    "p8_not_in_list",
    "SELECT person_id, care_site_id FROM person WHERE care_site_id NOT IN (1, 2, 3)",
)
def _(t: Tables):
    return R.filter_not_in(t.person.select("person_id", "care_site_id"), "care_site_id", [1, 2, 3])


@check(
    "p9_dropna",
    "SELECT person_id, provider_id, care_site_id FROM person WHERE provider_id IS NOT NULL AND care_site_id IS NOT NULL",
)
def _(t: Tables):
    return t.person.select("person_id", "provider_id", "care_site_id").dropna(subset=["provider_id", "care_site_id"])


@check(
    "p10_exists_flag",
    """SELECT p.person_id, CASE WHEN d.person_id IS NOT NULL THEN 1 ELSE 0 END AS has_death
       FROM person p LEFT JOIN (SELECT DISTINCT person_id FROM death) d ON p.person_id = d.person_id""",
)
def _(t: Tables):
    died = t.death.select("person_id").distinct().withColumn("hit", F.lit(True))
    return t.person.join(died, "person_id", "left").select("person_id", exists_flag("hit").alias("has_death"))


@check(
    "p11_name_contains",
    "SELECT DISTINCT concept_id, concept_name FROM concept WHERE lower(concept_name) LIKE '%an%'",
)
def _(t: Tables):
    return t.concept.where(name_contains("concept_name", "AN")).select("concept_id", "concept_name").distinct()


@check(
    "p13_adult_filter",
    """SELECT v.visit_occurrence_id, v.person_id FROM visit_occurrence v JOIN person p ON v.person_id = p.person_id
       WHERE year(v.visit_start_datetime) - p.year_of_birth >= 18""",
)
def _(t: Tables):
    rows = t.visit_occurrence.join(t.person.select("person_id", "year_of_birth"), "person_id")
    return R.adult_filter(rows, "visit_start_datetime", "year_of_birth").select("visit_occurrence_id", "person_id")


@check("p14_numeric_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t: Tables):
    return t.orders.select(R.numeric_columns(t.orders))


# --- joins ---------------------------------------------------------------


@check(
    "j1_inner_join",
    """SELECT v.visit_occurrence_id, p.person_id, p.year_of_birth
       FROM visit_occurrence v JOIN person p ON v.person_id = p.person_id""",
)
def _(t: Tables):
    return t.visit_occurrence.join(t.person, "person_id").select("visit_occurrence_id", "person_id", "year_of_birth")


@check("j2_vocabulary_chain", "SELECT name, concept_id FROM expanded")
def _(t: Tables):
    return expanded(t)


@check("j2_exposed_visits", "SELECT name, person_id, visit_occurrence_id FROM exposed")
def _(t: Tables):
    return X.exposed_visits(expanded(t), t.drug_exposure, t.visit_occurrence, label="name")


@check(
    "j3_predicate_in_on",
    """SELECT a.concept_id, b.concept_id_2 FROM concept a JOIN concept_relationship b
       ON a.concept_id = b.concept_id_1 AND b.relationship_id = 'Subsumes' AND a.concept_name LIKE 'class%'""",
)
def _(t: Tables):
    links = t.concept_relationship.where(F.col("relationship_id") == "Subsumes")
    classes = t.concept.where(F.col("concept_name").startswith("class"))
    return classes.join(links, classes.concept_id == links.concept_id_1).select("concept_id", "concept_id_2")


@check(
    "j4_composite_key_distinct",
    """SELECT DISTINCT v.person_id, v.visit_occurrence_id, v.visit_start_datetime FROM visit_occurrence v
       JOIN procedure_occurrence p ON v.person_id = p.person_id AND v.visit_occurrence_id = p.visit_occurrence_id
       JOIN procedure_mapping m ON m.concept_id = p.procedure_concept_id AND m.mapping = 'dialysis'""",
)
def _(t: Tables):
    sets = S.concept_sets(t.procedure_mapping, "mapping", wanted={"dialysis": "dialysis"})
    done = t.procedure_occurrence.join(
        R.sized_broadcast(sets.withColumnRenamed("concept_id", "procedure_concept_id")), "procedure_concept_id"
    )
    visits = t.visit_occurrence.select("person_id", "visit_occurrence_id", "visit_start_datetime")
    return R.restrict_to(visits, done, X.VISIT_KEY)


_PROCS = "SELECT visit_occurrence_id, COUNT(*) AS procedures FROM procedure_occurrence GROUP BY 1"


@check(
    "j5_left_join_default",
    f"""SELECT v.visit_occurrence_id, COALESCE(p.procedures, 0) AS procedures FROM visit_occurrence v
        LEFT JOIN ({_PROCS}) p ON v.visit_occurrence_id = p.visit_occurrence_id""",
)
def _(t: Tables):
    counts = R.count_by(t.procedure_occurrence, ["visit_occurrence_id"], "procedures")
    return R.attach_flags(t.visit_occurrence.select("visit_occurrence_id"), counts, ["visit_occurrence_id"])


@check(
    "j6_left_join_filtered",
    """SELECT v.visit_occurrence_id, v.person_id, d.device_concept_id FROM visit_occurrence v
       LEFT JOIN (SELECT * FROM device_exposure WHERE device_concept_id <> 600003) d
       USING (person_id, visit_occurrence_id)""",
)
def _(t: Tables):
    visits = t.visit_occurrence.select(*X.VISIT_KEY)
    keep = ~F.col("device_concept_id").isin(EXCLUDED_DEVICE)
    return R.left_join_filtered(visits, t.device_exposure, X.VISIT_KEY, keep)


@check(
    "j7_right_join_as_inner",
    """SELECT DISTINCT person_id, visit_occurrence_id, race_name, gender_name, e.* EXCLUDE (person_id, visit_occurrence_id)
       FROM device_events e JOIN cohort USING (person_id, visit_occurrence_id)""",
)
def _(t: Tables):
    sets = X.device_sets(t.device_mapping)
    return X.device_flags(stored_cohort(t), t.device_exposure, sets, [EXCLUDED_DEVICE], keep_unmatched=False)


@check(
    "j8_several_left_joins",
    """SELECT p.person_id, v.n_visits, d.n_devices, s.src_name FROM person p
       LEFT JOIN (SELECT person_id, COUNT(*) AS n_visits FROM visit_occurrence GROUP BY 1) v ON p.person_id = v.person_id
       LEFT JOIN (SELECT person_id, COUNT(*) AS n_devices FROM device_exposure GROUP BY 1) d ON p.person_id = d.person_id
       LEFT JOIN person_per_site s ON p.person_id = s.person_id""",
)
def _(t: Tables):
    return R.join_flags(
        t.person.select("person_id"),
        R.count_by(t.visit_occurrence, ["person_id"], "n_visits"),
        R.count_by(t.device_exposure, ["person_id"], "n_devices"),
        t.person_per_site,
        keys=["person_id"],
    )


@check(
    "j9_left_merge",
    """SELECT v.visit_occurrence_id, v.person_id, d.death_at FROM visit_occurrence v
       LEFT JOIN death_one d ON v.person_id = d.person_id""",
)
def _(t: Tables):
    dead = first_death(t.death).select("person_id", "death_at")
    return t.visit_occurrence.select("visit_occurrence_id", "person_id").join(dead, "person_id", "left")


@check(
    "j10_null_safe_join",
    """SELECT p.person_id, p.provider_id, p.care_site_id, p.year_of_birth, v.visit_occurrence_id
       FROM person p JOIN visit_occurrence v ON p.person_id = v.person_id
       AND p.provider_id IS NOT DISTINCT FROM v.provider_id AND p.care_site_id IS NOT DISTINCT FROM v.care_site_id""",
)
def _(t: Tables):
    keys = ["person_id", "provider_id", "care_site_id"]
    return R.join_null_safe(
        t.person.select(*keys, "year_of_birth"), t.visit_occurrence.select(*keys, "visit_occurrence_id"), keys
    )


@check(
    "j11_dimension_lookup",
    """SELECT p.person_id, p.race_concept_id, c.concept_name AS race FROM person p
       LEFT JOIN concept c ON p.race_concept_id = c.concept_id""",
)
def _(t: Tables):
    people = t.person.select("person_id", "race_concept_id")
    return R.lookup(people, {"race_concept_id": "race"}, t.concept, "concept_id", "concept_name")


@check(
    "j12_semi_join",
    """SELECT c.* FROM condition_occurrence c WHERE EXISTS (SELECT 1 FROM cohort h
       WHERE h.person_id = c.person_id AND h.visit_occurrence_id = c.visit_occurrence_id)""",
)
def _(t: Tables):
    return R.semi_join(t.condition_occurrence, stored_cohort(t), X.VISIT_KEY)


@check(
    "j13_null_aware_anti",
    """SELECT person_id FROM person WHERE person_id NOT IN (SELECT person_id FROM death WHERE person_id IS NOT NULL)""",
)
def _(t: Tables):
    return R.exclude_ids(t.person.select("person_id"), t.death.select("person_id"), "person_id")


@check(
    "j13_null_aware_anti_with_null",
    "SELECT person_id FROM person WHERE provider_id NOT IN (SELECT provider_id FROM visit_occurrence)",
)
def _(t: Tables):
    found = R.exclude_ids(t.person, t.visit_occurrence.select("provider_id"), "provider_id")
    return found.select("person_id")


@check(
    "j14_left_join_names_grouped",
    """SELECT c.concept_name AS race, p.race_concept_id, COUNT(*) AS people FROM person p
       LEFT JOIN concept c ON p.race_concept_id = c.concept_id GROUP BY 1, 2""",
)
def _(t: Tables):
    counts = R.count_by(t.person, ["race_concept_id"], "people")
    return R.lookup(counts, {"race_concept_id": "race"}, t.concept, "concept_id", "concept_name")


@check(
    "j15_star_left_join",
    """SELECT c.*, CASE WHEN d.person_id IS NOT NULL THEN 1 ELSE 0 END AS has_dialysis FROM cohort c
       LEFT JOIN (SELECT DISTINCT po.person_id, po.visit_occurrence_id FROM procedure_occurrence po
         JOIN procedure_mapping m ON m.concept_id = po.procedure_concept_id WHERE m.mapping = 'dialysis') d
       ON c.person_id = d.person_id AND c.visit_occurrence_id = d.visit_occurrence_id""",
)
def _(t: Tables):
    sets = S.concept_sets(t.procedure_mapping, "mapping", wanted={"dialysis": "dialysis"})
    done = (
        t.procedure_occurrence.join(
            R.sized_broadcast(sets.withColumnRenamed("concept_id", "procedure_concept_id")), "procedure_concept_id"
        )
        .select(*X.VISIT_KEY)
        .distinct()
        .withColumn("has_dialysis", F.lit(1))
    )
    return R.attach_flags(stored_cohort(t), done, X.VISIT_KEY)


@check(
    "j16_unordered_pairs",
    """SELECT a.src_name AS site1, b.src_name AS site2, a.n AS n1, b.n AS n2
       FROM (SELECT src_name, COUNT(*) AS n FROM person_per_site GROUP BY 1) a
       JOIN (SELECT src_name, COUNT(*) AS n FROM person_per_site GROUP BY 1) b ON a.src_name < b.src_name""",
)
def _(t: Tables):
    sizes = R.count_by(t.person_per_site, ["src_name"]).withColumnRenamed("src_name", "site")
    return R.pairs(sizes, "site")


# --- aggregates ---------------------------------------------------------------


@check("a1_count_by", "SELECT race_concept_id, COUNT(*) AS n FROM person GROUP BY race_concept_id")
def _(t: Tables):
    return R.count_by(t.person, ["race_concept_id"])


@check(
    "a1_value_counts",
    "SELECT race_concept_id, COUNT(*) AS n FROM person WHERE race_concept_id IS NOT NULL GROUP BY race_concept_id",
)
def _(t: Tables):
    return R.count_by(t.person, ["race_concept_id"], drop_null_keys=True)


@check(
    "a2_count_distinct",
    "SELECT care_site_id, COUNT(DISTINCT person_id) AS n FROM visit_occurrence GROUP BY care_site_id",
)
def _(t: Tables):
    return R.count_distinct_by(t.visit_occurrence, ["care_site_id"], "person_id")


@check("a3_distinct", "SELECT DISTINCT visit_concept_id, care_site_id FROM visit_occurrence")
def _(t: Tables):
    return t.visit_occurrence.select("visit_concept_id", "care_site_id").distinct()


@check(
    "a4_flags_null_absent",
    """SELECT person_id, visit_occurrence_id, MAX(CASE WHEN name = 'steroid' THEN 1 END) AS steroid_flag,
         MAX(CASE WHEN name = 'sedative' THEN 1 END) AS sedative_flag FROM exposed GROUP BY 1, 2""",
)
def _(t: Tables):
    found = X.exposed_visits(expanded(t), t.drug_exposure, t.visit_occurrence, label="name")
    return R.pivot_flags(found, X.VISIT_KEY, "name", {"steroid_flag": "steroid", "sedative_flag": "sedative"})


@check(
    "a5_flags_zero_absent",
    """SELECT person_id, visit_occurrence_id, MAX(CASE WHEN condition_status_concept_id = 32890 THEN 1 ELSE 0 END) AS admit,
         MAX(CASE WHEN condition_status_concept_id = 32907 THEN 1 ELSE 0 END) AS discharge
       FROM condition_occurrence GROUP BY 1, 2""",
)
def _(t: Tables):
    wanted = {"admit": 32890, "discharge": 32907}
    return R.pivot_flags(t.condition_occurrence, X.VISIT_KEY, "condition_status_concept_id", wanted, absent=0)


@check(
    "a6_rate_by",
    """SELECT race_name, gender_name, AVG(nasal_canula_mask) AS avg_nasal_canula_mask,
         AVG(hiflo_oximyzer) AS avg_hiflo_oximyzer, AVG(cpap_bipap) AS avg_cpap_bipap,
         AVG(mechanical_ventilation) AS avg_mechanical_ventilation FROM cohort_devices GROUP BY 1, 2""",
)
def _(t: Tables):
    found = X.device_flags(stored_cohort(t), t.device_exposure, X.device_sets(t.device_mapping), [EXCLUDED_DEVICE])
    return R.rate_by(found, ["race_name", "gender_name"], list(X.DEVICE_SETS))


@check(
    "a7_two_level",
    """SELECT race_concept_id, COUNT(person_id) AS total_patients, CAST(SUM(n) AS BIGINT) AS total_events,
         ROUND(AVG(n), 2) AS avg_events
       FROM (SELECT p.race_concept_id, o.person_id, COUNT(*) AS n FROM procedure_occurrence o
             JOIN person p ON o.person_id = p.person_id GROUP BY 1, 2) t GROUP BY 1""",
)
def _(t: Tables):
    rows = t.procedure_occurrence.join(t.person.select("person_id", "race_concept_id"), "person_id")
    return R.events_per_subject(rows, "person_id", "race_concept_id")


_NUM = "SELECT 'o_totalprice' AS variable, o_totalprice AS v FROM orders UNION ALL SELECT 'o_custkey', o_custkey FROM orders"


@check(
    "a8_summarize",
    f"""SELECT variable, ROUND(AVG(v), 4) AS mean, quantile_cont(v, 0.5) AS median, MIN(v) AS min, MAX(v) AS max,
          ROUND(SUM(v), 2) AS sum, COUNT(v) AS count FROM ({_NUM}) t GROUP BY 1""",
)
def _(t: Tables):
    found = summarize(t.orders, ["o_totalprice", "o_custkey"])
    return found.withColumns({"mean": F.round("mean", 4), "sum": F.round("sum", 2)})


@check(
    "a9_describe_by",
    """SELECT o_orderpriority, 'o_totalprice' AS variable, ROUND(AVG(o_totalprice), 4) AS mean,
         ROUND(stddev_samp(o_totalprice), 4) AS std, ROUND(quantile_cont(o_totalprice, 0.5), 4) AS median
       FROM orders GROUP BY 1""",
)
def _(t: Tables):
    # The bucketed path, whatever the size of the table.
    found = describe_by(t.orders, ["o_orderpriority"], ["o_totalprice"], small_rows=0)
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "std", "median")})


_FLAG_ROWS = " UNION ALL ".join(
    f"""SELECT gender_name, '{c}' AS variable, AVG(CAST({c} AS INT)) AS proportion,
        CAST(SUM(CAST({c} AS INT)) AS BIGINT) AS positives, COUNT(*) AS total FROM flags GROUP BY 1"""
    for c in ("died_in_hospital", "steroid_flag", "ecmo")
)


@check("a10_flag_profile", _FLAG_ROWS)
def _(t: Tables):
    return R.flag_profile(stored_flags(t), ["gender_name"], ["died_in_hospital", "steroid_flag", "ecmo"])


@check(
    "a11_breakdown",
    """SELECT gender_name, COUNT(los) AS los_count, ROUND(AVG(los), 2) AS los_mean, ROUND(stddev_samp(los), 2) AS los_std,
         CAST(SUM(CAST(died_in_hospital AS INT)) AS DOUBLE) AS died_in_hospital_sum,
         ROUND(AVG(CAST(died_in_hospital AS INT)), 2) AS died_in_hospital_mean
       FROM clinical GROUP BY 1""",
)
def _(t: Tables):
    from checks.shared import clinical

    return R.breakdown(clinical(t), "gender_name", "los", "died_in_hospital")


@check(
    "a12_describe",
    f"""SELECT variable, COUNT(v) AS count, ROUND(AVG(v), 4) AS mean, ROUND(stddev_samp(v), 4) AS std, MIN(v) AS min,
          quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3, MAX(v) AS max
        FROM ({_NUM}) t GROUP BY 1""",
)
def _(t: Tables):
    return describe(t.orders, ["o_totalprice", "o_custkey"]).withColumns(
        {"mean": F.round("mean", 4), "std": F.round("std", 4)}
    )


@check(
    "a13_stratum_means",
    """SELECT o_orderstatus, o_orderpriority, COUNT(*) AS count, AVG(o_totalprice) AS mean_price,
         AVG(o_orderkey % 30) AS mean_stay, AVG(o_totalprice) + AVG(o_orderkey % 30) AS mean_both
       FROM orders GROUP BY 1, 2""",
)
def _(t: Tables):
    rows = t.orders.withColumn("stay", F.col("o_orderkey") % 30)
    return R.stratum_means(
        rows,
        ["o_orderstatus", "o_orderpriority"],
        {"mean_price": "o_totalprice", "mean_stay": "stay"},
        {"mean_both": ["mean_price", "mean_stay"]},
    )


@check(
    "a14_crosstab",
    """SELECT race_concept_id, care_site_id, COUNT(*) AS n FROM person
       WHERE race_concept_id IS NOT NULL AND care_site_id IS NOT NULL GROUP BY 1, 2""",
)
def _(t: Tables):
    return R.crosstab_long(t.person, "race_concept_id", "care_site_id")


@check(
    "a15_row_proportions",
    """SELECT race_concept_id, gender_concept_id, n, n * 1.0::DOUBLE / SUM(n) OVER (PARTITION BY race_concept_id) AS proportion
       FROM (SELECT race_concept_id, gender_concept_id, COUNT(*) AS n FROM person
             WHERE race_concept_id IS NOT NULL GROUP BY 1, 2) t""",
)
def _(t: Tables):
    return R.row_proportions(R.crosstab_long(t.person, "race_concept_id", "gender_concept_id"), "race_concept_id")


_GRID = """SELECT x.care_site_id, y.race_concept_id, COALESCE(c.n, 0) AS n
  FROM (SELECT DISTINCT care_site_id FROM person WHERE care_site_id IS NOT NULL AND race_concept_id IS NOT NULL) x
  CROSS JOIN (SELECT DISTINCT race_concept_id FROM person WHERE care_site_id IS NOT NULL AND race_concept_id IS NOT NULL) y
  LEFT JOIN (SELECT care_site_id, race_concept_id, COUNT(*) AS n FROM person GROUP BY 1, 2) c
  ON c.care_site_id = x.care_site_id AND c.race_concept_id = y.race_concept_id"""


@check("a16_count_grid", _GRID)
def _(t: Tables):
    return R.count_grid(t.person, "care_site_id", "race_concept_id")


@check(
    "a17_pivot_sum",
    """SELECT race_name, CAST(COALESCE(SUM(CASE WHEN gender_name = 'MALE' THEN cnt END), 0) AS BIGINT) AS "cnt_MALE",
         CAST(COALESCE(SUM(CASE WHEN gender_name = 'FEMALE' THEN cnt END), 0) AS BIGINT) AS "cnt_FEMALE",
         CAST(COALESCE(SUM(CASE WHEN gender_name = 'MALE' THEN base_count END), 0) AS BIGINT) AS "base_count_MALE",
         CAST(COALESCE(SUM(CASE WHEN gender_name = 'FEMALE' THEN base_count END), 0) AS BIGINT) AS "base_count_FEMALE"
       FROM rates GROUP BY 1""",
)
def _(t: Tables):
    from checks.shared import rates

    return R.pivot_sum(rates(t), "race_name", "gender_name", ["MALE", "FEMALE"], ["cnt", "base_count"])


@check(
    "a18_max_cell",
    """SELECT gender_concept_id, MAX(n) AS max_count FROM (
         SELECT gender_concept_id, race_concept_id, ethnicity_concept_id, COUNT(*) AS n FROM person
         WHERE race_concept_id IS NOT NULL GROUP BY 1, 2, 3) t GROUP BY 1""",
)
def _(t: Tables):
    return R.max_cell(t.person, ["gender_concept_id"], ["race_concept_id", "ethnicity_concept_id"])


@check(
    "a19_mode",
    """SELECT variable, value AS mode FROM (
         SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS rn FROM (
           SELECT 'race_concept_id' AS variable, CAST(race_concept_id AS VARCHAR) AS value, COUNT(*) AS n FROM person
             WHERE race_concept_id IS NOT NULL GROUP BY 2
           UNION ALL SELECT 'year_of_birth', CAST(year_of_birth AS VARCHAR), COUNT(*) FROM person GROUP BY 2) t) u
       WHERE rn = 1""",
)
def _(t: Tables):
    return R.mode_of(t.person, ["race_concept_id", "year_of_birth"])


@check(
    "a20_margins",
    """SELECT name, CASE WHEN grouping(race_name) = 0 AND grouping(gender_name) = 0 THEN 'race_name+gender_name'
           WHEN grouping(race_name) = 0 THEN 'race_name+age_group'
           WHEN grouping(gender_name) = 0 AND grouping(age_group) = 0 THEN 'gender_name+age_group'
           WHEN grouping(gender_name) = 0 THEN 'gender_name' ELSE 'age_group' END AS margin,
         gender_name, age_group, race_name, CAST(SUM(cnt) AS BIGINT) AS cnt, CAST(SUM(base_count) AS BIGINT) AS base_count,
         SUM(cnt) * 100.0::DOUBLE / SUM(base_count) AS percentage
       FROM rates GROUP BY GROUPING SETS ((name, gender_name), (name, age_group), (name, gender_name, age_group),
         (name, race_name, gender_name), (name, race_name, age_group))""",
)
def _(t: Tables):
    from checks.shared import rates
    from cohortry.plans.rates import rate_margins

    sets = [
        ["gender_name"],
        ["age_group"],
        ["gender_name", "age_group"],
        ["race_name", "gender_name"],
        ["race_name", "age_group"],
    ]
    found = rate_margins(rates(t), sets)
    order = F.when(F.col("margin") == "gender_name+race_name", "race_name+gender_name").when(
        F.col("margin") == "age_group+race_name", "race_name+age_group"
    )
    return found.withColumn("margin", F.coalesce(order, "margin"))


@check(
    "a21_guarded_rate",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_custkey * 100.0::DOUBLE / (o_orderkey % 3) END AS percentage
       FROM orders""",
)
def _(t: Tables):
    rows = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 3).alias("base"))
    return R.add_rate(rows, "o_custkey", "base").select("o_orderkey", "percentage")


@check(
    "a22_outcome_summary",
    """SELECT race_name, CAST(SUM(visits) AS BIGINT) AS visits, COUNT(*) AS people, CAST(SUM(f) AS BIGINT) AS first_visit_deaths,
         COUNT(CASE WHEN visits > 1 THEN 1 END) AS readmitted, AVG(visits - 1) AS mean_readmissions,
         quantile_cont(visits - 1, 0.5) AS median_readmissions, MAX(visits - 1) AS max_readmissions,
         CAST(SUM(h) AS BIGINT) AS died_hospital, CAST(SUM(m) AS BIGINT) AS died_30_days,
         CAST(SUM(greatest(h, m)) AS BIGINT) AS died_total, SUM(f) * 100.0::DOUBLE / COUNT(*) AS first_visit_deaths_pct,
         COUNT(CASE WHEN visits > 1 THEN 1 END) * 100.0::DOUBLE / COUNT(*) AS readmitted_pct,
         SUM(h) * 100.0::DOUBLE / COUNT(*) AS died_hospital_pct, SUM(m) * 100.0::DOUBLE / COUNT(*) AS died_30_days_pct,
         SUM(greatest(h, m)) * 100.0::DOUBLE / COUNT(*) AS died_total_pct
       FROM (SELECT n.race_name, v.person_id, COUNT(*) AS visits,
               MAX(CASE WHEN first_visit AND (died_in_hospital OR died_in_30_days) THEN 1 ELSE 0 END) AS f,
               MAX(CAST(died_in_hospital AS INT)) AS h, MAX(CAST(died_in_30_days AS INT)) AS m
             FROM visit_kept v JOIN adult_named n ON n.person_id = v.person_id GROUP BY 1, 2) t GROUP BY 1""",
)
def _(t: Tables):
    from checks.registry import AS_OF
    from cohortry.plans.cohort import add_demographics

    visits = surviving_visits(t.person, t.visit_occurrence, t.death, AS_OF)
    people = add_demographics(t.person, t.concept).select("person_id", "race_name")
    return outcome_summary(visits.join(people, "person_id"))


@check(
    "a23_attrition",
    """SELECT 1 AS step_no, 'discharge in the future' AS step, COUNT(*) AS rows_removed,
         COUNT(DISTINCT person_id) AS people_affected FROM visit_judged WHERE visit_end_datetime > TIMESTAMP '2001-08-01'
       UNION ALL SELECT 2, 'death two or more days before discharge', COUNT(*), COUNT(DISTINCT person_id) FROM visit_judged
         WHERE NOT COALESCE(visit_end_datetime > TIMESTAMP '2001-08-01', FALSE) AND days <= -2
       UNION ALL SELECT 3, 'too many visits', CAST(COALESCE(SUM(n), 0) AS BIGINT), COUNT(*) FROM (
         SELECT person_id, COUNT(*) AS n FROM visit_kept GROUP BY 1 HAVING COUNT(*) > 15) t""",
)
def _(t: Tables):
    from checks.registry import AS_OF, MAX_VISITS

    return attrition(t.person, t.visit_occurrence, t.death, AS_OF, MAX_VISITS)


@check("a24_cluster_sizes", "SELECT label AS cluster, COUNT(*) AS n FROM embeddings GROUP BY 1")
def _(t: Tables):
    from cohortry.operators.evaluation import cluster_sizes

    return cluster_sizes(t.embeddings, "label")


@check(
    "a25_row_counts",
    """SELECT l AS left_rows, r AS right_rows, l = r AS equal FROM
       (SELECT (SELECT COUNT(*) FROM cohort) AS l, (SELECT COUNT(*) FROM cohort_devices) AS r) t""",
)
def _(t: Tables):
    found = X.device_flags(stored_cohort(t), t.device_exposure, X.device_sets(t.device_mapping), [EXCLUDED_DEVICE])
    return R.row_count_check(stored_cohort(t), found)


# --- one row per key ---------------------------------------------------------------


@check(
    "w1_first_per_key",
    """SELECT person_id, death_date, death_datetime FROM (SELECT *, row_number() OVER (PARTITION BY person_id
         ORDER BY death_date NULLS FIRST, death_datetime NULLS FIRST) AS rn FROM death) t WHERE rn = 1""",
)
def _(t: Tables):
    return R.first_per_key(t.death, ["person_id"], ["death_date", "death_datetime"])


@check(
    "w2_first_flag",
    """SELECT visit_occurrence_id, person_id, row_number() OVER (PARTITION BY person_id
         ORDER BY visit_start_datetime NULLS LAST, visit_occurrence_id) = 1 AS first_visit FROM visit_occurrence""",
)
def _(t: Tables):
    visits = t.visit_occurrence.select("visit_occurrence_id", "person_id", "visit_start_datetime")
    marked = R.flag_first(visits, ["person_id"], ["visit_start_datetime"], "visit_occurrence_id", "first_visit")
    return marked.drop("visit_start_datetime")


@check(
    "w3_last_per_key",
    """SELECT visit_occurrence_id, person_id, visit_start_datetime FROM (SELECT *, row_number() OVER (
         PARTITION BY person_id ORDER BY visit_start_datetime DESC NULLS FIRST, visit_occurrence_id DESC) AS rn
       FROM visit_occurrence) t WHERE rn = 1""",
)
def _(t: Tables):
    visits = t.visit_occurrence.select("visit_occurrence_id", "person_id", "visit_start_datetime")
    return R.last_per_key(visits, ["person_id"], ["visit_start_datetime", "visit_occurrence_id"])


@check(
    "w4_death_after_discharge",
    """WITH lv AS (SELECT v.*, row_number() OVER (PARTITION BY v.person_id ORDER BY visit_end_datetime DESC,
           visit_occurrence_id DESC) AS rn FROM visit_occurrence v JOIN person p ON v.person_id = p.person_id
         WHERE year(v.visit_start_datetime) - p.year_of_birth >= 18),
       ld AS (SELECT person_id, MAX(death_datetime) AS death_datetime FROM death
         WHERE death_datetime IS NOT NULL GROUP BY 1)
       SELECT lv.person_id, lv.visit_occurrence_id, lv.visit_start_datetime, lv.visit_end_datetime AS latest_discharge_datetime,
         ld.death_datetime, CAST(date_diff('day', lv.visit_end_datetime, ld.death_datetime) AS INT) AS days_to_death,
         CASE WHEN ld.death_datetime >= lv.visit_end_datetime THEN 'Death after discharge'
           WHEN ld.death_datetime BETWEEN lv.visit_start_datetime AND lv.visit_end_datetime THEN 'Death during visit' END AS death_timing
       FROM lv JOIN ld ON lv.person_id = ld.person_id WHERE rn = 1""",
)
def _(t: Tables):
    return death_after_latest_discharge(t.visit_occurrence, t.death, t.person)


@check(
    "w5_bounded_sample",
    """SELECT * FROM visit_occurrence QUALIFY row_number() OVER (PARTITION BY visit_concept_id
         ORDER BY substr(md5(visit_occurrence_id || ':42'), 1, 15), visit_occurrence_id) <= 40""",
)
def _(t: Tables):
    return R.bounded_sample(t.visit_occurrence, 40, "visit_occurrence_id", by=["visit_concept_id"])


@check(
    "w6_average_rank",
    """SELECT variable, value, ties, avg_rank FROM (
         SELECT DISTINCT o_orderstatus AS variable, o_totalprice AS value,
           COUNT(*) OVER (PARTITION BY o_orderstatus, o_totalprice) AS ties,
           rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice)
             + (COUNT(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0::DOUBLE AS avg_rank FROM orders) t""",
)
def _(t: Tables):
    rows = t.orders.select(F.col("o_orderstatus").alias("variable"), F.col("o_totalprice").alias("value"))
    # The bucketed path, whatever the size of the table.
    return rank_values(rows, "value", ["variable"], small_rows=0).drop("n")


# --- order ---------------------------------------------------------------

_SITES = "SELECT care_site_id, COUNT(*) AS n FROM visit_occurrence GROUP BY 1"


@check("o1_order_by_aggregate", f"{_SITES} ORDER BY n DESC, care_site_id")
def _(t: Tables):
    return R.count_by(t.visit_occurrence, ["care_site_id"]).orderBy(F.desc("n"), "care_site_id")


@check("o2_order_by_keys", "SELECT person_id, visit_occurrence_id FROM cohort ORDER BY person_id, visit_occurrence_id")
def _(t: Tables):
    return stored_cohort(t).select(*X.VISIT_KEY).orderBy(*X.VISIT_KEY)


@check(
    "o3_ranked_results",
    "SELECT name, race_name, gender_name, age_group, percentage FROM rates ORDER BY percentage DESC, name",
)
def _(t: Tables):
    from checks.shared import rates

    found = rates(t).select("name", "race_name", "gender_name", "age_group", "percentage")
    return found.orderBy(F.desc("percentage"), "name")


@check("o4_limit", "SELECT visit_occurrence_id, person_id FROM visit_occurrence ORDER BY visit_occurrence_id DESC LIMIT 25")
def _(t: Tables):
    ids = t.visit_occurrence.select("visit_occurrence_id", "person_id")
    return ids.orderBy(F.desc("visit_occurrence_id")).limit(25)


@check(
    "o5_top_1",
    f"SELECT * FROM ({_SITES}) s ORDER BY n DESC, care_site_id LIMIT 1",
)
def _(t: Tables):
    sites = R.count_by(t.visit_occurrence, ["care_site_id"])
    return R.best(sites, "n", ["care_site_id"])


@check(
    "o6_level_order",
    """SELECT src_name, COUNT(*) AS n, CAST(CASE src_name WHEN 'SITE-3' THEN 1 WHEN 'SITE-1' THEN 2 WHEN 'SITE-8' THEN 3 END AS INT) AS level
       FROM person_per_site GROUP BY 1""",
)
def _(t: Tables):
    from cohortry.functions.expr import level_of

    counts = R.count_by(t.person_per_site, ["src_name"])
    return counts.withColumn("level", level_of("src_name", ["SITE-3", "SITE-1", "SITE-8"]))


# --- set operations ---------------------------------------------------------------


@check(
    "u1_union_labeled",
    """SELECT person_id, visit_occurrence_id, 'device' AS source FROM device_exposure
       UNION ALL SELECT person_id, visit_occurrence_id, 'procedure' FROM procedure_occurrence""",
)
def _(t: Tables):
    frames = {"device": t.device_exposure.select(*X.VISIT_KEY), "procedure": t.procedure_occurrence.select(*X.VISIT_KEY)}
    return R.union_labeled(frames, "source")


@check(
    "u2_concatenate",
    """SELECT person_id, death_date FROM death UNION ALL SELECT person_id, visit_start_date FROM visit_occurrence""",
)
def _(t: Tables):
    parts = [
        t.death.select("person_id", "death_date"),
        t.visit_occurrence.select("person_id", F.col("visit_start_date").alias("death_date")),
    ]
    return R.union_all(parts, t.spark, parts[0].schema)


@check(
    "u3_union_of_ids",
    "SELECT concept_id FROM procedure_mapping WHERE mapping IN ('ECMO', 'dialysis') UNION SELECT concept_id FROM device_mapping",
)
def _(t: Tables):
    sets = S.concept_sets(t.procedure_mapping, "mapping", wanted=X.PROCEDURE_SETS).select("concept_id")
    return sets.union(t.device_mapping.select("concept_id")).distinct()
