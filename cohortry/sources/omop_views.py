"""Hospital-record tables as views over the generic star-schema test tables.

The SQL runs unchanged in Spark and in DuckDB. ``{name}`` marks an input relation:
Spark binds a DataFrame to it, the checks put a CTE name there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_TABLES = ("customer", "orders", "lineitem", "part", "supplier")

VIEWS: dict[str, str] = {
    "person": """
SELECT c_custkey AS person_id, CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS gender_concept_id,
  1910 + c_custkey % 80 AS year_of_birth,
  CAST(CONCAT(CAST(1910 + c_custkey % 80 AS STRING), '-07-01') AS TIMESTAMP) AS birth_datetime,
  CASE WHEN c_nationkey % 8 = 7 THEN NULL ELSE 9000 + c_nationkey % 8 END AS race_concept_id,
  9100 + c_custkey % 3 AS ethnicity_concept_id,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 50 END AS provider_id,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS care_site_id
FROM {customer}""",
    "visit_occurrence": """
SELECT o_orderkey AS visit_occurrence_id, o_custkey AS person_id, 9201 + o_orderkey % 3 AS visit_concept_id,
  o_orderdate AS visit_start_datetime,
  o_orderdate + (o_orderkey % 30) * INTERVAL '1' DAY AS visit_end_datetime,
  CAST(o_orderdate AS DATE) AS visit_start_date,
  CAST(o_orderdate + (o_orderkey % 30) * INTERVAL '1' DAY AS DATE) AS visit_end_date,
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 50 END AS provider_id,
  CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_orderkey % 10 = 0 THEN -1 ELSE c_nationkey END AS care_site_id
FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "death": """
SELECT person_id, CAST(d AS DATE) AS death_date, CASE WHEN person_id % 4 = 0 THEN NULL ELSE d END AS death_datetime
FROM (SELECT person_id, MAX(visit_end_datetime) + (person_id % 50 - 5) * INTERVAL '1' DAY AS d
      FROM {visit_occurrence} JOIN {customer} ON person_id = c_custkey WHERE c_acctbal < 500 GROUP BY person_id) t
UNION ALL
SELECT person_id, DATE '2002-06-01', NULL
FROM {visit_occurrence} JOIN {customer} ON person_id = c_custkey
WHERE c_acctbal < 500 AND person_id % 3 = 0 GROUP BY person_id""",
    "concept": """
SELECT 100000 + p_partkey AS concept_id, p_name AS concept_name,
  CASE WHEN p_partkey % 2 = 0 THEN 'S' ELSE NULL END AS standard_concept FROM {part}
UNION ALL SELECT DISTINCT 200000 + p_size, CONCAT('class ', CAST(p_size AS STRING)), NULL FROM {part}
UNION ALL SELECT 300000 + p_partkey, p_name, NULL FROM {part}
UNION ALL SELECT 400000 + p_partkey, p_name, NULL FROM {part}
UNION ALL SELECT id, nm, 'S' FROM (VALUES (9000,'White'),(9001,'African American'),(9002,'Asian'),(9003,'Other'),
  (9004,'American Indian or Alaska Native'),(9005,'Other Pacific Islander'),(9006,'More than one race'),
  (8507,'MALE'),(8532,'FEMALE'),(9100,'Hispanic or Latino'),(9101,'Not Hispanic or Latino'),
  (9102,'No matching concept'),(9201,'Inpatient Visit'),(9202,'Outpatient Visit'),
  (32890,'Admission diagnosis')) AS t(id, nm)""",
    "concept_relationship": """
SELECT 200000 + p_size AS concept_id_1, 300000 + p_partkey AS concept_id_2, 'Subsumes' AS relationship_id FROM {part}
UNION ALL SELECT 300000 + p_partkey, 400000 + p_partkey, 'SNOMED - RxNorm eq' FROM {part}
UNION ALL SELECT 400000 + p_partkey, 100000 + p_partkey, 'Maps to' FROM {part}
UNION ALL SELECT 300000 + p_partkey, 400001 + p_partkey, 'Is a' FROM {part}""",
    "drug_exposure": """
SELECT 100000 + l_partkey AS drug_concept_id, l_orderkey AS visit_occurrence_id FROM {lineitem}""",
    "procedure_occurrence": """
SELECT o_custkey AS person_id, l_orderkey AS visit_occurrence_id, 500000 + l_suppkey AS procedure_concept_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 1""",
    "device_exposure": """
SELECT o_custkey AS person_id, l_orderkey AS visit_occurrence_id, 600000 + l_suppkey AS device_concept_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 2""",
    "condition_occurrence": """
SELECT o_custkey AS person_id, l_orderkey AS visit_occurrence_id,
  CASE l_partkey % 4 WHEN 0 THEN 32890 WHEN 1 THEN 32901 WHEN 2 THEN 32907 ELSE NULL END AS condition_status_concept_id
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_linenumber = 3""",
    "person_per_site": """
SELECT c_custkey AS person_id, CONCAT('SITE-', CAST(c_nationkey % 9 + 1 AS STRING)) AS src_name FROM {customer}""",
    "procedure_mapping": """
SELECT 500000 + s_suppkey AS concept_id,
  CASE WHEN s_suppkey % 10 = 0 THEN 'ECMO' WHEN s_suppkey % 10 IN (1, 2) THEN 'dialysis' ELSE 'other' END AS mapping
FROM {supplier}""",
    "device_mapping": """
SELECT 600000 + s_suppkey AS concept_id, CAST(s_suppkey % 6 AS STRING) AS Mapping FROM {supplier}""",
}


class Tables:
    """Lazy access to the base tables and the views above: ``Tables(spark, dir).person``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            self._frames[name] = self._build(name)
        return self._frames[name]

    def _build(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        used = {n: getattr(self, n) for n in (*BASE_TABLES, *VIEWS) if "{" + n + "}" in VIEWS[name]}
        frame = self.spark.sql(VIEWS[name], **used)
        # The stored timestamps carry no zone; keep the derived ones alike.
        zoned = [f.name for f in frame.schema.fields if f.dataType == T.TimestampType()]
        return frame.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})
