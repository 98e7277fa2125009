"""Column expressions."""

from pyspark.sql import functions as F

from checks.registry import Tables, check
from checks.shared import clinical, flags
from cohortry.functions import expr as E
from cohortry.operators.relational import clamp_counts

_AGES = "FROM visit_occurrence v JOIN person p ON v.person_id = p.person_id"


def _visits(t: Tables):
    return t.visit_occurrence.join(t.person.select("person_id", "year_of_birth", "birth_datetime"), "person_id")


@check("f1_age_year_difference", f"SELECT v.visit_occurrence_id, CAST(year(v.visit_start_datetime) - p.year_of_birth AS BIGINT) AS age {_AGES}")
def _(t: Tables):
    age = E.age_year_diff("visit_start_datetime", "year_of_birth").cast("long")
    return _visits(t).select("visit_occurrence_id", age.alias("age"))


@check(
    "f2_age_365",
    f"""SELECT v.visit_occurrence_id, ROUND((epoch_us(v.visit_start_datetime) - epoch_us(p.birth_datetime)) / (365 * 86400e6), 6) AS age {_AGES}""",
)
def _(t: Tables):
    age = F.round(E.age_365("visit_start_datetime", "birth_datetime"), 6)
    return _visits(t).select("visit_occurrence_id", age.alias("age"))


@check("f3_age_completed", f"SELECT v.visit_occurrence_id, datesub('year', p.birth_datetime, v.visit_start_datetime) AS age {_AGES}")
def _(t: Tables):
    age = E.age_completed("visit_start_datetime", "birth_datetime")
    return _visits(t).select("visit_occurrence_id", age.alias("age"))


@check(
    "f4_stay_hours",
    "SELECT visit_occurrence_id, (epoch_us(visit_end_datetime) - epoch_us(visit_start_datetime)) / 3600e6 AS los FROM visit_occurrence",
)
def _(t: Tables):
    return t.visit_occurrence.select(
        "visit_occurrence_id", E.los_hours("visit_start_datetime", "visit_end_datetime").alias("los")
    )


_ODD_END = "l_shipdate - INTERVAL '1' DAY * (l_linenumber % 3) + INTERVAL '1' HOUR * (l_orderkey % 30)"


def _stays(t: Tables):
    end = F.expr("l_shipdate - INTERVAL '1' DAY * (l_linenumber % 3) + INTERVAL '1' HOUR * (l_orderkey % 30)")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate", end.alias("stay_end"))


@check(
    "f5_stay_days_truncated",
    f"""SELECT l_orderkey, l_linenumber, CAST(trunc((epoch_us({_ODD_END}) - epoch_us(l_shipdate)) / 86400e6) AS INT) AS days FROM lineitem""",
)
def _(t: Tables):
    return _stays(t).select("l_orderkey", "l_linenumber", E.los_days_trunc("l_shipdate", "stay_end").alias("days"))


@check(
    "f6_day_difference",
    f"SELECT l_orderkey, l_linenumber, CAST(date_diff('day', l_shipdate, {_ODD_END}) AS INT) AS days FROM lineitem",
)
def _(t: Tables):
    return _stays(t).select("l_orderkey", "l_linenumber", E.day_diff("stay_end", "l_shipdate").alias("days"))


@check(
    "f7_fractional_days",
    f"SELECT l_orderkey, l_linenumber, ROUND((epoch_us({_ODD_END}) - epoch_us(l_shipdate)) / 86400e6, 6) AS days FROM lineitem",
)
def _(t: Tables):
    return _stays(t).select(
        "l_orderkey", "l_linenumber", F.round(E.frac_days("stay_end", "l_shipdate"), 6).alias("days")
    )


@check("f8_mixed_formats", "SELECT o_orderkey, o_orderdate AS parsed FROM orders")
def _(t: Tables):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(
        F.date_format("o_orderdate", "dd/MM/yyyy")
    )
    rows = t.orders.select("o_orderkey", text.alias("text"))
    parsed = E.parse_mixed_ts("text", ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy"])
    return rows.select("o_orderkey", parsed.cast("timestamp_ntz").alias("parsed"))


@check("f9_zone_to_naive_utc", "SELECT o_orderkey, o_orderdate - INTERVAL '5' HOUR AS utc FROM orders")
def _(t: Tables):
    text = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:00"))
    rows = t.orders.select("o_orderkey", F.to_timestamp(text).alias("at"))
    return rows.select("o_orderkey", E.to_naive_utc("at").alias("utc"))


@check("f10_coalesce", "SELECT person_id, death_date, COALESCE(death_datetime, CAST(death_date AS TIMESTAMP)) AS died FROM death")
def _(t: Tables):
    died = F.coalesce("death_datetime", F.col("death_date").cast("timestamp_ntz"))
    return t.death.select("person_id", "death_date", died.alias("died"))


@check("f11_default", "SELECT person_id, COALESCE(provider_id, -1) AS provider_id FROM person")
def _(t: Tables):
    return t.person.select("person_id", E.fill_default("provider_id", -1).alias("provider_id"))


@check(
    "f12_strict_recode",
    """SELECT person_id, CASE src_name WHEN 'SITE-1' THEN 'MW' WHEN 'SITE-3' THEN 'SW' END AS region FROM person_per_site""",
)
def _(t: Tables):
    return t.person_per_site.select("person_id", E.recode("src_name", {"SITE-1": "MW", "SITE-3": "SW"}).alias("region"))


@check(
    "f13_recode_fallback",
    """SELECT person_id, visit_occurrence_id, CAST(CASE WHEN condition_status_concept_id IN (32890, 32901, 32907) THEN 32890
         ELSE COALESCE(condition_status_concept_id, 0) END AS BIGINT) AS status FROM condition_occurrence""",
)
def _(t: Tables):
    status = E.fill_cast("condition_status_concept_id", 0, "long")
    mapped = E.recode(status, {32890: 32890, 32901: 32890, 32907: 32890}, status).cast("long")
    return t.condition_occurrence.select("person_id", "visit_occurrence_id", mapped.alias("status"))


@check(
    "f14_lump_other",
    """SELECT person_id, CASE WHEN src_name IN ('SITE-1', 'SITE-2') THEN src_name ELSE 'Other' END AS site FROM person_per_site""",
)
def _(t: Tables):
    return t.person_per_site.select("person_id", E.lump_other("src_name", ["SITE-1", "SITE-2"]).alias("site"))


@check(
    "f15_age_band",
    f"""SELECT v.visit_occurrence_id, CASE WHEN year(v.visit_start_datetime) - p.year_of_birth >= 65 THEN '65+' ELSE '<65' END AS age_group {_AGES}""",
)
def _(t: Tables):
    age = E.age_year_diff("visit_start_datetime", "year_of_birth")
    return _visits(t).select("visit_occurrence_id", E.age_band(age).alias("age_group"))


@check(
    "f16_case_label",
    """SELECT v.visit_occurrence_id, CASE WHEN d.death_at >= v.visit_end_datetime THEN 'Death after discharge'
         WHEN d.death_at BETWEEN v.visit_start_datetime AND v.visit_end_datetime THEN 'Death during visit' END AS timing
       FROM visit_occurrence v JOIN death_one d ON v.person_id = d.person_id""",
)
def _(t: Tables):
    from cohortry.plans.cohort import first_death

    rows = t.visit_occurrence.join(first_death(t.death), "person_id")
    timing = E.death_timing("visit_start_datetime", "visit_end_datetime", "death_at")
    return rows.select("visit_occurrence_id", timing.alias("timing"))


_FLAG_INPUT = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 1 END AS a,
    CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS b FROM orders"""


def _two_flags(t: Tables):
    a = F.when(F.col("o_orderkey") % 3 != 0, 1)
    return t.orders.select("o_orderkey", a.alias("a"), (F.col("o_orderkey") % 5 == 0).cast("int").alias("b"))


@check("f17_sum_flags_null", f"SELECT o_orderkey, a + b AS total FROM ({_FLAG_INPUT}) t")
def _(t: Tables):
    return _two_flags(t).select("o_orderkey", E.sum_flags(["a", "b"]).alias("total"))


@check("f18_sum_flags_zero", f"SELECT o_orderkey, COALESCE(a, 0) + COALESCE(b, 0) AS total FROM ({_FLAG_INPUT}) t")
def _(t: Tables):
    return _two_flags(t).select("o_orderkey", E.sum_flags(["a", "b"], null_as_zero=True).alias("total"))


@check(
    "f19_fill_and_cast",
    "SELECT person_id, CAST(COALESCE(care_site_id, 0) AS BIGINT) AS site FROM person",
)
def _(t: Tables):
    return t.person.select("person_id", E.fill_cast("care_site_id", 0, "long").alias("site"))


@check("f20_round", "SELECT o_orderkey, ROUND(o_totalprice / 7, 2) AS r, round_even(o_orderkey / 2, 0) AS even FROM orders")
def _(t: Tables):
    share = F.col("o_totalprice") / 7
    return t.orders.select("o_orderkey", F.round(share, 2).alias("r"), F.bround(F.col("o_orderkey") / 2, 0).alias("even"))


@check(
    "f21_clamp_counts",
    """SELECT l_orderkey, l_linenumber, least(got, total) AS got, total, greatest(total - got, 0) AS not_got, got > total AS clamped
       FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS got, CAST(l_suppkey AS BIGINT) AS total FROM lineitem) t""",
)
def _(t: Tables):
    rows = t.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("got"), F.col("l_suppkey").alias("total")
    )
    return clamp_counts(rows, "got", "total")


@check(
    "f22_as_of_bound",
    "SELECT visit_occurrence_id FROM visit_occurrence WHERE visit_end_datetime IS NULL OR visit_end_datetime <= TIMESTAMP '2001-08-01'",
)
def _(t: Tables):
    from checks.registry import AS_OF
    from cohortry.operators.relational import drop_where

    late = F.col("visit_end_datetime") > F.lit(AS_OF).cast("timestamp_ntz")
    return drop_where(t.visit_occurrence, late).select("visit_occurrence_id")


@check(
    "f23_labels",
    """SELECT DISTINCT o_orderpriority, list_aggregate(list_transform(string_split(lower(replace(replace(o_orderpriority, '-', '_'), ' ', '_')), '_'),
         lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS label FROM orders""",
)
def _(t: Tables):
    c = F.replace("o_orderpriority", F.lit("-"), F.lit("_"))
    return t.orders.select("o_orderpriority", E.pretty_label(F.lower(c)).alias("label")).distinct()


@check(
    "f24_concatenate",
    "SELECT DISTINCT a.src_name || ' vs ' || b.src_name AS pair FROM person_per_site a JOIN person_per_site b ON a.person_id = b.person_id + 1",
)
def _(t: Tables):
    after = t.person_per_site.select((F.col("person_id") + 1).alias("person_id"), F.col("src_name").alias("other"))
    return t.person_per_site.join(after, "person_id").select(E.versus("src_name", "other").alias("pair")).distinct()


@check(
    "f25_stars",
    """SELECT l_orderkey, l_linenumber, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars
       FROM (SELECT l_orderkey, l_linenumber, l_discount * l_tax * 10 / l_linenumber AS p FROM lineitem) t""",
)
def _(t: Tables):
    p = F.col("l_discount") * F.col("l_tax") * 10 / F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", E.stars(p).alias("stars"))


@check(
    "f26_arithmetic",
    """SELECT c_custkey, abs(c_acctbal) AS a, ROUND(sqrt(abs(c_acctbal)), 6) AS s, ROUND(ln(abs(c_acctbal) + 1), 6) AS l,
         greatest(1, c_nationkey) AS g FROM customer""",
)
def _(t: Tables):
    size = F.abs("c_acctbal")
    return t.customer.select(
        "c_custkey",
        size.alias("a"),
        F.round(F.sqrt(size), 6).alias("s"),
        F.round(F.log(size + 1), 6).alias("l"),
        F.greatest(F.lit(1), F.col("c_nationkey")).alias("g"),
    )


@check(
    "f27_mortality_labels",
    """SELECT visit_occurrence_id, COALESCE(days >= -1 AND days <= 0, FALSE) AS died_in_hospital,
         COALESCE(days > 0 AND days <= 30, FALSE) AS died_in_30_days FROM (
         SELECT v.visit_occurrence_id, (epoch_us(d.death_at) - epoch_us(v.visit_end_datetime)) / 86400e6 AS days
         FROM visit_occurrence v LEFT JOIN death_one d ON v.person_id = d.person_id) t""",
)
def _(t: Tables):
    from cohortry.plans.cohort import first_death

    rows = t.visit_occurrence.join(first_death(t.death), "person_id", "left")
    days = E.frac_days("death_at", "visit_end_datetime")
    return rows.select("visit_occurrence_id", *[c.alias(n) for n, c in E.mortality_labels(days).items()])


@check(
    "p12_ranges",
    """SELECT o_orderkey, COALESCE(o_totalprice >= 1000 AND o_totalprice < 50000, FALSE) AS left_closed,
         COALESCE(o_totalprice > 1000 AND o_totalprice <= 50000, FALSE) AS right_closed,
         o_totalprice BETWEEN 1000 AND 50000 AS closed FROM orders""",
)
def _(t: Tables):
    sides = {"left_closed": "left", "right_closed": "right", "closed": "both"}
    return t.orders.select(
        "o_orderkey", *[E.between_flag("o_totalprice", 1000, 50000, how).alias(n) for n, how in sides.items()]
    )


@check(
    "x1_scalar_lambda",
    """SELECT visit_occurrence_id, age >= 65 AS medicare, number_drugs, number_interventions FROM clinical""",
)
def _(t: Tables):
    return clinical(t).select("visit_occurrence_id", "medicare", "number_drugs", "number_interventions")
