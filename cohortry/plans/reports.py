"""Descriptive reports and the tables behind the figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions.expr import (
    age_365,
    age_completed,
    as_number,
    level_of,
    los_days_trunc,
    los_hours,
    medicare_flag,
    recode,
    sum_flags,
    to_naive_utc,
)
from cohortry.operators.order_stats import QUARTILES, describe, describe_by, quantiles
from cohortry.operators.relational import (
    breakdown,
    count_by,
    count_grid,
    flag_profile,
    max_cell,
    sized_broadcast,
    stratum_means,
)
from cohortry.operators.tests_of_difference import compare_groups

# Columns of the flag table.
DRUG_FLAGS = ["steroid_flag", "narcotic_flag", "sedative_flag", "vasopressor_flag"]
DEVICE_FLAGS = ["nasal_canula_mask", "hiflo_oximyzer", "cpap_bipap", "mechanical_ventilation"]
PROCEDURE_FLAGS = ["ecmo", "dialysis"]
DEATH_FLAGS = ["died_in_hospital", "died_in_30_days"]
BINARY = [*DEATH_FLAGS, *DRUG_FLAGS, *DEVICE_FLAGS, *PROCEDURE_FLAGS]
NUMERIC = ["age", "los"]

# Order and names of the levels in the stratum report.
RACE_LEVELS = ["White", "Black", "Asian", "Other", "Not Reported"]
GENDER_LEVELS = ["Male", "Female"]
GENDER_LABELS = {"MALE": "Male", "FEMALE": "Female"}
REGION_LABELS = {"MW": "Midwest", "NE": "Northeast", "SE": "Southeast"}

# Metric -> source column, sums of metrics, and figure titles.
STRATUM_METRICS = {
    "mean_age": "age",
    "mean_los": "los",
    "mean_died_in_hospital_ou": "died_in_hospital",
    "mean_died_in_30_days_ou": "died_in_30_days",
    "mean_steroid_dr": "steroid_flag",
    "mean_narcotic_dr": "narcotic_flag",
    "mean_sedative_dr": "sedative_flag",
    "mean_vasopressor_dr": "vasopressor_flag",
    "mean_nasal_canula_mask_de": "nasal_canula_mask",
    "mean_hiflo_oximyzer_de": "hiflo_oximyzer",
    "mean_cpap_bipap_de": "cpap_bipap",
    "mean_mechanical_ventilation_de": "mechanical_ventilation",
    "mean_ecmo_pr": "ecmo",
    "mean_dialysis_pr": "dialysis",
    "mean_total": "total_interventions",
}
STRATUM_SUMS = {
    "mean_dr": ["mean_steroid_dr", "mean_narcotic_dr", "mean_sedative_dr", "mean_vasopressor_dr"],
    "mean_de": [
        "mean_nasal_canula_mask_de",
        "mean_hiflo_oximyzer_de",
        "mean_cpap_bipap_de",
        "mean_mechanical_ventilation_de",
    ],
}
FIGURE_TITLES = {
    "mean_age": "Age",
    "mean_los": "Length of Stay",
    "mean_died_in_hospital_ou": "In-Hospital Mortality",
    "mean_died_in_30_days_ou": "30-Day Mortality",
    "mean_steroid_dr": "Steroid Use",
    "mean_narcotic_dr": "Narcotic Use",
    "mean_sedative_dr": "Sedative Use",
    "mean_vasopressor_dr": "Vasopressor Use",
    "mean_dr": "Total Drug Use",
    "mean_nasal_canula_mask_de": "Nasal Cannula or Mask",
    "mean_hiflo_oximyzer_de": "High-Flow or Oxymyzer Use",
    "mean_cpap_bipap_de": "CPAP or BiPAP Use",
    "mean_mechanical_ventilation_de": "Mechanical Ventilation",
    "mean_de": "Total Device Use",
    "mean_ecmo_pr": "ECMO Use",
    "mean_dialysis_pr": "Dialysis Use",
    "mean_total": "Total Interventions",
}


def clinical_columns(flags: DataFrame) -> DataFrame:
    """Age in 365-day years, stay in hours, medicare age, and counts of drugs and interventions."""
    times = ["visit_start_datetime", "visit_end_datetime", "birth_datetime"]
    # Columns of one row only, so derived ones can build on the ones before.
    naive = flags.withColumns({c: to_naive_utc(c) for c in times})
    timed = naive.withColumns(
        {
            "age": age_365("visit_start_datetime", "birth_datetime"),
            "los": los_hours("visit_start_datetime", "visit_end_datetime"),
        }
    )
    return timed.withColumns(
        {
            "medicare": medicare_flag("age"),
            "number_interventions": sum_flags([*DEVICE_FLAGS, "ecmo"]),
            "number_drugs": sum_flags(DRUG_FLAGS),
        }
    )


# --- figure tables ---------------------------------------------------------------


def box_stats(df: DataFrame, group: str | None, value: str, outcome: str) -> DataFrame:
    """Box-plot numbers per group and outcome side: n, mean, quartiles and whisker ends.

    Whiskers end at the outermost values within 1.5 interquartile ranges of the box.
    """
    keys = [*([group] if group else []), outcome]
    numeric_outcome = df.schema[outcome].dataType
    side = as_number(outcome).cast("int") if isinstance(numeric_outcome, T.BooleanType) else F.col(outcome)
    rows = df.select(*keys[:-1], side.alias(outcome), F.col(value).cast("double").alias("value")).dropna()
    boxes = quantiles(rows, "value", keys, QUARTILES)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        rows.join(sized_broadcast(boxes), keys)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("value").alias("mean"),
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        )
    )


def axis_limits(df: DataFrame, column: str, binary: bool = False, margin: float = 0.05) -> DataFrame:
    """Shared axis range with a margin; a binary column spans 0 to 1."""
    if binary:
        low, high = F.lit(0.0), F.lit(1.0)
        edges = df.agg(low.alias("low"), high.alias("high"))
    else:
        edges = df.agg(
            F.min(F.col(column).cast("double")).alias("low"), F.max(F.col(column).cast("double")).alias("high")
        )
    pad = (F.col("high") - F.col("low")) * margin
    return edges.select((F.col("low") - pad).alias("low"), (F.col("high") + pad).alias("high"))


def scatter_points(df: DataFrame, x: str, y: str, group: str | None = None) -> DataFrame:
    """Points of a scatter plot with the size of their group."""
    if group is None:
        return df.select(F.col(x).alias("x"), F.col(y).alias("y"))
    sizes = sized_broadcast(count_by(df, [group], "group_size", drop_null_keys=True))
    return df.select(group, F.col(x).alias("x"), F.col(y).alias("y")).join(sizes, group)


def scatter_bins(df: DataFrame, x: str, y: str, group: str | None = None, bins: int = 50, margin: float = 0.05) -> DataFrame:
    """A scatter plot of any size as a grid: ``([group], bin_x, bin_y, n, mean_x, mean_y)`` of the cells that hold points.

    The grid spans the axis limits of all rows, so the groups' plots share it. Rows without
    a group or a coordinate are left out; an axis with a single value has one bin, 0.
    """
    keys = [group] if group else []
    rows = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    across = axis_limits(rows, "x", margin=margin).toDF("low_x", "high_x")
    upward = axis_limits(rows, "y", margin=margin).toDF("low_y", "high_y")

    def cell(axis: str) -> Column:
        share = F.try_divide(F.col(axis) - F.col(f"low_{axis}"), F.col(f"high_{axis}") - F.col(f"low_{axis}"))
        return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")

    # One row of limits each.
    placed = rows.join(F.broadcast(across)).join(F.broadcast(upward))
    cells = placed.groupBy(*keys, cell("x").alias("bin_x"), cell("y").alias("bin_y"))
    return cells.agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))


def figure_table(means: DataFrame, keys: Sequence[str], titles: Mapping[str, str] = FIGURE_TITLES) -> DataFrame:
    """Long form of the stratum means: value, bar label, title and the metric's axis limit."""
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), F.lit(t).alias("title"), F.col(m).cast("double").alias("value"))
                for m, t in titles.items()
            ]
        )
    )
    long = means.select(*keys, cells.alias("c")).select(*keys, "c.*")
    limits = sized_broadcast(long.groupBy("metric").agg((F.max("value") * 1.15).alias("upper_limit")))
    return long.join(limits, "metric").withColumn("bar_label", F.bround(F.col("value") * 100, 1))


# --- reports ---------------------------------------------------------------


def stratum_report(flags: DataFrame) -> DataFrame:
    """Means over race x gender x region, with level columns for ordering.

    Values outside the race or gender levels become null.
    """
    rows = flags.withColumns(
        {
            "total_interventions": sum_flags([*DRUG_FLAGS, *DEVICE_FLAGS, *PROCEDURE_FLAGS], null_as_zero=True),
            "age": age_completed("visit_start_datetime", "birth_datetime"),
            "los": los_days_trunc("visit_start_datetime", "visit_end_datetime"),
        }
    )
    means = stratum_means(rows, ["race_name", "gender_name", "site_location"], STRATUM_METRICS, STRATUM_SUMS)
    gender = recode("gender_name", GENDER_LABELS, F.col("gender_name"))
    return (
        means.withColumn("gender_name", gender)
        .withColumns(
            {
                "race_level": level_of("race_name", RACE_LEVELS),
                "gender_level": level_of("gender_name", GENDER_LEVELS),
                "site_location": recode("site_location", REGION_LABELS, F.col("site_location")),
            }
        )
        .withColumns(
            {
                "race_name": F.when(F.col("race_level").isNotNull(), F.col("race_name")),
                "gender_name": F.when(F.col("gender_level").isNotNull(), F.col("gender_name")),
            }
        )
    )


def describe_groups(
    df: DataFrame,
    group: str,
    numeric: Sequence[str] = NUMERIC,
    binary: Sequence[str] = BINARY,
    normality: str = "moments",
) -> dict[str, DataFrame]:
    """Sizes, numeric summaries, flag proportions and significance tests by group."""
    named = df.where(F.col(group).isNotNull())
    tests = compare_groups(named, group, numeric, binary, normality=normality)
    return {
        "sizes": count_by(named, [group]),
        "numeric": describe_by(named, [group], numeric),
        "flags": flag_profile(named, [group], binary),
        "tests": tests,
        "significant": tests.where("significant"),
    }


def binary_totals(df: DataFrame, column: str) -> DataFrame:
    """Positives and negatives of a flag with percentages."""
    flag = as_number(column)
    totals = df.agg(
        F.count(F.lit(1)).alias("total"), F.sum(flag).cast("long").alias("positives"), F.avg(flag).alias("p")
    )
    return totals.select(
        "total",
        "positives",
        (F.col("p") * 100).alias("positive_pct"),
        (F.col("total") - F.col("positives")).alias("negatives"),
        ((1 - F.col("p")) * 100).alias("negative_pct"),
    )


def compare_two(
    df: DataFrame, v1: str, v2: str, group: str | None = None, binary: Sequence[str] = BINARY
) -> dict[str, DataFrame]:
    """Two variables against each other, optionally by group: the tables behind the figure and its captions."""
    flag = v2 in binary
    out = {
        "overview": df.agg(F.count(F.lit(1)).alias("total")),
        "limits_v1": axis_limits(df, v1),
        "limits_v2": axis_limits(df, v2, flag),
        "describe": describe(df, [v1] if flag else [v1, v2]),
    }
    if group:
        out["breakdown"] = breakdown(df, group, v1, v2, flag)
    if flag:
        out["boxes"] = box_stats(df, group, v1, v2)
        out["totals"] = binary_totals(df, v2)
        return out
    by = [group] if group else []
    out["points"] = scatter_points(df, v1, v2, group)
    out["grid"] = count_grid(df, v1, v2, by)
    out["max_cell"] = max_cell(df, [], [*by, v1, v2])
    return out
