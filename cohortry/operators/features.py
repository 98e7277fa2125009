"""Feature preparation: imputation, encodings, standardisation, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.operators.order_stats import quantiles, to_long
from cohortry.operators.relational import mode_of, numeric_columns, sized_broadcast

#: A categorical column with more levels than this is not turned into indicator columns.
MAX_LEVELS = 1_000


def impute(
    df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], binary: Sequence[str]
) -> DataFrame:
    """Fill nulls: mode for categorical, median for numeric, 0 (false) for binary columns.

    The fitted values are one row per column; they become literals in the result.
    """
    fills: dict = {}
    if categorical:
        fills |= {r["variable"]: r["mode"] for r in mode_of(df, categorical).collect()}
    if numeric:
        long = to_long(df, numeric)
        fills |= {
            r["variable"]: r["median"] for r in quantiles(long, "value", ["variable"], {"median": 0.5}).collect()
        }
    types = {f.name: f.dataType for f in df.schema.fields}
    fills |= {c: (False if isinstance(types[c], T.BooleanType) else 0) for c in binary}
    widened = [c for c in numeric if c in fills]
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double") if c in widened else F.col(c), F.lit(v)) for c, v in fills.items()}
    )


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values per column; refuses columns with more than ``MAX_LEVELS``."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    seen = df.select(cells.alias("c")).select("c.*").where(F.col("value").isNotNull()).distinct()
    rows = seen.limit(MAX_LEVELS * len(columns) + 1).collect()
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in rows:
        found[r["variable"]].append(r["value"])
    for c, values in found.items():
        if len(values) > MAX_LEVELS:
            raise ValueError(f"{c} has more than {MAX_LEVELS} levels")
    return {c: sorted(v) for c, v in found.items()}


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """``(value, code)``: the distinct non-null values as text, numbered from 0 in sorted order.

    Values are dealt out in ranges and numbered inside each; the numbers before a range
    come from the counts of the ranges, one row each. So any number of levels will do.
    """
    values = df.select(F.col(column).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    dealt = values.repartitionByRange("value").withColumn("__range", F.spark_partition_id()).checkpoint()
    place = F.row_number().over(Window.partitionBy("__range").orderBy("value"))
    sizes = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")
    offsets = sizes.select("__range", before.alias("__before"))
    numbered = dealt.withColumn("__place", place).join(F.broadcast(offsets), "__range")
    return numbered.select("value", (F.col("__before") + F.col("__place") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, columns: Sequence[str], suffix: str = "_encoded") -> DataFrame:
    """Add integer codes, numbered in sorted order of the values; null stays null."""
    for c in columns:
        codes = sized_broadcast(level_codes(df, c)).toDF("__value", c + suffix)
        df = df.withColumn("__key", F.col(c).cast("string")).join(codes, F.col("__key") == F.col("__value"), "left")
        df = df.drop("__key", "__value")
    return df


def one_hot_long(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """``(row_id, feature)``: one row per non-null cell, the feature that is 1; for columns with many levels."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])
    )
    rows = df.select(row_id, cells.alias("x")).where(F.col("x.v").isNotNull())
    return rows.select(row_id, F.concat_ws("_", "x.c", "x.v").alias("feature"))


def one_hot(df: DataFrame, columns: Sequence[str], keep: bool = False) -> DataFrame:
    """Replace each column by 0/1 columns ``column_value``, one per value, none dropped.

    A table as wide as that holds no more than ``MAX_LEVELS`` values a column; ``one_hot_long``
    takes any number.
    """
    known = levels(df, columns)
    flags = {
        f"{c}_{v}": F.coalesce((F.col(c).cast("string") == v).cast("int"), F.lit(0)) for c in columns for v in known[c]
    }
    wide = df.withColumns(flags)
    return wide if keep else wide.drop(*columns)


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "") -> DataFrame:
    """(x - mean) / population standard deviation; a constant column becomes 0.

    The moments are one bounded row, computed in a single pass.
    """
    stats = df.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{i}") for i, c in enumerate(columns)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        mean, sd = stats[f"m_{i}"] or 0.0, stats[f"s_{i}"] or 0.0
        # A spread at rounding level of the mean is no spread.
        if sd <= 1e-12 * max(1.0, abs(mean)):
            sd = 1.0
        scaled[c + suffix] = (F.col(c).cast("double") - F.lit(mean)) / F.lit(sd)
    return df.withColumns(scaled)


def as_array(columns: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in columns])


def feature_array(df: DataFrame, columns: Sequence[str], row_id: str, as_: str = "vec") -> DataFrame:
    """``(row_id, vec)`` with standardised ``columns`` as an array of doubles."""
    return standardize(df, columns).select(row_id, as_array(columns).alias(as_))


def numeric_feature_names(df: DataFrame, row_id: str, exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns other than the row id and ``exclude``; booleans are not numeric."""
    return [c for c in numeric_columns(df) if c != row_id and c not in exclude]
