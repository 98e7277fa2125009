"""Exact ranks and quantiles without gathering a group in one task.

A window over a whole group, or an exact percentile aggregate, puts the group in one
task. Both are fine for an input of a checked, small size. Beyond that the values of
every group are cut into many buckets at approximate quantiles. Buckets are sorted
independently, and the rows before a bucket are known from the bucket counts, so
positions are exact however rough the cuts are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from cohortry.functions.expr import as_number
from cohortry.operators.relational import at_most, checked, sized_broadcast

#: A group is cut into this many buckets (a power of two, for the search).
BUCKETS = 1_024
#: Cut lists (8 KB each) that are broadcast at most.
WIDE_ROWS = 2_000
#: Inputs up to this many rows take the built-in aggregate or window.
SMALL_ROWS = 1_000_000


def to_long(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., variable, value)`` with one row per non-null, non-NaN value, as doubles."""
    is_bool = {f.name: isinstance(f.dataType, T.BooleanType) for f in df.schema.fields}
    cells = [
        F.struct(
            F.lit(c).alias("variable"),
            (as_number(c) if is_bool[c] else F.col(c).cast("double")).alias("value"),
        )
        for c in columns
    ]
    rows = df.select(*keep, F.explode(F.array(*cells)).alias("__c")).select(*keep, "__c.*")
    return rows.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _cuts(values: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Cut points per group, computed once: both users of the cuts must see the same ones."""
    probs = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = values.groupBy(*by).agg(F.percentile_approx(value, probs).alias("__cuts"))
    return sized_broadcast(cuts, WIDE_ROWS)


def _with_bucket(rows: DataFrame, value: str) -> DataFrame:
    """Add ``__bucket``, the number of cut points below the value: an unrolled binary search.

    Each halving is one generated-code step; no lambda runs per cut.
    """
    rows = rows.withColumn("__bucket", F.lit(0))
    step = BUCKETS // 2
    while step:
        passed = F.element_at("__cuts", F.col("__bucket") + step) < F.col(value)
        rows = rows.withColumn("__bucket", F.col("__bucket") + F.when(passed, step).otherwise(0))
        step //= 2
    return rows.drop("__cuts")


def _null_safe(names: Sequence[str], left: str, right: str) -> Column:
    parts = [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in names]
    return reduce(lambda a, b: a & b, parts)


def _join_groups(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-group data back to its group, nulls matching nulls."""
    extra = [F.col(f"__r.{c}") for c in right.columns if c not in by]
    return left.alias("__l").join(right.alias("__r"), _null_safe(by, "__l", "__r")).select("__l.*", *extra)


def _bucketed(df: DataFrame, value: str, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with a bucket number, and per bucket the number of rows in earlier buckets."""
    rows = _with_bucket(_join_groups(df, _cuts(df, value, by), by), value)
    sizes = rows.groupBy(*by, "__bucket").agg(F.count(F.lit(1)).alias("__size"))
    window = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sizes.withColumns(
        {
            "__before": F.coalesce(F.sum("__size").over(window), F.lit(0)),
            "__total": F.sum("__size").over(whole),
        }
    )
    return rows, offsets


def rank_values(
    df: DataFrame, value: str, by: Sequence[str], count_by: Sequence[str] = (), small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Distinct values of each ``by`` group with their average rank, (rows below) + (ties + 1) / 2.

    Columns: ``by``, ``value``, ``count_by``, ``n`` (rows of this row's ``count_by``),
    ``ties`` (all rows with the value) and ``avg_rank``.
    """
    if at_most(df, small_rows):
        counts = df.groupBy(*by, value, *count_by).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(
            Window.partitionBy(*by).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        )
        ties = F.sum("n").over(Window.partitionBy(*by, value))
        ranked = counts.withColumns({"__upto": upto, "ties": ties})
        rank = (F.col("__upto") - F.col("ties") + (F.col("ties") + 1) / 2).cast("double")
        return ranked.select(*by, value, *count_by, "n", "ties", rank.alias("avg_rank"))
    rows, offsets = _bucketed(df, value, by)
    keyed = rows.groupBy(*by, "__bucket", value, *count_by).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(*by, "__bucket").orderBy(value)
    upto = F.sum("n").over(window.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ties = F.sum("n").over(Window.partitionBy(*by, "__bucket", value))
    ranked = keyed.withColumns({"__upto": upto, "ties": ties})
    placed = _join_groups(ranked, offsets.drop("__size", "__total"), [*by, "__bucket"])
    below = F.col("__before") + F.col("__upto") - F.col("ties")
    return placed.select(
        *by, value, *count_by, "n", "ties", (below + (F.col("ties") + 1) / 2).cast("double").alias("avg_rank")
    )


def quantiles(
    df: DataFrame, value: str, by: Sequence[str], probs: Mapping[str, float], small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group, one column per entry.

    Beyond ``small_rows`` only the buckets holding a wanted position are sorted.
    """
    if at_most(df, small_rows):
        return df.groupBy(*by).agg(*[F.percentile(value, F.lit(float(p))).alias(k) for k, p in probs.items()])
    rows, offsets = _bucketed(df, value, by)
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("q"), F.lit(float(p)).alias("p")) for k, p in probs.items()]))
    position = F.col("p") * (F.col("__total") - 1)
    targets = (
        offsets.select("*", wanted.alias("__w"))
        .select(*[c for c in offsets.columns], "__w.*")
        .withColumn("__pos", position)
        .withColumn("__end", F.explode(F.array(F.lit(0), F.lit(1))))
        # Zero-based index of the lower and of the upper neighbour of the position.
        .withColumn("__k", F.when(F.col("__end") == 0, F.floor("__pos")).otherwise(F.ceil("__pos")))
        .where((F.col("__k") >= F.col("__before")) & (F.col("__k") < F.col("__before") + F.col("__size")))
    )
    targets, small = checked(targets.select(*by, "__bucket", "q", "__pos", "__end", "__k", "__before"))
    hot = targets.select(*by, "__bucket").distinct()
    if small:
        targets, hot = F.broadcast(targets), F.broadcast(hot)
    kept = rows.alias("__l").join(hot.alias("__r"), _null_safe([*by, "__bucket"], "__l", "__r"), "left_semi")
    counted = kept.groupBy(*by, "__bucket", value).agg(F.count(F.lit(1)).alias("n"))
    window = Window.partitionBy(*by, "__bucket").orderBy(value)
    placed = counted.withColumn("__upto", F.sum("n").over(window))
    found = _join_groups(placed, targets, [*by, "__bucket"]).where(
        (F.col("__k") - F.col("__before") < F.col("__upto"))
        & (F.col("__k") - F.col("__before") >= F.col("__upto") - F.col("n"))
    )
    low = F.max(F.when(F.col("__end") == 0, F.col(value)))
    high = F.max(F.when(F.col("__end") == 1, F.col(value)))
    share = F.max(F.col("__pos") - F.floor("__pos"))
    each = found.groupBy(*by, "q").agg((low + (high - low) * share).alias("__v"))
    return each.groupBy(*by).agg(*[F.max(F.when(F.col("q") == k, F.col("__v"))).alias(k) for k in probs])


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def summarize(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, min, max, sum and count per variable (and group)."""
    long = to_long(df, columns, by)
    keys = [*by, "variable"]
    basic = long.groupBy(*keys).agg(
        F.avg("value").alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum("value").alias("sum"),
        F.count("value").alias("count"),
    )
    return _join_groups(basic, quantiles(long, "value", keys, {"median": 0.5}), keys)


def describe_by(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Mean, median and sample standard deviation per group and variable."""
    long = to_long(df, columns, keys)
    by = [*keys, "variable"]
    basic = long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return _join_groups(basic, quantiles(long, "value", by, {"median": 0.5}, small_rows), by)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles (linear interpolation) and max per variable."""
    long = to_long(df, columns)
    basic = long.groupBy("variable").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return _join_groups(basic, quantiles(long, "value", ["variable"], QUARTILES), ["variable"])
