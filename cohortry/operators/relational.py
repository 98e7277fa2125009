"""Filters, joins, aggregates, per-key picks and set operations."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from cohortry.functions.expr import as_col, as_number, rate

#: Largest side, in rows, that is ever broadcast by a hint.
BROADCAST_ROWS = 1_000_000
#: Up to this many rows a checked side is kept as a literal relation.
LITERAL_ROWS = 10_000
#: Rows looked at, at most, to find hot keys; smaller frames than ``HOT_ROWS`` have none.
HOT_SAMPLE = 1_000_000
HOT_ROWS = 1_000_000
#: Heavy keys that are broadcast at most, and the rows from which a key can be one.
HEAVY_KEYS = 10_000
HEAVY_ROWS = 1_000
#: Tasks the rows of heavy keys are spread over.
HEAVY_PARTS = 1_024
#: Longest axis of a count grid that is unfolded from an array.
AXIS_VALUES = 10_000
#: Parts of a longer axis.
GRID_PARTS = 256
#: Longest literal list kept as an ``IN`` predicate.
IN_LIST_LIMIT = 1_000


# --- broadcasting ---------------------------------------------------------------


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the frame has no more than ``rows`` rows; each task sends one number."""
    return df.count() <= rows


def checked(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The frame, computed once, and whether it has at most ``max_rows`` rows.

    Up to ``LITERAL_ROWS`` rows come back as a literal relation, which the planner knows
    the size of. Anything larger is checkpointed, so that the counted rows are the ones
    that are used.
    """
    cap = min(LITERAL_ROWS, max_rows)
    # Collecting a limit reads partition after partition and stops when it has enough.
    head = df.limit(cap + 1).collect()
    if len(head) <= cap:
        return df.sparkSession.createDataFrame(head, df.schema), True
    kept = df.checkpoint()
    return kept, cap < max_rows and at_most(kept, max_rows)


def sized_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting the rows; a larger side is left to the planner."""
    kept, fits = checked(df, max_rows)
    return F.broadcast(kept) if fits else kept


# --- skewed joins ---------------------------------------------------------------


def hot_keys(df: DataFrame, key: str, sample_rows: int = HOT_SAMPLE, min_rows: int = HOT_ROWS) -> list:
    """Values of ``key`` that would overload one task of a shuffle on it.

    A key is hot when it holds several partitions' worth of rows. Found on a sample of the
    key column; the list is bounded by the share that makes a key hot. Frames of up to
    ``min_rows`` rows have none.
    """
    total = df.count()
    if total <= min_rows:
        return []
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = min(0.05, 4 / partitions)
    sampled = df.select(key).where(F.col(key).isNotNull()).sample(min(1.0, sample_rows / total), 42)
    least = share * min(sample_rows, total)
    found = sampled.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return [r[key] for r in found.orderBy(F.desc("n")).limit(int(2 / share)).collect()]


def skew_join(
    fact: DataFrame, dim: DataFrame, key: str, row_id: str, how: str = "inner", min_rows: int = HOT_ROWS
) -> DataFrame:
    """Join a large ``fact`` with a one-row-per-key ``dim`` (inner or left), splitting hot keys.

    Adaptive execution only splits a join side it shuffled for that join, which an
    aggregated ``dim`` is not. So the rows of a hot key are spread by a hash of
    ``row_id`` and the dimension's rows for those few keys are repeated. The hot keys are
    literals, the same on both sides; without any, this is the plain join.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"cannot split a {how} join")
    hot = hot_keys(fact, key, min_rows=min_rows)
    if not hot:
        return fact.join(dim, key, how)
    parts = min(1_024, max(8, int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    spread = F.when(is_hot, F.pmod(F.xxhash64(row_id), F.lit(parts)).cast("int")).otherwise(0)
    repeat = F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    left = fact.withColumn("__part", spread)
    right = dim.withColumn("__part", repeat)
    return left.join(right, [key, "__part"], how).drop("__part")


def join_heavy(df: DataFrame, summary: DataFrame, key: str, n: str, row_id: str, total: int) -> DataFrame:
    """Left join of ``df`` with a one-row-per-key ``summary`` of its own rows, heavy keys by broadcast.

    ``n`` is the summary's column with the rows of the key and ``total`` at least the rows of
    ``df``. A key with more than ``total / HEAVY_KEYS`` rows is heavy, so there are at most
    ``HEAVY_KEYS`` of them; their rows are spread by a hash of ``row_id``. ``n`` is dropped.
    """
    least = F.lit(max(HEAVY_ROWS, total // HEAVY_KEYS))
    values = [c for c in summary.columns if c not in (key, n)]
    heavy = summary.where(F.col(n) > least).select(key, F.struct(*values).alias("__heavy"))
    # Not a literal 0, which the optimizer would take out of the join's keys.
    none = F.when(F.col(n) > least, 1).otherwise(0).alias("__part")
    light = summary.where(F.col(n) <= least).select(key, none, F.struct(*values).alias("__light"))
    part = F.when(F.col("__heavy").isNull(), 0).otherwise(F.pmod(F.xxhash64(row_id), F.lit(HEAVY_PARTS)).cast("int") + 1)
    met = df.join(F.broadcast(heavy), key, "left").withColumn("__part", part).join(light, [key, "__part"], "left")
    return met.select(*df.columns, F.coalesce("__heavy", "__light").alias("__found")).select(*df.columns, "__found.*")


# --- filters ---------------------------------------------------------------


def drop_where(df: DataFrame, condition: Column) -> DataFrame:
    """Remove the rows where ``condition`` is true; rows where it is null stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def _literals(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    field = T.StructField(column, df.schema[column].dataType)
    return df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], T.StructType([field]))


def filter_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Literal ``IN``; a long list turns into a semi join with the list as a relation."""
    if len(values) <= IN_LIST_LIMIT:
        return df.where(F.col(column).isin(list(values)))
    return df.join(_literals(df, column, values), column, "left_semi")


def filter_not_in(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Literal ``NOT IN``: null values drop out, and a null in the list leaves no rows, as in SQL."""
    if any(v is None for v in values):
        return df.where(F.lit(False))
    if len(values) <= IN_LIST_LIMIT:
        return df.where(~F.col(column).isin(list(values)))
    return df.where(F.col(column).isNotNull()).join(_literals(df, column, values), column, "left_anti")


def adult_filter(df: DataFrame, start: str, year_of_birth: str, min_age: int = 18) -> DataFrame:
    return df.where(F.year(start) - F.col(year_of_birth) >= min_age)


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the numeric columns; booleans do not count as numeric."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# --- joins ---------------------------------------------------------------


def left_join_filtered(left: DataFrame, right: DataFrame, keys: Sequence[str], keep: Column) -> DataFrame:
    """Left join whose right-side predicate sits in the join condition: every left row survives."""
    return left.join(right.where(keep), list(keys), "left")


def restrict_to(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct rows of ``df`` whose key occurs in ``wanted``."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi").distinct()


def semi_join(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def exclude_ids(df: DataFrame, ids: DataFrame, column: str, null_aware: bool = True) -> DataFrame:
    """Rows whose ``column`` is not among ``ids`` (a one-column frame).

    ``null_aware`` follows SQL ``NOT IN``: one null among the ids empties the result
    and a null on the left drops out. Written as an anti join plus a null probe, so it
    shuffles on the key instead of broadcasting the whole id list.
    """
    ids = ids.toDF(column)
    if not null_aware:
        return df.join(ids.distinct(), column, "left_anti")
    flags = ids.agg(F.max(F.col(column).isNull()).alias("has_null"), F.count(F.lit(1)).alias("n"))
    some_null, n = flags.first()
    if n == 0:
        return df
    if some_null:
        return df.where(F.lit(False))
    return df.where(F.col(column).isNotNull()).join(ids.distinct(), column, "left_anti")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys match null keys; each key appears once in the result."""
    left, right = left.alias("l"), right.alias("r")
    condition = reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys])
    rest = [F.col(f"r.{c}") for c in right.columns if c not in keys]
    return left.join(right, condition, how).select("l.*", *rest)


def unique_dimension(dim: DataFrame, key: str, value: str, as_: str) -> DataFrame:
    """``(key, value)`` with one row per key; a repeated key fails the query."""
    clash = F.raise_error(F.concat(F.lit(f"{key} is not unique: "), F.col(key).cast("string")))
    return dim.groupBy(key).agg(
        F.when(F.count(F.lit(1)) > 1, clash.cast(dim.schema[value].dataType))
        .otherwise(F.min(value))
        .alias(as_)
    )


def lookup(
    df: DataFrame,
    names: Mapping[str, str],
    dim: DataFrame,
    dim_key: str,
    value: str,
    codes_from: DataFrame | None = None,
) -> DataFrame:
    """For each ``key -> as_`` in ``names`` add ``as_`` = the dimension's ``value`` for ``key``.

    A miss gives null. A code column has few values and one of them may cover a third of
    the rows, so ``df`` is never shuffled on it: the codes in use are reduced first, their
    names are fetched, and that one short list is broadcast for all keys after a size
    check. ``codes_from`` is a cheaper frame holding every code of ``df`` (for instance
    the table the column came from).
    """
    source = df if codes_from is None else codes_from
    codes = source.select(F.explode(F.array_distinct(F.array(*names))).alias(dim_key))
    needed = dim.join(codes.where(F.col(dim_key).isNotNull()).distinct(), dim_key, "left_semi")
    found = sized_broadcast(unique_dimension(needed, dim_key, value, "__name"))
    for key, as_ in names.items():
        df = df.join(found.withColumnsRenamed({dim_key: key, "__name": as_}), key, "left")
    return df


def attribute(df: DataFrame, key: str, dim: DataFrame, dim_key: str, value: str, as_: str) -> DataFrame:
    """As :func:`lookup` for a key that identifies a row (a person): a plain left join."""
    names = unique_dimension(dim, dim_key, value, as_).withColumnRenamed(dim_key, key)
    return df.join(names, key, "left")


def attach_flags(df: DataFrame, flags: DataFrame, keys: Sequence[str], default: int | None = 0) -> DataFrame:
    """Left join of one-row-per-key flags; missing flags become ``default`` (null keeps them null)."""
    names = [c for c in flags.columns if c not in keys]
    joined = df.join(flags, list(keys), "left")
    if default is None:
        return joined
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(default)) for c in names})


def join_flags(df: DataFrame, *tables: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left joins of several one-row-per-key tables on the same key; no default."""
    return reduce(lambda left, right: left.join(right, list(keys), "left"), tables, df)


def pairs(df: DataFrame, order: str, by: Sequence[str] = (), suffixes: tuple[str, str] = ("1", "2")) -> DataFrame:
    """Every unordered pair of rows with ``order`` increasing, inside each ``by`` group.

    Meant for summary tables (one row per stratum): the result is the pairs themselves.
    """
    one = df.select(*by, *[F.col(c).alias(c + suffixes[0]) for c in df.columns if c not in by])
    two = df.select(*by, *[F.col(c).alias(c + suffixes[1]) for c in df.columns if c not in by])
    ordered = F.col(order + suffixes[0]) < F.col(order + suffixes[1])
    if by:
        return one.join(two, list(by)).where(ordered)
    return one.join(two, ordered)


# --- aggregates ---------------------------------------------------------------


def count_by(df: DataFrame, keys: Sequence[str], name: str = "n", drop_null_keys: bool = False) -> DataFrame:
    """Rows per group; ``drop_null_keys`` leaves out groups with a null key."""
    rows = df.dropna(subset=list(keys)) if drop_null_keys else df
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def count_distinct_by(df: DataFrame, keys: Sequence[str], column: str, name: str = "n") -> DataFrame:
    """Distinct non-null values per group.

    Two grouped steps: the first shuffles on (group, value), so a group with a third of
    the rows is spread over all tasks; the second adds up partial counts.
    """
    distinct = df.select(*keys, column).distinct()
    return distinct.groupBy(*keys).agg(F.count(column).alias(name))


def pivot_flags(
    df: DataFrame,
    keys: Sequence[str],
    category: str,
    values: Mapping[str, object],
    absent: int | None = None,
) -> DataFrame:
    """One row per key and one flag per entry of ``values`` (output name -> category value).

    A flag is 1 when the category occurs and ``absent`` otherwise. One pass, no pivot job.
    """
    flags = []
    for name, value in values.items():
        hit = F.max(F.when(F.col(category) == F.lit(value), F.lit(1)))
        flags.append((hit if absent is None else F.coalesce(hit, F.lit(absent))).alias(name))
    return df.groupBy(*keys).agg(*flags)


def rate_by(df: DataFrame, keys: Sequence[str], flags: Sequence[str], prefix: str = "avg_") -> DataFrame:
    """Mean of 0/1 flags per group."""
    return df.groupBy(*keys).agg(*[F.avg(as_number(c)).alias(prefix + c) for c in flags])


def events_per_subject(df: DataFrame, subject: str, group: str) -> DataFrame:
    """Events per subject, then subjects, events and mean events per group."""
    per_subject = df.groupBy(group, subject).agg(F.count(F.lit(1)).alias("events"))
    return per_subject.groupBy(group).agg(
        F.count(subject).alias("total_patients"),
        F.sum("events").alias("total_events"),
        F.round(F.avg("events"), 2).alias("avg_events"),
    )


def flag_profile(df: DataFrame, keys: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Long form: proportion, count and total rows for every flag and group."""
    wide = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.avg(as_number(c)).alias(f"__p_{c}") for c in flags],
        *[F.sum(as_number(c)).cast("long").alias(f"__s_{c}") for c in flags],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("variable"),
                    F.col(f"__p_{c}").alias("proportion"),
                    F.col(f"__s_{c}").alias("positives"),
                )
                for c in flags
            ]
        )
    )
    return wide.select(*keys, "total", rows.alias("r")).select(*keys, "r.*", "total")


def breakdown(df: DataFrame, group: str, v1: str, v2: str, v2_binary: bool = True) -> DataFrame:
    """Count, mean, std of ``v1`` and sum, mean (or mean, std) of ``v2``, rounded to 2."""
    two = as_number(v2) if v2_binary else F.col(v2)
    second = (
        [F.sum(two).alias(f"{v2}_sum"), F.round(F.avg(two), 2).alias(f"{v2}_mean")]
        if v2_binary
        else [F.round(F.avg(two), 2).alias(f"{v2}_mean"), F.round(F.stddev_samp(two), 2).alias(f"{v2}_std")]
    )
    return (
        df.where(F.col(group).isNotNull())
        .groupBy(group)
        .agg(
            F.count(v1).alias(f"{v1}_count"),
            F.round(F.avg(v1), 2).alias(f"{v1}_mean"),
            F.round(F.stddev_samp(v1), 2).alias(f"{v1}_std"),
            *second,
        )
    )


def stratum_means(
    df: DataFrame, keys: Sequence[str], metrics: Mapping[str, str], composites: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Null-skipping means (``metrics``: output -> column) and sums of those means."""
    means = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("count"),
        *[F.avg(F.col(c).cast("double") if not _is_bool(df, c) else as_number(c)).alias(m) for m, c in metrics.items()],
    )
    return means.withColumns(
        {name: reduce(lambda a, b: a + b, [F.col(p) for p in parts]) for name, parts in composites.items()}
    )


def _is_bool(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.BooleanType)


def crosstab_long(df: DataFrame, row: str, col: str) -> DataFrame:
    """Non-null contingency counts, one row per observed cell."""
    return count_by(df, [row, col], "n", drop_null_keys=True)


def complete_grid(cells: DataFrame, row: str, col: str, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Fill absent cells of a long contingency table with 0 (rows x columns seen in each table).

    The column axis becomes one array per table and every row value unfolds it. An axis
    too long for that is joined instead, on the table's keys or in parts.
    """
    rows = cells.select(*by, row).distinct()
    cols, short = checked(cells.select(*by, col).distinct(), AXIS_VALUES)
    if not by and short:
        axis = F.array(*[F.lit(r[col]) for r in cols.collect()]).cast(T.ArrayType(cells.schema[col].dataType))
        grid = rows.withColumn(col, F.explode(axis))
    elif short:
        axis = cols.groupBy(*by).agg(F.collect_list(col).alias("__axis"))
        grid = rows.join(F.broadcast(axis), list(by)).select(*by, row, F.explode("__axis").alias(col))
    elif by:
        grid = rows.join(cols, list(by))
    else:
        # Every row value visits all parts of the other axis.
        parts = F.lit(GRID_PARTS)
        numbers = F.sequence(F.lit(0), parts - 1).cast("array<bigint>")
        spread = rows.withColumn("__part", F.explode(numbers))
        grid = spread.join(cols.withColumn("__part", F.pmod(F.xxhash64(col), parts)), "__part").drop("__part")
    return grid.join(cells, [*by, row, col], "left").withColumn(n, F.coalesce(F.col(n), F.lit(0)))


def row_proportions(cells: DataFrame, row: str, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Share of each cell in its row of a contingency table."""
    total = F.sum(n).over(Window.partitionBy(*by, row))
    return cells.withColumn("proportion", F.col(n) / total)


def count_grid(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Long count grid with zeros for the pairs of axis values that do not occur together."""
    return complete_grid(count_by(df, [*by, x, y], "n", drop_null_keys=True), x, y, "n", by)


def pivot_sum(df: DataFrame, index: str, columns: str, levels: Sequence, values: Sequence[str]) -> DataFrame:
    """Sums of ``values`` per ``index`` row, one column per value and level, 0 where absent."""
    return (
        df.where(F.col(index).isNotNull())
        .groupBy(index)
        .agg(
            *[
                F.coalesce(F.sum(F.when(F.col(columns) == F.lit(level), F.col(v))), F.lit(0)).alias(f"{v}_{level}")
                for v in values
                for level in levels
            ]
        )
    )


def max_cell(df: DataFrame, keys: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """Largest cell count: over everything, or per ``keys``."""
    counts = count_by(df, [*keys, *cells], "n", drop_null_keys=True)
    return counts.groupBy(*keys).agg(F.max("n").alias("max_count"))


def mode_of(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(variable, mode)``: the most frequent non-null value, the smallest one on ties.

    Counting by value first keeps the work spread out; only counted values meet in a group.
    """
    rows = F.explode(
        F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value")) for c in columns])
    )
    counts = (
        df.select(*by, rows.alias("r"))
        .select(*by, "r.*")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "variable", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counts.groupBy(*by, "variable").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def margins(df: DataFrame, sets: Sequence[Sequence[str]], sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums over several groupings in one pass.

    ``margin`` names the grouping (``gender_name+age_group``); keys outside it are null.
    ``by`` columns belong to every grouping.
    """
    keys = list(dict.fromkeys(k for s in sets for k in s))
    marks = [F.grouping(k).alias(f"__g_{k}") for k in keys]
    rolled = df.groupingSets([[*[F.col(b) for b in by], *[F.col(k) for k in s]] for s in sets], *by, *keys).agg(
        *[F.sum(c).alias(c) for c in sums], *marks
    )
    label = F.concat_ws("+", *[F.when(F.col(f"__g_{k}") == 0, F.lit(k)) for k in keys])
    return rolled.select(*by, F.when(label == "", F.lit("all")).otherwise(label).alias("margin"), *keys, *sums)


def add_rate(df: DataFrame, count: str = "cnt", base: str = "base_count", as_: str = "percentage") -> DataFrame:
    return df.withColumn(as_, rate(count, base))


def clamp_counts(df: DataFrame, got: str, total: str) -> DataFrame:
    """``got`` at most ``total``, ``not_<got>`` at least 0, and a flag for rows that were changed."""
    return df.withColumns(
        {
            "clamped": F.col(got) > F.col(total),
            f"not_{got}": F.greatest(F.col(total) - F.col(got), F.lit(0)),
            got: F.least(F.col(got), F.col(total)),
        }
    )


def row_count_check(left: DataFrame, right: DataFrame) -> DataFrame:
    """Row counts of two frames and whether they agree."""
    counted = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    totals = counted.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum("r"), F.lit(0)).alias("right_rows")
    )
    return totals.withColumn("equal", F.col("left_rows") == F.col("right_rows"))


# --- one row per key ---------------------------------------------------------------


def _order_key(order: Sequence[str], nulls_first: bool) -> Column:
    """A struct that sorts ascending by ``order`` with nulls at the chosen end."""
    parts = []
    for i, name in enumerate(order):
        null_rank = F.col(name).isNull() if not nulls_first else F.col(name).isNotNull()
        parts += [null_rank.alias(f"n{i}"), F.col(name).alias(f"v{i}")]
    return F.struct(*parts)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], nulls_first: bool = True) -> DataFrame:
    """The earliest row of every key; ``order`` should end in a column that breaks ties.

    An aggregate, not a window: rows are reduced before the shuffle, so a key that owns
    a third of the table sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), _order_key(order, nulls_first)).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], nulls_last: bool = True) -> DataFrame:
    """The latest row of every key; with ``nulls_last`` a null order value counts as latest."""
    rest = [c for c in df.columns if c not in keys]
    key = _order_key(order, nulls_first=not nulls_last)
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), key).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)


def flag_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str, as_: str = "first") -> DataFrame:
    """Mark the earliest row of every key (null order values last).

    The first row's id is found by an aggregate and joined back on that id, which is
    unique, so no key can overload a task.
    """
    firsts = df.groupBy(*keys).agg(F.min_by(row_id, _order_key([*order, row_id], nulls_first=False)).alias(row_id))
    marks = firsts.select(row_id, F.lit(True).alias(as_))
    return df.join(marks, row_id, "left").withColumn(as_, F.coalesce(F.col(as_), F.lit(False)))


def bounded_sample(df: DataFrame, n: int, row_id: str, by: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """``min(n, size)`` rows, overall or per group: those with the smallest seeded hash.

    Group sizes give a hash threshold that keeps about ``4 n`` rows per group; the exact
    pick then only sees those, whatever the size of the group.
    """
    by = list(by)
    # 60 bits of md5: the same pick in any engine.
    digits = F.substring(F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed)))), 1, 15)
    hashed = df.withColumn("__h", F.conv(digits, 16, 10).cast("long"))
    sizes = hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    unit = F.col("__h").cast("double") / F.lit(2.0**60)
    near = unit <= F.lit(4.0 * n + 64) / F.col("__n")
    if not by:
        total = sizes.first()["__n"]
        kept = hashed.where(unit <= F.lit((4.0 * n + 64) / max(total, 1)))
        return kept.orderBy("__h", row_id).limit(n).drop("__h")
    safe = sizes.select(*[F.col(b).alias(f"__b_{b}") for b in by], "__n")
    match = reduce(lambda a, b: a & b, [F.col(b).eqNullSafe(F.col(f"__b_{b}")) for b in by])
    kept = hashed.join(sized_broadcast(safe), match).where(near)
    ranked = kept.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy("__h", row_id)))
    return ranked.where(F.col("__r") <= n).select(*df.columns)


# --- ordering ---------------------------------------------------------------


def best(df: DataFrame, metric: str, order: Sequence[str], desc: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The row with the best ``metric``; the first in ``order`` wins a tie. Null metrics never win."""
    scored = df.where(F.col(metric).isNotNull())
    signed = -F.col(metric) if desc else F.col(metric)
    picked = scored.groupBy(*by).agg(F.min_by(F.struct(*df.columns), F.struct(signed, *order)).alias("__row"))
    return picked.select("__row.*")


# --- set operations ---------------------------------------------------------------


def union_labeled(frames: Mapping[str, DataFrame], label: str = "label") -> DataFrame:
    """``UNION ALL`` with the mapping key as a column."""
    return reduce(
        lambda a, b: a.unionByName(b), [df.withColumn(label, F.lit(name)) for name, df in frames.items()]
    )


def union_all(frames: Iterable[DataFrame], spark, schema: T.StructType) -> DataFrame:
    """Concatenate frames; an empty frame of ``schema`` when there are none."""
    frames = list(frames)
    if not frames:
        return spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b), frames)
