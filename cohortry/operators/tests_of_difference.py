"""Hypothesis tests and effect sizes.

The data-sized part of each test (counts, ranks, moments) is a Spark aggregate. The
p-value is computed on the one summary row a test leaves behind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from cohortry.functions.expr import as_col, rate, score_sum, stars, versus
from cohortry.functions.tails import END_SCORES, chi2_sf, fisher_p, rank_sum_p, shapiro_p, shapiro_w, t_two_sided
from cohortry.operators.order_stats import rank_values, to_long
from cohortry.operators.relational import pairs, sized_broadcast

FISHER = "Fisher's exact"
CHI2 = "Chi-square"
#: Below this many people in the smaller arm the exact test is used.
FISHER_CUTOFF = 50


# --- contingency tables ---------------------------------------------------------------


def chi2_2x2_statistic(a, b, c, d, yates: bool = True) -> Column:
    """Chi-square of [[a, b], [c, d]]; null when a row or column is empty."""
    a, b, c, d = (as_col(x).cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    gap = F.abs(a * d - b * c)
    if yates:
        gap = F.greatest(F.lit(0.0), gap - n / 2)
    return F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))


def chi2_2x2(df: DataFrame, a: str, b: str, c: str, d: str, yates: bool = True) -> DataFrame:
    """Add ``statistic``, ``dof`` and ``p_value``."""
    scored = df.withColumns({"statistic": chi2_2x2_statistic(a, b, c, d, yates), "dof": F.lit(1)})
    return scored.withColumn("p_value", chi2_sf("statistic", F.col("dof").cast("double")))


def odds_ratio(a, b, c, d) -> Column:
    """(a d) / (b c): infinite when ``b c`` is 0, null when a row or column is empty."""
    a, b, c, d = (as_col(x).cast("double") for x in (a, b, c, d))
    empty = F.least(a + b, c + d, a + c, b + d) == 0
    return F.when(~empty, F.coalesce(F.try_divide(a * d, b * c), F.lit(float("inf"))))


def fisher_2x2(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """Add ``odds_ratio`` and the two-sided ``p_value``."""
    return df.withColumns(
        {
            "odds_ratio": odds_ratio(a, b, c, d),
            "p_value": fisher_p(*[F.col(x).cast("double") for x in (a, b, c, d)]),
        }
    )


def auto_test_2x2(df: DataFrame, a: str, b: str, c: str, d: str, cutoff: int = FISHER_CUTOFF) -> DataFrame:
    """Exact test when the smaller row total is below ``cutoff``, else corrected chi-square."""
    small = F.least(F.col(a) + F.col(b), F.col(c) + F.col(d)) < cutoff
    chosen = df.withColumns(
        {
            "test_used": F.when(small, F.lit(FISHER)).otherwise(F.lit(CHI2)),
            "statistic": F.when(~small, chi2_2x2_statistic(a, b, c, d)),
        }
    )
    exact = fisher_p(*[F.when(small, F.col(x).cast("double")) for x in (a, b, c, d)])
    return chosen.withColumn("p_value", F.coalesce(exact, chi2_sf("statistic", F.lit(1.0))))


def chi2_rxc(
    cells: DataFrame, row: str, col: str, n: str = "n", by: Sequence[str] = (), yates_2x2: bool = False
) -> DataFrame:
    """Chi-square of each long contingency table: one row per ``by``.

    Uses n (sum o^2 / (r c) - 1), so cells that do not occur need no row. A row or
    column whose total is 0 makes the statistic null.
    """
    counted = cells.groupBy(*by, row, col).agg(F.sum(n).cast("double").alias("__o"))
    sides = counted.withColumns(
        {
            "__r": F.sum("__o").over(Window.partitionBy(*by, row)),
            "__c": F.sum("__o").over(Window.partitionBy(*by, col)),
        }
    )
    share = F.try_divide(F.col("__o") * F.col("__o"), F.col("__r") * F.col("__c"))
    total = sides.groupBy(*by).agg(
        F.sum("__o").alias("n"),
        F.count_distinct(row).alias("n_rows"),
        F.count_distinct(col).alias("n_cols"),
        F.count(F.lit(1)).alias("n_cells"),
        F.min("__o").alias("__min"),
        F.sum(share).alias("__s"),
        F.min(F.least("__r", "__c")).alias("__low"),
        F.min("__r").alias("__r"),
        F.min("__c").alias("__c"),
    )
    plain = F.when(F.col("__low") > 0, F.greatest(F.lit(0.0), F.col("n") * (F.col("__s") - 1)))
    if yates_2x2:
        sizes = F.col("__r") * (F.col("n") - F.col("__r")) * F.col("__c") * (F.col("n") - F.col("__c"))
        gap = F.greatest(F.lit(0.0), F.sqrt(plain * F.try_divide(sizes, F.col("n"))) - F.col("n") / 2)
        is_2x2 = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
        plain = F.when(is_2x2, F.try_divide(F.col("n") * gap * gap, sizes)).otherwise(plain)
    scored = total.withColumns(
        {
            "statistic": plain,
            "dof": ((F.col("n_rows") - 1) * (F.col("n_cols") - 1)).cast("int"),
            # A cell that never occurs counts as 0.
            "min_cell": F.when(F.col("n_cells") < F.col("n_rows") * F.col("n_cols"), F.lit(0.0)).otherwise(
                F.col("__min")
            ),
        }
    )
    return scored.select(*by, "n", "n_rows", "n_cols", "min_cell", "statistic", "dof").withColumn(
        "p_value", chi2_sf("statistic", F.col("dof").cast("double"))
    )


def cramers_v(statistic, n, n_rows, n_cols) -> Column:
    return F.sqrt(F.try_divide(as_col(statistic), as_col(n) * (F.least(as_col(n_rows), as_col(n_cols)) - 1)))


def cells_test_choice(min_cell, n_rows, n_cols) -> Column:
    """Which test fits a table: decided on observed cells, as the analysis does."""
    square = (as_col(n_rows) == 2) & (as_col(n_cols) == 2)
    return (
        F.when(as_col(min_cell) >= 5, F.lit("Chi-square test"))
        .when(square, F.lit("Fisher's exact test"))
        .otherwise(F.lit("Chi-square test (small cells)"))
    )


def auto_test_counts(cells: DataFrame, row: str, col: str, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    """Test a long contingency table: test name, statistic, p and effect, one row per ``by``.

    Tables with a single row or column are left out. The effect is Cramer's V, or the
    odds ratio for the exact test.
    """
    tables = chi2_rxc(cells, row, col, n, by, yates_2x2=True).where((F.col("n_rows") > 1) & (F.col("n_cols") > 1))
    counted = cells.groupBy(*by, row, col).agg(F.sum(n).alias("__o"))
    # Corner counts of the 2x2 tables, rows and columns in sorted order.
    edges = counted.withColumns(
        {
            "__r": F.dense_rank().over(Window.partitionBy(*by).orderBy(row)),
            "__c": F.dense_rank().over(Window.partitionBy(*by).orderBy(col)),
        }
    )
    corner = {
        name: F.coalesce(F.sum(F.when((F.col("__r") == i) & (F.col("__c") == j), F.col("__o"))), F.lit(0))
        for name, i, j in (("__a", 1, 1), ("__b", 1, 2), ("__cc", 2, 1), ("__d", 2, 2))
    }
    corners = edges.groupBy(*by).agg(*[v.alias(k) for k, v in corner.items()])
    joined = (
        tables.join(corners, list(by))
        if by
        else tables.withColumn("__k", F.lit(1)).join(corners.withColumn("__k", F.lit(1)), "__k").drop("__k")
    )
    chosen = joined.withColumn("test_used", cells_test_choice("min_cell", "n_rows", "n_cols"))
    exact = F.col("test_used") == "Fisher's exact test"
    four = ("__a", "__b", "__cc", "__d")
    p_exact = fisher_p(*[F.when(exact, F.col(x).cast("double")) for x in four])
    return chosen.withColumns(
        {
            "p_value": F.when(exact, p_exact).otherwise(F.col("p_value")),
            "effect_size": F.when(exact, odds_ratio(*four)).otherwise(
                cramers_v("statistic", "n", "n_rows", "n_cols")
            ),
            "statistic": F.when(~exact, F.col("statistic")),
        }
    ).drop(*four)


# --- strata ---------------------------------------------------------------


def two_arms(
    df: DataFrame, strata: Sequence[str], arm: str, levels: tuple[str, str], cnt: str = "cnt", base: str = "base_count"
) -> DataFrame:
    """One row per stratum with both arms: got/total/not-got per arm, rates and their difference.

    ``got1``/``total1`` belong to ``levels[0]``. A stratum without either arm is left out.
    Counts above their total are cut back and marked.
    """
    sums = []
    for i, level in enumerate(levels, start=1):
        here = F.col(arm) == level
        sums += [F.sum(F.when(here, F.col(cnt))).alias(f"got{i}"), F.sum(F.when(here, F.col(base))).alias(f"total{i}")]
    wide = df.groupBy(*strata).agg(*sums).where(F.col("total1").isNotNull() & F.col("total2").isNotNull())
    rates = {f"rate{i}": rate(f"got{i}", f"total{i}") for i in (1, 2)}
    wide = wide.withColumns(rates).withColumns(
        {
            "difference": F.col("rate1") - F.col("rate2"),
            "clamped": (F.col("got1") > F.col("total1")) | (F.col("got2") > F.col("total2")),
            "not1": F.greatest(F.col("total1") - F.col("got1"), F.lit(0)),
            "not2": F.greatest(F.col("total2") - F.col("got2"), F.lit(0)),
        }
    )
    return wide.withColumns({f"got{i}": F.least(f"got{i}", f"total{i}") for i in (1, 2)})


def stratified_rate_diff(
    df: DataFrame,
    strata: Sequence[str],
    arm: str,
    levels: tuple[str, str],
    cnt: str = "cnt",
    base: str = "base_count",
    cutoff: int = FISHER_CUTOFF,
    alpha: float = 0.05,
) -> DataFrame:
    """Rate of ``levels[0]`` minus rate of ``levels[1]`` in every stratum, with a test."""
    tested = auto_test_2x2(two_arms(df, strata, arm, levels, cnt, base), "got1", "not1", "got2", "not2", cutoff)
    return tested.withColumn("significant", F.col("p_value") < alpha)


def stratum_odds_ratio(
    df: DataFrame, strata: Sequence[str], arm: str, levels: tuple[str, str], cnt: str = "cnt", base: str = "base_count"
) -> DataFrame:
    """Odds of ``levels[0]`` over odds of ``levels[1]``; not-got counts as at least 1.

    Strata with a zero total or zero reference odds are left out.
    """
    wide = two_arms(df, strata, arm, levels, cnt, base).where((F.col("total1") > 0) & (F.col("total2") > 0))
    odds = {f"odds{i}": F.col(f"got{i}") / F.greatest(F.lit(1), F.col(f"not{i}")) for i in (1, 2)}
    scored = wide.withColumns(odds).where(F.col("odds2") > 0)
    return scored.select(*strata, "odds1", "odds2", (F.col("odds1") / F.col("odds2")).alias("odds_ratio"))


_CELLS = ("got1", "not1", "got2", "not2")


def interaction_test(
    df: DataFrame,
    stratum: str,
    arm: str,
    levels: tuple[str, str],
    by: Sequence[str] = (),
    cnt: str = "cnt",
    base: str = "base_count",
) -> DataFrame:
    """Chi-square of strata x (arm, outcome): does the arm's effect vary between strata?

    Strata with an empty arm are left out; fewer than two strata give no row.
    """
    wide = two_arms(df, [*by, stratum], arm, levels, cnt, base).where((F.col("total1") > 0) & (F.col("total2") > 0))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("cell"), F.col(c).alias("n")) for c in _CELLS]))
    long = wide.select(*by, stratum, cells.alias("c")).select(*by, stratum, "c.*")
    tested = chi2_rxc(long, stratum, "cell", "n", by).where(F.col("n_rows") > 1)
    return tested.select(*by, F.col("n_rows").alias("n_strata"), "statistic", "dof", "p_value")


def pairwise_strata(
    df: DataFrame,
    stratum: str,
    arm: str,
    levels: tuple[str, str],
    by: Sequence[str] = (),
    cnt: str = "cnt",
    base: str = "base_count",
    alpha: float = 0.05,
) -> DataFrame:
    """Each pair of strata: both differences, their gap, and the chi-square of the 2x4 table.

    A table with an empty column cannot be tested; its p-value is null.
    """
    wide = two_arms(df, [*by, stratum], arm, levels, cnt, base).where((F.col("total1") > 0) & (F.col("total2") > 0))
    # Rates after clamping, as the comparison works on the clamped counts.
    diff = rate("got1", "total1") - rate("got2", "total2")
    rows = wide.select(*by, F.col(stratum).alias("stratum"), diff.alias("diff"), *_CELLS)
    both = pairs(rows, "stratum", by, suffixes=("_a", "_b"))
    sides = {s: sum((F.col(f"{c}_{s}") for c in _CELLS[1:]), F.col(f"{_CELLS[0]}_{s}")).cast("double") for s in "ab"}
    total = sides["a"] + sides["b"]
    share = F.lit(0.0)
    for c in _CELLS:
        column = (F.col(f"{c}_a") + F.col(f"{c}_b")).cast("double")
        for s in "ab":
            cell = F.col(f"{c}_{s}").cast("double")
            share = share + F.try_divide(cell * cell, sides[s] * column)
    scored = both.withColumns(
        {
            "diff_of_diffs": F.abs(F.col("diff_a") - F.col("diff_b")),
            "statistic": F.greatest(F.lit(0.0), total * (share - 1)) + share * 0,
            "dof": F.lit(len(_CELLS) - 1),
        }
    )
    tested = scored.withColumn("p_value", chi2_sf("statistic", F.lit(float(len(_CELLS) - 1))))
    return tested.select(
        *by,
        F.col("stratum_a").alias("stratum1"),
        F.col("stratum_b").alias("stratum2"),
        F.col("diff_a").alias("diff1"),
        F.col("diff_b").alias("diff2"),
        "diff_of_diffs",
        "statistic",
        "dof",
        "p_value",
        (F.col("p_value") < alpha).alias("significant"),
    )


def bonferroni(tests: DataFrame, by: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Add ``n_tests``, ``corrected_alpha`` and the verdict under it; tests without a p do not count."""
    counts = tests.groupBy(*by).agg(F.count("p_value").alias("n_tests"))
    if by:
        joined = tests.join(counts, list(by))
    else:
        one = F.lit(1).alias("__k")
        joined = tests.select("*", one).join(counts.select("*", one), "__k").drop("__k")
    limit = F.when(F.col("n_tests") > 0, F.lit(alpha) / F.col("n_tests")).otherwise(F.lit(alpha))
    return joined.withColumn("corrected_alpha", limit).withColumn(
        "significant_corrected", F.col("p_value") < F.col("corrected_alpha")
    )


# --- numeric variables by group ---------------------------------------------------------------


def group_moments(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``(variable, group, n, mean, var)`` over non-null values of named groups."""
    long = to_long(df.where(F.col(group).isNotNull()), columns, [group])
    return long.groupBy("variable", F.col(group).alias("grp")).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var")
    )


def _two_groups(stats: DataFrame, fields: Sequence[str], by: str = "variable") -> DataFrame:
    """Side-by-side rows for variables with exactly two groups, in order of the group name."""
    rows = stats.withColumn("__i", F.row_number().over(Window.partitionBy(by).orderBy("grp")))
    picks = [
        F.max(F.when(F.col("__i") == i, F.col(f))).alias(f"{f}{i}") for f in ("grp", *fields) for i in (1, 2)
    ]
    wide = rows.groupBy(by).agg(F.max("__i").alias("__k"), *picks)
    return wide.where(F.col("__k") == 2).drop("__k")


def _pooled_var() -> Column:
    spread = (F.col("n1") - 1) * F.coalesce("var1", F.lit(0.0)) + (F.col("n2") - 1) * F.coalesce("var2", F.lit(0.0))
    return F.try_divide(spread, (F.col("n1") + F.col("n2") - 2).cast("double"))


def t_test(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Pooled two-sample t-test of every variable that has exactly two groups."""
    wide = _two_groups(group_moments(df, group, columns), ("n", "mean", "var"))
    scale = F.sqrt(_pooled_var() * (1 / F.col("n1") + 1 / F.col("n2")))
    scored = wide.withColumns(
        {
            "statistic": F.try_divide(F.col("mean1") - F.col("mean2"), scale),
            "dof": F.col("n1") + F.col("n2") - 2,
        }
    )
    return scored.withColumn("p_value", t_two_sided("statistic", F.col("dof").cast("double")))


def cohens_d(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Absolute mean difference over the pooled standard deviation; 0 when that is 0."""
    wide = _two_groups(group_moments(df, group, columns), ("n", "mean", "var"))
    gap = F.abs(F.col("mean1") - F.col("mean2"))
    return wide.withColumn("cohens_d", F.coalesce(F.try_divide(gap, F.sqrt(_pooled_var())), F.lit(0.0)))


def rank_sums(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """``(variable, grp, n, rank_sum, tie_term)`` from ranks over all groups of a variable."""
    long = to_long(df.where(F.col(group).isNotNull()), columns, [group]).withColumnRenamed(group, "grp")
    ranked = rank_values(long, "value", ["variable"], ["grp"])
    t = F.col("ties").cast("double")
    return ranked.groupBy("variable", "grp").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("avg_rank")).alias("rank_sum"),
        F.sum(F.col("n") * (t * t - 1)).alias("tie_term"),
    )


def mann_whitney_from(sums: DataFrame) -> DataFrame:
    wide = _two_groups(sums, ("n", "rank_sum", "tie_term"))
    u1 = F.col("rank_sum1") - F.col("n1") * (F.col("n1") + 1) / 2
    scored = wide.withColumns({"u1": u1, "ties": F.col("tie_term1") + F.col("tie_term2")})
    p = rank_sum_p("u1", F.col("n1").cast("double"), F.col("n2").cast("double"), "ties")
    return scored.select("variable", "grp1", "grp2", "n1", "n2", F.col("u1").alias("statistic"), p.alias("p_value"))


def mann_whitney(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Two-sided rank-sum test of every variable with exactly two groups (``statistic`` = U of the first)."""
    return mann_whitney_from(rank_sums(df, group, columns))


def kruskal_from(sums: DataFrame) -> DataFrame:
    total = sums.groupBy("variable").agg(
        F.sum("n").cast("double").alias("n"),
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("__s"),
        F.sum("tie_term").alias("__t"),
    )
    n = F.col("n")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("__s") - 3 * (n + 1)
    scored = total.withColumns(
        {
            "statistic": F.try_divide(raw, 1 - F.try_divide(F.col("__t"), n * n * n - n)),
            "dof": (F.col("n_groups") - 1).cast("int"),
        }
    ).where(F.col("n_groups") > 1)
    return scored.select(
        "variable", "n", "n_groups", "statistic", "dof", chi2_sf("statistic", F.col("dof").cast("double")).alias("p_value")
    )


def kruskal(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Tie-corrected rank test over all groups of every variable."""
    return kruskal_from(rank_sums(df, group, columns))


def shapiro_statistics(long: DataFrame) -> DataFrame:
    """``(variable, grp, statistic, p_value)``: Shapiro-Wilk over all rows of ``long(variable, grp, value)``.

    The values' exact ranks give their normal scores, so W is a ratio of aggregates. Tied values
    are one row with the sum of their scores. Fewer than 3 values, or equal ones, give 1 and 1.
    """
    keys = ["variable", "grp"]
    sizes = long.groupBy(*keys).agg(
        F.count("value").alias("rows"),
        F.avg("value").alias("mean"),
        (F.var_pop("value") * F.count("value")).alias("about"),
    )
    placed = rank_values(long, "value", keys).join(sized_broadcast(sizes), keys)
    half = (F.col("ties") - 1) / 2
    placed = placed.withColumns(
        {"low": (F.col("avg_rank") - half).cast("long"), "high": (F.col("avg_rank") + half).cast("long")}
    )

    def held(position: Column) -> Column:
        return F.max(F.when(position.between(F.col("low"), F.col("high")), F.col("value")))

    scores = score_sum(F.col("low"), F.col("high"), F.col("rows"), END_SCORES)
    sums = placed.groupBy(*keys).agg(
        F.max("rows").alias("size"),
        F.max("about").alias("squares"),
        F.sum((F.col("value") - F.col("mean")) * scores).alias("score"),
        *[held(i).alias(c) for c, i in (("x1", F.lit(1)), ("x2", F.least(F.lit(2), F.col("rows"))))],
        *[held(i).alias(c) for c, i in (("xm", F.greatest(F.lit(1), F.col("rows") - 1)), ("xn", F.col("rows")))],
    )
    w = shapiro_w(*[F.col(c).cast("double") for c in ("size", "score", "x1", "x2", "xm", "xn", "squares")])
    scored = sums.select(*keys, "size", w.alias("statistic"))
    return scored.select(*keys, "statistic", shapiro_p("statistic", F.col("size").cast("double")).alias("p_value"))


def normality_gate(df: DataFrame, group: str, columns: Sequence[str], method: str = "moments") -> DataFrame:
    """``(variable, grp, n, statistic, p_value, normal)``, over all rows.

    ``moments`` is Jarque-Bera, ``shapiro`` Shapiro-Wilk. Fewer than 8 values are never called normal.
    """
    long = to_long(df.where(F.col(group).isNotNull()), columns, [group]).withColumnRenamed(group, "grp")
    keys = ["variable", "grp"]
    sizes = long.groupBy(*keys).agg(
        F.count("value").alias("n"),
        F.skewness("value").alias("__skew"),
        F.kurtosis("value").alias("__kurt"),
        (F.min("value") == F.max("value")).alias("__same"),
    )
    if method == "moments":
        jb = F.col("n") / 6 * (F.col("__skew") ** 2 + F.col("__kurt") ** 2 / 4)
        # A constant has no moments to speak against it.
        jb = F.when(F.col("__same") & (F.col("n") >= 8), 0.0).otherwise(jb)
        scored = sizes.withColumn("statistic", jb).withColumn("p_value", chi2_sf("statistic", F.lit(2.0)))
    elif method == "shapiro":
        scored = sizes.join(shapiro_statistics(long), keys)
    else:
        raise ValueError(f"unknown method {method!r}")
    normal = (F.col("p_value") > 0.05) & (F.col("n") >= 8)
    return scored.select(*keys, "n", "statistic", "p_value", normal.alias("normal"))


def compare_groups(
    df: DataFrame,
    group: str,
    numeric: Sequence[str],
    binary: Sequence[str],
    alpha: float = 0.05,
    normality: str = "moments",
) -> DataFrame:
    """One row per testable variable: groups, test, statistic, p, effect, stars, verdict.

    Numeric with two groups: t-test if both look normal and have 30 values, else
    rank-sum; effect is Cohen's d. More groups: Kruskal-Wallis, no effect. Binary: see
    :func:`auto_test_counts`. A variable with fewer than two groups gives no row.
    """
    sums = rank_sums(df, group, numeric).checkpoint()
    gate = normality_gate(df, group, numeric, normality)
    by_t = t_test(df, group, numeric).select(
        "variable", F.col("statistic").alias("t_stat"), F.col("p_value").alias("t_p")
    )
    effect = cohens_d(df, group, numeric).select("variable", "cohens_d")
    ok = gate.groupBy("variable").agg(F.min((F.col("normal") & (F.col("n") >= 30)).cast("int")).alias("ok"))
    use_t = F.coalesce(F.col("ok") == 1, F.lit(False))
    two = (
        mann_whitney_from(sums)
        .join(by_t, "variable", "left")
        .join(effect, "variable", "left")
        .join(ok, "variable", "left")
        .select(
            "variable",
            versus(F.col("grp1").cast("string"), F.col("grp2").cast("string")).alias("groups"),
            F.when(use_t, F.lit("Independent t-test")).otherwise(F.lit("Mann-Whitney U test")).alias("test_used"),
            F.when(use_t, F.col("t_stat")).otherwise(F.col("statistic")).alias("statistic"),
            F.when(use_t, F.col("t_p")).otherwise(F.col("p_value")).alias("p_value"),
            F.col("cohens_d").alias("effect_size"),
        )
    )
    many = (
        kruskal_from(sums)
        .where(F.col("n_groups") > 2)
        .select(
            "variable",
            F.concat(F.lit("All "), F.col("n_groups").cast("string"), F.lit(" groups")).alias("groups"),
            F.lit("Kruskal-Wallis test").alias("test_used"),
            "statistic",
            "p_value",
            F.lit(None).cast("double").alias("effect_size"),
        )
    )
    flags = to_long(df.where(F.col(group).isNotNull()), binary, [group])
    cells = flags.groupBy("variable", group, "value").agg(F.count(F.lit(1)).alias("n"))
    counted = auto_test_counts(cells, group, "value", "n", ["variable"]).select(
        "variable",
        F.lit(f"Groups by {group}").alias("groups"),
        "test_used",
        "statistic",
        "p_value",
        "effect_size",
    )
    every = two.unionByName(many).unionByName(counted)
    return every.withColumns({"stars": stars("p_value"), "significant": F.col("p_value") < alpha})
