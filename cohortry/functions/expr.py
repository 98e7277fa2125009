"""Column expressions. Everything here stays inside whole-stage code generation."""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time -----------------------------------------------------------------


def micros_between(start: ColumnLike, end: ColumnLike) -> Column:
    """Microseconds from ``start`` to ``end``; works for both timestamp types."""
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))


def age_year_diff(start: ColumnLike, year_of_birth: ColumnLike) -> Column:
    """Calendar-year difference, the age used by the adult filter and the age bands."""
    return F.year(as_col(start)) - as_col(year_of_birth)


def age_365(start: ColumnLike, birth: ColumnLike) -> Column:
    """Age in years of exactly 365 days, fractional."""
    return micros_between(birth, start) / F.lit(365 * 86400 * 1e6)


def age_completed(start: ColumnLike, birth: ColumnLike) -> Column:
    """Birthdays passed."""
    return F.timestamp_diff("YEAR", as_col(birth), as_col(start))


def los_hours(start: ColumnLike, end: ColumnLike) -> Column:
    return micros_between(start, end) / F.lit(3600e6)


def los_days_trunc(start: ColumnLike, end: ColumnLike) -> Column:
    """Whole days of stay, truncated toward zero (a stay of -1.5 days gives -1)."""
    return (micros_between(start, end) / F.lit(86400e6)).cast("int")


def day_diff(end: ColumnLike, start: ColumnLike) -> Column:
    """Midnights crossed between two dates."""
    return F.datediff(F.to_date(as_col(end)), F.to_date(as_col(start)))


def frac_days(later: ColumnLike, earlier: ColumnLike) -> Column:
    return micros_between(earlier, later) / F.lit(86400e6)


def parse_mixed_ts(text: ColumnLike, formats: Sequence[str]) -> Column:
    """First format that fits each value; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(as_col(text), F.lit(f)) for f in formats])


def to_naive_utc(ts: ColumnLike) -> Column:
    """Instant -> wall clock in UTC (the session runs in UTC)."""
    return as_col(ts).cast("timestamp").cast("timestamp_ntz")


# --- recoding ---------------------------------------------------------------


def recode(c: ColumnLike, mapping: Mapping, default: Column | str | int | None = None) -> Column:
    """Map values; a value outside ``mapping`` becomes ``default`` (null unless given).

    Pass the column itself as ``default`` to keep unmapped values.
    """
    c = as_col(c)
    hit = F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)
    if default is None:
        return hit
    return F.coalesce(hit, default if isinstance(default, Column) else F.lit(default))


def lump_other(c: ColumnLike, keep: Iterable[str], other: str = "Other", null_as_other: bool = False) -> Column:
    """Values outside ``keep`` become ``other``; nulls stay null unless ``null_as_other``."""
    c = as_col(c)
    lumped = F.when(c.isin(list(keep)), c)
    if null_as_other:
        return lumped.otherwise(F.lit(other))
    return lumped.when(c.isNotNull(), F.lit(other))


def age_band(age: ColumnLike, cut: int = 65) -> Column:
    """``"65+"`` / ``"<65"``; an unknown age counts as below the cut."""
    return F.when(as_col(age) >= cut, F.lit(f"{cut}+")).otherwise(F.lit(f"<{cut}"))


def medicare_flag(age: ColumnLike, cut: int = 65) -> Column:
    return F.coalesce(as_col(age) >= cut, F.lit(False))


def fill_default(c: ColumnLike, value) -> Column:
    return F.coalesce(as_col(c), F.lit(value))


def fill_cast(c: ColumnLike, value, dtype: str) -> Column:
    return F.coalesce(as_col(c), F.lit(value)).cast(dtype)


def sum_flags(cols: Sequence[ColumnLike], null_as_zero: bool = False) -> Column:
    """Row-wise sum; one null makes the sum null unless ``null_as_zero``."""
    parts = [F.coalesce(as_col(c), F.lit(0)) if null_as_zero else as_col(c) for c in cols]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return total


def level_of(c: ColumnLike, levels: Sequence[str]) -> Column:
    """1-based position in ``levels``; null for values outside."""
    return F.nullif(F.array_position(F.array(*[F.lit(x) for x in levels]), as_col(c)), F.lit(0)).cast("int")


def pretty_label(c: ColumnLike, drop: str | None = None) -> Column:
    """``mean_los`` -> ``Mean Los``; ``drop`` is removed first (a regular expression)."""
    c = as_col(c)
    if drop:
        c = F.regexp_replace(c, drop, "")
    return F.initcap(F.regexp_replace(c, "_", " "))


def versus(a: ColumnLike, b: ColumnLike) -> Column:
    return F.concat(as_col(a), F.lit(" vs "), as_col(b))


# --- predicates ---------------------------------------------------------------


def between_flag(c: ColumnLike, low, high, closed: str = "both") -> Column:
    """Range test that is false (not null) for null; ``closed`` is both, left, right or neither."""
    c = as_col(c)
    lower = c >= low if closed in ("both", "left") else c > low
    upper = c <= high if closed in ("both", "right") else c < high
    return F.coalesce(lower & upper, F.lit(False))


def mortality_labels(days: ColumnLike) -> dict[str, Column]:
    """Labels from the days between discharge and death."""
    return {
        "died_in_hospital": between_flag(days, -1, 0, "both"),
        "died_in_30_days": between_flag(days, 0, 30, "right"),
    }


def name_contains(c: ColumnLike, text: str) -> Column:
    return F.lower(as_col(c)).contains(text.lower())


def exists_flag(c: ColumnLike) -> Column:
    return as_col(c).isNotNull().cast("int")


def death_timing(start: ColumnLike, end: ColumnLike, death: ColumnLike) -> Column:
    start, end, death = as_col(start), as_col(end), as_col(death)
    return F.when(death >= end, F.lit("Death after discharge")).when(
        death.between(start, end), F.lit("Death during visit")
    )


# --- arithmetic ---------------------------------------------------------------


def rate(count: ColumnLike, base: ColumnLike) -> Column:
    """Percentage; null on a zero base."""
    return F.try_divide(as_col(count).cast("double"), as_col(base).cast("double")) * 100


def stars(p: ColumnLike) -> Column:
    p = as_col(p)
    return (
        F.when(p < 0.001, F.lit("***"))
        .when(p < 0.01, F.lit("**"))
        .when(p < 0.05, F.lit("*"))
        .when(p.isNotNull(), F.lit("ns"))
    )


def as_number(c: ColumnLike) -> Column:
    """Flag or number as double (booleans become 0/1)."""
    return as_col(c).cast("double")


# --- normal scores ---------------------------------------------------------------

# The published coefficients of AS 241 (Wichura 1988), highest power first,
# numerator and denominator for the centre, the tails and the far tails.
NORMAL_CENTRE = (
    (2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.3871328727963666080),
    (5226.4952788528545610, 28729.085735721942674, 39307.895800092710610, 21213.794301586595867,
     5394.1960214247511077, 687.18700749205790830, 42.313330701600911252, 1.0),
)
NORMAL_TAIL = (
    (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258,
     3.64784832476320460504, 5.76949722146069140550, 4.63033784615654529590, 1.42343711074968357734),
    (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
     6.89767334985100004550e-1, 1.67638483018380384940, 2.05319162663775882187, 1.0),
)
NORMAL_FAR = (
    (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
     2.96560571828504891230e-1, 1.78482653991729133580, 5.46378491116411436990, 6.65790464350110377720),
    (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
     1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0),
)


def _ratio(parts: tuple, x: Column) -> Column:
    above, below = (reduce(lambda total, c: total * x + F.lit(c), part[1:], F.lit(part[0])) for part in parts)
    return above / below


def normal_quantile(p: Column) -> Column:
    """Standard normal quantile of a probability strictly between 0 and 1."""
    q = p - F.lit(0.5)
    r = F.sqrt(-F.log(F.least(p, F.lit(1.0) - p)))
    tail = F.when(r <= 5.0, _ratio(NORMAL_TAIL, r - F.lit(1.6))).otherwise(_ratio(NORMAL_FAR, r - F.lit(5.0)))
    return F.when(F.abs(q) <= 0.425, q * _ratio(NORMAL_CENTRE, F.lit(0.180625) - q * q)).otherwise(F.signum(q) * tail)


def score_sum(low: Column, high: Column, n: Column, ends: int) -> Column:
    """Sum of the normal scores of positions ``low`` to ``high`` of ``n``.

    Of a run longer than twice ``ends`` the inner part is the difference of normal densities.
    """

    def at(i: Column) -> Column:
        return normal_quantile((i - F.lit(0.375)) / (n + F.lit(0.25)))

    def each(first: Column, last: Column) -> Column:
        return F.aggregate(F.sequence(first, last), F.lit(0.0), lambda total, i: total + at(i))

    def density(i: Column) -> Column:
        return F.exp(at(i) * at(i) / F.lit(-2.0)) / F.lit(math.sqrt(2 * math.pi))

    inner = (n + F.lit(0.25)) * (density(low + F.lit(ends - 0.5)) - density(high - F.lit(ends - 0.5)))
    long_run = each(low, low + F.lit(ends - 1)) + inner + each(high - F.lit(ends - 1), high)
    return F.when(low == high, at(low)).when(high - low < 2 * ends, each(low, high)).otherwise(long_run)
