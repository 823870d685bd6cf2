"""Column expressions shared by every table: ratios, rounding, bands, dates, text.

All of them are built-in Spark expressions, so they stay inside whole-stage
code generation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that count as a missing key.
NULL_TOKENS = ("", "nan", "None", "NULL")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- arithmetic
def ratio(num: Column | str, den: Column | str) -> Column:
    """``num / den`` as double, NULL when the denominator is 0 or NULL."""
    return col(num).cast("double") / F.nullif(col(den).cast("double"), F.lit(0.0))


def ratio_or(num: Column | str, den: Column | str, default: float) -> Column:
    return F.coalesce(ratio(num, den), F.lit(float(default)))


def pct(num: Column | str, den: Column | str) -> Column:
    return ratio(num, den) * 100.0


def clip(c: Column | str, low: float | None = None, high: float | None = None) -> Column:
    out = col(c)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return out


def half_even(c: Column | str, digits: int) -> Column:
    """Round the scaled binary value half to even (array-library rounding)."""
    scale = float(10**digits)
    return F.rint(col(c) * scale) / scale


def half_up(c: Column | str, digits: int) -> Column:
    """Round the scaled binary value half away from zero (SQL ``ROUND``)."""
    scale = float(10**digits)
    return F.signum(col(c)) * (F.floor(F.abs(col(c)) * scale + 0.5).cast("double") / scale)


def maybe_half_up(c: Column | str, digits: int | None) -> Column:
    return col(c) if digits is None else half_up(c, digits)


def std_from_sums(n: Column, total: Column, squares: Column, ddof: int = 1) -> Column:
    """Standard deviation from count, sum and sum of squares.

    Sums of integers are exact in any order, so the result does not depend on
    how partial aggregates were merged. NULL when ``n <= ddof``.
    """
    n, total, squares = n.cast("double"), total.cast("double"), squares.cast("double")
    spread = F.greatest(n * squares - total * total, F.lit(0.0))
    return F.when(n > ddof, F.sqrt(spread / (n * (n - float(ddof)))))


def mean_of_rounded(c: Column | str, digits: int = 2) -> Column:
    """Aggregate: mean of values that are rounded to ``digits`` decimals.

    Summing whole hundredths is exact, so the mean (and its own rounding) does
    not depend on how the partial sums of a shuffle were merged.
    """
    scale = float(10**digits)
    units = F.sum(F.round(col(c) * scale).cast("long")).cast("double")
    return units / F.nullif(F.count(col(c)), F.lit(0)).cast("double") / scale


# --------------------------------------------------------------------- bands
def band(score: Column | str, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the half-open interval ``[cut_i, cut_i+1)`` that holds the score."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("a band needs one label more than it has cuts")
    out = None
    for cut, label in zip(cuts, labels):
        hit = col(score) < cut
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.lit(labels[0]) if out is None else out.otherwise(labels[-1])


def histogram_bin(c: Column | str, bins: int, low: float = 0.0, high: float = 1.0) -> Column:
    """1-based fixed-width bin; the last bin is closed on the right."""
    return F.least(
        F.width_bucket(col(c), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)
    ).cast("int")


# --------------------------------------------------------------------- dates
def year_month(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def day_number(d: Column | str) -> Column:
    return F.unix_date(col(d))


def iso_date(text: Column | str) -> Column:
    """Strict ISO date, NULL when the text is not one."""
    return F.when(col(text).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(col(text), "yyyy-MM-dd"))


def flag(condition: Column) -> Column:
    """1 when the condition holds, else 0 (also when it is NULL)."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def calendar_columns(d: Column | str) -> dict[str, Column]:
    """Deterministic calendar attributes of a date (Monday is day 0)."""
    d = col(d)
    weekday = F.weekday(d)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "quarter": F.quarter(d),
        "week_of_year": F.weekofyear(d),
        "day_of_week": weekday,
        "day_name": F.date_format(d, "EEEE"),
        "is_weekend": flag(weekday >= 5),
        "is_month_start": flag(F.dayofmonth(d) == 1),
        "is_month_end": flag(d == F.last_day(d)),
        "is_quarter_end": flag((d == F.last_day(d)) & (F.month(d) % 3 == 0)),
    }


# ---------------------------------------------------------------------- text
def is_null_like(c: Column | str) -> Column:
    return col(c).isNull() | F.trim(col(c).cast("string")).isin(*NULL_TOKENS)


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def sentence_list(*pieces: Column) -> Column:
    """Array of the non-NULL texts, in the order given."""
    return F.array_compact(F.array(*pieces))


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
