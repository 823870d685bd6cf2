"""Building blocks for time series keyed by (product, warehouse).

All frames are over one row per day, so a group is never longer than the
calendar. Expressions that share the same window are planned together: one
shuffle and one sort serve any number of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyspark.functions.exprs import col, std_from_sums
from supplyspark.operators.ledger import SERIES, series_window

MIN_ROW = Window.unboundedPreceding


def lag(x: str, k: int, w=None) -> Column:
    return F.lag(x, k).over(w or series_window())


def lead(x: str, h: int, w=None) -> Column:
    return F.lead(x, h).over(w or series_window())


def before(width: int, w=None):
    """Rows t-width .. t-1."""
    return (w or series_window()).rowsBetween(-width, -1)


def rolling_mean(x: Column | str, width: int, w=None) -> Column:
    return F.avg(col(x)).over(before(width, w))


def rolling_std(x: Column | str, width: int, w=None) -> Column:
    """Sample deviation of the last ``width`` days, 0 below two observations."""
    frame, x = before(width, w), col(x)
    return F.coalesce(
        std_from_sums(F.count(x).over(frame), F.sum(x).over(frame), F.sum(x * x).over(frame)), F.lit(0.0)
    )


def rolling_sum(x: Column | str, width: int, w=None) -> Column:
    return F.coalesce(F.sum(col(x)).over(before(width, w)), F.lit(0))


def trailing_mean(x: Column | str, width: int, w=None) -> Column:
    """Mean of the last ``width`` days including day t."""
    return F.avg(col(x)).over((w or series_window()).rowsBetween(-(width - 1), 0))


def forward(agg, x: Column | str, first: int, last: int, w=None) -> Column:
    """``agg`` over rows t+first .. t+last, NULL unless all of them exist."""
    frame = (w or series_window()).rowsBetween(first, last)
    return F.when(F.count(col(x)).over(frame) == last - first + 1, agg(col(x)).over(frame))


def with_streak(df: DataFrame, flag_column: str, out: str, keys: Sequence[str] = SERIES, order: str = "date") -> DataFrame:
    """Length of the run of 1s that ends on the previous row.

    The distance to the last 0 before t is the streak: one running maximum of
    row numbers, no second grouping.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    rn = F.row_number().over(w)
    numbered = df.withColumn("_rn", rn).withColumn(
        "_last_zero",
        F.max(F.when(F.coalesce(F.col(flag_column), F.lit(0)) == 0, F.col("_rn")).otherwise(0)).over(
            w.rowsBetween(MIN_ROW, -1)
        ),
    )
    return numbered.withColumn(
        out, F.coalesce(F.col("_rn") - 1 - F.col("_last_zero"), F.lit(0)).cast("int")
    ).drop("_rn", "_last_zero")


def episodes(df: DataFrame, flag_column: str, keys: Sequence[str] = SERIES, order: str = "date") -> DataFrame:
    """Maximal runs of consecutive 1s: one row per run with start, end, length."""
    w = Window.partitionBy(*keys).orderBy(order)
    starts = F.coalesce((F.col(flag_column) != F.lag(flag_column).over(w)).cast("int"), F.lit(1))
    marked = df.select(*keys, order, flag_column).withColumn("_start", starts)
    numbered = marked.withColumn("streak_id", F.sum("_start").over(w.rowsBetween(MIN_ROW, 0)))
    return (
        numbered.filter(F.col(flag_column) == 1)
        .groupBy(*keys, "streak_id")
        .agg(
            F.min(order).alias("first_day"),
            F.max(order).alias("last_day"),
            F.count(F.lit(1)).alias("streak_days"),
        )
    )


def group_share(x: Column | str, total_over: Sequence[str]) -> Column:
    """Share of the group total; meant for already aggregated rows."""
    return col(x) / F.sum(col(x)).over(Window.partitionBy(*total_over))


# Event columns and what a day without an event carries.
EVENT_DEFAULTS = {
    "event_active": 0,
    "event_type": "Normal",
    "event_severity": "None",
    "event_demand_multiplier": 1.0,
    "event_lead_time_multiplier": 1.0,
    "event_transport_multiplier": 1.0,
    "days_since_event_start": -1,
    "days_until_event_end": -1,
}


def event_days(events: DataFrame) -> DataFrame:
    """One row per day with an event: the last event in sequence order wins.

    Intervals are unrolled to days, which turns the interval join into an
    equality join on a table no longer than the calendar.
    """
    unrolled = events.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    pick = F.struct(
        F.lit(1).alias("event_active"),
        F.col("event_type"),
        F.col("severity").alias("event_severity"),
        F.col("demand_multiplier").alias("event_demand_multiplier"),
        F.col("lead_time_multiplier").alias("event_lead_time_multiplier"),
        F.col("transport_cost_multiplier").alias("event_transport_multiplier"),
        F.datediff("date", "start_date").alias("days_since_event_start"),
        F.datediff("end_date", "date").alias("days_until_event_end"),
    )
    return unrolled.groupBy("date").agg(F.max_by(pick, "ev_seq").alias("ev")).select("date", "ev.*")


def with_events(df: DataFrame, events: DataFrame) -> DataFrame:
    kept = [c for c in df.columns if c not in EVENT_DEFAULTS]
    joined = df.select(*kept).join(event_days(events), "date", "left")
    return joined.select(
        *kept, *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in EVENT_DEFAULTS.items()]
    )
