"""Series at part grain: as many as the data has, each from its first to its last day.

A dense grid of parts, warehouses and days would grow with their product. Here a
series has rows only for days on which something happens, and the days between
are implied: they have zero demand, and stock does not move. Windows over a
range of days and running sums give what they would give on the dense days, so
the work grows with the rows. A series has at most one row a day, so none is
longer than the calendar, and dealing series by hash gives tasks of like size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from supplyspark.functions.exprs import day_number, half_even, std_from_sums

SERIES = ("part_id", "warehouse_id")
LAGS = (1, 7, 14, 28)
WINDOWS = (7, 28)


def daily(events: DataFrame, units: str) -> DataFrame:
    """One row for each series and day: (part, warehouse, date, units)."""
    return events.groupBy(*SERIES, "date").agg(F.sum(units).alias(units))


def flows(demand: DataFrame, receipts: DataFrame) -> DataFrame:
    """Days of a series on which units leave or arrive."""
    zero = F.lit(0).cast("long")
    both = demand.select(*SERIES, "date", "demand_requested", zero.alias("po_received")).unionByName(
        receipts.select(*SERIES, "date", zero.alias("demand_requested"), "po_received")
    )
    return both.groupBy(*SERIES, "date").agg(F.sum("demand_requested").alias("demand_requested"), F.sum("po_received").alias("po_received"))


def _back(first: int, last: int) -> WindowSpec:
    """The days from ``first`` to ``last`` days ago."""
    return Window.partitionBy(*SERIES).orderBy("_day").rangeBetween(-first, -last)


def _days_back(days: int) -> Column:
    """How many days of the series lie in the ``days`` days before this one."""
    return F.least(F.lit(days), F.col("age_days"))


def demand_features(demand: DataFrame, x: str = "demand_requested") -> DataFrame:
    """Lags and rolling measures of each day with demand, over the days before it in its series.

    A lag beyond the first day is NULL, a day without demand counts as zero.
    """
    start = Window.partitionBy(*SERIES).orderBy("_day")
    out = demand.withColumn("_day", day_number("date")).withColumn("age_days", (F.col("_day") - F.first("_day").over(start)).cast("int"))
    out = out.withColumn("days_since_last", (F.col("_day") - F.lag("_day").over(start)).cast("int"))
    columns: dict[str, Column] = {
        f"demand_lag_{k}": F.when(F.col("age_days") >= k, F.coalesce(F.sum(x).over(_back(k, k)), F.lit(0))) for k in LAGS
    }
    for w in WINDOWS:
        n, total = _days_back(w), F.coalesce(F.sum(x).over(_back(w, 1)), F.lit(0))
        seen = F.count(x).over(_back(w, 1))
        columns[f"rolling_sum_{w}"] = total
        columns[f"rolling_mean_{w}"] = half_even(total.cast("double") / F.nullif(n, F.lit(0)), 4)
        columns[f"rolling_max_{w}"] = F.when(n > 0, F.coalesce(F.max(x).over(_back(w, 1)), F.lit(0)))
        columns[f"rolling_min_{w}"] = F.when(n > 0, F.when(seen < n, F.lit(0)).otherwise(F.min(x).over(_back(w, 1))))
        columns[f"active_days_{w}"] = seen
    squares = F.coalesce(F.sum(F.col(x) * F.col(x)).over(_back(28, 1)), F.lit(0))
    columns["rolling_std_28"] = half_even(std_from_sums(_days_back(28), F.coalesce(F.sum(x).over(_back(28, 1)), F.lit(0)), squares), 4)
    return out.withColumns(columns).drop("_day")


def ledger(moves: DataFrame, initial_stock: int) -> DataFrame:
    """Zero-floored stock after each day with a movement, and for how many days it then stood.

    With the free balance S, the units that had to be conjured up are
    C = max(0, -min S so far); stock is S + C, and a day's unmet units are the
    growth of C. Days without movements change neither.
    """
    w = Window.partitionBy(*SERIES).orderBy("date")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.lit(initial_stock).cast("long")
    out = moves.withColumn("_free", start + F.sum(F.col("po_received") - F.col("demand_requested")).over(so_far))
    out = out.withColumn("_conjured", F.greatest(F.lit(0).cast("long"), -F.min("_free").over(so_far)))
    out = out.withColumn("ending_inventory", F.col("_free") + F.col("_conjured"))
    out = out.withColumns(
        {
            "beginning_inventory": F.coalesce(F.lag("ending_inventory").over(w), start),
            "stockout_quantity": F.col("_conjured") - F.coalesce(F.lag("_conjured").over(w), F.lit(0)),
            "days_held": F.coalesce(F.datediff(F.lead("date").over(w), "date"), F.lit(1)).cast("int"),
        }
    )
    return out.drop("_free", "_conjured")


def stock_summary(stock: DataFrame) -> DataFrame:
    """By series: its span, mean stock over all its days, empty days and unmet units."""
    days = F.sum("days_held")
    return stock.groupBy(*SERIES).agg(
        F.min("date").alias("first_day"),
        F.max("date").alias("last_day"),
        days.alias("days"),
        F.count(F.lit(1)).alias("movement_days"),
        half_even(F.sum(F.col("ending_inventory") * F.col("days_held")).cast("double") / days, 4).alias("mean_stock"),
        F.sum(F.when(F.col("ending_inventory") == 0, F.col("days_held")).otherwise(0)).alias("empty_days"),
        F.sum("stockout_quantity").alias("unmet_units"),
    )
