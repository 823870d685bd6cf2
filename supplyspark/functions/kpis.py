"""KPI registry: every KPI is an aggregate expression usable at any grain.

``df.groupBy(...).agg(*[kpis.unit_fill().alias("unit_fill"), ...])``. Column
names follow the star schema; each function takes overrides where needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplyspark.functions.costs import DAYS_PER_YEAR, HOLDING_ANNUAL_RATE, STOCKOUT_MULTIPLIER
from supplyspark.functions.exprs import col, pct, ratio


def unit_fill() -> Column:
    return pct(F.sum("demand_fulfilled"), F.sum("demand_requested"))


def stockout_frequency() -> Column:
    return pct(F.sum("stockout_flag"), F.count(F.lit(1)))


def lost_sales_rate() -> Column:
    return pct(F.sum("lost_sales_quantity"), F.sum("demand_requested"))


def annual_turnover(days: Column | int) -> Column:
    """Fulfilled units over mean stock, scaled to a year."""
    span = days if isinstance(days, Column) else F.lit(float(days))
    return ratio(F.sum("demand_fulfilled"), F.avg("ending_inventory")) * (F.lit(DAYS_PER_YEAR) / span)


def days_of_coverage(stock: Column | str = "ending_inventory", mean_demand: Column | str = "demand_mean_28") -> Column:
    return ratio(stock, mean_demand)


def safety_stock_coverage(
    stock: Column | str = "ending_inventory", target: Column | str = "safety_stock_target"
) -> Column:
    return ratio(stock, target)


def on_time_rate() -> Column:
    return F.avg("on_time_flag") * 100.0


def otif_rate() -> Column:
    return F.avg("otif_flag") * 100.0


def mean_delay() -> Column:
    return F.avg("delay_days")


def delay_percentile(p: float) -> Column:
    """Exact interpolated percentile; delays are small integers, so the buffer
    is a short value-to-count map."""
    return F.percentile("delay_days", F.lit(p))


def holding_cost() -> Column:
    return F.sum(col("ending_inventory") * col("unit_cost") * HOLDING_ANNUAL_RATE / DAYS_PER_YEAR)


def stockout_penalty() -> Column:
    return F.sum(col("lost_sales_quantity") * col("selling_price") * STOCKOUT_MULTIPLIER)


def procurement_cost() -> Column:
    return F.sum(col("quantity_received") * col("unit_cost"))


def freight_cost() -> Column:
    return F.sum("transport_cost")


def total_operational_cost(
    procurement: Column | str = "procurement_cost",
    holding: Column | str = "holding_cost",
    stockout: Column | str = "stockout_cost",
    transport: Column | str = "transport_cost",
) -> Column:
    """Sum of the four components; each must be aggregated before joining."""
    parts = [F.coalesce(col(c), F.lit(0.0)) for c in (procurement, holding, stockout, transport)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def capacity_utilisation(capacity: Column | str = "capacity_units") -> Column:
    return pct(F.sum("ending_inventory"), F.max(col(capacity)))


def demand_cv(x: Column | str = "demand_requested") -> Column:
    return ratio(F.stddev_pop(col(x)), F.avg(col(x)))
