"""Unit cost models of the replenishment problem, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplyspark.functions.exprs import clip, col

# Cost model constants.
SECONDARY_PREMIUM = 0.05
BASE_FREIGHT_RATE = 2.5
HOLDING_ANNUAL_RATE = 0.20
DAYS_PER_YEAR = 365.25
PLANNING_DAYS = 7
STOCKOUT_MULTIPLIER = 1.5
DELAY_DAY_SHARE = 0.3
DELAY_COST_PER_DAY = 1.0
WEEKS_PER_MONTH = 4.333333


def procurement_unit_cost(
    unit_cost: Column | str, is_primary: Column | bool = True, premium: float = SECONDARY_PREMIUM
) -> Column:
    primary = F.lit(is_primary) if isinstance(is_primary, bool) else is_primary
    return F.when(primary, col(unit_cost)).otherwise(col(unit_cost) * (1.0 + premium))


def freight_unit_cost(
    supplier_factor: Column | str, warehouse_factor: Column | str, rate: Column | float = BASE_FREIGHT_RATE
) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return rate * col(supplier_factor) * col(warehouse_factor)


def transfer_unit_cost(
    origin_handling: Column | str,
    origin_factor: Column | str,
    dest_factor: Column | str,
    rate: Column | float = BASE_FREIGHT_RATE,
) -> Column:
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return col(origin_handling) + rate * ((col(origin_factor) + col(dest_factor)) / 2.0)


def holding_unit_cost(
    unit_cost: Column | str, annual_rate: float = HOLDING_ANNUAL_RATE, days: int = PLANNING_DAYS
) -> Column:
    return col(unit_cost) * (annual_rate / DAYS_PER_YEAR) * float(days)


def shortage_unit_cost(
    selling_price: Column | str,
    stockout_probability: Column | str | None = None,
    multiplier: float = STOCKOUT_MULTIPLIER,
) -> Column:
    chance = F.lit(0.0) if stockout_probability is None else clip(stockout_probability, 0.0, 1.0)
    return col(selling_price) * multiplier * (1.0 + chance)


def delay_unit_cost(
    delay_probability: Column | str, lead_time_days: Column | str, per_day: float = DELAY_COST_PER_DAY
) -> Column:
    return clip(delay_probability, 0.0, 1.0) * col(lead_time_days) * DELAY_DAY_SHARE * per_day
