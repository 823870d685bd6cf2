"""Demand feature table: one row per product, warehouse and day, 55 columns.

All window columns share one partitioning (product, warehouse) and one order
(date). Features at t read days before t only; targets read days after t.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyspark.functions.exprs import calendar_columns, flag, half_even, ratio_or
from supplyspark.operators import series as S
from supplyspark.operators.ledger import align_to_grid, dense_grid, series_window

# Lags, horizons and windows of the feature table.
LAGS = (1, 2, 7, 14, 28)
HORIZONS = (1, 7, 14, 28)
SUM_HORIZONS = (7, 14, 28)
WARMUP_DAYS = 28

# Holidays flagged in the feature table, unless the caller names others.
HOLIDAY_DATES = (
    "2024-01-01", "2024-05-27", "2024-07-04", "2024-09-02", "2024-11-29", "2024-12-25",
    "2025-01-01", "2025-05-26", "2025-07-04", "2025-09-01", "2025-11-28", "2025-12-25",
)

GRID_DEFAULTS = {"demand_requested": 0, "promotion_flag": 0, "event_flag": 0, "outlier_flag": 0}


def base_grid(
    dim_product: DataFrame, dim_warehouse: DataFrame, dim_date: DataFrame, daily_demand: DataFrame
) -> DataFrame:
    """Dense calendar grid; days without orders carry 0 units."""
    grid = align_to_grid(dense_grid(dim_product, dim_warehouse, dim_date), daily_demand, GRID_DEFAULTS)
    names = dim_product.select("product_id", "product_name", "category")
    places = dim_warehouse.select("warehouse_id", "warehouse_name")
    return grid.join(names, "product_id").join(places, "warehouse_id")


def first_day(df: DataFrame) -> Column:
    """Earliest date as a scalar subquery."""
    return df.agg(F.min("date")).scalar()


def lag_columns(lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"demand_lag_{k}": S.lag("demand_requested", k) for k in lags}


def rolling_columns() -> dict[str, Column]:
    x = "demand_requested"
    out = {f"rolling_mean_{w}": half_even(S.rolling_mean(x, w), 2) for w in (7, 14, 28)}
    out |= {f"rolling_std_{w}": half_even(S.rolling_std(x, w), 2) for w in (7, 28)}
    out["rolling_min_28"] = F.min(x).over(S.before(28))
    out["rolling_max_28"] = F.max(x).over(S.before(28))
    return out


def dynamics_columns() -> dict[str, Column]:
    """Built on the lag and (rounded) rolling columns above."""
    zero = F.lit(0)
    return {
        "demand_change_1d": F.coalesce(F.col("demand_lag_1") - F.col("demand_lag_2"), zero).cast("double"),
        "demand_change_7d": F.coalesce(F.col("demand_lag_1") - F.col("demand_lag_7"), zero).cast("double"),
        "demand_growth_28d": half_even(ratio_or("rolling_mean_7", "rolling_mean_28", 1.0), 3),
        "demand_cv_28": half_even(ratio_or("rolling_std_28", "rolling_mean_28", 0.0), 3),
        # A missing first lag counts as "not zero" and stays in the denominator.
        "zero_demand_frequency_28": half_even(
            F.avg(flag(F.col("demand_lag_1") == 0)).over(series_window().rowsBetween(-27, 0)), 3
        ),
    }


def calendar_feature_columns(holidays: Sequence[str] = HOLIDAY_DATES) -> dict[str, Column]:
    """``holidays`` are dates (yyyy-MM-dd) or days of every year (MM-dd)."""
    cal = calendar_columns("date")
    return {
        "day_of_week": cal["day_of_week"],
        "week_of_year": cal["week_of_year"],
        "month": cal["month"],
        "quarter": cal["quarter"],
        "is_weekend": cal["is_weekend"],
        "month_start": cal["is_month_start"],
        "month_end": cal["is_month_end"],
        "holiday_flag": flag(
            F.date_format("date", "yyyy-MM-dd").isin(*holidays) | F.date_format("date", "MM-dd").isin(*holidays)
        ),
    }


def target_columns() -> dict[str, Column]:
    x = "demand_requested"
    out = {f"target_demand_t_plus_{h}": S.lead(x, h) for h in HORIZONS}
    out |= {f"target_demand_sum_{h}d": S.forward(F.sum, x, 1, h) for h in SUM_HORIZONS}
    return out


def availability_columns(start: Column) -> dict[str, Column]:
    out = {"has_sufficient_history_28d": flag(F.col("date") >= F.date_add(start, WARMUP_DAYS))}
    out |= {
        f"is_target_available_t_plus_{h}": F.col(f"target_demand_t_plus_{h}").isNotNull().cast("int") for h in HORIZONS
    }
    return out


def demand_features(
    grid: DataFrame, events: DataFrame, holidays: Sequence[str] = HOLIDAY_DATES, start: Column | None = None
) -> DataFrame:
    """All feature groups. ``grid`` needs product_id, warehouse_id, date,
    demand_requested (plus any descriptive columns, which are kept)."""
    begin = first_day(grid) if start is None else start
    out = grid.withColumns(lag_columns() | rolling_columns() | target_columns())
    out = out.withColumns(dynamics_columns()).withColumns(calendar_feature_columns(holidays))
    return S.with_events(out, events).withColumns(availability_columns(begin))


def sparse_demand_features(
    daily_demand: DataFrame, lags: Sequence[int] = (1, 7, 14, 28), windows: Sequence[int] = (7, 14, 28)
) -> DataFrame:
    """Smaller variant on the sparse rollup, rolling values unrounded."""
    x = "demand_requested"
    cal = calendar_columns("date")
    base = daily_demand.select(
        "date", "product_id", "category", "warehouse_id", x, "promotion_flag", "event_flag"
    ).withColumns({k: cal[k] for k in ("day_of_week", "day_name", "is_weekend", "month", "quarter")})
    cols = {f"lag_{k}": S.lag(x, k) for k in lags}
    for w in windows:
        cols[f"rolling_mean_{w}"] = S.rolling_mean(x, w)
        cols[f"rolling_std_{w}"] = S.rolling_std(x, w)
    out = base.withColumns(cols)
    return out.withColumns(
        {
            "demand_cv_28": half_even(ratio_or("rolling_std_28", "rolling_mean_28", 0.0), 3),
            "demand_growth_ratio": half_even(ratio_or("rolling_mean_7", "rolling_mean_28", 1.0), 3),
        }
    )
