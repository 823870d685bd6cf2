"""Chronological splits and feature whitelists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAIN, VALIDATION, TEST = "TRAIN", "VAL", "TEST"


def split_column(date_column: str, train_end: str, val_end: str) -> Column:
    d = F.col(date_column)
    return (
        F.when(d <= F.to_date(F.lit(train_end)), TRAIN).when(d <= F.to_date(F.lit(val_end)), VALIDATION).otherwise(TEST)
    )


def with_split(
    df: DataFrame, date_column: str = "date", train_end: str = "2025-03-31", val_end: str = "2025-06-30"
) -> DataFrame:
    return df.withColumn("split", split_column(date_column, train_end, val_end))


def temporal_split(
    df: DataFrame, date_column: str = "date", train_end: str = "2025-03-31", val_end: str = "2025-06-30"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    d = F.col(date_column)
    train, val = F.to_date(F.lit(train_end)), F.to_date(F.lit(val_end))
    return df.filter(d <= train), df.filter((d > train) & (d <= val)), df.filter(d > val)


def split_bounds(df: DataFrame, date_column: str = "date") -> DataFrame:
    """First day, last day and rows of each split, for the no-overlap check."""
    return df.groupBy("split").agg(
        F.min(date_column).alias("first_day"), F.max(date_column).alias("last_day"), F.count(F.lit(1)).alias("n_rows")
    )


def splits_ordered(bounds: DataFrame) -> DataFrame:
    """True when every split is non-empty and ends before the next begins."""
    spans = bounds.groupBy().pivot("split", [TRAIN, VALIDATION, TEST]).agg(
        F.min("first_day").alias("a"), F.max("last_day").alias("b")
    )
    ok = (F.col(f"{TRAIN}_b") < F.col(f"{VALIDATION}_a")) & (F.col(f"{VALIDATION}_b") < F.col(f"{TEST}_a"))
    return spans.select(F.coalesce(ok, F.lit(False)).alias("ordered"))


# Approved model inputs and forbidden columns.
DEMAND_NUMERIC = (
    "demand_requested", "demand_lag_1", "demand_lag_2", "demand_lag_7", "demand_lag_14", "demand_lag_28",
    "rolling_mean_7", "rolling_mean_14", "rolling_mean_28", "rolling_std_7", "rolling_std_28", "rolling_min_28",
    "rolling_max_28", "demand_change_1d", "demand_change_7d", "demand_growth_28d", "demand_cv_28",
    "zero_demand_frequency_28", "day_of_week", "week_of_year", "month", "quarter", "is_weekend", "month_start",
    "month_end", "holiday_flag", "promotion_flag", "event_flag", "event_active", "event_demand_multiplier",
    "event_lead_time_multiplier", "event_transport_multiplier", "days_since_event_start", "days_until_event_end",
)
DEMAND_CATEGORICAL = ("category", "warehouse_id")
INVENTORY_FEATURES = (
    "beginning_inventory", "ending_inventory_lag1", "ending_inventory_lag2", "inventory_change_1d",
    "safety_stock_target", "safety_stock_gap", "inventory_to_safety_stock_ratio", "demand_mean_7", "demand_mean_28",
    "demand_std_28", "demand_trend_28", "inventory_days_of_supply", "stockout_lag_1", "stockout_count_7d",
    "stockout_count_28d", "stockout_rate_28d", "consecutive_stockout_days", "lost_sales_7d", "lost_sales_28d",
    "lost_sales_rate_28d", "ending_backorder_lag1", "backorder_count_7d", "backorder_count_28d",
    "warehouse_total_inv_lag1", "warehouse_capacity_utilization_lag1", "warehouse_utilization_7d",
    "warehouse_inventory_share", "unit_cost", "selling_price", "forecast_demand_7d", "category", "criticality",
    "warehouse_id",
)
INVENTORY_CATEGORICAL = ("category", "criticality", "warehouse_id")
SUPPLIER_FEATURES = (
    "baseline_reliability", "baseline_lead_time_days", "lead_time_variance", "monthly_capacity_units", "moq_units",
    "supplier_transport_cost_factor", "hist_order_count", "hist_order_volume", "hist_on_time_rate", "hist_otif_rate",
    "hist_fill_rate", "hist_mean_delay", "hist_std_delay", "hist_p90_delay", "hist_p95_delay", "recent_delay_30d",
    "recent_otif_30d", "recent_otif_90d", "delay_trend", "days_since_last_delivery", "is_cold_start",
    "supplier_active_orders_count", "supplier_active_volume", "supplier_capacity_pressure", "quantity_ordered",
    "expected_lead_time_days", "unit_cost", "order_day_of_week", "order_month", "order_quarter", "order_is_weekend",
    "order_is_month_end", "hist_sku_unit_cost_mean", "hist_sku_unit_cost_std", "supplier_id", "supplier_tier",
    "warehouse_id",
)
SUPPLIER_CATEGORICAL = ("supplier_id", "supplier_tier", "warehouse_id")
FORBIDDEN_DEMAND = (
    "target_demand_t_plus_1", "target_demand_t_plus_7", "target_demand_t_plus_14", "target_demand_t_plus_28",
    "target_demand_sum_7d", "target_demand_sum_14d", "target_demand_sum_28d", "is_target_available_t_plus_1",
    "is_target_available_t_plus_7", "is_target_available_t_plus_14", "is_target_available_t_plus_28",
    "target_stockout_t_plus_1", "target_stockout_within_7d", "target_stockout_within_14d", "target_lost_sales_7d",
    "is_target_available_7d", "is_target_available_14d", "target_delay_days", "target_delay_gt_2d",
    "target_delay_gt_5d", "target_on_time", "target_otif", "target_actual_lead_time_days", "outlier_flag",
)
FORBIDDEN_INVENTORY = (
    "demand_fulfilled", "lost_sales_quantity", "ending_backorder", "ending_inventory", "stockout_flag",
    "holding_cost", "stockout_cost", "po_received", "target_stockout_t_plus_1", "target_stockout_within_7d",
    "target_stockout_within_14d", "target_lost_sales_7d",
)
FORBIDDEN_SUPPLIER = (
    "actual_lead_time_days", "actual_delivery_date", "quantity_received", "total_procurement_cost", "transport_cost",
    "delay_days", "on_time_flag", "in_full_flag", "otif_flag", "status", "target_delay_days", "target_delay_gt_2d",
    "target_delay_gt_5d", "target_on_time", "target_otif", "target_actual_lead_time_days",
)


def assert_whitelist(
    columns: Sequence[str],
    whitelist: Sequence[str] | None = None,
    forbidden: Sequence[str] = FORBIDDEN_DEMAND,
    prefixes: Sequence[str] = ("target_",),
    context: str = "model",
) -> None:
    """Raise before any job starts when a column must not be a model input."""
    targets = [c for c in columns if c.startswith(tuple(prefixes))]
    if targets:
        raise ValueError(f"{context}: target columns among the features: {targets}")
    banned = [c for c in columns if c in set(forbidden)]
    if banned:
        raise ValueError(f"{context}: forbidden columns among the features: {banned}")
    unknown = [c for c in columns if whitelist is not None and c not in set(whitelist)]
    if unknown:
        raise ValueError(f"{context}: columns not in the approved whitelist: {unknown}")


def model_features(
    df: DataFrame,
    numeric: Sequence[str] = DEMAND_NUMERIC,
    categorical: Sequence[str] = DEMAND_CATEGORICAL,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Approved feature columns only (plus row keys named in ``keep``)."""
    wanted = [*numeric, *categorical]
    assert_whitelist(wanted, wanted)
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"feature table lacks columns: {missing}")
    return df.select(*[c for c in keep if c not in wanted], *wanted)


def keep_existing(df: DataFrame, columns: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Projection that drops names the table does not have, then renames."""
    return df.select(*[c for c in columns if c in df.columns]).withColumnsRenamed(rename or {})
