"""Inventory and stockout-risk feature table: product x warehouse x day, 53 columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyspark.functions.exprs import flag, half_even, ratio, ratio_or
from supplyspark.operators import series as S
from supplyspark.operators.features.demand import WARMUP_DAYS, first_day
from supplyspark.operators.ledger import SERIES

BASE_COLUMNS = (
    "beginning_inventory",
    "po_received",
    "demand_requested",
    "demand_fulfilled",
    "lost_sales_quantity",
    "ending_backorder",
    "ending_inventory",
    "stockout_flag",
    "safety_stock_target",
    "holding_cost",
    "stockout_cost",
)


def base_ledger(fact_inventory: DataFrame, dim_product: DataFrame, dim_warehouse: DataFrame) -> DataFrame:
    products = dim_product.select(
        "product_id", "product_name", "category", "criticality", "unit_cost", "selling_price"
    )
    places = dim_warehouse.select(
        "warehouse_id", "warehouse_name", F.col("capacity_units").alias("warehouse_capacity_units")
    )
    return (
        fact_inventory.select("date", *SERIES, *BASE_COLUMNS).join(products, "product_id").join(places, "warehouse_id")
    )


def state_columns() -> dict[str, Column]:
    return {
        "ending_inventory_lag1": S.lag("ending_inventory", 1),
        "ending_inventory_lag2": S.lag("ending_inventory", 2),
    }


def buffer_columns() -> dict[str, Column]:
    return {
        "inventory_change_1d": F.coalesce(
            F.col("ending_inventory_lag1") - F.col("ending_inventory_lag2"), F.lit(0)
        ).cast("double"),
        "safety_stock_gap": F.col("beginning_inventory") - F.col("safety_stock_target"),
        "inventory_to_safety_stock_ratio": half_even(ratio_or("beginning_inventory", "safety_stock_target", 1.0), 2),
        "demand_trend_28": half_even(ratio_or("demand_mean_7", "demand_mean_28", 1.0), 3),
        "inventory_days_of_supply": half_even(ratio_or("beginning_inventory", "demand_mean_28", 999.0), 1),
        "stockout_rate_28d": half_even(F.col("stockout_count_28d") / 28.0, 3),
        "lost_sales_rate_28d": half_even(ratio_or("lost_sales_28d", F.col("demand_mean_28") * 28.0, 0.0), 3),
    }


def history_columns() -> dict[str, Column]:
    x = "demand_requested"
    backlog = flag(F.col("ending_backorder") > 0)
    return {
        "demand_mean_7": half_even(S.rolling_mean(x, 7), 2),
        "demand_mean_28": half_even(S.rolling_mean(x, 28), 2),
        "demand_std_28": half_even(S.rolling_std(x, 28), 2),
        "stockout_lag_1": F.coalesce(S.lag("stockout_flag", 1), F.lit(0)),
        "stockout_count_7d": S.rolling_sum("stockout_flag", 7).cast("int"),
        "stockout_count_28d": S.rolling_sum("stockout_flag", 28).cast("int"),
        "lost_sales_7d": S.rolling_sum("lost_sales_quantity", 7),
        "lost_sales_28d": S.rolling_sum("lost_sales_quantity", 28),
        "ending_backorder_lag1": F.coalesce(S.lag("ending_backorder", 1), F.lit(0)),
        "backorder_count_7d": S.rolling_sum(backlog, 7).cast("int"),
        "backorder_count_28d": S.rolling_sum(backlog, 28).cast("int"),
    }


def target_columns() -> dict[str, Column]:
    """Day t itself belongs to the 7 and 14 day target windows."""
    return {
        "target_stockout_t_plus_1": S.lead("stockout_flag", 1),
        "target_stockout_within_7d": S.forward(F.max, "stockout_flag", 0, 6),
        "target_stockout_within_14d": S.forward(F.max, "stockout_flag", 0, 13),
        "target_lost_sales_7d": S.forward(F.sum, "lost_sales_quantity", 0, 6),
    }


def warehouse_load(lagged: DataFrame) -> DataFrame:
    """Warehouse x day: previous-day stock, utilisation and its 7-day mean.

    Product rows are summed per (warehouse, day) before any window, so the
    window runs on one row per warehouse and day.
    """
    totals = lagged.groupBy("warehouse_id", "date").agg(
        F.coalesce(F.sum("ending_inventory_lag1"), F.lit(0)).alias("warehouse_total_inv_lag1"),
        F.max("warehouse_capacity_units").alias("capacity"),
    )
    used = totals.withColumn(
        "warehouse_capacity_utilization_lag1",
        half_even(ratio("warehouse_total_inv_lag1", "capacity") * 100.0, 2),
    )
    week = Window.partitionBy("warehouse_id").orderBy("date").rowsBetween(-6, 0)
    return used.withColumn(
        "warehouse_utilization_7d", half_even(F.avg("warehouse_capacity_utilization_lag1").over(week), 2)
    ).drop("capacity")


def with_warehouse_pressure(df: DataFrame) -> DataFrame:
    joined = df.join(warehouse_load(df), ["warehouse_id", "date"], "left")
    return joined.withColumn(
        "warehouse_inventory_share", half_even(ratio_or("beginning_inventory", "warehouse_total_inv_lag1", 0.0), 4)
    )


def inventory_features(base: DataFrame, start: Column | None = None) -> DataFrame:
    begin = first_day(base) if start is None else start
    out = base.withColumns(state_columns() | history_columns() | target_columns())
    out = out.withColumns(buffer_columns())
    out = S.with_streak(out, "stockout_flag", "consecutive_stockout_days")
    out = with_warehouse_pressure(out)
    return out.withColumns(
        {
            "has_sufficient_history_28d": flag(F.col("date") >= F.date_add(begin, WARMUP_DAYS)),
            "is_target_available_7d": F.col("target_stockout_within_7d").isNotNull().cast("int"),
            "is_target_available_14d": F.col("target_stockout_within_14d").isNotNull().cast("int"),
        }
    )
