"""The six materialized rollups and their four logical view twins.

``digits=None`` keeps full precision; the defaults give the rounded values of
the published tables. Facts are aggregated before they meet dimensions: the
joins then run on the (small) aggregated rows, and no sum can be inflated by a
many-to-many join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyspark.functions import kpis
from supplyspark.functions.exprs import maybe_half_up, pct, ratio, year_month

HEALTH_COLUMNS = (
    "beginning_inventory",
    "po_received",
    "demand_requested",
    "demand_fulfilled",
    "lost_sales_quantity",
    "ending_backorder",
    "ending_inventory",
    "stockout_flag",
    "stockout_quantity",
    "safety_stock_target",
)


def daily_demand(fact_demand: DataFrame, dim_product: DataFrame, dim_warehouse: DataFrame) -> DataFrame:
    """Product x warehouse x day: distinct markets, units, promotion, event, outlier."""
    rolled = fact_demand.groupBy("date", "product_id", "warehouse_id").agg(
        F.countDistinct("market_id").alias("markets_count"),
        F.sum("demand_requested").alias("demand_requested"),
        F.max("promotion_flag").alias("promotion_flag"),
        F.max(F.when(F.col("event_id") != "NONE", 1).otherwise(0)).alias("event_flag"),
        F.max("outlier_flag").alias("outlier_flag"),
        F.sum("outlier_flag").alias("outlier_market_count"),
    )
    return _named(rolled, dim_product, dim_warehouse).select(
        "date",
        "product_id",
        "product_name",
        "category",
        "warehouse_id",
        "warehouse_name",
        "markets_count",
        "demand_requested",
        "promotion_flag",
        "event_flag",
        "outlier_flag",
        "outlier_market_count",
    )


def _named(df: DataFrame, dim_product: DataFrame, dim_warehouse: DataFrame, *extra: str) -> DataFrame:
    return df.join(dim_product.select("product_id", "product_name", "category", *extra), "product_id").join(
        dim_warehouse.select("warehouse_id", "warehouse_name"), "warehouse_id"
    )


def inventory_health(
    fact_inventory: DataFrame, dim_product: DataFrame, dim_warehouse: DataFrame, digits: int | None = 2
) -> DataFrame:
    """Product x warehouse x day: the ledger with names and coverage ratio."""
    named = _named(fact_inventory, dim_product, dim_warehouse, "criticality")
    return named.select(
        "date",
        "product_id",
        "product_name",
        "category",
        "criticality",
        "warehouse_id",
        "warehouse_name",
        *HEALTH_COLUMNS,
        maybe_half_up(ratio("ending_inventory", "safety_stock_target"), digits).alias("safety_stock_coverage"),
        "holding_cost",
        "stockout_cost",
    )


def supplier_performance(
    fact_purchase_orders: DataFrame, dim_supplier: DataFrame, digits: int | None = 2
) -> DataFrame:
    """Supplier x month of the order date."""
    po = fact_purchase_orders.groupBy(year_month("order_date").alias("year_month"), "supplier_id").agg(
        F.count("po_id").alias("total_orders"),
        F.sum("quantity_ordered").alias("units_ordered"),
        F.sum("quantity_received").alias("units_received"),
        maybe_half_up(kpis.on_time_rate(), digits).alias("on_time_rate_pct"),
        maybe_half_up(F.avg("in_full_flag") * 100.0, digits).alias("in_full_rate_pct"),
        maybe_half_up(kpis.otif_rate(), digits).alias("otif_rate_pct"),
        maybe_half_up(kpis.mean_delay(), digits).alias("avg_delay_days"),
        maybe_half_up(F.sum("total_procurement_cost"), digits).alias("total_procurement_cost"),
        maybe_half_up(F.sum("transport_cost"), digits).alias("total_freight_cost"),
    )
    names = dim_supplier.select("supplier_id", "supplier_name", "tier")
    return po.join(names, "supplier_id").select(
        "year_month",
        "supplier_id",
        "supplier_name",
        "tier",
        *[c for c in po.columns if c not in ("year_month", "supplier_id")],
    )


def warehouse_operations(fact_inventory: DataFrame, dim_warehouse: DataFrame, digits: int | None = 2) -> DataFrame:
    """Warehouse x day, with utilisation of the storage capacity."""
    day = fact_inventory.groupBy("date", "warehouse_id").agg(
        F.sum("ending_inventory").alias("ending_inventory"),
        F.sum("demand_requested").alias("demand_requested"),
        F.sum("demand_fulfilled").alias("demand_fulfilled"),
        F.sum("lost_sales_quantity").alias("lost_sales_units"),
        F.sum("stockout_flag").alias("stockout_skus_count"),
        maybe_half_up(F.sum("holding_cost"), digits).alias("holding_cost"),
        maybe_half_up(F.sum("stockout_cost"), digits).alias("stockout_cost"),
    )
    dims = dim_warehouse.select("warehouse_id", "warehouse_name", "capacity_units")
    return day.join(dims, "warehouse_id").select(
        "date",
        "warehouse_id",
        "warehouse_name",
        "capacity_units",
        "ending_inventory",
        maybe_half_up(pct("ending_inventory", "capacity_units"), digits).alias("capacity_utilization_pct"),
        "demand_requested",
        "demand_fulfilled",
        "lost_sales_units",
        "stockout_skus_count",
        "holding_cost",
        "stockout_cost",
    )


def cost_summary(
    fact_inventory: DataFrame, fact_purchase_orders: DataFrame, dim_warehouse: DataFrame
) -> DataFrame:
    """Warehouse x month. Months with orders but no ledger row are not kept;
    ``reconcile.cost_reconciliation`` reports what that leaves out."""
    keys = ["warehouse_id", "year_month"]
    stock = fact_inventory.groupBy(year_month("date").alias("year_month"), "warehouse_id").agg(
        F.sum("holding_cost").alias("holding_cost"), F.sum("stockout_cost").alias("stockout_cost")
    )
    orders = fact_purchase_orders.groupBy(year_month("order_date").alias("year_month"), "warehouse_id").agg(
        F.sum("total_procurement_cost").alias("procurement_cost"), F.sum("transport_cost").alias("transport_cost")
    )
    zero = F.lit(0.0)
    joined = stock.join(orders, keys, "left").join(
        dim_warehouse.select("warehouse_id", "warehouse_name"), "warehouse_id"
    )
    return joined.select(
        "year_month",
        "warehouse_id",
        "warehouse_name",
        F.coalesce("procurement_cost", zero).alias("procurement_cost"),
        F.coalesce("holding_cost", zero).alias("holding_cost"),
        F.coalesce("stockout_cost", zero).alias("stockout_cost"),
        F.coalesce("transport_cost", zero).alias("transport_cost"),
        kpis.total_operational_cost().alias("total_operational_cost"),
    )


# Thresholds of the empirical risk tier.
HIGH_STOCKOUT_SHARE = 0.15
MEDIUM_STOCKOUT_SHARE = 0.05
LOW_RELIABILITY = 0.85


def product_supply_risk(
    fact_inventory: DataFrame,
    dim_product: DataFrame,
    dim_warehouse: DataFrame,
    dim_supplier: DataFrame,
    digits: bool = True,
) -> DataFrame:
    """Product x warehouse: mean stock, coverage, service level and risk tier."""
    one, two = (1, 2) if digits else (None, None)
    series = fact_inventory.groupBy("product_id", "warehouse_id").agg(
        F.avg("ending_inventory").alias("mean_stock"),
        F.avg("demand_requested").alias("mean_demand"),
        F.sum("stockout_flag").alias("stockout_days_count"),
        F.count(F.lit(1)).alias("n_days"),
        F.sum("lost_sales_quantity").alias("total_lost_sales_units"),
        kpis.unit_fill().alias("fill"),
    )
    reliability = dim_supplier.select(
        F.col("supplier_id").alias("primary_supplier_id"),
        F.col("supplier_name").alias("primary_supplier_name"),
        F.col("baseline_reliability").alias("supplier_reliability"),
    )
    share = ratio("stockout_days_count", "n_days")
    tier = (
        F.when((share >= HIGH_STOCKOUT_SHARE) | (F.col("supplier_reliability") < LOW_RELIABILITY), "HIGH")
        .when(share >= MEDIUM_STOCKOUT_SHARE, "MEDIUM")
        .otherwise("LOW")
    )
    named = _named(series, dim_product, dim_warehouse, "criticality", "primary_supplier_id")
    return named.join(reliability, "primary_supplier_id").select(
        "product_id",
        "product_name",
        "category",
        "criticality",
        "primary_supplier_id",
        "primary_supplier_name",
        "supplier_reliability",
        "warehouse_id",
        "warehouse_name",
        maybe_half_up("mean_stock", one).alias("avg_inventory_units"),
        maybe_half_up("mean_demand", one).alias("avg_daily_demand"),
        maybe_half_up(ratio("mean_stock", "mean_demand"), one).alias("avg_days_of_coverage"),
        "stockout_days_count",
        maybe_half_up(share * 100.0, two).alias("stockout_frequency_pct"),
        "total_lost_sales_units",
        maybe_half_up("fill", two).alias("service_level_pct"),
        tier.alias("empirical_risk_tier"),
    )


def build_all(star) -> dict[str, DataFrame]:
    """All six rollups of a star schema (any object with the table attributes)."""
    stock = star.ledger
    return {
        "analytics_daily_demand": daily_demand(star.fact_demand, star.dim_product, star.dim_warehouse).drop(
            "outlier_market_count"
        ),
        "analytics_inventory_health": inventory_health(stock, star.dim_product, star.dim_warehouse),
        "analytics_supplier_performance": supplier_performance(star.fact_purchase_orders, star.dim_supplier),
        "analytics_warehouse_operations": warehouse_operations(stock, star.dim_warehouse),
        "analytics_cost_summary": cost_summary(stock, star.fact_purchase_orders, star.dim_warehouse),
        "analytics_product_supply_risk": product_supply_risk(
            stock, star.dim_product, star.dim_warehouse, star.dim_supplier
        ),
    }


def build_views(star) -> dict[str, DataFrame]:
    """Logical view twins, with the column names the views use."""
    rollup = daily_demand(star.fact_demand, star.dim_product, star.dim_warehouse)
    suppliers = supplier_performance(star.fact_purchase_orders, star.dim_supplier)
    operations = warehouse_operations(star.ledger, star.dim_warehouse)
    health = inventory_health(star.ledger, star.dim_product, star.dim_warehouse)
    return {
        "view_daily_demand_rollup": rollup.drop("outlier_flag").withColumnsRenamed(
            {
                "markets_count": "markets_served_count",
                "demand_requested": "total_demand_requested",
                "promotion_flag": "is_promotional_day",
                "event_flag": "is_disruption_event_day",
            }
        ),
        "view_inventory_health_rollup": health.withColumnRenamed(
            "safety_stock_coverage", "safety_stock_coverage_ratio"
        ),
        "view_supplier_monthly_performance": suppliers.withColumnsRenamed(
            {
                "units_ordered": "total_units_ordered",
                "units_received": "total_units_received",
                "total_procurement_cost": "total_spend",
            }
        ),
        "view_warehouse_daily_operations": operations.withColumnsRenamed(
            {
                "ending_inventory": "total_ending_inventory",
                "demand_requested": "total_demand_requested",
                "demand_fulfilled": "total_demand_fulfilled",
                "lost_sales_units": "total_lost_sales",
                "holding_cost": "daily_holding_cost",
                "stockout_cost": "daily_stockout_cost",
            }
        ),
    }
