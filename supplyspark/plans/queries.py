"""The eleven analytical queries.

Queries that the rollups can answer take rollups; the others take facts.
``digits=False`` switches the presentation rounding off. Ordering follows the
published result order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyspark.functions import kpis
from supplyspark.functions.exprs import maybe_half_up, mean_of_rounded, pct, ratio, std_from_sums
from supplyspark.operators import series
from supplyspark.sources.io import scan_equal


def _r(c: Column | str, digits: int, on: bool) -> Column:
    return maybe_half_up(c, digits if on else None)


def calendar_days(fact_inventory: DataFrame) -> Column:
    """Number of distinct ledger days, as a scalar subquery."""
    return fact_inventory.agg(F.countDistinct("date")).scalar()


def inventory_turnover(
    fact_inventory: DataFrame, dim_product: DataFrame, dim_warehouse: DataFrame, days: int | None = None, digits: bool = True
) -> DataFrame:
    """Turnover and days of coverage by category and warehouse."""
    n_days = calendar_days(fact_inventory) if days is None else F.lit(days)
    per_series = fact_inventory.groupBy("product_id", "warehouse_id").agg(
        F.sum("demand_fulfilled").alias("fulfilled"),
        F.sum("ending_inventory").alias("stock"),
        F.count(F.lit(1)).alias("n"),
        F.sum("holding_cost").alias("holding"),
    )
    grouped = (
        per_series.join(dim_product.select("product_id", "category"), "product_id")
        .groupBy("category", "warehouse_id")
        .agg(
            F.count(F.lit(1)).alias("active_skus"),
            F.sum("fulfilled").alias("total_fulfilled_units"),
            (F.sum("stock") / F.sum("n")).alias("mean_stock"),
            F.sum("holding").alias("holding"),
        )
        .withColumn("days", n_days.cast("double"))
        .join(dim_warehouse.select("warehouse_id", "warehouse_name"), "warehouse_id")
    )
    return grouped.select(
        "category",
        "warehouse_id",
        "warehouse_name",
        "active_skus",
        "total_fulfilled_units",
        _r("mean_stock", 1, digits).alias("avg_daily_inventory_units"),
        _r("holding", 2, digits).alias("total_holding_cost"),
        _r(ratio("total_fulfilled_units", "mean_stock") * (F.lit(365.25) / F.col("days")), 2, digits).alias(
            "annualized_inventory_turnover"
        ),
        _r(ratio("mean_stock", F.col("total_fulfilled_units") / F.col("days")), 1, digits).alias(
            "days_of_inventory_coverage"
        ),
    ).orderBy("category", "warehouse_id")


def supplier_otif(fact_purchase_orders: DataFrame, dim_supplier: DataFrame, digits: bool = True) -> DataFrame:
    """All-time supplier benchmark, weighted by order; suppliers without orders stay."""
    po = fact_purchase_orders.groupBy("supplier_id").agg(
        F.count("po_id").alias("n"),
        F.sum("quantity_ordered").alias("total_units_ordered"),
        F.sum("quantity_received").alias("total_units_received"),
        kpis.on_time_rate().alias("on_time"),
        (F.avg("in_full_flag") * 100.0).alias("in_full"),
        kpis.otif_rate().alias("otif"),
        kpis.mean_delay().alias("delay"),
        F.sum("total_procurement_cost").alias("value"),
    )
    return (
        dim_supplier.join(po, "supplier_id", "left")
        .select(
            "supplier_id",
            "supplier_name",
            "tier",
            "baseline_reliability",
            "baseline_lead_time_days",
            F.coalesce("n", F.lit(0)).alias("total_purchase_orders"),
            "total_units_ordered",
            "total_units_received",
            _r("on_time", 2, digits).alias("on_time_delivery_pct"),
            _r("in_full", 2, digits).alias("in_full_delivery_pct"),
            _r("otif", 2, digits).alias("composite_otif_pct"),
            _r("delay", 2, digits).alias("avg_delay_days"),
            _r("value", 2, digits).alias("total_procurement_value"),
        )
        .orderBy(F.desc_nulls_last("composite_otif_pct"))
    )


def _by_category(fact_inventory: DataFrame, dim_product: DataFrame) -> DataFrame:
    per_product = fact_inventory.groupBy("product_id").agg(
        F.sum("demand_requested").alias("requested"),
        F.sum("demand_fulfilled").alias("fulfilled"),
        F.sum("lost_sales_quantity").alias("lost"),
        F.sum("stockout_flag").alias("out_days"),
        F.count(F.lit(1)).alias("n"),
        F.sum("ending_inventory").alias("stock"),
        F.sum("holding_cost").alias("holding"),
        F.sum("stockout_cost").alias("penalty"),
    )
    sums = [F.sum(c).alias(c) for c in per_product.columns if c != "product_id"]
    return (
        per_product.join(dim_product.select("product_id", "category"), "product_id")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("sku_count"), *sums)
    )


def service_level_by_category(fact_inventory: DataFrame, dim_product: DataFrame, digits: bool = True) -> DataFrame:
    return (
        _by_category(fact_inventory, dim_product)
        .select(
            "category",
            "sku_count",
            F.col("requested").alias("total_demand_requested"),
            F.col("fulfilled").alias("total_demand_fulfilled"),
            F.col("lost").alias("total_lost_sales_units"),
            _r(pct("fulfilled", "requested"), 2, digits).alias("service_level_pct"),
            F.col("out_days").alias("stockout_days_count"),
            F.col("n").alias("total_sku_wh_days"),
            _r(pct("out_days", "n"), 2, digits).alias("stockout_frequency_pct"),
            _r("penalty", 2, digits).alias("total_stockout_penalty_cost"),
        )
        .orderBy("service_level_pct")
    )


def category_performance(fact_inventory: DataFrame, dim_product: DataFrame, digits: bool = True) -> DataFrame:
    return (
        _by_category(fact_inventory, dim_product)
        .select(
            "category",
            "sku_count",
            F.col("requested").alias("total_demand_requested"),
            F.col("fulfilled").alias("total_demand_fulfilled"),
            F.col("lost").alias("total_lost_sales_units"),
            _r(pct("fulfilled", "requested"), 2, digits).alias("service_level_pct"),
            F.col("out_days").alias("stockout_sku_days"),
            _r(pct("out_days", "n"), 2, digits).alias("stockout_frequency_pct"),
            _r(F.col("stock") / F.col("n"), 1, digits).alias("avg_inventory_units"),
            _r("holding", 2, digits).alias("total_holding_cost"),
            _r("penalty", 2, digits).alias("total_stockout_cost"),
        )
        .orderBy(F.desc("total_demand_requested"))
    )


def warehouse_cost_breakdown(
    fact_inventory: DataFrame, fact_purchase_orders: DataFrame, dim_warehouse: DataFrame, digits: bool = True
) -> DataFrame:
    stock = fact_inventory.groupBy("warehouse_id").agg(
        _r(F.sum("holding_cost"), 2, digits).alias("holding_cost"),
        _r(F.sum("stockout_cost"), 2, digits).alias("stockout_cost"),
    )
    orders = fact_purchase_orders.groupBy("warehouse_id").agg(
        _r(F.sum("total_procurement_cost"), 2, digits).alias("procurement_cost"),
        _r(F.sum("transport_cost"), 2, digits).alias("transport_cost"),
    )
    parts = ("procurement_cost", "holding_cost", "stockout_cost", "transport_cost")
    return (
        dim_warehouse.select("warehouse_id", "warehouse_name", "capacity_units")
        .join(stock, "warehouse_id", "left")
        .join(orders, "warehouse_id", "left")
        .select(
            "warehouse_id",
            "warehouse_name",
            "capacity_units",
            *[F.coalesce(c, F.lit(0.0)).alias(c) for c in parts],
            _r(kpis.total_operational_cost(), 2, digits).alias("total_operational_cost"),
        )
        .orderBy(F.desc("total_operational_cost"))
    )


def executive_kpis(
    cost_summary: DataFrame,
    daily_demand: DataFrame,
    fact_inventory: DataFrame,
    supplier_performance: DataFrame,
    dims: dict[str, DataFrame],
    days: int | None = None,
) -> DataFrame:
    """One row of four nested groups: entity counts, financials, operations, procurement.

    Every part is a one-row aggregate read through a scalar subquery, so the
    parts run side by side and nothing is joined.
    """
    money = ("procurement_cost", "holding_cost", "stockout_cost", "transport_cost", "total_operational_cost")
    costs = cost_summary.agg(
        F.struct(
            *[
                maybe_half_up(F.sum(c), 2).alias(c if c.startswith("total_") else f"total_{c}")
                for c in money
            ]
        )
    ).scalar()
    n_days = F.countDistinct("date") if days is None else F.lit(days)
    stock = fact_inventory.agg(
        F.sum("demand_requested").alias("requested"),
        F.sum("demand_fulfilled").alias("fulfilled"),
        F.sum("lost_sales_quantity").alias("lost"),
        F.count(F.lit(1)).alias("n"),
        F.sum("stockout_flag").alias("out_days"),
        F.sum("ending_inventory").alias("stock"),
        n_days.cast("double").alias("days"),
    )
    commercial = daily_demand.agg(F.sum("demand_requested")).scalar()
    turnover = ratio("fulfilled", F.col("stock") / F.col("days")) * (F.lit(365.25) / F.col("days"))
    operations = F.struct(
        F.coalesce(commercial, F.lit(0)).alias("total_commercial_demand_requested"),
        F.col("requested").alias("total_warehouse_demand_requested"),
        F.col("requested").alias("total_demand_requested"),
        F.col("fulfilled").alias("total_demand_fulfilled"),
        F.col("lost").alias("total_lost_sales_units"),
        maybe_half_up(pct("fulfilled", "requested"), 2).alias("service_level_pct"),
        maybe_half_up(pct("out_days", "n"), 2).alias("stockout_frequency_pct"),
        F.col("n").alias("total_sku_warehouse_days"),
        F.col("out_days").alias("stockout_sku_warehouse_days"),
        F.coalesce(maybe_half_up(turnover, 2), F.lit(0.0)).alias("annualized_inventory_turnover"),
    )
    procurement = supplier_performance.agg(
        F.struct(
            F.sum("total_orders").alias("total_purchase_orders"),
            F.sum("units_ordered").alias("total_units_ordered"),
            F.sum("units_received").alias("total_units_received"),
            maybe_half_up(mean_of_rounded("otif_rate_pct"), 2).alias("supplier_otif_pct"),
            maybe_half_up(mean_of_rounded("avg_delay_days"), 2).alias("supplier_avg_delay_days"),
        )
    ).scalar()
    entities = F.struct(
        *[df.agg(F.count(F.lit(1))).scalar().alias(name) for name, df in dims.items()]
    )
    return stock.select(
        entities.alias("entity_counts"),
        costs.alias("financials"),
        operations.alias("operations"),
        procurement.alias("procurement"),
    )


def monthly_cost(cost_summary: DataFrame, warehouse_id: str | None = None, digits: bool = True) -> DataFrame:
    """Cost components per month, of one warehouse or of the network."""
    money = ("procurement_cost", "holding_cost", "stockout_cost", "transport_cost", "total_operational_cost")
    if warehouse_id is not None:
        return (
            scan_equal(cost_summary, warehouse_id=warehouse_id)
            .select("year_month", "warehouse_id", "warehouse_name", *money)
            .orderBy("year_month")
        )
    return (
        cost_summary.groupBy("year_month")
        .agg(*[_r(F.sum(c), 2, digits).alias(c) for c in money])
        .orderBy("year_month")
    )


def supplier_scorecard(
    supplier_performance: DataFrame,
    fact_purchase_orders: DataFrame,
    dim_supplier: DataFrame,
    supplier_id: str | None = None,
    digits: bool = True,
) -> DataFrame:
    """Unweighted means of the monthly rates, plus exact delay percentiles."""
    monthly = scan_equal(supplier_performance, supplier_id=supplier_id).groupBy("supplier_id").agg(
        F.sum("total_orders").alias("total_orders"),
        F.sum("units_ordered").alias("units_ordered"),
        F.sum("units_received").alias("units_received"),
        *[
            _r(mean_of_rounded(c) if digits else F.avg(c), 2, digits).alias(c)
            for c in ("on_time_rate_pct", "in_full_rate_pct", "otif_rate_pct", "avg_delay_days")
        ],
        _r(F.sum("total_procurement_cost"), 2, digits).alias("total_spend"),
        _r(F.sum("total_freight_cost"), 2, digits).alias("total_freight_cost"),
    )
    delays = delay_percentiles(scan_equal(fact_purchase_orders, supplier_id=supplier_id))
    return (
        scan_equal(dim_supplier, supplier_id=supplier_id)
        .join(monthly, "supplier_id", "left")
        .join(delays, "supplier_id", "left")
        .select(
            "supplier_id",
            "supplier_name",
            "tier",
            F.col("baseline_lead_time_days").alias("contractual_lead_time_days"),
            "baseline_reliability",
            *[c for c in monthly.columns if c != "supplier_id"],
            "median_delay_days",
            "p90_delay_days",
        )
        .orderBy(F.desc_nulls_last("total_spend"))
    )


def delay_percentiles(fact_purchase_orders: DataFrame) -> DataFrame:
    """Median and p90 delay per supplier from a (supplier, delay) histogram.

    Counting equal delays first shrinks a supplier with billions of orders to
    one row per distinct delay before any group is gathered.
    """
    counts = fact_purchase_orders.groupBy("supplier_id", "delay_days").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("supplier_id").agg(
        F.percentile("delay_days", F.lit(0.5), F.col("n")).alias("median_delay_days"),
        F.percentile("delay_days", F.lit(0.9), F.col("n")).alias("p90_delay_days"),
    )


def warehouse_capacity(warehouse_operations: DataFrame, digits: bool = True) -> DataFrame:
    return (
        warehouse_operations.groupBy("warehouse_id", "warehouse_name", "capacity_units")
        .agg(
            _r(F.avg("ending_inventory"), 1, digits).alias("avg_ending_inventory"),
            F.max("ending_inventory").alias("peak_ending_inventory"),
            _r(mean_of_rounded("capacity_utilization_pct") if digits else F.avg("capacity_utilization_pct"), 2, digits).alias("avg_capacity_utilization_pct"),
            _r(F.max("capacity_utilization_pct"), 2, digits).alias("peak_capacity_utilization_pct"),
            F.sum("demand_requested").alias("total_demand_requested"),
            F.sum("demand_fulfilled").alias("total_demand_fulfilled"),
            F.sum("lost_sales_units").alias("total_lost_sales_units"),
            F.sum("stockout_skus_count").alias("total_stockout_events"),
            _r(F.sum("holding_cost"), 2, digits).alias("total_holding_cost"),
            _r(F.sum("stockout_cost"), 2, digits).alias("total_stockout_cost"),
        )
        .orderBy("warehouse_id")
    )


def demand_volatility_hhi(
    daily_demand: DataFrame, fact_demand: DataFrame, dim_product: DataFrame, digits: bool = True
) -> DataFrame:
    """Coefficient of variation of daily demand and market concentration per product."""
    x = F.col("demand_requested")
    stats = daily_demand.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2")
    )
    mean = _r(F.col("s1") / F.col("n"), 2, digits)
    spread = _r(std_from_sums(F.col("n"), F.col("s1"), F.col("s2"), ddof=0), 2, digits)
    concentration = market_hhi(fact_demand, digits)
    return (
        stats.join(dim_product.select("product_id", "product_name", "category"), "product_id")
        .join(concentration, "product_id", "left")
        .withColumn("mean_daily_demand", mean)
        .withColumn("std_daily_demand", spread)
        .select(
            "product_id",
            "product_name",
            "category",
            "mean_daily_demand",
            "std_daily_demand",
            F.col("s1").alias("total_product_demand"),
            _r(F.coalesce(ratio("std_daily_demand", "mean_daily_demand"), F.lit(0.0)), 3, digits).alias("demand_cv"),
            "market_hhi",
        )
        .orderBy(F.desc("total_product_demand"))
    )


def hhi(fact: DataFrame, key: str, member: str, units: str, out: str, digits: int | None = 1) -> DataFrame:
    """Sum of squared percentage shares of the members of each key.

    Uses sum(q^2) / (sum q)^2, so no per-row share and no window is needed.
    """
    per_member = fact.groupBy(key, member).agg(F.sum(units).cast("double").alias("q"))
    return per_member.groupBy(key).agg(
        F.coalesce(
            maybe_half_up(
                ratio(F.sum(F.col("q") * F.col("q")) * 10000.0, F.sum("q") * F.sum("q")), digits
            ),
            F.lit(0.0),
        ).alias(out)
    )


def market_hhi(fact_demand: DataFrame, digits: bool = True) -> DataFrame:
    return hhi(fact_demand, "product_id", "market_id", "demand_requested", "market_hhi", 1 if digits else None)


# Stockout duration brackets.
BRACKETS = ("1 Day (Transient)", "2 Days (Short)", "3-5 Days (Moderate)", "6+ Days (Severe/Disrupted)")


def stockout_durations(fact_inventory: DataFrame, digits: bool = True) -> DataFrame:
    """Distribution of the lengths of consecutive stockout days."""
    runs = series.episodes(fact_inventory, "stockout_flag")
    days = F.col("streak_days")
    bracket = (
        F.when(days == 1, BRACKETS[0]).when(days == 2, BRACKETS[1]).when(days <= 5, BRACKETS[2]).otherwise(BRACKETS[3])
    )
    grouped = runs.groupBy(bracket.alias("duration_bracket")).agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.sum("streak_days").alias("total_stockout_days"),
        _r(F.avg("streak_days"), 2, digits).alias("avg_streak_days"),
        F.max("streak_days").alias("max_streak_days"),
    )
    # At most four rows are left here, so the total may use an unkeyed window.
    share = series.group_share("episode_count", [F.lit(1)]) * 100.0
    return grouped.withColumn("pct_of_episodes", _r(share, 2, digits)).orderBy(F.desc("total_stockout_days"))
