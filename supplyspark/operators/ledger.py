"""Dense series grids, the zero-floored stock ledger and stock policy levels.

Every window here is keyed by (product, warehouse) over a table with one row
per day, so the largest window group is the length of the calendar no matter
how many order lines a popular product has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyspark.functions.exprs import pct, std_from_sums

SERIES = ["product_id", "warehouse_id"]

# Fixed value: normal quantile of a 95 % service target.
SERVICE_Z = 1.645


def series_window(order: str = "date"):
    return Window.partitionBy(*SERIES).orderBy(order)


def series_parts(df: DataFrame) -> int:
    """Partitions for tables hashed by series.

    Given explicitly, because adaptive execution would size these exchanges by
    the few pairs that cross them and merge them into one task, before each
    pair is unrolled to a whole calendar.
    """
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def series_pairs(products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Every product with every warehouse, hashed by the series key.

    The warehouse list is one array value read by a scalar subquery, so product
    rows stay where they are and are unrolled in place: no nested-loop join.
    """
    warehouse_list = warehouses.agg(F.sort_array(F.collect_set("warehouse_id"))).scalar()
    return (
        products.select("product_id")
        .withColumn("warehouse_id", F.explode(warehouse_list))
        .repartition(series_parts(products), *SERIES)
    )


def dense_grid(products: DataFrame, warehouses: DataFrame, dates: DataFrame) -> DataFrame:
    """One row per product, warehouse and calendar day.

    Days are unrolled after the pairs are hashed, so the (large) grid itself is
    never shuffled. Sparse facts hashed the same way merge into it in place.
    """
    span = F.struct(F.min("date").alias("first_day"), F.max("date").alias("last_day"))
    bounds = dates.agg(span).scalar()
    return series_pairs(products, warehouses).withColumn(
        "date", F.explode(F.sequence(bounds["first_day"], bounds["last_day"]))
    )


def align_to_grid(grid: DataFrame, sparse: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Put a one-row-per-(series, day) table on the grid, filling gaps.

    Grid rows and sparse rows are stacked and merged by key instead of joined.
    Both sides are hashed by series, the stack keeps that, and grouping by
    (series, day) is satisfied by it: only the sparse rows are ever shuffled,
    and series windows that follow need no shuffle either.
    """
    types = dict(sparse.dtypes)
    blank = grid.select(*SERIES, "date", *[F.lit(None).cast(types[c]).alias(c) for c in defaults])
    keyed = sparse.select(*SERIES, "date", *defaults).repartition(series_parts(sparse), *SERIES)
    on_grid = blank.withColumn("_grid", F.lit(1)).unionByName(keyed.withColumn("_grid", F.lit(0)))
    merged = on_grid.groupBy(*SERIES, "date").agg(
        *[F.max(c).alias(c) for c in defaults], F.max("_grid").alias("_grid")
    )
    return merged.filter(F.col("_grid") == 1).select(
        *SERIES, "date", *[F.coalesce(F.col(c), F.lit(v).cast(types[c])).alias(c) for c, v in defaults.items()]
    )


def dense_flows(
    products: DataFrame, warehouses: DataFrame, dates: DataFrame, demand: DataFrame, receipts: DataFrame
) -> DataFrame:
    """Daily demand and receipts on the dense grid.

    Both sparse tables are put in one shape and summed together before they
    meet the grid, which leaves a single join.
    """
    zero = F.lit(0).cast("long")
    flows = (
        demand.select(*SERIES, "date", "demand_requested", zero.alias("po_received"))
        .unionByName(receipts.select(*SERIES, "date", zero.alias("demand_requested"), "po_received"))
        .groupBy(*SERIES, "date")
        .agg(F.sum("demand_requested").alias("demand_requested"), F.sum("po_received").alias("po_received"))
    )
    grid = dense_grid(products, warehouses, dates)
    return align_to_grid(grid, flows, {"demand_requested": 0, "po_received": 0})


def floored_ledger(flows: DataFrame, initial_stock: int, backorder_tenths: int = 3) -> DataFrame:
    """Stock ledger whose balance never goes below zero.

    With the free balance ``S_t = I0 + sum(receipts - demand)``, the stock that
    had to be conjured up until t is ``C_t = max(0, -min(S_1..S_t))``; ending
    stock is ``S_t + C_t`` and the unmet units of day t are ``C_t - C_(t-1)``.
    Two running windows over the same sort order, no loop.
    Of the unmet units ``backorder_tenths`` tenths are noted as backorder of the
    day, the rest is lost.
    """
    w = series_window()
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = flows.withColumn(
        "free_balance", F.lit(initial_stock).cast("long") + F.sum(F.col("po_received") - F.col("demand_requested")).over(so_far)
    )
    out = out.withColumn("conjured", F.greatest(F.lit(0).cast("long"), -F.min("free_balance").over(so_far)))
    out = out.withColumn("ending_inventory", F.col("free_balance") + F.col("conjured"))
    out = out.withColumn("stockout_quantity", F.col("conjured") - F.coalesce(F.lag("conjured").over(w), F.lit(0)))
    out = out.withColumn(
        "beginning_inventory", F.coalesce(F.lag("ending_inventory").over(w), F.lit(initial_stock).cast("long"))
    )
    backorder = F.floor(F.col("stockout_quantity") * backorder_tenths / 10.0)
    return (
        out.withColumn("ending_backorder", backorder)
        .withColumn("new_backorder", F.col("ending_backorder"))
        .withColumn("opening_backorder", F.lit(0).cast("long"))
        .withColumn("backorder_fulfilled", F.lit(0).cast("long"))
        .withColumn("lost_sales_quantity", F.col("stockout_quantity") - F.col("ending_backorder"))
        .withColumn("demand_fulfilled", F.col("demand_requested") - F.col("stockout_quantity"))
        .withColumn("stockout_flag", (F.col("stockout_quantity") > 0).cast("int"))
        .drop("free_balance", "conjured")
    )


def _policy_levels(n: Column, total: Column, squares: Column, z: float) -> dict[str, Column]:
    mean = F.greatest(F.lit(1.0), total / n)
    spread = F.greatest(F.lit(1.0), std_from_sums(n, total, squares, ddof=0))
    lead = F.col("baseline_lead_time_days").cast("double")
    safety = F.ceil(z * spread * F.sqrt(lead))
    reorder = F.ceil(mean * lead + safety)
    return {
        "mean_demand": mean,
        "safety_stock": safety,
        "reorder_point": reorder,
        "order_up_to": reorder + F.greatest(F.col("moq_units").cast("long"), F.ceil(14 * mean)),
    }


def stock_policy(flows: DataFrame, product_terms: DataFrame, z: float = SERVICE_Z) -> DataFrame:
    """Safety stock, reorder point and order-up-to level per series.

    ``product_terms`` holds product_id, baseline_lead_time_days and moq_units.
    """
    x = F.col("demand_requested")
    stats = flows.groupBy(*SERIES).agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s1"), F.sum(x * x).alias("s2")
    )
    levels = _policy_levels(F.col("n"), F.col("s1"), F.col("s2"), z)
    return stats.join(product_terms, "product_id").select(*SERIES, *[c.alias(k) for k, c in levels.items()])


def with_safety_stock(flows: DataFrame, product_terms: DataFrame, z: float = SERVICE_Z) -> DataFrame:
    """The same level as a column on every day of the series.

    The series are already hashed by (product, warehouse), so a whole-series
    window needs neither a second pass over the flows nor a shuffle.
    """
    whole = Window.partitionBy(*SERIES)
    x = F.col("demand_requested")
    joined = flows.join(product_terms, "product_id")
    levels = _policy_levels(
        F.count(F.lit(1)).over(whole), F.sum(x).over(whole), F.sum(x * x).over(whole), z
    )
    return joined.withColumn("safety_stock_target", levels["safety_stock"]).select(
        *flows.columns, "safety_stock_target"
    )


def with_warehouse_load(ledger: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Attach the stock total and utilisation of the warehouse on that day.

    Aggregated per (warehouse, day) first and joined back, so a warehouse with
    very many products is summed in parallel instead of in one window group.
    """
    load = ledger.groupBy("warehouse_id", "date").agg(F.sum("ending_inventory").alias("total_warehouse_inventory"))
    capacity = warehouses.select("warehouse_id", F.col("capacity_units").alias("warehouse_capacity"))
    return (
        ledger.join(capacity, "warehouse_id")
        .join(load, ["warehouse_id", "date"], "left")
        .withColumn("capacity_utilization_pct", pct("total_warehouse_inventory", "warehouse_capacity"))
    )


def balance_error(ledger: DataFrame) -> Column:
    """Aggregate: largest violation of begin + received - fulfilled = ending."""
    gap = F.col("beginning_inventory") + F.col("po_received") - F.col("demand_fulfilled") - F.col("ending_inventory")
    return F.max(F.abs(gap))
