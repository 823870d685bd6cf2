"""Replenishment policies, what-if scenarios, plan costing and plan audit.

A position is a (product, warehouse) on the decision day with
``forecast_demand_7d, ending_inventory_lag1, safety_stock_target,
stockout_probability_7d, supplier_delay_probability, criticality``. All
scenarios are rows of one job: each position is unrolled once per scenario and
``scenario_name`` is part of every key afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplyspark.functions import costs
from supplyspark.functions.exprs import clip, half_even
from supplyspark.sources.io import literal_rows

# The six standard scenarios.
SCENARIO_SCHEMA = (
    "scenario_id string, scenario_name string, display_name string, description string, "
    "demand_multiplier_general double, demand_multiplier_critical double, delay_probability_shift double, "
    "freight_multiplier double, supplier_capacity_multiplier double, initial_inventory_multiplier double, "
    "service_level_target double"
)
SCENARIOS = (
    ("SCEN-01", "baseline", "1. Baseline Standard Operations",
     "Certified forward demand forecasts, standard vendor capacities, and nominal freight costs.",
     1.0, 1.0, 0.0, 1.0, 1.0, 1.0, 0.95),
    ("SCEN-02", "demand_surge", "2. Demand Surge Shock",
     "Unplanned demand spike of +20% network-wide, rising to +35% for critical components.",
     1.20, 1.35, 0.05, 1.10, 1.0, 1.0, 0.95),
    ("SCEN-03", "supplier_delay_shock", "3. Supplier Delay & Disruption",
     "Tier-2 economy vendors suffer acute delivery delays (+0.35 delay prob) and 25% capacity contraction.",
     1.0, 1.0, 0.35, 1.05, 0.75, 1.0, 0.95),
    ("SCEN-04", "transport_bottleneck", "4. Transport Capacity Bottleneck",
     "Fuel surcharges and carrier driver shortages trigger a +50% freight rate spike across regional lanes.",
     1.0, 1.0, 0.10, 1.50, 1.0, 1.0, 0.95),
    ("SCEN-05", "inventory_constraint", "5. Constrained Buffer Depletion",
     "Prior operational shortages leave initial on-hand stock depleted by 30% across all hubs.",
     1.0, 1.0, 0.0, 1.0, 1.0, 0.70, 0.95),
    ("SCEN-06", "combined_stress", "6. Combined Multi-Vector Stress",
     "Simultaneous demand surge (+15%), vendor capacity crunch (-30%), and carrier freight inflation (+40%).",
     1.15, 1.25, 0.25, 1.40, 0.70, 0.85, 0.95),
)
DEFAULT_STOCKOUT_PROBABILITY = 0.10
DEFAULT_DELAY_PROBABILITY = 0.15
MAX_SUPPLIER_SHARE = 0.60
SERVICE_TARGET = 0.95
BINDING = 1e-4

PARAMETERS = tuple(p.split(" ")[0] for p in SCENARIO_SCHEMA.split(", "))[4:]
POSITION_KEY = ["scenario_name", "product_id", "warehouse_id"]


def standard_scenarios(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, SCENARIOS, SCENARIO_SCHEMA)


def sweep_scenarios(
    spark: SparkSession,
    freight: Sequence[float] = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0),
    caps: Sequence[float] = (0.50, 0.55, 0.60, 0.70, 0.85, 1.00),
    service: Sequence[float] = (0.90, 0.92, 0.95, 0.98, 0.99),
) -> DataFrame:
    """Parameter table of the three sensitivity sweeps: one scenario per value."""
    rows = [("freight", v, 1.0 * v, MAX_SUPPLIER_SHARE, SERVICE_TARGET) for v in freight]
    rows += [("sourcing_cap", v, 1.0, v, SERVICE_TARGET) for v in caps]
    rows += [("service_level", v, 1.0, MAX_SUPPLIER_SHARE, v) for v in service]
    named = [(f"sweep_{kind}_{v:.2f}", kind, v, f, c, s) for kind, v, f, c, s in rows]
    params = literal_rows(
        spark,
        named,
        "scenario_name string, sweep string, sweep_value double, freight_multiplier double, "
        "max_supplier_share double, service_level_target double",
    )
    neutral = {p: F.lit(1.0) for p in PARAMETERS if p not in ("freight_multiplier", "service_level_target")}
    return params.withColumns(neutral | {"delay_probability_shift": F.lit(0.0)})


def unroll_scenarios(positions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each position once per scenario, with the scenario parameters as columns.

    The scenario list is one small array read by a scalar subquery, so the
    positions are not moved to be multiplied.
    """
    params = [c for c in scenarios.columns if c not in ("scenario_id", "display_name", "description")]
    table = scenarios.agg(F.sort_array(F.collect_list(F.struct(*params)))).scalar()
    return positions.withColumn("_s", F.explode(table)).select(*positions.columns, "_s.*")


def apply_scenarios(positions: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenario effects on demand, stock and delay risk.

    ``max_supplier_share`` falls back to the standard ceiling when the scenario
    table does not set it.
    """
    out = unroll_scenarios(positions, scenarios)
    critical = F.lower("criticality").isin("critical", "high")
    factor = F.when(critical, F.col("demand_multiplier_critical")).otherwise(F.col("demand_multiplier_general"))
    delay = F.coalesce("supplier_delay_probability", F.lit(DEFAULT_DELAY_PROBABILITY))
    if "max_supplier_share" not in out.columns:
        out = out.withColumn("max_supplier_share", F.lit(MAX_SUPPLIER_SHARE))
    return out.withColumns(
        {
            "demand": F.coalesce(F.col("forecast_demand_7d").cast("double"), F.lit(0.0)) * factor,
            "stock": F.coalesce(F.col("ending_inventory_lag1").cast("double"), F.lit(0.0))
            * F.col("initial_inventory_multiplier"),
            "safety_stock": F.coalesce(F.col("safety_stock_target").cast("double"), F.lit(0.0)),
            "p_stockout": F.coalesce("stockout_probability_7d", F.lit(DEFAULT_STOCKOUT_PROBABILITY)),
            "p_delay": F.when(F.col("delay_probability_shift") == 0, delay).otherwise(
                clip(delay + F.col("delay_probability_shift"), 0.0, 1.0)
            ),
            "freight_rate": F.lit(costs.BASE_FREIGHT_RATE) * F.col("freight_multiplier"),
        }
    )


# ----------------------------------------------------------- dimension lookups
def with_products(df: DataFrame, dim_product: DataFrame) -> DataFrame:
    return df.join(
        dim_product.select("product_id", "unit_cost", "selling_price", "primary_supplier_id", "secondary_supplier_id"),
        "product_id",
    )


def supplier_terms(dim_supplier: DataFrame, prefix: str = "") -> DataFrame:
    return dim_supplier.select(
        F.col("supplier_id").alias(f"{prefix}supplier_id"),
        F.col("transport_cost_factor").alias(f"{prefix}supplier_factor"),
        F.col("baseline_lead_time_days").alias(f"{prefix}lead_time"),
        F.col("monthly_capacity_units").alias(f"{prefix}monthly_capacity"),
    )


def warehouse_terms(dim_warehouse: DataFrame) -> DataFrame:
    return dim_warehouse.select("warehouse_id", F.col("transport_cost_factor").alias("warehouse_factor"))


def ration(orders: DataFrame, quantity: str = "requested") -> DataFrame:
    """Scale every supplier's orders down to its weekly capacity.

    Totals are aggregated and joined back rather than summed in a window: one
    supplier may serve most positions.
    """
    totals = orders.groupBy("scenario_name", "supplier_id").agg(F.sum(quantity).alias("_asked"))
    weekly = F.col("monthly_capacity") * F.col("supplier_capacity_multiplier") / costs.WEEKS_PER_MONTH
    scale = F.when((F.col("_asked") > weekly) & (F.col("_asked") > 0), weekly / F.nullif(F.col("_asked"), F.lit(0.0)))
    joined = orders.join(totals, ["scenario_name", "supplier_id"])
    return joined.withColumn("order_quantity", F.col(quantity) * F.coalesce(scale, F.lit(1.0))).drop("_asked")


def order_costs(df: DataFrame, is_primary: Column) -> DataFrame:
    q = F.col("order_quantity")
    return df.withColumns(
        {
            "procurement_cost": q * costs.procurement_unit_cost("unit_cost", is_primary),
            "transport_cost": q * costs.freight_unit_cost("supplier_factor", "warehouse_factor", F.col("freight_rate")),
            "risk_cost": q * costs.delay_unit_cost("p_delay", "lead_time"),
        }
    )


def flow_columns(supply: Column, demand: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    fulfilled = F.least(demand, supply)
    return {
        "fulfilled_quantity": fulfilled,
        "shortage_quantity": F.greatest(zero, demand - supply),
        "ending_inventory": F.greatest(zero, supply - demand),
        "fill_rate": F.when(demand > 0, fulfilled / F.nullif(demand, zero)).otherwise(1.0),
    }


def flow_costs() -> dict[str, Column]:
    return {
        "shortage_cost": F.col("shortage_quantity") * costs.shortage_unit_cost("selling_price", "p_stockout"),
        "holding_cost": F.col("ending_inventory") * costs.holding_unit_cost("unit_cost"),
    }


# ------------------------------------------------------------- baseline policy
def baseline_plan(
    positions: DataFrame, dim_product: DataFrame, dim_supplier: DataFrame, dim_warehouse: DataFrame
) -> DataFrame:
    """Order-up-to policy: primary supplier only, rationed, no transfers.

    ``positions`` come from ``apply_scenarios``. One row per scenario and
    position with order, flow and cost columns.
    """
    fallback = dim_supplier.agg(F.min("supplier_id")).scalar()
    known = dim_supplier.select(F.col("supplier_id").alias("primary_supplier_id"), F.lit(True).alias("_known"))
    base = (
        with_products(positions, dim_product)
        .join(known, "primary_supplier_id", "left")
        .withColumn("supplier_id", F.when(F.col("_known"), F.col("primary_supplier_id")).otherwise(fallback))
        .drop("_known")
        .join(supplier_terms(dim_supplier), "supplier_id")
        .join(warehouse_terms(dim_warehouse), "warehouse_id")
        .withColumn("requested", F.greatest(F.lit(0.0), F.col("demand") + F.col("safety_stock") - F.col("stock")))
    )
    ordered = order_costs(ration(base), F.lit(True))
    flowed = ordered.withColumns(flow_columns(F.col("stock") + F.col("order_quantity"), F.col("demand")))
    return flowed.withColumns(flow_costs()).withColumn("transshipment_cost", F.lit(0.0))


COST_PARTS = (
    "procurement_cost",
    "transport_cost",
    "transshipment_cost",
    "holding_cost",
    "shortage_cost",
    "supplier_risk_cost",
)


def baseline_totals(plan: DataFrame, digits: int | None = 2) -> DataFrame:
    return plan_totals(
        plan.groupBy("scenario_name").agg(
            *[F.sum(c).alias(c) for c in COST_PARTS if c != "supplier_risk_cost"],
            F.sum("risk_cost").alias("supplier_risk_cost"),
            F.sum("demand").alias("total_demand"),
            F.sum("fulfilled_quantity").alias("total_fulfilled"),
            F.sum("shortage_quantity").alias("total_shortage"),
            F.sum("order_quantity").alias("total_ordered"),
        ).withColumn("total_transferred", F.lit(0.0)),
        digits,
    )


def plan_totals(sums: DataFrame, digits: int | None = 2) -> DataFrame:
    landed = reduce(lambda a, b: a + b, [F.col(c) for c in COST_PARTS])
    service = F.when(
        F.col("total_demand") > 0, F.col("total_fulfilled") / F.nullif(F.col("total_demand"), F.lit(0.0))
    ).otherwise(1.0)
    r = (lambda c: c) if digits is None else (lambda c: half_even(c, digits))
    units = ("total_demand", "total_fulfilled", "total_shortage", "total_ordered", "total_transferred")
    return sums.select(
        "scenario_name",
        *[r(F.col(c)).alias(c) for c in COST_PARTS],
        r(landed).alias("total_landed_cost"),
        *[r(F.col(c)).alias(c) for c in units],
        half_even(service, 4).alias("service_level"),
    )


# ------------------------------------------------------------------------ lanes
def order_lanes(dim_product: DataFrame, dim_supplier: DataFrame, dim_warehouse: DataFrame) -> DataFrame:
    """Product x (primary, secondary) supplier x warehouse with neutral unit cost.

    The delay penalty depends on the position and is added where lanes meet
    positions.
    """
    places = dim_warehouse.agg(
        F.sort_array(F.collect_list(F.struct("warehouse_id", F.col("transport_cost_factor").alias("warehouse_factor"))))
    ).scalar()
    both = F.array_distinct(F.array_compact(F.array("primary_supplier_id", "secondary_supplier_id")))
    lanes = (
        dim_product.withColumn("supplier_id", F.explode(both))
        .withColumn("_w", F.explode(places))
        .select(
            "product_id",
            "supplier_id",
            "_w.*",
            "unit_cost",
            (F.col("supplier_id") == F.col("primary_supplier_id")).alias("is_primary"),
        )
    )
    terms = supplier_terms(dim_supplier).select("supplier_id", "supplier_factor", "lead_time")
    return lanes.join(terms, "supplier_id").select(
        "product_id",
        "supplier_id",
        "warehouse_id",
        "is_primary",
        "lead_time",
        costs.procurement_unit_cost("unit_cost", F.col("is_primary")).alias("procurement_unit_cost"),
        costs.freight_unit_cost("supplier_factor", "warehouse_factor").alias("freight_unit_cost"),
    )


def transfer_lanes(dim_product: DataFrame, dim_warehouse: DataFrame) -> DataFrame:
    """Product x origin x destination (distinct warehouses) with unit cost."""
    item = F.struct("warehouse_id", "handling_cost_per_unit", "transport_cost_factor")
    places = dim_warehouse.agg(F.sort_array(F.collect_list(item))).scalar()
    pairs = (
        dim_product.select("product_id")
        .withColumn("o", F.explode(places))
        .withColumn("d", F.explode(places))
        .filter(F.col("o.warehouse_id") != F.col("d.warehouse_id"))
    )
    return pairs.select(
        "product_id",
        F.col("o.warehouse_id").alias("origin_warehouse"),
        F.col("d.warehouse_id").alias("dest_warehouse"),
        costs.transfer_unit_cost(
            F.col("o.handling_cost_per_unit"), F.col("o.transport_cost_factor"), F.col("d.transport_cost_factor")
        ).alias("unit_transfer_cost"),
    )


# ------------------------------------------------------- coordinated plan, step 1
def lateral_transfers(positions: DataFrame, dim_warehouse: DataFrame) -> DataFrame:
    """Match surplus to deficit of the same product across warehouses.

    Surpluses (cheapest origin first) and deficits (by warehouse) are each laid
    end to end on a line from 0. The union of all interval ends cuts the line
    into pieces; a piece that lies on both lines is a transfer. Origin and
    destination of a piece are the next end of either kind, so one sort per
    product replaces a join of every surplus with every deficit, and at most
    (surpluses + deficits) rows come out.
    """
    terms = dim_warehouse.select("warehouse_id", "handling_cost_per_unit", F.col("transport_cost_factor").alias("factor"))
    base = positions.join(terms, "warehouse_id").withColumns(
        {
            "surplus": F.greatest(F.lit(0.0), F.col("stock") - F.col("demand")),
            "deficit": F.greatest(F.lit(0.0), F.col("demand") - F.col("stock")),
        }
    )
    group = Window.partitionBy("scenario_name", "product_id")
    running = (Window.unboundedPreceding, Window.currentRow)
    leaving = F.col("handling_cost_per_unit") + F.col("freight_rate") * F.col("factor") / 2.0
    placed = base.withColumns(
        {
            "_s_end": F.sum("surplus").over(group.orderBy(leaving, "warehouse_id").rowsBetween(*running)),
            "_d_end": F.sum("deficit").over(group.orderBy("warehouse_id").rowsBetween(*running)),
        }
    )
    side = F.struct("warehouse_id", "handling_cost_per_unit", "factor")
    nothing = F.lit(None).cast("struct<warehouse_id:string,handling_cost_per_unit:double,factor:double>")
    ends = F.array(
        F.struct(F.col("_s_end").alias("end"), F.col("surplus").alias("units"), side.alias("o"), nothing.alias("d")),
        F.struct(F.col("_d_end").alias("end"), F.col("deficit").alias("units"), nothing.alias("o"), side.alias("d")),
    )
    line = (
        placed.select("scenario_name", "product_id", "freight_rate", F.explode(ends).alias("e"))
        .filter(F.col("e.units") > 0)
        .select("scenario_name", "product_id", "freight_rate", "e.end", "e.o", "e.d")
    )
    order = group.orderBy("end", F.col("o").isNull(), F.coalesce(F.col("o.warehouse_id"), F.col("d.warehouse_id")))
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    pieces = line.withColumns(
        {
            "origin": F.first("o", ignorenulls=True).over(onward),
            "dest": F.first("d", ignorenulls=True).over(onward),
            "start": F.coalesce(F.lag("end").over(order), F.lit(0.0)),
        }
    )
    q = F.col("end") - F.col("start")
    unit = costs.transfer_unit_cost(
        F.col("origin.handling_cost_per_unit"), F.col("origin.factor"), F.col("dest.factor"), F.col("freight_rate")
    )
    return pieces.filter((q > BINDING) & F.col("origin").isNotNull() & F.col("dest").isNotNull()).select(
        "scenario_name",
        "product_id",
        F.col("origin.warehouse_id").alias("origin_warehouse"),
        F.col("dest.warehouse_id").alias("dest_warehouse"),
        q.alias("transfer_quantity"),
        unit.alias("unit_transfer_cost"),
        (q * unit).alias("total_transfer_cost"),
    )


def net_transfers(transfers: DataFrame) -> DataFrame:
    """Signed units per position: + received, - sent."""
    moves = F.array(
        F.struct(F.col("dest_warehouse").alias("warehouse_id"), F.col("transfer_quantity").alias("net")),
        F.struct(F.col("origin_warehouse").alias("warehouse_id"), (-F.col("transfer_quantity")).alias("net")),
    )
    return (
        transfers.select("scenario_name", "product_id", F.inline(moves))
        .groupBy(*POSITION_KEY)
        .agg(F.sum("net").alias("net_transfer"))
    )


# ------------------------------------------------------- coordinated plan, step 2
def split_orders(
    positions: DataFrame, transfers: DataFrame, dim_product: DataFrame, dim_supplier: DataFrame, dim_warehouse: DataFrame
) -> DataFrame:
    """Order the deficit left after transfers from two suppliers.

    The cheaper lane gets the allowed share, the other the rest; both are
    rationed to weekly capacity, then the larger lane is trimmed so that it
    stays within the share of what is really ordered. A product with a single
    supplier orders everything there.
    """
    netted = positions.join(net_transfers(transfers), POSITION_KEY, "left").withColumn(
        "need",
        F.greatest(
            F.lit(0.0), F.col("demand") - F.col("stock") - F.coalesce("net_transfer", F.lit(0.0))
        ),
    )
    both = F.array_distinct(F.array_compact(F.array("primary_supplier_id", "secondary_supplier_id")))
    lanes = (
        with_products(netted.filter(F.col("need") > BINDING), dim_product)
        .withColumn("n_suppliers", F.size(both))
        .withColumn("supplier_id", F.explode(both))
        .join(supplier_terms(dim_supplier), "supplier_id")
        .join(warehouse_terms(dim_warehouse), "warehouse_id")
        .withColumn("is_primary", F.col("supplier_id") == F.col("primary_supplier_id"))
    )
    unit = (
        costs.procurement_unit_cost("unit_cost", F.col("is_primary"))
        + costs.freight_unit_cost("supplier_factor", "warehouse_factor", F.col("freight_rate"))
        + costs.delay_unit_cost("p_delay", "lead_time")
    )
    # At most two rows per position, so these windows are never large.
    by_cost = Window.partitionBy(*POSITION_KEY).orderBy("lane_cost", "supplier_id")
    share = F.col("max_supplier_share")
    ranked = lanes.withColumn("lane_cost", unit).withColumn("lane_rank", F.row_number().over(by_cost))
    asked = ranked.withColumn(
        "requested",
        F.col("need")
        * F.when(F.col("n_suppliers") == 1, 1.0).when(F.col("lane_rank") == 1, share).otherwise(1.0 - share),
    )
    rationed = ration(asked)
    whole = Window.partitionBy(*POSITION_KEY)
    other = F.sum("order_quantity").over(whole) - F.col("order_quantity")
    ceiling = other * share / F.nullif(1.0 - share, F.lit(0.0))
    capped = F.when((F.col("n_suppliers") == 2) & (share < 1.0), F.least(F.col("order_quantity"), ceiling)).otherwise(
        F.col("order_quantity")
    )
    final = rationed.withColumn("order_quantity", capped).filter(F.col("order_quantity") > BINDING)
    costed = order_costs(final, F.col("is_primary"))
    return costed.select(
        *POSITION_KEY,
        "supplier_id",
        "is_primary",
        "order_quantity",
        "procurement_cost",
        "transport_cost",
        "risk_cost",
        (F.col("procurement_cost") + F.col("transport_cost") + F.col("risk_cost")).alias("total_order_cost"),
    )


def coordinated_flows(
    positions: DataFrame, transfers: DataFrame, orders: DataFrame, dim_product: DataFrame
) -> DataFrame:
    """Shortage and ending stock per position once transfers and orders arrive."""
    arrived = orders.groupBy(*POSITION_KEY).agg(F.sum("order_quantity").alias("ordered"))
    zero = F.lit(0.0)
    joined = (
        with_products(positions, dim_product)
        .join(net_transfers(transfers), POSITION_KEY, "left")
        .join(arrived, POSITION_KEY, "left")
        .withColumn("ordered", F.coalesce("ordered", zero))
        .withColumn("net_transfer", F.coalesce("net_transfer", zero))
    )
    supply = F.col("stock") + F.col("ordered") + F.col("net_transfer")
    flowed = joined.withColumns(flow_columns(supply, F.col("demand"))).withColumns(flow_costs())
    return flowed.select(
        *POSITION_KEY,
        "demand",
        "stock",
        "ordered",
        "net_transfer",
        "fulfilled_quantity",
        "shortage_quantity",
        "ending_inventory",
        "fill_rate",
        "shortage_cost",
        "holding_cost",
    )


def coordinated_totals(flows: DataFrame, transfers: DataFrame, orders: DataFrame, digits: int | None = 2) -> DataFrame:
    f = flows.groupBy("scenario_name").agg(
        F.sum("holding_cost").alias("holding_cost"),
        F.sum("shortage_cost").alias("shortage_cost"),
        F.sum("demand").alias("total_demand"),
        F.sum("fulfilled_quantity").alias("total_fulfilled"),
        F.sum("shortage_quantity").alias("total_shortage"),
    )
    t = transfers.groupBy("scenario_name").agg(
        F.sum("total_transfer_cost").alias("transshipment_cost"), F.sum("transfer_quantity").alias("total_transferred")
    )
    o = orders.groupBy("scenario_name").agg(
        F.sum("procurement_cost").alias("procurement_cost"),
        F.sum("transport_cost").alias("transport_cost"),
        F.sum("risk_cost").alias("supplier_risk_cost"),
        F.sum("order_quantity").alias("total_ordered"),
    )
    joined = f.join(t, "scenario_name", "left").join(o, "scenario_name", "left")
    filled = joined.select(
        "scenario_name", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in joined.columns if c != "scenario_name"]
    )
    return plan_totals(filled, digits)


# ------------------------------------------------------------------- plan audit
def plan_audit(
    positions: DataFrame,
    flows: DataFrame,
    transfers: DataFrame,
    orders: DataFrame,
    dim_supplier: DataFrame,
    dim_warehouse: DataFrame,
    dim_product: DataFrame,
) -> DataFrame:
    """Slack of every constraint: flow balance, storage, capacity, share, service.

    ``scenario_name, constraint_name, constraint_type, used, bound, slack,
    is_binding``. A negative slack (or a non-zero balance) is a violation.
    """
    zero = F.lit(0.0)
    # Positions differ only by key from scenario to scenario, so the scenario
    # parameters are one row each.
    params = positions.groupBy("scenario_name").agg(
        F.max("supplier_capacity_multiplier").alias("capacity_factor"),
        F.max("max_supplier_share").alias("share"),
        F.max("service_level_target").alias("target"),
    )
    signed = (
        flows.select(
            *POSITION_KEY,
            (F.col("stock") + F.col("shortage_quantity") - F.col("ending_inventory") - F.col("demand")).alias("units"),
        )
        .unionByName(orders.select(*POSITION_KEY, F.col("order_quantity").alias("units")))
        .unionByName(net_transfers(transfers).select(*POSITION_KEY, F.col("net_transfer").alias("units")))
    )
    balance = signed.groupBy(*POSITION_KEY).agg(F.sum("units").alias("used")).select(
        "scenario_name",
        F.concat_ws("_", F.lit("flow_balance"), "product_id", "warehouse_id").alias("constraint_name"),
        F.lit("EQUALITY").alias("constraint_type"),
        "used",
        zero.alias("bound"),
    )
    storage = (
        flows.groupBy("scenario_name", "warehouse_id")
        .agg(F.sum("ending_inventory").alias("used"))
        .join(dim_warehouse.select("warehouse_id", F.col("capacity_units").cast("double").alias("bound")), "warehouse_id")
        .select(
            "scenario_name",
            F.concat_ws("_", F.lit("warehouse_cap"), "warehouse_id").alias("constraint_name"),
            F.lit("INEQUALITY").alias("constraint_type"),
            "used",
            "bound",
        )
    )
    capacity = (
        orders.groupBy("scenario_name", "supplier_id")
        .agg(F.sum("order_quantity").alias("used"))
        .join(supplier_terms(dim_supplier), "supplier_id")
        .join(params, "scenario_name")
        .select(
            "scenario_name",
            F.concat_ws("_", F.lit("supplier_cap"), "supplier_id").alias("constraint_name"),
            F.lit("INEQUALITY").alias("constraint_type"),
            "used",
            (F.col("monthly_capacity") * F.col("capacity_factor") / costs.WEEKS_PER_MONTH).alias("bound"),
        )
    )
    both = dim_product.filter(F.col("primary_supplier_id") != F.col("secondary_supplier_id")).select("product_id")
    per_supplier = orders.groupBy("scenario_name", "product_id", "supplier_id").agg(F.sum("order_quantity").alias("used"))
    per_product = per_supplier.groupBy("scenario_name", "product_id").agg(F.sum("used").alias("all_units"))
    share = (
        per_supplier.join(per_product, ["scenario_name", "product_id"])
        .join(both, "product_id")
        .join(params, "scenario_name")
        .filter(F.col("share") < 1.0)
        .select(
            "scenario_name",
            F.concat_ws("_", F.lit("dual_source_cap"), "product_id", "supplier_id").alias("constraint_name"),
            F.lit("INEQUALITY").alias("constraint_type"),
            "used",
            (F.col("share") * F.col("all_units")).alias("bound"),
        )
    )
    service = (
        flows.groupBy("scenario_name")
        .agg(F.sum("shortage_quantity").alias("used"), F.sum("demand").alias("units"))
        .join(params, "scenario_name")
        .select(
            "scenario_name",
            F.lit("service_level_floor").alias("constraint_name"),
            F.lit("INEQUALITY").alias("constraint_type"),
            "used",
            ((1.0 - F.col("target")) * F.col("units")).alias("bound"),
        )
    )
    rows = reduce(DataFrame.unionByName, [balance, storage, capacity, share, service])
    slack = F.col("bound") - F.col("used")
    return rows.withColumn("slack", slack).withColumn("is_binding", F.abs(slack) < BINDING)


# ------------------------------------------------------------- policy comparison
def cost_waterfall(baseline: DataFrame, coordinated: DataFrame) -> DataFrame:
    """Cost category rows with both policies, difference and change in percent."""
    parts = (*COST_PARTS, "total_landed_cost")

    def long(df: DataFrame, name: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("cost_category"), F.col(c).alias(name)) for c in parts])
        return df.select("scenario_name", F.inline(pairs))

    both = long(baseline, "baseline_cost").join(
        long(coordinated, "optimized_cost"), ["scenario_name", "cost_category"]
    )
    gap = F.col("baseline_cost") - F.col("optimized_cost")
    change = F.when(F.col("baseline_cost") > 0, gap / F.nullif(F.col("baseline_cost"), F.lit(0.0)) * 100.0).otherwise(0.0)
    return both.withColumn("modeled_difference", half_even(gap, 2)).withColumn("pct_change", half_even(change, 2))


def scenario_summary(baseline: DataFrame, coordinated: DataFrame) -> DataFrame:
    """One row per scenario: both policies side by side, and each policy's cost
    relative to the baseline scenario."""
    b = baseline.select(
        "scenario_name",
        F.col("total_landed_cost").alias("baseline_total_cost"),
        F.col("service_level").alias("baseline_service_level"),
        F.col("total_shortage").alias("baseline_shortage_units"),
    )
    c = coordinated.select(
        "scenario_name",
        F.col("total_landed_cost").alias("optimized_total_cost"),
        F.col("service_level").alias("optimized_service_level"),
        F.col("total_shortage").alias("optimized_shortage_units"),
        F.col("total_transferred").alias("lateral_transfers_units"),
        F.col("total_demand").alias("total_demand_units"),
    )
    joined = b.join(c, "scenario_name")
    normal = joined.filter(F.col("scenario_name") == "baseline").agg(
        F.struct(F.max("baseline_total_cost").alias("b"), F.max("optimized_total_cost").alias("o"))
    ).scalar()
    gap = F.col("baseline_total_cost") - F.col("optimized_total_cost")
    return joined.withColumns(
        {
            "cost_difference": half_even(gap, 2),
            "cost_reduction_pct": half_even(
                F.coalesce(gap / F.nullif(F.col("baseline_total_cost"), F.lit(0.0)) * 100.0, F.lit(0.0)), 2
            ),
            "baseline_vs_normal": half_even(F.col("baseline_total_cost") - normal["b"], 2),
            "optimized_vs_normal": half_even(F.col("optimized_total_cost") - normal["o"], 2),
        }
    )


def sourcing_shares(baseline_plan_rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Units and share per supplier for both policies."""
    keys = ["scenario_name", "supplier_id"]
    b = baseline_plan_rows.groupBy(*keys).agg(F.sum("order_quantity").alias("baseline_quantity"))
    o = orders.groupBy(*keys).agg(F.sum("order_quantity").alias("optimized_quantity"))
    zero = F.lit(0.0)
    both = b.filter(F.col("baseline_quantity") > 0).join(o, keys, "full").select(
        *keys, *[F.coalesce(c, zero).alias(c) for c in ("baseline_quantity", "optimized_quantity")]
    )
    totals = both.groupBy("scenario_name").agg(
        F.sum("baseline_quantity").alias("_b"), F.sum("optimized_quantity").alias("_o")
    )
    joined = both.join(totals, "scenario_name")
    return joined.select(
        *keys,
        half_even("baseline_quantity", 2).alias("baseline_quantity"),
        half_even(F.coalesce(F.col("baseline_quantity") / F.nullif(F.col("_b"), zero) * 100.0, zero), 2).alias("baseline_share_pct"),
        half_even("optimized_quantity", 2).alias("optimized_quantity"),
        half_even(F.coalesce(F.col("optimized_quantity") / F.nullif(F.col("_o"), zero) * 100.0, zero), 2).alias("optimized_share_pct"),
    )


def sourcing_hhi(baseline_plan_rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Concentration index of supplier units per scenario and policy."""
    def one(df: DataFrame, name: str) -> DataFrame:
        per = df.groupBy("scenario_name", "supplier_id").agg(F.sum("order_quantity").alias("q"))
        total = F.sum("q")
        index = F.sum(F.col("q") * F.col("q")) * 10000.0 / F.nullif(total * total, F.lit(0.0))
        return per.groupBy("scenario_name").agg(half_even(F.coalesce(index, F.lit(0.0)), 1).alias(name))

    return one(baseline_plan_rows, "baseline_hhi").join(one(orders, "optimized_hhi"), "scenario_name", "full").select(
        "scenario_name", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("baseline_hhi", "optimized_hhi")]
    )


def warehouse_comparison(baseline_plan_rows: DataFrame, flows: DataFrame) -> DataFrame:
    keys = ["scenario_name", "warehouse_id"]

    def sums(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            half_even(F.sum("ending_inventory"), 2).alias(f"{name}_ending_inv"),
            half_even(F.sum("shortage_quantity"), 2).alias(f"{name}_shortage"),
        )

    joined = sums(baseline_plan_rows, "baseline").join(sums(flows, "optimized"), keys, "full")
    return joined.select(*keys, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in joined.columns if c not in keys])


# ---------------------------------------------------------------- explanations
def _money(c: Column) -> Column:
    return F.format_number(half_even(c, 2), 2)


def _units(c: Column) -> Column:
    return F.format_number(F.rint(c), 0)


def explain_transfers(transfers: DataFrame, dim_product: DataFrame, dim_warehouse: DataFrame, top_n: int = 5) -> DataFrame:
    """The largest transfers in words, with the purchase cost they avoid."""
    names = dim_warehouse.select("warehouse_id", "warehouse_name")
    top = transfers.orderBy(
        F.desc("transfer_quantity"), "product_id", "origin_warehouse", "dest_warehouse"
    ).limit(top_n)
    joined = (
        top.join(dim_product.select("product_id", "product_name", "unit_cost"), "product_id")
        .join(names.select(F.col("warehouse_id").alias("origin_warehouse"), F.col("warehouse_name").alias("o")), "origin_warehouse")
        .join(names.select(F.col("warehouse_id").alias("dest_warehouse"), F.col("warehouse_name").alias("d")), "dest_warehouse")
    )
    q, cost = F.col("transfer_quantity"), F.col("total_transfer_cost")
    purchase = q * (F.col("unit_cost") + costs.BASE_FREIGHT_RATE)
    text = F.concat(
        F.lit("Move "), _units(q), F.lit(" of "), F.col("product_name"), F.lit(" ["), F.col("product_id"), F.lit("] by lateral transfer, "),
        F.col("o"), F.lit(" to "), F.col("d"), F.lit(" ["), F.col("origin_warehouse"), F.lit(" > "), F.col("dest_warehouse"),
        F.lit("]. Freight: "), _money(cost), F.lit(" in total, "), _money(F.col("unit_transfer_cost")),
        F.lit(" a unit. Buying the same units new would cost about "), _money(purchase), F.lit(" with freight."),
    )
    return joined.select(
        "scenario_name",
        F.lit("TRANSFER").alias("entity_type"),
        F.concat(F.col("origin_warehouse"), F.lit("->"), F.col("dest_warehouse"), F.lit(":"), F.col("product_id")).alias("entity_id"),
        "product_id",
        half_even(q, 2).alias("quantity"),
        half_even(purchase - cost, 2).alias("impact_value"),
        text.alias("explanation"),
    )


def explain_dual_sourcing(
    orders: DataFrame, dim_product: DataFrame, dim_supplier: DataFrame, top_n: int = 5, max_share: float = MAX_SUPPLIER_SHARE
) -> DataFrame:
    """Products with the largest quantity at their secondary supplier, in words."""
    per = orders.groupBy("scenario_name", "product_id").agg(
        F.sum(F.when(~F.col("is_primary"), F.col("order_quantity")).otherwise(0.0)).alias("q"),
        F.sum("order_quantity").alias("all_units"),
    )
    top = per.filter(F.col("q") > 0).orderBy(F.desc("q"), "product_id").limit(top_n)
    names = dim_supplier.select("supplier_id", "supplier_name")
    joined = (
        top.join(dim_product.select("product_id", "product_name", "primary_supplier_id", "secondary_supplier_id"), "product_id")
        .join(names.select(F.col("supplier_id").alias("primary_supplier_id"), F.col("supplier_name").alias("p")), "primary_supplier_id")
        .join(names.select(F.col("supplier_id").alias("secondary_supplier_id"), F.col("supplier_name").alias("s")), "secondary_supplier_id")
    )
    share = F.col("q") / F.col("all_units") * 100.0
    text = F.concat(
        F.col("product_name"), F.lit(" ["), F.col("product_id"), F.lit("]: "), _units(F.col("q")), F.lit(" units, "),
        F.format_string("%.1f", half_even(share, 1)), F.lit("% of the order, go to "), F.col("s"), F.lit(" ["), F.col("secondary_supplier_id"),
        F.lit("], the rest to "), F.col("p"), F.lit(" ["), F.col("primary_supplier_id"), F.lit("]. No supplier may get more than "),
        F.format_string("%.0f", F.lit(max_share * 100.0)), F.lit("%, so that a late delivery of one leaves the other."),
    )
    return joined.select(
        "scenario_name",
        F.lit("DUAL_SOURCING").alias("entity_type"),
        F.concat_ws(":", "product_id", "secondary_supplier_id").alias("entity_id"),
        "product_id",
        half_even("q", 2).alias("quantity"),
        half_even(share, 1).alias("impact_value"),
        text.alias("explanation"),
    )


def narrative(coordinated: DataFrame, baseline: DataFrame, transfers: DataFrame) -> DataFrame:
    """One line of text per scenario with the plan totals."""
    lanes = transfers.groupBy("scenario_name").agg(F.count(F.lit(1)).alias("n_lanes"))
    joined = (
        coordinated.join(
            baseline.select("scenario_name", F.col("total_landed_cost").alias("base_cost")), "scenario_name"
        )
        .join(lanes, "scenario_name", "left")
        .withColumn("n_lanes", F.coalesce("n_lanes", F.lit(0)))
    )
    saved = F.col("base_cost") - F.col("total_landed_cost")
    pct = F.coalesce(saved / F.nullif(F.col("base_cost"), F.lit(0.0)) * 100.0, F.lit(0.0))
    text = F.concat(
        F.lit("Coordinated plan for scenario '"), F.col("scenario_name"), F.lit("' reaches a service level of "),
        F.format_string("%.1f", half_even(F.col("service_level") * 100.0, 1)), F.lit("% across "),
        _units(F.col("total_demand")), F.lit(" units of 7-day demand. Modeled 7-day cost is $"),
        _money(F.col("total_landed_cost")), F.lit(", a difference of $"), _money(saved), F.lit(" ("),
        F.format_string("%.1f", half_even(pct, 1)), F.lit("% lower) to the order-up-to baseline ($"),
        _money(F.col("base_cost")), F.lit("). It moves "), _units(F.col("total_transferred")), F.lit(" units over "),
        F.col("n_lanes").cast("string"), F.lit(" transfers and orders "), _units(F.col("total_ordered")),
        F.lit(" units under the single-supplier share ceiling."),
    )
    return joined.select("scenario_name", text.alias("narrative"))


# ------------------------------------------------------------------- decision log
def decision_rows(flows: DataFrame, transfers: DataFrame, orders: DataFrame, run_id: str) -> DataFrame:
    """Orders, transfers and shortages (of at least a hundredth) in one shape."""
    def unit(total: str, q: str) -> Column:
        return F.coalesce(F.col(total) / F.nullif(F.col(q), F.lit(0.0)), F.lit(0.0))

    o = orders.select(
        "scenario_name", F.lit("ORDER").alias("decision_type"), "product_id", F.col("supplier_id").alias("origin_id"),
        F.col("warehouse_id").alias("dest_warehouse_id"), F.col("order_quantity").alias("quantity"),
        unit("total_order_cost", "order_quantity").alias("unit_cost"), F.col("total_order_cost").alias("total_cost"),
        F.col("is_primary").cast("int").alias("is_primary"),
    )
    t = transfers.select(
        "scenario_name", F.lit("TRANSFER").alias("decision_type"), "product_id",
        F.col("origin_warehouse").alias("origin_id"), F.col("dest_warehouse").alias("dest_warehouse_id"),
        F.col("transfer_quantity").alias("quantity"), F.col("unit_transfer_cost").alias("unit_cost"),
        F.col("total_transfer_cost").alias("total_cost"), F.lit(1).alias("is_primary"),
    )
    s = flows.filter(half_even("shortage_quantity", 2) > 0).select(
        "scenario_name", F.lit("SHORTAGE").alias("decision_type"), "product_id",
        F.lit(None).cast("string").alias("origin_id"), F.col("warehouse_id").alias("dest_warehouse_id"),
        F.col("shortage_quantity").alias("quantity"), unit("shortage_cost", "shortage_quantity").alias("unit_cost"),
        F.col("shortage_cost").alias("total_cost"), F.lit(0).alias("is_primary"),
    )
    rows = reduce(DataFrame.unionByName, [o, t, s])
    return rows.select(F.lit(run_id).alias("run_id"), "*")


def coordinated_plan(
    positions: DataFrame,
    dims: Mapping[str, DataFrame],
    keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df,
) -> dict[str, DataFrame]:
    """Transfers, orders and flows of the coordinated policy for all scenarios.

    ``keep`` decides what happens to each decision table before the next step
    reads it: pass ``session.staged`` to write it once, since orders depend on
    transfers and flows on both.
    """
    transfers = keep(lateral_transfers(positions, dims["dim_warehouse"]), "transfers")
    orders = keep(
        split_orders(positions, transfers, dims["dim_product"], dims["dim_supplier"], dims["dim_warehouse"]), "orders"
    )
    flows = keep(coordinated_flows(positions, transfers, orders, dims["dim_product"]), "flows")
    return {"transfers": transfers, "orders": orders, "flows": flows}
