"""The star schema derived from order, lineitem and part tables.

A retail order set has no stock ledger and no lead times, so both are derived
here by fixed rules. Prices are snapped to 1/64 and costs to 1/16384: such
values are exact in binary, so sums come out the same in any order and results
can be compared bit by bit with another engine.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from supplyspark.functions.exprs import calendar_columns, flag
from supplyspark.operators import ledger as L
from supplyspark.operators import ragged
from supplyspark.session import staged_property, tune
from supplyspark.sources.io import literal_rows, with_default_member
from supplyspark.sources.schemas import SPECS

INITIAL_STOCK = 200
PRICE_GRID = 64.0
COST_GRID = 16384.0

# Promotion windows (month-day ranges) and fixed-date holidays.
PROMOTION_WINDOWS = (("03-22", "03-29"), ("07-10", "07-17"), ("11-24", "12-02"), ("12-15", "12-22"))
HOLIDAYS = ("01-01", "05-01", "07-04", "11-28", "12-25")

# Part types in the source tables.
# Longest lead time of a supplier (5 + 13 days) and longest delay beyond it.
LONGEST_LEAD_DAYS = 18 + 4
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

# The event calendar of the adapted data (sequence order matters:
# of two overlapping events the later row wins).
EVENTS = (
    (1, "EVT-01", "Port strike", "1995-09-01", "1995-10-15", "Supply", "High", "ASIA", "ALL", 1.0, 1.5, 1.25),
    (2, "EVT-02", "Spring promotion", "1996-03-01", "1996-03-31", "Demand", "Low", "ALL", "PROMO, SMALL", 1.25, 1.0, 1.0),
    (3, "EVT-03", "Fuel price rise", "1997-05-10", "1997-08-20", "Transport", "Medium", "EUROPE", "ALL", 1.0, 1.125, 1.5),
    (4, "EVT-04", "Summer heat", "1997-08-01", "1997-08-31", "Demand", "Medium", "AFRICA", "ECONOMY, LARGE", 1.5, 1.0, 1.125),
    (5, "EVT-05", "Supplier outage", "1999-02-01", "1999-03-15", "Supply", "Critical", "ALL", "STANDARD", 0.75, 2.0, 1.0),
    (6, "EVT-06", "Year-end rush", "2000-11-20", "2000-12-31", "Demand", "High", "ALL", "ALL", 1.75, 1.25, 1.25),
)
EVENT_SCHEMA = (
    "ev_seq int, event_id string, event_name string, start_text string, end_text string, event_type string, "
    "severity string, affected_region string, affected_categories string, demand_multiplier double, "
    "lead_time_multiplier double, transport_cost_multiplier double"
)


def snap(c: Column, grid: float) -> Column:
    return F.floor(c * grid + 0.5).cast("double") / grid


def tag(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def date_dimension(days: DataFrame, holidays=HOLIDAYS, promotions=PROMOTION_WINDOWS) -> DataFrame:
    """Calendar attributes for a DataFrame with one ``date`` column."""
    cal = calendar_columns("date")
    month_day = F.date_format("date", "MM-dd")
    promo = F.lit(False)
    for first, last in promotions:
        promo = promo | month_day.between(first, last)
    return days.select(
        "date",
        cal["year"].alias("year"),
        cal["month"].alias("month"),
        cal["quarter"].alias("quarter"),
        cal["week_of_year"].alias("week"),
        cal["day_of_week"].alias("day_of_week"),
        cal["day_name"].alias("day_name"),
        cal["is_weekend"].alias("is_weekend"),
        cal["is_month_start"].alias("is_month_start"),
        cal["is_month_end"].alias("is_month_end"),
        cal["is_quarter_end"].alias("is_quarter_end"),
        flag(month_day.isin(*holidays)).alias("holiday_flag"),
        flag(promo).alias("promotion_period"),
    )


def days_between(first_last: DataFrame, first: str = "first_day", last: str = "last_day") -> DataFrame:
    """One row per day between the two dates of a one-row DataFrame."""
    return first_last.select(F.explode(F.sequence(F.col(first), F.col(last))).alias("date"))


class StarSchema:
    """Lazily built dimension and fact tables over one data folder.

    Passing ``tables`` overrides single tables, for example with materialized
    Parquet copies.
    """

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, DataFrame] | None = None):
        self.spark = tune(spark)
        self.folder = folder
        for name, df in (tables or {}).items():
            self.__dict__[name] = df

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SPECS}

    def narrow(self, name: str) -> DataFrame:
        """A fact for one pass over a few of its columns: the others are not computed."""
        return getattr(self, name)

    # ------------------------------------------------------------ dimensions
    @cached_property
    def dim_warehouse(self) -> DataFrame:
        k = F.col("r_regionkey")
        return self.raw("region").select(
            tag("WH-", "r_regionkey").alias("warehouse_id"),
            F.col("r_name").alias("warehouse_name"),
            F.col("r_name").alias("region"),
            (F.lit(40000) + 10000 * k).cast("long").alias("capacity_units"),
            (F.lit(1.25) + 0.125 * k).alias("handling_cost_per_unit"),
            (F.lit(1.0) + 0.125 * k).alias("transport_cost_factor"),
        )

    @cached_property
    def dim_market(self) -> DataFrame:
        k = F.col("n_nationkey")
        regions = self.raw("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
        return (
            self.raw("nation")
            .join(regions, "n_regionkey")
            .select(
                tag("MKT-", "n_nationkey").alias("market_id"),
                F.col("n_name").alias("market_name"),
                "region",
                tag("WH-", "n_regionkey").alias("primary_warehouse_id"),
                (F.lit(1.0) + 0.125 * (k % 4)).alias("demand_multiplier"),
                (F.lit(1.0) + 0.0625 * (k % 3)).alias("seasonality_multiplier"),
                (0.03125 * (k % 5)).alias("annual_growth_rate"),
            )
        )

    @cached_property
    def dim_supplier(self) -> DataFrame:
        k = F.col("s_suppkey")
        category = F.array(*[F.lit(c) for c in CATEGORIES])
        n = len(CATEGORIES)
        return self.raw("supplier").select(
            tag("SUP-", "s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.concat_ws(
                ", ", F.get(category, (k % n).cast("int")), F.get(category, ((k + 1) % n).cast("int"))
            ).alias("primary_categories"),
            (F.lit(0.75) + 0.0625 * (k % 4)).alias("baseline_reliability"),
            (F.lit(5) + k % 14).cast("int").alias("baseline_lead_time_days"),
            (F.lit(1.0) + 0.25 * (k % 5)).alias("lead_time_variance"),
            (F.lit(1200) + 300 * (k % 7)).cast("long").alias("monthly_capacity_units"),
            (50 * (1 + k % 4)).cast("int").alias("moq_units"),
            (F.lit(0.75) + 0.125 * (k % 5)).alias("transport_cost_factor"),
            F.concat(F.lit("Tier-"), (1 + k % 3).cast("string")).alias("tier"),
        )

    @cached_property
    def dim_product(self) -> DataFrame:
        cents = F.round(F.col("p_retailprice") * 100).cast("long")
        n_suppliers = self.raw("supplier").agg(F.count(F.lit(1))).scalar()
        grouped = (
            self.raw("part")
            .groupBy("p_brand")
            .agg(
                F.min("p_partkey").alias("lo"),
                F.max("p_partkey").alias("hi"),
                F.min_by("p_type", "p_partkey").alias("category"),
                F.sum(cents).alias("cents"),
                F.count(F.lit(1)).alias("n"),
                F.max("p_size").alias("max_size"),
            )
            .withColumn("selling_price", snap(F.col("cents") / F.col("n") / 100.0, PRICE_GRID))
        )
        criticality = F.get(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), (F.col("hi") % 3).cast("int"))
        primary = (F.col("lo") * 7) % n_suppliers
        secondary = (F.col("lo") * 7 + 1 + F.col("lo") % 3) % n_suppliers
        return grouped.select(
            F.col("p_brand").alias("product_id"),
            F.concat(F.lit("Family "), F.col("p_brand")).alias("product_name"),
            "category",
            (F.col("selling_price") * 0.625).alias("unit_cost"),
            "selling_price",
            criticality.alias("criticality"),
            F.col("n").cast("int").alias("base_demand"),
            (F.col("max_size") * 30).cast("int").alias("shelf_life_days"),
            F.when(F.col("lo") % 2 == 0, "Ambient").otherwise("Cold").alias("storage_requirement"),
            F.when(F.col("lo") % 4 == 0, "Single-sourced").otherwise("Dual-sourced").alias("supplier_dependency"),
            F.concat(F.lit("SUP-"), primary.cast("string")).alias("primary_supplier_id"),
            F.concat(F.lit("SUP-"), secondary.cast("string")).alias("secondary_supplier_id"),
            (100 + 10 * (F.col("lo") % 5)).cast("int").alias("moq_units"),
            F.lit(7).alias("lead_time_expectation_days"),
        )

    @cached_property
    def dim_date(self) -> DataFrame:
        """From the first order or shipment to the last possible delivery, so every fact date is a member."""
        ordered = self.raw("orders").select(F.col("o_orderdate").cast("date").alias("day"))
        shipped = self.raw("lineitem").agg(F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi"))
        shipped = shipped.select(F.explode(F.array("lo", F.date_add("hi", LONGEST_LEAD_DAYS))).alias("day"))
        span = ordered.unionByName(shipped).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"))
        return date_dimension(days_between(span))

    @cached_property
    def event_rows(self) -> DataFrame:
        """Real events with their sequence number, without the default member."""
        return literal_rows(self.spark, EVENTS, EVENT_SCHEMA).select(
            "ev_seq",
            "event_id",
            "event_name",
            F.to_date("start_text").alias("start_date"),
            F.to_date("end_text").alias("end_date"),
            "event_type",
            "severity",
            "affected_region",
            "affected_categories",
            F.lit("ALL").alias("affected_suppliers"),
            "demand_multiplier",
            "lead_time_multiplier",
            "transport_cost_multiplier",
            F.col("event_name").alias("description"),
        )

    @cached_property
    def dim_event(self) -> DataFrame:
        rows = self.event_rows.drop("ev_seq")
        default = literal_rows(
            self.spark,
            [("NONE", "No event", "None", "None", 1.0, 1.0, 1.0)],
            "event_id string, event_name string, event_type string, severity string, demand_multiplier double, "
            "lead_time_multiplier double, transport_cost_multiplier double",
        ).select(
            *[
                F.lit(None).cast(SPECS["dim_event"].schema[c].dataType).alias(c)
                if c in ("start_date", "end_date", "affected_region", "affected_categories", "affected_suppliers", "description")
                else c
                for c in rows.columns
            ]
        )
        return with_default_member(rows, default, "event_id")

    # ----------------------------------------------------------------- facts
    @cached_property
    def fact_demand(self) -> DataFrame:
        line = self.raw("lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("date")
        )
        customers = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        nations = self.raw("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_id"))
        categories = self.dim_product.select("product_id", "category")
        rows = (
            line.join(orders.join(customers.join(nations, "c_nationkey"), "o_custkey"), "l_orderkey")
            .join(parts, "l_partkey")
            .select(
                "date",
                "product_id",
                tag("MKT-", "c_nationkey").alias("market_id"),
                tag("WH-", "n_regionkey").alias("warehouse_id"),
                F.col("l_quantity").cast("long").alias("demand_requested"),
                flag(F.col("l_discount") >= 0.08).alias("promotion_flag"),
                flag(F.col("l_quantity") >= 50).alias("outlier_flag"),
            )
        )
        return (
            rows.join(categories, "product_id", "left")
            .join(self._event_of_day(), ["date", "warehouse_id", "category"], "left")
            .select(
                "date",
                "product_id",
                "market_id",
                "warehouse_id",
                "demand_requested",
                "promotion_flag",
                F.coalesce("event_id", F.lit("NONE")).alias("event_id"),
                "outlier_flag",
            )
        )

    def _event_of_day(self) -> DataFrame:
        """(date, warehouse, category) -> last matching event.

        Events are unrolled to days first, so the interval match becomes an
        equality join on a table no larger than days x warehouses x categories.
        """
        every = self.dim_product.agg(F.sort_array(F.collect_set("category"))).scalar()
        categories = F.when(F.col("affected_categories") == "ALL", every).otherwise(
            F.split("affected_categories", r",\s*")
        )
        regions = self.dim_warehouse.select("warehouse_id", "region")
        every_region = regions.agg(F.sort_array(F.collect_set("region"))).scalar()
        region_list = F.when(F.col("affected_region") == "ALL", every_region).otherwise(
            F.array("affected_region")
        )
        return (
            self.event_rows.withColumn("date", F.explode(F.sequence("start_date", "end_date")))
            .withColumn("category", F.explode(categories))
            .withColumn("region", F.explode(region_list))
            .join(regions, "region")
            .groupBy("date", "warehouse_id", "category")
            .agg(F.max_by("event_id", "ev_seq").alias("event_id"))
        )

    @cached_property
    def fact_purchase_orders(self) -> DataFrame:
        parts = self.raw("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_id"))
        nations = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
        suppliers = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        # Nations follow suppliers: the size of a join of both would be taken as their product, too large
        # to broadcast, and all order lines would be shuffled by supplier.
        freight = (F.lit(0.75) + 0.125 * (F.col("l_suppkey") % 5)) * (F.lit(1.0) + 0.125 * F.col("n_regionkey")) * 2.5
        jitter = (7 * F.col("l_partkey") + 3 * F.col("l_orderkey") + F.col("l_linenumber")) % 8 - 3
        quantity = F.col("l_quantity").cast("long")
        return (
            self.raw("lineitem").join(parts, "l_partkey")
            .join(suppliers, "l_suppkey")
            .join(nations, "s_nationkey")
            .withColumn("supplier_id", tag("SUP-", "l_suppkey"))
            .withColumn("warehouse_id", tag("WH-", "n_regionkey"))
            .withColumn("expected_lead_time_days", (F.lit(5) + F.col("l_suppkey") % 14).cast("int"))
            .withColumn("order_date", F.col("l_shipdate").cast("date"))
            .withColumn("quantity_ordered", quantity)
            .withColumn("actual_lead_time_days", F.greatest(F.lit(1), F.col("expected_lead_time_days") + jitter).cast("int"))
            .withColumn(
                "quantity_received",
                F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") * 0.9375)).otherwise(quantity),
            )
            .withColumn("unit_cost", snap(F.col("l_extendedprice") / F.col("l_quantity"), PRICE_GRID))
            .withColumn(
                "delay_days",
                F.greatest(F.lit(0), F.col("actual_lead_time_days") - F.col("expected_lead_time_days")).cast("int"),
            )
            .withColumn("on_time_flag", flag(F.col("delay_days") == 0))
            .withColumn("in_full_flag", flag(F.col("quantity_received") == F.col("quantity_ordered")))
            .select(
                # The source repeats (order, line number); part, supplier and day tell the lines apart.
                F.concat_ws(
                    "-", F.lit("PO"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.date_format("order_date", "yyyyMMdd")
                ).alias("po_id"),
                "order_date",
                "supplier_id",
                "warehouse_id",
                "product_id",
                "quantity_ordered",
                "expected_lead_time_days",
                "actual_lead_time_days",
                F.date_add("order_date", F.col("expected_lead_time_days")).alias("expected_delivery_date"),
                F.date_add("order_date", F.col("actual_lead_time_days")).alias("actual_delivery_date"),
                "quantity_received",
                "unit_cost",
                (F.col("quantity_received") * F.col("unit_cost")).alias("total_procurement_cost"),
                (F.col("quantity_ordered") * freight).alias("transport_cost"),
                "delay_days",
                "on_time_flag",
                "in_full_flag",
                (F.col("on_time_flag") * F.col("in_full_flag")).alias("otif_flag"),
                F.lit("Delivered").alias("status"),
            )
        )

    @cached_property
    def fact_transport(self) -> DataFrame:
        modes = F.array(F.lit("Road"), F.lit("Rail"), F.lit("Sea"))
        return self.fact_purchase_orders.select(
            F.regexp_replace("po_id", "^PO", "TR").alias("transport_id"),
            "po_id",
            F.col("supplier_id").alias("origin_supplier_id"),
            F.col("warehouse_id").alias("dest_warehouse_id"),
            F.col("order_date").alias("departure_date"),
            F.col("actual_delivery_date").alias("arrival_date"),
            F.col("quantity_received").alias("quantity_transported"),
            "transport_cost",
            F.get(modes, (F.col("quantity_ordered") % 3).cast("int")).alias("transport_mode"),
            "delay_days",
        )

    @cached_property
    def daily_flows(self) -> DataFrame:
        """Demand and receipts per product, warehouse and calendar day."""
        keys = ["product_id", "warehouse_id", "date"]
        demand = self.narrow("fact_demand").groupBy(*keys).agg(F.sum("demand_requested").alias("demand_requested"))
        receipts = self.narrow("fact_purchase_orders").groupBy(
            "product_id", "warehouse_id", F.col("actual_delivery_date").alias("date")
        ).agg(F.sum("quantity_received").alias("po_received"))
        return L.dense_flows(self.dim_product, self.dim_warehouse, self.dim_date, demand, receipts)

    @cached_property
    def part_demand_rows(self) -> DataFrame:
        """Units of each order line, by part, warehouse and day."""
        orders = self.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("date"))
        places = self.raw("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
        nations = self.raw("nation").select("n_nationkey", tag("WH-", "n_regionkey").alias("warehouse_id"))
        lines = self.raw("lineitem").select("l_orderkey", F.col("l_partkey").alias("part_id"), F.col("l_quantity").cast("long").alias("demand_requested"))
        return lines.join(orders.join(places.join(nations, "n_nationkey"), "o_custkey"), "l_orderkey")

    @cached_property
    def part_demand(self) -> DataFrame:
        """Units of each part, warehouse and day; days without orders have no row."""
        return ragged.daily(self.part_demand_rows, "demand_requested")

    @cached_property
    def part_receipt_rows(self) -> DataFrame:
        """Units of each purchase order, by part, warehouse and day of arrival."""
        orders = self.narrow("fact_purchase_orders")
        part = F.split_part("po_id", F.lit("-"), F.lit(4)).cast("long").alias("part_id")
        return orders.select(part, "warehouse_id", F.col("actual_delivery_date").alias("date"), F.col("quantity_received").alias("po_received"))

    @cached_property
    def policy_terms(self) -> DataFrame:
        return self.dim_product.select(
            "product_id", F.col("primary_supplier_id").alias("supplier_id"), "moq_units"
        ).join(self.dim_supplier.select("supplier_id", "baseline_lead_time_days"), "supplier_id")

    @cached_property
    def ledger(self) -> DataFrame:
        """``fact_inventory`` without its three warehouse-load columns.

        Most queries do not read those columns, which cost one more aggregate.
        """
        prices = self.dim_product.select("product_id", "unit_cost", "selling_price")
        flows = L.with_safety_stock(self.daily_flows, self.policy_terms)
        led = (
            L.floored_ledger(flows, INITIAL_STOCK)
            .join(prices, "product_id")
            .withColumn(
                "holding_cost", snap(F.col("ending_inventory") * F.col("unit_cost") * 0.2 / 365.25, COST_GRID)
            )
            .withColumn("stockout_cost", F.col("lost_sales_quantity") * F.col("selling_price") * 1.5)
        )
        return led.select(*SPECS["fact_inventory"].schema.names[:-3])

    @cached_property
    def fact_inventory(self) -> DataFrame:
        full = L.with_warehouse_load(self.ledger, self.dim_warehouse)
        return full.select(*SPECS["fact_inventory"].schema.names)


class StagedStar(StarSchema):
    """The same schema with its derived facts materialized on first use."""

    def narrow(self, name: str) -> DataFrame:
        """The written fact if there is one, else its definition: one pass doesn't pay for writing all columns."""
        return self.__dict__[name] if name in self.__dict__ else getattr(StarSchema, name).func(self)

    @staged_property
    def fact_demand(self) -> DataFrame:
        return StarSchema.fact_demand.func(self)

    @staged_property
    def fact_purchase_orders(self) -> DataFrame:
        return StarSchema.fact_purchase_orders.func(self)

    @staged_property
    def ledger(self) -> DataFrame:
        return StarSchema.ledger.func(self)
