"""Declared schemas, keys and foreign keys of the star schema."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql.types import (
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

_TYPES = {"s": StringType(), "l": LongType(), "i": IntegerType(), "d": DoubleType(), "t": DateType()}


def _schema(spec: str) -> StructType:
    """``"name:type"`` words; a trailing ``?`` marks a nullable column."""
    fields = []
    for word in spec.split():
        name, code = word.split(":")
        fields.append(StructField(name, _TYPES[code[0]], code.endswith("?")))
    return StructType(fields)


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: StructType
    key: tuple[str, ...]
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # (column, parent table, parent column)
    date_column: str | None = None
    not_null: tuple[str, ...] = field(default=())


def _spec(name, spec, key, fks=(), date=None) -> TableSpec:
    schema = _schema(spec)
    required = tuple(f.name for f in schema if not f.nullable)
    return TableSpec(name, schema, tuple(key), tuple(fks), date, required)


# Table layouts of the star schema.
SPECS: dict[str, TableSpec] = {
    s.name: s
    for s in (
        _spec(
            "dim_product",
            "product_id:s product_name:s category:s unit_cost:d selling_price:d criticality:s base_demand:i "
            "shelf_life_days:i? storage_requirement:s supplier_dependency:s primary_supplier_id:s "
            "secondary_supplier_id:s moq_units:i lead_time_expectation_days:i",
            ["product_id"],
        ),
        _spec(
            "dim_supplier",
            "supplier_id:s supplier_name:s primary_categories:s baseline_reliability:d baseline_lead_time_days:i "
            "lead_time_variance:d monthly_capacity_units:l moq_units:i transport_cost_factor:d tier:s",
            ["supplier_id"],
        ),
        _spec(
            "dim_warehouse",
            "warehouse_id:s warehouse_name:s region:s capacity_units:l handling_cost_per_unit:d transport_cost_factor:d",
            ["warehouse_id"],
        ),
        _spec(
            "dim_market",
            "market_id:s market_name:s region:s primary_warehouse_id:s demand_multiplier:d "
            "seasonality_multiplier:d annual_growth_rate:d",
            ["market_id"],
            [("primary_warehouse_id", "dim_warehouse", "warehouse_id")],
        ),
        _spec(
            "dim_date",
            "date:t year:i month:i quarter:i week:i day_of_week:i day_name:s is_weekend:i is_month_start:i "
            "is_month_end:i is_quarter_end:i holiday_flag:i promotion_period:i",
            ["date"],
            date="date",
        ),
        _spec(
            "dim_event",
            "event_id:s event_name:s start_date:t? end_date:t? event_type:s severity:s affected_region:s? "
            "affected_categories:s? affected_suppliers:s? demand_multiplier:d lead_time_multiplier:d "
            "transport_cost_multiplier:d description:s?",
            ["event_id"],
        ),
        _spec(
            "fact_demand",
            "date:t product_id:s market_id:s warehouse_id:s demand_requested:l promotion_flag:i event_id:s "
            "outlier_flag:i",
            [],
            [
                ("date", "dim_date", "date"),
                ("product_id", "dim_product", "product_id"),
                ("market_id", "dim_market", "market_id"),
                ("warehouse_id", "dim_warehouse", "warehouse_id"),
                ("event_id", "dim_event", "event_id"),
            ],
            date="date",
        ),
        _spec(
            "fact_inventory",
            "date:t product_id:s warehouse_id:s beginning_inventory:l po_received:l demand_requested:l "
            "demand_fulfilled:l opening_backorder:l backorder_fulfilled:l new_backorder:l lost_sales_quantity:l "
            "ending_backorder:l ending_inventory:l stockout_flag:i stockout_quantity:l safety_stock_target:l "
            "holding_cost:d stockout_cost:d total_warehouse_inventory:l warehouse_capacity:l "
            "capacity_utilization_pct:d",
            ["date", "product_id", "warehouse_id"],
            [
                ("date", "dim_date", "date"),
                ("product_id", "dim_product", "product_id"),
                ("warehouse_id", "dim_warehouse", "warehouse_id"),
            ],
            date="date",
        ),
        _spec(
            "fact_purchase_orders",
            "po_id:s order_date:t supplier_id:s warehouse_id:s product_id:s quantity_ordered:l "
            "expected_lead_time_days:i actual_lead_time_days:i expected_delivery_date:t actual_delivery_date:t? "
            "quantity_received:l unit_cost:d total_procurement_cost:d transport_cost:d delay_days:i on_time_flag:i "
            "in_full_flag:i otif_flag:i status:s",
            ["po_id"],
            [
                ("supplier_id", "dim_supplier", "supplier_id"),
                ("warehouse_id", "dim_warehouse", "warehouse_id"),
                ("product_id", "dim_product", "product_id"),
            ],
            date="order_date",
        ),
        _spec(
            "fact_transport",
            "transport_id:s po_id:s origin_supplier_id:s dest_warehouse_id:s departure_date:t arrival_date:t? "
            "quantity_transported:l transport_cost:d transport_mode:s delay_days:i",
            ["transport_id"],
            [
                ("po_id", "fact_purchase_orders", "po_id"),
                ("origin_supplier_id", "dim_supplier", "supplier_id"),
                ("dest_warehouse_id", "dim_warehouse", "warehouse_id"),
            ],
            date="departure_date",
        ),
    )
}


def text_schema(table: str) -> StructType:
    """Same columns, all read as text: the form an audit needs, because a bad
    date or number must stay visible instead of turning into NULL."""
    return StructType([StructField(f.name, StringType(), True) for f in SPECS[table].schema])
