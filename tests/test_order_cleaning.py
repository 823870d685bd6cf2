"""Orders are deduplicated by work on the ids that come more than once."""

import datetime as dt

from pyspark.sql import functions as F

from supplyspark.operators import audit, cleaning

COLUMNS = "po_id string, order_date date, supplier_id string, product_id string, quantity_received long, unit_cost double, total_procurement_cost double"
RANK = ["order_date", "supplier_id", "product_id", "quantity_received", "unit_cost", "total_procurement_cost"]


def cleaned(spark, rows):
    orders = spark.createDataFrame(rows, COLUMNS)
    suppliers = spark.createDataFrame([("S1",), ("S2",)], "supplier_id string")
    products = spark.createDataFrame([("A", 2.0)], "product_id string, unit_cost double")
    return cleaning.clean_purchase_orders(orders, suppliers, products, RANK)


def test_copies_conflicts_and_single_orders(spark):
    day = lambda n: dt.date(2000, 1, n)
    single = ("P1", day(1), "S1", "A", 5, 3.0, 15.0)
    twice = ("P2", day(1), "S1", "A", 5, 3.0, 15.0)
    early, late = ("P3", day(2), "S1", "A", 5, -1.0, -5.0), ("P3", day(3), "S2", "A", 6, 3.0, 18.0)
    orphan = ("P4", day(1), "S9", "A", 5, 3.0, 15.0)
    unnamed, other = (None, day(1), "S1", "A", 1, 1.0, 1.0), (None, day(2), "S1", "A", 1, 1.0, 1.0)
    c = cleaned(spark, [single, twice, twice, twice, late, early, late, orphan, unnamed, other])
    rows = {r.po_id: r for r in c.rows.collect()}
    assert set(rows) == {"P1", "P2", "P3", None} and c.rows.count() == 4
    assert (rows["P3"].order_date, rows["P3"].unit_cost, rows["P3"].total_procurement_cost) == (day(2), 2.0, 10.0)
    assert rows[None].order_date == day(1)
    assert {r.action: r.records_affected for r in c.actions.collect()} == {
        "DEDUPLICATE": 3, "DEDUPLICATE_PRIMARY_KEY": 2, "QUARANTINE_NULL_OR_ORPHAN_KEY": 1, "REPAIR_NEGATIVE_PRICE": 1,
    }
    assert sorted((r.po_id or "", r.action, r.copies) for r in c.quarantine.collect()) == [
        ("", "DEDUPLICATE_PRIMARY_KEY", 1), ("P2", "DEDUPLICATE", 2), ("P3", "DEDUPLICATE", 1), ("P3", "DEDUPLICATE_PRIMARY_KEY", 1), ("P4", "QUARANTINE_NULL_OR_ORPHAN_KEY", 1),
    ]


def test_no_orders(spark):
    c = cleaned(spark, [])
    assert c.rows.count() == 0 and {r.records_affected for r in c.actions.collect()} == {0}


def test_only_rows_of_repeated_ids_are_written(spark, monkeypatch):
    written = {}
    keep = cleaning.staged
    monkeypatch.setattr(cleaning, "staged", lambda df, name, *_: written.setdefault(name, keep(df, name)))
    day = dt.date(2000, 1, 1)
    c = cleaned(spark, [(f"P{i % 1000}", day, "S1", "A", i, 1.0, 1.0) for i in range(1003)])
    assert c.rows.count() == 1000
    assert sum(df.count() for df in written.values()) <= 3 + 6 + 3


def test_rows_without_a_broken_rule_are_dropped_before_cells_are_built(spark):
    products = spark.createDataFrame([("A", "Name", "C", 1.0, 2.0, 3), ("B", "Name", "C", -1.0, 2.0, 3), ("B", None, "C", 1.0, 2.0, 3)],
                                     "product_id string, product_name string, category string, unit_cost double, selling_price double, base_demand int")
    found = audit.table_violations("dim_product", products, {"dim_product": products}, (1995, 2001))
    assert sorted((r.rule_id, r.column_name, r.row_key, r.records) for r in found.collect()) == [
        ("DQ-001", "product_name", "B", 1), ("DQ-003", "product_id", "B", 1), ("DQ-004", "unit_cost", "B", 1),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "(greatest(0, " in plan and plan.index("(greatest(0, ") > plan.index("Generate inline")
