"""Rules and cleaning on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from supplyspark.operators import cleaning, quality


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_not_null(spark):
    df = spark.createDataFrame([("A",), (None,), ("C",), ("",)], "id string")
    row = one(quality.check_not_null(df, "t", ["id"]))
    assert (row.row_count, row.severity, row.rule_id) == (2, "ERROR", "DQ-001")


def test_dates(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-02-30",), ("INVALID",), ("2099-01-01",), (None,)], "d string")
    assert one(quality.check_valid_dates(df, "t", ["d"])).row_count == 3


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "b")], "id int, v string")
    assert one(quality.check_duplicates(df, "t")).row_count == 1
    assert one(quality.check_duplicates(df, "t", ["v"])).row_count == 2


def test_non_negative_with_samples(spark):
    rows = [(str(i), v) for i, v in enumerate([10, -5, 0, -12, -1, -2, -3, -4])]
    df = spark.createDataFrame(rows, "id string, v int")
    row = one(quality.check_non_negative(df, "t", ["v"], "id"))
    assert row.row_count == 6 and row.samples == ["1", "3", "4", "5", "6"]


def test_referential(spark):
    child = spark.createDataFrame([("SKU-01",), ("SKU-99",), ("SKU-02",), (None,)], "k string")
    parent = spark.createDataFrame([("SKU-01",), ("SKU-02",), ("SKU-03",)], "k string")
    row = one(quality.check_referential(child, "c", "k", parent, "k", "k"))
    assert row.row_count == 1 and row.samples == ["SKU-99"]


def test_continuity_and_outliers(spark):
    days = [("a", dt.date(2024, 1, d)) for d in range(1, 6)] + [("b", dt.date(2024, 1, 1))]
    df = spark.createDataFrame(days, "k string, date date")
    row = one(quality.check_continuity(df, "t", ["k"], "date", 5))
    assert row.row_count == 1 and row.samples == ["b"]
    flat = spark.createDataFrame([("g", 10)] * 50 + [("g", 1000)], "g string, v int")
    assert one(quality.check_outliers(flat, "t", "v", "g", 4.5)).row_count == 1
    constant = spark.createDataFrame([("g", 10)] * 5, "g string, v int")
    assert quality.check_outliers(constant, "t", "v", "g").count() == 0


def _demand(spark):
    base = dt.date(2024, 1, 1)
    rows = [(base, "P1", "M", "W", 10, 0, "", 0)] * 2  # exact duplicate
    rows += [(base, None, "M", "W", 1, 0, "E", 0), (base, "PX", "M", "W", 1, 0, "E", 0)]
    rows += [(dt.date(2030, 1, 1), "P1", "M", "W", 4, 0, "E", 0), (base, "P1", "M2", "W", -7, 0, None, 0)]
    rows += [(base, "P1", f"M{i}", "W", 10, 0, "E", 0) for i in range(3, 60)]
    rows += [(base, "P1", "M99", "W", 5000, 0, "E", 0)]
    schema = "date date, product_id string, market_id string, warehouse_id string, demand_requested long, promotion_flag int, event_id string, outlier_flag int"
    return spark.createDataFrame(rows, schema)


def test_clean_demand_accounts_for_every_row(spark):
    raw = _demand(spark)
    products = spark.createDataFrame([("P1",)], "product_id string")
    days = spark.createDataFrame([(dt.date(2024, 1, 1),)], "date date")
    c = cleaning.clean_demand(raw, products, days)
    actions = {r.action: r.records_affected for r in c.actions.collect()}
    assert actions == {
        "DEDUPLICATE": 1, "QUARANTINE_NULL_OR_ORPHAN_KEY": 2, "QUARANTINE_INVALID_DATE": 1,
        "REPAIR_NEGATIVE_VALUE": 1, "ANNOTATE_OUTLIER": 1,
    }
    kept, removed = c.rows.count(), c.quarantine.agg(F.sum("copies")).first()[0]
    assert kept + removed == raw.count()
    assert c.rows.agg(F.min("demand_requested")).first()[0] == 0
    assert c.rows.filter("event_id = 'NONE'").count() == 2
    trail = cleaning.audit_trail({"fact_demand": c})
    assert trail.filter("disposition = 'REMOVED'").agg(F.sum("records_affected")).first()[0] == 4


def test_clean_orders_keeps_first_and_restores_price(spark):
    d = dt.date(2024, 1, 1)
    schema = "po_id string, order_date date, supplier_id string, product_id string, quantity_received long, unit_cost double, total_procurement_cost double"
    rows = [("1", d, "S1", "P1", 3, 2.0, 6.0), ("1", d + dt.timedelta(1), "S1", "P1", 9, 2.0, 18.0)]
    rows += [("2", d, "SX", "P1", 1, 1.0, 1.0), ("3", d, "S1", "P1", 4, -1.0, -4.0), ("4", d, "S1", "P?", 4, 0.0, 0.0)]
    orders = spark.createDataFrame(rows + rows[:1], schema)
    suppliers = spark.createDataFrame([("S1",)], "supplier_id string")
    products = spark.createDataFrame([("P1", 5.5)], "product_id string, unit_cost double")
    c = cleaning.clean_purchase_orders(orders, suppliers, products, ["order_date", "quantity_received"])
    kept = {r.po_id: r for r in c.rows.collect()}
    assert set(kept) == {"1", "3", "4"} and kept["1"].quantity_received == 3
    assert (kept["3"].unit_cost, kept["3"].total_procurement_cost) == (5.5, 22.0)
    assert kept["4"].unit_cost == 25.0
    removed = {(r.action, r.po_id, r.quantity_received, r.copies) for r in c.quarantine.collect()}
    assert removed == {
        ("DEDUPLICATE", "1", 3, 1), ("DEDUPLICATE_PRIMARY_KEY", "1", 9, 1), ("QUARANTINE_NULL_OR_ORPHAN_KEY", "2", 1, 1),
    }
    actions = {r.action: r.records_affected for r in c.actions.collect()}
    assert actions == {
        "DEDUPLICATE": 1, "DEDUPLICATE_PRIMARY_KEY": 1, "QUARANTINE_NULL_OR_ORPHAN_KEY": 1, "REPAIR_NEGATIVE_PRICE": 2,
    }


def test_clean_inventory_and_transport(spark):
    schema = "product_id string, beginning_inventory long, po_received long, demand_fulfilled long, ending_inventory long, holding_cost double"
    led = spark.createDataFrame([("P1", 10, 5, 3, 12, 0.0), ("P1", 10, 0, 3, -4, 0.0)], schema)
    products = spark.createDataFrame([("P1", 365.25)], "product_id string, unit_cost double")
    c = cleaning.clean_inventory(led, products)
    assert sorted(r.ending_inventory for r in c.rows.collect()) == [7, 12]
    assert sorted(r.holding_cost for r in c.rows.collect()) == [1.4, 2.4]
    tr = spark.createDataFrame([("t1", "1"), ("t2", "2")], "transport_id string, po_id string")
    t = cleaning.clean_transport(tr, spark.createDataFrame([("1",)], "po_id string"))
    assert t.rows.count() == 1 and t.quarantine.first().transport_id == "t2"
