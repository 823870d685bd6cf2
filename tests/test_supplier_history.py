"""Supplier history on hand-made orders, and what its plan leaves out."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from supplyspark import catalog
from supplyspark.operators import leakage
from supplyspark.operators.features import supplier as fs
from supplyspark.sources.adapter import StarSchema

SUPPLIER = dict(
    supplier_id="S1", supplier_name="One", tier="Tier-1", baseline_reliability=0.75, baseline_lead_time_days=5, lead_time_variance=1.0,
    monthly_capacity_units=1000, moq_units=50, transport_cost_factor=1.0,
)
ORDERS = "po_id string, order_date date, supplier_id string, warehouse_id string, product_id string, quantity_ordered long, expected_lead_time_days int, actual_lead_time_days int, actual_delivery_date date, quantity_received long, unit_cost double, delay_days int, on_time_flag int, otif_flag int"
START = dt.date(2000, 1, 1)


def order(i, placed, delivered, delay, product="A", cost=1.0):
    day = lambda n: None if n is None else START + dt.timedelta(days=n)
    known = delivered is not None
    lead = delivered - placed if known else None
    return (f"P{i}", day(placed), "S1", "W", product, 10, 5, lead, day(delivered), 8 if known else None, cost, delay, int(delay == 0) if known else None, int(delay == 0) if known else None)


@pytest.fixture
def base(spark):
    # Two deliveries of one delay on one day, one that is never made, one on the border of each window.
    rows = [order(1, 0, 10, 0), order(2, 0, 10, 0, cost=3.0), order(3, 5, 11, 4), order(4, 7, None, None), order(5, 40, 45, 1), order(6, 41, 60, 0), order(7, 101, 110, 2), order(8, 5, 11, 0, product="B")]
    return fs.base_orders(spark.createDataFrame(rows, ORDERS), spark.createDataFrame([SUPPLIER]))


def test_windows_end_on_their_last_day(base):
    found = {r.po_id: r for r in fs.supplier_features(base).collect()}
    assert len(found) == 8
    # Day 40 still sees day 10 in its 30 days, day 41 does not.
    assert (found["P5"].hist_order_count, found["P6"].hist_order_count) == (4, 4)
    assert found["P5"].recent_delay_30d == 1.0 and found["P6"].recent_delay_30d == 2.0
    # Day 101 sees deliveries of day 11 to 100 in its 90 days: four of six.
    assert found["P7"].hist_otif_rate == pytest.approx(4 / 6) and found["P7"].recent_otif_90d == 0.5
    assert found["P7"].hist_p90_delay == pytest.approx(2.5) and found["P7"].supplier_active_orders_count == 0
    assert found["P1"].is_cold_start == 1 and found["P1"].days_since_last_delivery == 999.0
    assert (found["P3"].hist_sku_unit_cost_mean, found["P8"].hist_sku_unit_cost_mean) == (2.0, 1.0)


def exchanged(df):
    """Plan text of what is shuffled, below each exchange."""
    return df._jdf.queryExecution().executedPlan().toString()


def test_history_is_read_without_cost_history(spark, base):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = exchanged(fs.supplier_features(base))
        narrow = exchanged(fs.supplier_features(base).select("po_id", *catalog.SUPPLIER_HISTORY))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "_day_s1" in whole and "_day_s1" not in narrow
    assert narrow.count("Exchange hashpartitioning") < whole.count("Exchange hashpartitioning")
    # Events are summed once and pass one window.
    assert narrow.count("Window [") == 1


def test_orders_are_dealt_once(spark, base):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exchanged(fs.supplier_features(base))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line[line.index("Exchange hash") :] for line in plan.splitlines() if "Exchange hash" in line]
    # The join to the costs uses the orders as they lie for the history.
    assert not [line for line in dealt if "product_id#" in line]
    assert sum("REPARTITION_BY_COL" in line and "order_date#" in line for line in dealt) == 1


def test_wide_feature_rows_are_not_written_for_their_readers(spark, tmp_path, base, monkeypatch):
    monkeypatch.setattr(catalog, "staged", lambda *_: pytest.fail("staged"))
    view = catalog.View(StarSchema(spark, str(tmp_path)))
    view.__dict__["order_base"] = base
    for name in ("supplier_history", "supplier_recent", "supplier_inflight", "supplier_risk_score"):
        catalog.QUERIES[name](view)
    assert view.supplier_features.agg(F.count(F.lit(1))).first()[0] == 8


def test_only_rows_that_differ_are_compared_in_full(spark):
    rows = "k string, x double, y double, z string"
    a = spark.createDataFrame([("same", 1.0, None, "u"), ("moved", 5.0, None, "u"), ("near", 1.0, 2.0, "u"), ("left", 1.0, 1.0, "u"), (None, 1.0, 1.0, "u")], rows)
    b = spark.createDataFrame([("same", 1.0, None, "u"), ("moved", None, 5.0, "u"), ("near", 1.0, 2.0 + 1e-9, "v"), (None, 1.0, 1.0, "u")], rows)
    keys = [r.k for r in leakage.differing_keys(a, b, ["k"], ["x", "y", "z"]).collect()]
    assert set(keys) == {None, "left", "moved", "near"} and len(keys) == 4
    found = {r.column_name: (r.max_abs_diff, r.differing_rows) for r in leakage.table_differences(a, b, ["k"], ["x", "y", "z"]).collect()}
    # One row on the left only, and two without a key that meet nothing.
    assert found["x"] == (5.0, 4) and found["y"] == (5.0, 4) and found["z"] == (0.0, 4)
    same = leakage.table_differences(a.dropna(subset=["k"]), a.dropna(subset=["k"]), ["k"], ["x", "z"]).collect()
    assert {(r.column_name, r.max_abs_diff, r.differing_rows) for r in same} == {("x", 0.0, 0), ("z", 0.0, 0)}


def test_orders_are_dealt_before_they_are_summed(spark):
    """No sums where the orders are read: with nearly as many groups as orders they would spill there."""
    rows = [("S", "P", dt.date(2020, 1, 1 + k % 9), dt.date(2020, 1, 5 + k % 9), 1.0 + k, k % 3, 5, 4, 1, 0) for k in range(30)]
    names = "supplier_id string, product_id string, order_date date, actual_delivery_date date, unit_cost double, delay_days int, quantity_ordered long, quantity_received long, on_time_flag int, otif_flag int"
    orders = spark.createDataFrame(rows, names)
    plan = fs.daily_events(orders)._jdf.queryExecution().executedPlan().toString().splitlines()
    lowest = max(i for i, line in enumerate(plan) if "Exchange" in line)
    assert not [line for line in plan[lowest:] if "Aggregate" in line]
    events = fs.daily_events(orders).agg(F.sum("n"), F.sum("placed"), F.sum("ordered"), F.sum("received")).first()
    assert tuple(events) == (30, 30, 150, 120)
