"""Orders of a usual supplier are dealt once; all columns are those of the other way."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from supplyspark.operators import leakage
from supplyspark.operators.features import supplier as fs

ORDERS = "po_id string, order_date date, supplier_id string, warehouse_id string, product_id string, quantity_ordered long, expected_lead_time_days int, actual_lead_time_days int, actual_delivery_date date, quantity_received long, unit_cost double, delay_days int, on_time_flag int, otif_flag int"
SUPPLIERS = "supplier_id string, supplier_name string, tier string, baseline_reliability double, baseline_lead_time_days int, lead_time_variance double, monthly_capacity_units long, moq_units int, transport_cost_factor double"
CUTOFF = "2000-03-01"


def made(spark, twice):
    """Several orders a day, with nulls in every column; with ``twice`` some orders and a supplier come twice."""
    rng = random.Random(7)
    rows = []
    for i in range(1500):
        day, delay = dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(120)), rng.randrange(4)
        row = [f"P{i}", day, f"S{rng.randrange(7)}", "W", rng.choice("ABC"), rng.randrange(1, 50), 5, 5 + delay, day + dt.timedelta(days=5 + delay), rng.randrange(1, 50), rng.randrange(1, 640) / 64.0, delay, int(delay == 0), int(delay == 0)]
        if i % 9 == 0:
            row[1 + (i // 9) % 13] = None
        rows.append(tuple(row))
    orders = spark.createDataFrame(rows + rows[: 20 * twice], ORDERS)
    suppliers = [(f"S{k % 6}", f"Name {k}", "Tier-1", 0.75, 5, 1.0, 1000 + k, 50, 1.0) for k in range(6 + twice)]
    return fs.base_orders(orders, spark.createDataFrame(suppliers, SUPPLIERS))


@pytest.fixture(scope="module")
def base(spark):
    return made(spark, 0)


def rows(df):
    return sorted(map(repr, df.collect()))


def test_the_same_columns_and_rows(base):
    old, new = fs.supplier_features(base), fs.order_features(base)
    assert new.dtypes == old.dtypes and rows(new) == rows(old) and new.count() > 1000


def test_repeated_orders_and_suppliers(spark):
    """Earlier orders of one day and id can be taken in either order, so their costs are left out."""
    base = made(spark, 1)
    old, new = (f(base).drop(*fs.COST_COLUMNS) for f in (fs.supplier_features, fs.order_features))
    assert rows(new) == rows(old) and new.count() > fs.order_features(made(spark, 0)).count()


def test_busy_suppliers_are_spread_and_lose_nothing(base):
    counts = sorted(r["count"] for r in base.groupBy("supplier_id").count().collect())
    busy = fs.busy_suppliers(base, limit=counts[2])
    assert len(busy) == sum(n > counts[2] for n in counts) > 0
    both = fs.order_features(base, busy)
    assert rows(both) == rows(fs.order_features(base))
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.splitlines() if "REPARTITION_BY_COL" in line and "order_date#" in line]


def test_orders_are_shuffled_once(spark, base):
    """Orders and suppliers are dealt by supplier for their join, and stay so."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fs.order_features(base)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2 == plan.count("Exchange hashpartitioning(supplier_id")


def test_equal_tables_deal_no_rows_by_key(spark, monkeypatch):
    """Where all sums agree nothing is joined or written."""
    monkeypatch.setattr(leakage, "staged", lambda *_: pytest.fail("staged"))
    a = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") * 0.5).alias("x"))
    assert leakage.differing_keys(a, a, ["k"], ["x"]).count() == 0
    assert leakage.differing_keys(a, a, ["k"], ["x"], a.select("k")).count() == 0


def test_what_sums_alone_would_miss(spark):
    """Values that changed places, rows of a repeated key, and rows that only the source has."""
    table = lambda *rows: spark.createDataFrame(rows, "k string, x double")
    find = lambda a, b, *source: {r.k for r in leakage.differing_keys(a, b, ["k"], ["x"], *source).collect()}
    assert find(table(("a", 1.0), ("b", 2.0)), table(("a", 2.0), ("b", 1.0))) == {"a", "b"}
    twice = table(("a", 1.0), ("a", 2.0), ("b", 1.0))
    assert find(twice, twice) == {"a"} == find(twice, twice, twice.select("k"))
    assert find(table(("a", 1.0)), table(("a", 1.0)), table(("a", 1.0), ("b", 1.0))) == set()
    # The source has each key once, but the tables have one of them twice and lack another.
    source = table(("a", 0.0), ("b", 0.0), ("c", 0.0))
    assert find(twice, twice, source) == {"a"}


def test_a_leak_is_found_by_the_sums(base):
    once = base.dropna(subset=["product_id", "order_date"])
    clean = leakage.supplier_leakage(fs.order_features, once.repartition("supplier_id"), CUTOFF, once).first()
    assert clean.is_leakage_free and clean.violating_columns == 0
    future = F.max("unit_cost").over(fs.Window.partitionBy("supplier_id"))
    leaking = lambda d: fs.order_features(d).withColumn("delay_trend", future)
    found = leakage.supplier_leakage(leaking, once, CUTOFF).first()
    assert not found.is_leakage_free and found.violating_columns == 1
