"""Single passes over a fact don't write it; writers deal a bucket to several tasks and compress."""

import datetime
import os
import tempfile

from pyspark.sql import functions as F

from supplyspark import catalog, session
from supplyspark.sources import io
from supplyspark.sources.adapter import StagedStar, StarSchema
from supplyspark.sources.versioned import VersionedTable


def small_tables(spark) -> str:
    """Two regions, suppliers, customers and parts; forty order lines, two of them equal."""
    folder = tempfile.mkdtemp(prefix="small-star-")
    day = lambda k: datetime.datetime(1996, 3, 1) + datetime.timedelta(days=k)
    lines = [(k % 10, k % 2, k % 2, k // 10, float(1 + 7 * k % 50), 100.0 + k, 0.08 * (k % 2), "R" if k % 5 == 0 else "N", day(k % 13)) for k in range(40)]
    tables = {
        "region": ([(0, "AFRICA"), (1, "ASIA")], "r_regionkey int, r_name string"),
        "nation": ([(0, "A", 0), (1, "B", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(0, "S0", 0), (1, "S1", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "customer": ([(0, 0), (1, 1)], "c_custkey long, c_nationkey int"),
        "part": ([(0, "Brand#1", "PROMO X", 5, 9.5), (1, "Brand#2", "SMALL Y", 7, 3.25)], "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(k, k % 2, day(k)) for k in range(10)], "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": (lines + lines[:1], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string, l_shipdate timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_single_passes_do_not_write_the_facts(spark):
    """The same rows from the definition and from the written facts."""
    folder = small_tables(spark)
    lazy, written = catalog.View(StagedStar(spark, folder)), catalog.View(StagedStar(spark, folder))
    assert written.star.fact_demand.count() == 41 and written.star.fact_purchase_orders.count() == 41
    for name in ("category_performance", "monthly_cost", "product_supply_risk", "safety_stock", "demand_lags"):
        found = rows(catalog.QUERIES[name](lazy))
        assert found and found == rows(catalog.QUERIES[name](written))
    assert not {"fact_demand", "fact_purchase_orders"} & set(lazy.star.__dict__)


def test_part_stock_is_not_written(spark):
    folder = small_tables(spark)
    lazy, written = catalog.View(StagedStar(spark, folder)), catalog.View(StagedStar(spark, folder))
    assert written.star.fact_purchase_orders.count() == 41
    before = len(session._staged_paths)
    for name in ("part_ledger", "part_stock_summary"):
        found = rows(catalog.QUERIES[name](lazy))
        assert found and found == rows(catalog.QUERIES[name](written))
    assert len(session._staged_paths) == before


def test_a_bucket_is_written_by_several_tasks(spark):
    """A merge keeps old and new rows of a key together without a single task for the bucket."""
    table = VersionedTable(spark, tempfile.mkdtemp(prefix="versioned-"), ["k"], buckets=1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table.upsert(spark.range(2000).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v")))
        table.upsert(spark.range(1000, 3000).select(F.col("id").cast("string").alias("k"), F.lit(1).alias("v")))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    (place,) = table.entry()["buckets"].values()
    assert len([f for f in os.listdir(place) if f.endswith(".parquet")]) > 2
    assert {(r.v, r.n, r.d) for r in table.read().groupBy("v").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).collect()} == {(0, 1000, 1000), (1, 2000, 2000)}


def test_compressed_csv_reads_back(spark):
    folder = f"{tempfile.mkdtemp(prefix='csv-')}/fact_demand.csv"
    data = [(datetime.date(2024, 1, 1), f"P{k}", "M1", "W1", k, 0, "NONE", 0) for k in range(50)]
    demand = spark.createDataFrame(data, "date date, product_id string, market_id string, warehouse_id string, demand_requested long, promotion_flag int, event_id string, outlier_flag int")
    io.write_csv(demand, folder, compression="gzip")
    io.write_csv(demand.limit(3).withColumn("demand_requested", F.lit("many")), folder, mode="append", compression="gzip")
    assert all(f.endswith(".csv.gz") for f in os.listdir(folder) if f.startswith("part-"))
    good, bad = io.read_csv_checked(spark, folder, "fact_demand")
    assert sorted(r.demand_requested for r in good.collect()) == list(range(50)) and bad.count() == 3


def test_order_lines_stay_where_they_are_for_small_dimensions(spark):
    """Each dimension is below the limit, but the product of two sizes, taken as the size of their join, is above it."""
    star = StarSchema(spark, small_tables(spark))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, str(200_000))
    try:
        plan = star.fact_purchase_orders._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("BroadcastHashJoin") == 3 and "hashpartitioning" not in plan
    facts = {(r.supplier_id, r.warehouse_id, r.expected_lead_time_days, r.quantity_ordered, r.transport_cost) for r in star.fact_purchase_orders.collect()}
    assert {(s, w, d) for s, w, d, _, _ in facts} == {("SUP-0", "WH-0", 5), ("SUP-1", "WH-1", 6)}
    assert all(cost == n * {"SUP-0": 0.75 * 2.5, "SUP-1": 0.875 * 1.125 * 2.5}[s] for s, _, _, n, cost in facts)
