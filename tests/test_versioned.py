"""Upserts with several writers, logs that repeat, checked CSV, slices."""

import datetime
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from supplyspark.sources import io
from supplyspark.sources.commits import CommitConflict
from supplyspark.sources.versioned import VersionedTable, append_once, read_log


def table(spark, **options):
    return VersionedTable(spark, tempfile.mkdtemp(prefix="versioned-"), ["k"], **options)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k string, v int")


def content(df):
    return sorted(((r.k, r.v) for r in df.collect()), key=str)


def test_upsert_and_old_versions(spark):
    t = table(spark)
    with pytest.raises(LookupError):
        t.read()
    assert t.upsert(rows(spark, ("a", 1), ("b", 2), (None, 9))) == 1
    assert t.upsert(rows(spark, ("b", 3), ("c", 4), (None, 8))) == 2
    assert content(t.read()) == sorted([("a", 1), ("b", 3), ("c", 4), (None, 8)], key=str)
    assert content(t.read(1)) == sorted([("a", 1), ("b", 2), (None, 9)], key=str)
    with pytest.raises(ValueError, match="distinct"):
        t.upsert(rows(spark, ("a", 1), ("a", 2)))
    assert t.upsert(rows(spark)) == 3 and content(t.read()) == content(t.read(2))


def test_interleaved_upserts_keep_both(spark):
    """Two writers start from one version, once on the same key and once on others."""
    t = table(spark, buckets=4)
    t.upsert(rows(spark, ("a", 1), ("b", 2)))
    first, second = t.prepare(rows(spark, ("a", 10)), 1), t.prepare(rows(spark, ("b", 20), ("c", 30)), 1)
    assert t.commit(first) == 2
    with pytest.raises(CommitConflict):
        t.commit(second)
    assert content(t.read()) == [("a", 10), ("b", 2)]  # the loser has changed nothing
    assert t.upsert(rows(spark, ("b", 20), ("c", 30))) == 3
    assert content(t.read()) == [("a", 10), ("b", 20), ("c", 30)]


def test_a_lost_race_is_merged_again(spark, monkeypatch):
    t = table(spark)
    t.upsert(rows(spark, ("a", 1)))
    other = VersionedTable(spark, t.folder, ["k"])
    real, raced = t.commit, []

    def commit(entry):
        if not raced:
            raced.append(other.upsert(rows(spark, ("b", 2))))
        return real(entry)

    monkeypatch.setattr(t, "commit", commit)
    assert t.upsert(rows(spark, ("c", 3))) == 3 and raced == [2]
    assert content(t.read()) == [("a", 1), ("b", 2), ("c", 3)]
    monkeypatch.setattr(t, "commit", lambda entry: other.upsert(rows(spark, ("d", 4))) and real(entry))
    with pytest.raises(CommitConflict):
        t.upsert(rows(spark, ("e", 5)), attempts=1)


def test_only_touched_buckets_are_written(spark):
    t = table(spark, buckets=8)
    t.upsert(spark.range(500).select(F.col("id").cast("string").alias("k"), F.lit(0).alias("v")))
    t.upsert(rows(spark, ("7", 1)))
    before, after = t.entry(1)["buckets"], t.entry(2)["buckets"]
    changed = [n for n in after if before.get(n) != after[n]]
    assert len(before) == 8 and changed == t.entry(2)["touched"] and len(changed) == 1
    assert t.read().count() == 500 and t.read().filter("v = 1").count() == 1


def test_a_log_holds_each_run_once(spark):
    path = tempfile.mkdtemp(prefix="log-")
    for run, n in (("r1", 3), ("r2", 2), ("r1", 3), ("r1", 1)):
        append_once(spark.range(n), path, run)
    counts = {r.run_id: r.n for r in read_log(spark, path, spark.range(1).schema).groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"r1": 1, "r2": 2}
    empty = tempfile.mkdtemp(prefix="log-")
    append_once(spark.range(0), empty, "r1")
    assert read_log(spark, empty, spark.range(1).schema).count() == 0


def test_csv_keeps_bad_lines(spark):
    """A wrong type, a wrong date, too few and too many fields; an empty number is a NULL, not a fault."""
    folder = tempfile.mkdtemp(prefix="csv-")
    os.makedirs(f"{folder}/fact_demand.csv")
    header = "date,product_id,market_id,warehouse_id,demand_requested,promotion_flag,event_id,outlier_flag"
    good = ["2024-01-01,P1,M1,W1,5,0,NONE,0", "2024-01-02,P2,M1,W1,,0,NONE,0"]
    bad = ["2024-01-03,P3,M1,W1,many,0,NONE,0", "03.01.2024,P4,M1,W1,5,0,NONE,0", "2024-01-04,P5,M1", "2024-01-05,P6,M1,W1,5,0,NONE,0,extra"]
    with open(f"{folder}/fact_demand.csv/part.csv", "w") as file:
        file.write("\n".join([header, good[0], *bad, good[1]]) + "\n")
    kept, rejected = io.read_csv_checked(spark, f"{folder}/fact_demand.csv", "fact_demand")
    assert sorted(r.line for r in rejected.collect()) == sorted(bad)
    assert [(r.product_id, r.demand_requested) for r in kept.orderBy("product_id").collect()] == [("P1", 5), ("P2", None)]
    action = io.rejected_actions(rejected).first()
    assert (action.table_name, action.action, action.records_affected) == ("fact_demand", "REJECT_MALFORMED_LINE", 4)


def test_slices_are_pruned(spark):
    folder = tempfile.mkdtemp(prefix="slice-")
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=k) for k in range(200)]
    orders = spark.createDataFrame([(f"PO-{k}", d) for k, d in enumerate(days)], "po_id string, order_date date")
    moves = orders.select(F.concat(F.lit("TR-"), "po_id").alias("transport_id"), "po_id")
    io.write_slice(io.recent_slice({"fact_purchase_orders": orders, "fact_transport": moves}, "2024-03-01"), folder)
    back = io.read_slice(spark, folder, "fact_purchase_orders", "2024-06-10")
    assert back.columns == ["po_id", "order_date"] and back.count() == sum(d >= datetime.date(2024, 6, 10) for d in days)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and "2024-06" in plan
    assert io.read_slice(spark, folder, "fact_transport").count() == sum(d >= datetime.date(2024, 3, 1) for d in days)


def test_a_heavy_month_has_several_files(spark):
    """No fixed number of writers: Spark splits by size."""
    path = tempfile.mkdtemp(prefix="months-")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        io.write_parquet(spark.range(300_000).repartition(24).select(F.lit(datetime.date(2024, 1, 1)).alias("date"), F.xxhash64("id").alias("v")), path, "date")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len([f for f in os.listdir(f"{path}/month_key=2024-01") if f.endswith(".parquet")]) > 8
