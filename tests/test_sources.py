"""Readers, writers, splits, whitelists and models."""

import datetime as dt
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from supplyspark.operators import splits
from supplyspark.plans import models
from supplyspark.sources import io
from supplyspark.sources.adapter import date_dimension, days_between
from supplyspark.sources.schemas import SPECS


def test_partitioned_write_prunes(spark):
    path = tempfile.mkdtemp() + "/t"
    rows = [(dt.date(2024, 1 + i % 3, 1 + i % 20), i) for i in range(90)]
    io.write_parquet(spark.createDataFrame(rows, "date date, v int"), path, "date")
    assert spark.read.parquet(path).filter("month_key = '2024-02'").count() == 30
    io.append_parquet(spark.createDataFrame(rows, "date date, v int"), path, "date")
    assert spark.read.parquet(path).count() == 180


def test_csv_round_trip_and_fallback(spark):
    folder = tempfile.mkdtemp()
    df = spark.createDataFrame([("W1", "North", "N", 10, 1.0, 1.0)], SPECS["dim_warehouse"].schema)
    io.write_csv(df, f"{folder}/dim_warehouse.csv")
    back = io.read_csv_tables(spark, folder, names=["dim_warehouse"])["dim_warehouse"].first()
    assert back.capacity_units == "10"
    io.rebuild_table(df, "fallback_wh")
    assert io.read_parquet_or_table(spark, f"{folder}/nothing", "fallback_wh").count() == 1
    assert io.read_table(spark, "fallback_wh", warehouse_id="W9").count() == 0
    with pytest.raises(FileNotFoundError):
        io.read_parquet_or_table(spark, f"{folder}/nothing", "no_such_table")


def test_recent_slice_cascades_to_transport(spark):
    orders = spark.createDataFrame([("1", dt.date(2024, 1, 1)), ("2", dt.date(2024, 6, 1))], "po_id string, order_date date")
    moves = spark.createDataFrame([("t1", "1"), ("t2", "2")], "transport_id string, po_id string")
    out = io.recent_slice({"fact_purchase_orders": orders, "fact_transport": moves, "dim_x": orders}, "2024-03-01")
    assert out["fact_transport"].first().transport_id == "t2" and out["dim_x"].count() == 2


def test_calendar(spark):
    span = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2025, 12, 31))], "first_day date, last_day date")
    cal = date_dimension(days_between(span))
    assert cal.count() == 731
    row = cal.filter("date = '2024-03-31'").first()
    assert (row.is_month_end, row.is_quarter_end, row.day_of_week, row.day_name, row.week) == (1, 1, 6, "Sunday", 13)


def test_splits_and_whitelist(spark):
    df = spark.createDataFrame([(dt.date(2025, m, 1),) for m in range(1, 13)], "date date")
    bounds = splits.split_bounds(splits.with_split(df))
    assert splits.splits_ordered(bounds).first().ordered
    a, b, c = splits.temporal_split(df)
    assert (a.count(), b.count(), c.count()) == (3, 3, 6)
    splits.assert_whitelist(splits.DEMAND_NUMERIC, splits.DEMAND_NUMERIC)
    for bad in (["target_x"], ["outlier_flag"], ["unheard_of"]):
        with pytest.raises(ValueError):
            splits.assert_whitelist(bad, splits.DEMAND_NUMERIC)


def test_ridge_matches_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    x -= x.mean(axis=0)
    y = x @ np.array([3.0, -2.0, 0.5]) + rng.normal(size=400) * 2 + 7
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "label": y}))
    model = models.ridge(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df), 100.0)
    want = np.linalg.solve(x.T @ x + 100.0 * np.eye(3), x.T @ (y - y.mean()))
    assert np.allclose(model.coefficients.toArray(), want, rtol=1e-3)


def test_encoder_drops_first_level_and_ignores_unseen(spark):
    train = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "c")], "x double, k string")
    enc = models.Encoder(["x"], ["k"], scale=False).fit(train)
    assert enc.names == ["x", "k=b", "k=c"]
    got = enc.transform(spark.createDataFrame([(None, "zzz"), (5.0, "c")], "x double, k string")).collect()
    assert got[0].features.toArray().tolist()[1:] == [0.0, 0.0]
    assert got[1].features.toArray().tolist() == [5.0, 0.0, 1.0]


def test_classifier_is_calibrated_and_deterministic(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=1500)
    y = (rng.random(1500) < 1 / (1 + np.exp(-2 * x))).astype(int)
    part = np.where(np.arange(1500) < 900, "TRAIN", np.where(np.arange(1500) < 1200, "VAL", "TEST"))
    rows = spark.createDataFrame(pd.DataFrame({"x": x, "g": "k", "split": part, "label": y.astype(float)}))
    enc, fitted, metrics = models.fit_candidates(rows, ["g"], ["x", "g"], ("logistic", "random_forest"), rounds=5)
    assert metrics.filter("roc_auc > 0.8").count() == 2
    tuned = models.calibrate(enc, fitted["logistic"], rows.filter("split = 'VAL'"))
    test = tuned.score(rows.filter("split = 'TEST'"))
    assert test.agg(F.avg("score")).first()[0] == pytest.approx(y[1200:].mean(), abs=0.08)
    again = models.fit_candidates(rows, ["g"], ["x", "g"], ("logistic", "random_forest"), rounds=5)[2]
    assert sorted(metrics.collect()) == sorted(again.collect())


def test_lines_dates_and_reconciliation(spark):
    """No order line is lost, the calendar covers every fact, and every check passes."""
    from supplyspark import catalog
    from supplyspark.sources.adapter import StagedStar

    folder = "/root/testdata/sf0.001"
    view = catalog.View(StagedStar(spark, folder))
    orders = view.star.fact_purchase_orders
    assert orders.count() == spark.read.parquet(f"{folder}/lineitem.parquet").count() == orders.select("po_id").distinct().count()
    last = orders.agg({"actual_delivery_date": "max"}).first()[0]
    assert view.star.dim_date.agg({"date": "max"}).first()[0] >= last
    assert all(r["passed"] for r in catalog.QUERIES["reconcile_all"](view).collect())


def test_bounded_training_rows(spark):
    from supplyspark.plans import models

    rows = spark.range(5000).selectExpr("id", "CASE WHEN id % 5 = 0 THEN 'VAL' ELSE 'TRAIN' END AS split")
    found = {r["split"]: r["count"] for r in models.bounded(rows, ["id"], 1000).groupBy("split").count().collect()}
    assert found["VAL"] == 1000 and 850 < found["TRAIN"] < 1150
    assert models.bounded(rows, ["id"], 4000).count() == 5000


def test_staged_folders_can_be_released(spark, monkeypatch):
    import os

    from supplyspark import session

    monkeypatch.setattr(session, "_staged_paths", [])
    held = session.staged(spark.range(3), "numbers")
    folder = held.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert held.count() == 3 and os.path.isdir(folder)
    assert session.release_staged() == 1 and not os.path.exists(folder)
