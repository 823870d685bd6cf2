"""Window rewrites against plain Python loops."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from supplyspark.operators import evaluate, leakage, ledger, quantiles, series
from supplyspark.operators.features import demand as fd
from supplyspark.operators.features import supplier as fs

DAY0 = dt.date(2024, 1, 1)


def frame(spark, n=120, seed=1):
    rng = random.Random(seed)
    rows = []
    for p in ("A", "B"):
        for i in range(n):
            rows.append((p, "W", DAY0 + dt.timedelta(i), rng.choice([0, 0, 3, 7, 20]), rng.choice([0, 1, 1])))
    return spark.createDataFrame(rows, "product_id string, warehouse_id string, date date, demand_requested long, f int")


def test_rolling_equals_pandas(spark):
    df = frame(spark)
    got = df.withColumns(
        {"m": series.rolling_mean("demand_requested", 7), "s": series.rolling_std("demand_requested", 28)}
        | fd.target_columns()
    ).toPandas().sort_values(["product_id", "date"])
    for _, g in got.groupby("product_id"):
        x = g["demand_requested"].astype(float)
        want_m = x.shift(1).rolling(7, min_periods=1).mean()
        want_s = x.shift(1).rolling(28, min_periods=2).std().fillna(0.0)
        assert np.allclose(g["m"].astype(float), want_m, equal_nan=True)
        assert np.allclose(g["s"].astype(float), want_s)
        fwd = x.shift(-1)[::-1].rolling(7, min_periods=7).sum()[::-1]
        assert np.allclose(g["target_demand_sum_7d"].astype(float), fwd, equal_nan=True)


def test_streak_and_episodes(spark):
    rows = series.with_streak(frame(spark), "f", "streak").orderBy("product_id", "date").collect()
    current = {}
    for r in rows:
        assert r.streak == current.get(r.product_id, 0)
        current[r.product_id] = current.get(r.product_id, 0) + 1 if r.f else 0
    runs = series.episodes(frame(spark), "f").collect()
    assert sum(r.streak_days for r in runs) == sum(r.f for r in rows)
    assert all((r.last_day - r.first_day).days + 1 == r.streak_days for r in runs)


def test_last_event_wins(spark):
    ev = spark.createDataFrame(
        [(1, DAY0, DAY0 + dt.timedelta(5), "a", "Low", 1.0, 1.0, 1.0), (2, DAY0 + dt.timedelta(3), DAY0 + dt.timedelta(9), "b", "High", 2.0, 1.0, 1.0)],
        "ev_seq int, start_date date, end_date date, event_type string, severity string, demand_multiplier double, lead_time_multiplier double, transport_cost_multiplier double",
    )
    days = spark.createDataFrame([(DAY0 + dt.timedelta(i),) for i in range(12)], "date date")
    got = {(r.date - DAY0).days: r for r in series.with_events(days, ev).collect()}
    assert (got[2].event_type, got[3].event_type, got[9].days_until_event_end) == ("a", "b", 0)
    assert got[11].event_type == "Normal" and got[11].days_since_event_start == -1


def test_ledger_equals_loop(spark):
    rng = random.Random(3)
    rows = [("A", "W", DAY0 + dt.timedelta(i), rng.randint(0, 30), rng.choice([0, 0, 40])) for i in range(200)]
    flows = spark.createDataFrame(rows, "product_id string, warehouse_id string, date date, demand_requested long, po_received long")
    stock = 50
    for r in ledger.floored_ledger(flows, 50).orderBy("date").collect():
        assert r.beginning_inventory == stock
        unmet = max(0, r.demand_requested - stock - r.po_received)
        stock = max(0, stock + r.po_received - r.demand_requested)
        assert (r.ending_inventory, r.stockout_quantity) == (stock, unmet)


def test_dense_grid_fills_gaps_without_shuffling_the_grid(spark):
    products = spark.createDataFrame([("A",), ("B",)], "product_id string")
    places = spark.createDataFrame([("W1",), ("W2",)], "warehouse_id string")
    days = spark.createDataFrame([(DAY0,), (DAY0 + dt.timedelta(9),)], "date date")
    sparse = spark.createDataFrame([("A", "W1", DAY0, 5), ("A", "W1", DAY0 + dt.timedelta(99), 7)], "product_id string, warehouse_id string, date date, demand_requested long")
    grid = ledger.align_to_grid(ledger.dense_grid(products, places, days), sparse, {"demand_requested": 0})
    assert grid.count() == 40 and grid.agg(F.sum("demand_requested")).first()[0] == 5
    plan = grid.withColumn("x", series.lag("demand_requested", 1))._jdf.queryExecution().executedPlan().toString()
    body = plan.split("Union")[0]
    assert "Exchange" not in body  # window and merge reuse the hashing of the inputs


def test_grid_and_windows_are_spread(spark):
    """25 products in 5 places: every task gets a few times the mean share at most."""
    products = spark.range(25).selectExpr("concat('P', id) AS product_id")
    places = spark.range(5).selectExpr("concat('W', id) AS warehouse_id")
    days = spark.createDataFrame([(DAY0,), (DAY0 + dt.timedelta(999),)], "date date")
    sparse = spark.createDataFrame([("P1", "W1", DAY0, 5)], "product_id string, warehouse_id string, date date, demand_requested long")
    grid = ledger.align_to_grid(ledger.dense_grid(products, places, days), sparse, {"demand_requested": 0})
    lagged = grid.withColumn("x", series.lag("demand_requested", 1))
    shares = [r["count"] for r in lagged.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 125_000 and len(shares) >= 6 and max(shares) <= 4 * 125_000 / 8


def test_events_for_all_reach_every_category(spark):
    """A seventh category and a sixth warehouse get the events that name ALL."""
    from supplyspark.sources.adapter import StarSchema

    star = StarSchema(spark, "/root/testdata/sf0.001")
    star.__dict__["dim_product"] = star.dim_product.withColumn("category", F.lit("NEW"))
    extra = star.dim_warehouse.limit(1).withColumn("warehouse_id", F.lit("WH-9"))
    star.__dict__["dim_warehouse"] = star.dim_warehouse.unionByName(extra)
    found = star._event_of_day().filter("event_id = 'EVT-06'")
    assert found.select("category").distinct().collect()[0][0] == "NEW"
    assert "WH-9" in {r[0] for r in found.select("warehouse_id").distinct().collect()}


def test_holidays_of_every_year(spark):
    from supplyspark.operators.features import demand

    df = spark.createDataFrame([(dt.date(1996, 12, 25),), (dt.date(1999, 12, 25),), (dt.date(1999, 12, 26),)], "date date")
    flags = df.withColumns(demand.calendar_feature_columns(["12-25"])).orderBy("date").collect()
    assert [r["holiday_flag"] for r in flags] == [1, 1, 0]


@pytest.mark.parametrize("p", [0.1, 0.5, 0.9])
def test_exact_percentiles(spark, p):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=900), rng.normal(size=100) * 1e6, np.zeros(500)])
    df = spark.createDataFrame(pd.DataFrame({"k": ["a", "b"] * 750, "v": values}))
    got = {r.k: r.q for r in quantiles.exact_percentiles(df, ["k"], "v", {"q": p}, buckets=16).collect()}
    for i, k in enumerate("ab"):
        assert got[k] == pytest.approx(np.percentile(values[i::2], p * 100), abs=1e-9)
    whole = quantiles.exact_percentiles(df, [], "v", {"q": p}, buckets=16).first().q
    assert whole == pytest.approx(np.percentile(values, p * 100), abs=1e-9)


def test_percentiles_with_a_far_outlier_have_no_heavy_cell(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=20_000), [1e12]])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    got = quantiles.exact_percentiles(df, [], "v", {"q": 0.3})
    assert got.first().q == pytest.approx(np.percentile(values, 30), abs=1e-9)
    cells = quantiles.cell_counts(df.select("v"), [], "v")
    assert cells.agg(F.max("rows")).first()[0] < 0.02 * len(values)


def test_supplier_history_equals_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        order = DAY0 + dt.timedelta(rng.randint(0, 200))
        lead = rng.randint(1, 40)
        delivered = None if i % 37 == 0 else order + dt.timedelta(lead)
        rows.append((f"{i:04d}", order, rng.choice("XY"), "P", rng.randint(1, 50), rng.randint(1, 50), delivered,
                     rng.randint(0, 6), rng.randint(0, 1), rng.randint(0, 1), float(rng.randint(1, 9)), 0.8, 100))
    df = spark.createDataFrame(rows, "po_id string, order_date date, supplier_id string, product_id string, quantity_ordered long, quantity_received long, actual_delivery_date date, delay_days int, on_time_flag int, otif_flag int, unit_cost double, baseline_reliability double, monthly_capacity_units long")
    for r in fs.with_cost_history(fs.with_history(df)).collect():
        t = r.order_date
        past = [x for x in rows if x[2] == r.supplier_id and x[6] is not None and x[6] < t]
        flight = [x for x in rows if x[2] == r.supplier_id and x[6] is not None and x[1] < t <= x[6]]
        delays = [x[7] for x in past]
        assert r.hist_order_count == len(past)
        assert r.supplier_active_volume == sum(x[4] for x in flight)
        if past:
            assert r.hist_p90_delay == pytest.approx(np.percentile(delays, 90))
            assert r.hist_mean_delay == pytest.approx(np.mean(delays))
            assert r.hist_std_delay == pytest.approx(np.std(delays, ddof=1) if len(delays) > 1 else 0.0, abs=1e-9)
            recent = [x[7] for x in past if x[6] >= t - dt.timedelta(30)]
            assert r.recent_delay_30d == pytest.approx(np.mean(recent if recent else delays))
            assert r.days_since_last_delivery == min((t - x[6]).days for x in past)
        else:
            assert (r.is_cold_start, r.hist_on_time_rate, r.days_since_last_delivery) == (1, 0.8, 999.0)
        earlier = [x[10] for x in rows if x[2] == r.supplier_id and (x[1], x[0]) < (t, r.po_id)]
        assert r.hist_sku_unit_cost_mean == pytest.approx(np.mean(earlier) if earlier else r.unit_cost)
        assert r.hist_sku_unit_cost_std == pytest.approx(np.std(earlier, ddof=1) if len(earlier) > 1 else 0.0, abs=1e-6)


def test_leak_is_found_and_clean_builder_passes(spark):
    df = frame(spark).drop("f")
    clean = leakage.future_invariance(lambda d: d.withColumns(fd.lag_columns()), df, "2024-03-01", columns=list(fd.lag_columns())).first()
    leaky = leakage.future_invariance(
        lambda d: d.withColumn("peek", series.lead("demand_requested", 1)), df, "2024-03-01", columns=["peek"]
    ).first()
    assert clean.is_leakage_free and clean.max_abs_diff == 0
    assert not leaky.is_leakage_free and leaky.violating_columns == 1


def test_forecast_metrics_by_hand(spark):
    df = spark.createDataFrame([("m", 10.0, 12.0), ("m", 20.0, 16.0), ("m", 0.0, 0.0), ("m", None, 3.0)], "model string, actual double, forecast double")
    r = evaluate.forecast_metrics(df, ["model"]).first()
    assert (r.mae, r.wape, r.bias, r.n_samples) == (2.0, 0.2, -0.6667, 3)
    assert r.rmse == pytest.approx(np.sqrt(20 / 3), abs=1e-4)
    zero = spark.createDataFrame([("m", 0.0, 5.0)], "model string, actual double, forecast double")
    assert evaluate.forecast_metrics(zero, ["model"]).first().wape == 0.0


def test_ranking_metrics_with_ties(spark):
    rng = np.random.default_rng(2)
    score = np.round(rng.random(400), 2)
    label = (rng.random(400) < score).astype(int)
    r = evaluate.evaluate_classifier(spark.createDataFrame(pd.DataFrame({"label": label, "score": score}))).first()
    pos, neg = score[label == 1], score[label == 0]
    auc = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    ap = 0.0
    for s in sorted(set(score), reverse=True):
        seen = score >= s
        ap += (label[score == s].sum() / label.sum()) * (label[seen].sum() / seen.sum())
    assert r.roc_auc == pytest.approx(auc, abs=1e-4) and r.pr_auc == pytest.approx(ap, abs=1e-4)
    assert r.brier_score == pytest.approx(np.mean((np.clip(score, 1e-7, 1 - 1e-7) - label) ** 2), abs=1e-4)
    assert r.tp + r.fp + r.tn + r.fn == 400


def test_intervals_are_ordered(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 50, 500).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"horizon": "t+1", "actual": y, "forecast": np.maximum(y + rng.normal(size=500) * 9, 0)}))
    banded = evaluate.with_intervals(df, evaluate.interval_quantiles(df, ["horizon"]), ["horizon"])
    bad = banded.filter("lower_prediction_interval < 0 OR upper_prediction_interval < lower_prediction_interval")
    assert bad.count() == 0
    assert evaluate.interval_coverage(banded, ["horizon"]).first().empirical_coverage == pytest.approx(0.8, abs=0.05)
