"""Series at part grain against loops over dense days, and how they grow."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from supplyspark import catalog
from supplyspark.operators import ragged
from supplyspark.sources.adapter import StagedStar

START = datetime.date(2024, 1, 1)


def series(seed, n=60, span=200):
    rng = np.random.default_rng(seed)
    days = np.sort(rng.choice(span, n, replace=False))
    return {int(d): int(q) for d, q in zip(days, rng.integers(1, 9, n), strict=True)}


def rows_of(spark, many, column):
    rows = [(p, "W", START + datetime.timedelta(days=d), q) for p, s in many.items() for d, q in s.items()]
    return spark.createDataFrame(rows, f"part_id long, warehouse_id string, date date, {column} long")


def test_features_against_dense_days(spark):
    many = {1: series(1), 2: series(2, 5), 3: {7: 4}, 4: series(3, 180)}
    found = {(r.part_id, (r.date - START).days): r for r in ragged.demand_features(rows_of(spark, many, "demand_requested")).collect()}
    assert len(found) == sum(map(len, many.values()))
    for part, s in many.items():
        first = min(s)
        dense = {d: s.get(d, 0) for d in range(first, max(s) + 1)}
        for d in s:
            r = found[part, d]
            assert r.age_days == d - first
            for k in ragged.LAGS:
                assert r[f"demand_lag_{k}"] == dense.get(d - k)
            for w in ragged.WINDOWS:
                past = [dense[x] for x in range(max(first, d - w), d)]
                assert r[f"rolling_sum_{w}"] == sum(past) and r[f"active_days_{w}"] == sum(x > 0 for x in past)
                assert r[f"rolling_max_{w}"] == (max(past) if past else None)
                assert r[f"rolling_min_{w}"] == (min(past) if past else None)
                assert r[f"rolling_mean_{w}"] == (pytest.approx(np.mean(past), abs=1e-4) if past else None)
            past = [dense[x] for x in range(max(first, d - 28), d)]
            assert r.rolling_std_28 == (pytest.approx(np.std(past, ddof=1), abs=1e-4) if len(past) > 1 else None)


def test_ledger_against_a_loop(spark):
    leaving, coming = {1: series(4), 2: {3: 50}}, {1: series(5), 2: {1: 2, 90: 7}}
    moves = ragged.flows(rows_of(spark, leaving, "demand_requested"), rows_of(spark, coming, "po_received"))
    stock = ragged.ledger(moves, 10)
    found = {(r.part_id, (r.date - START).days): r for r in stock.collect()}
    totals = {r.part_id: r for r in ragged.stock_summary(stock).collect()}
    for part in leaving:
        level, held, empty, unmet, days = 10, 0, 0, 0, sorted({*leaving[part], *coming[part]})
        for d in range(days[0], days[-1] + 1):
            before = level
            level = before + coming[part].get(d, 0) - leaving[part].get(d, 0)
            short, level = max(0, -level), max(0, level)
            if d in days:
                r = found[part, d]
                assert (r.beginning_inventory, r.ending_inventory, r.stockout_quantity) == (before, level, short)
            held, empty, unmet = held + level, empty + (level == 0), unmet + short
        t = totals[part]
        assert (t.days, t.movement_days, t.empty_days, t.unmet_units) == (days[-1] - days[0] + 1, len(days), empty, unmet)
        assert t.mean_stock == pytest.approx(held / t.days, abs=1e-4)


def test_series_grow_with_the_data_and_are_dealt_evenly(spark):
    """More data has more series and rows; no partition of the windows holds much more than others."""
    counts = {}
    for sf in ("sf0.001", "sf0.01"):
        demand = StagedStar(spark, f"/root/testdata/{sf}").part_demand
        counts[sf] = demand.agg(F.count("*"), F.count_distinct(*ragged.SERIES)).first()
    assert counts["sf0.01"][0] > 8 * counts["sf0.001"][0] and counts["sf0.01"][1] > 8 * counts["sf0.001"][1]
    sizes = [r["count"] for r in demand.repartition(32, *ragged.SERIES).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 1.3 * np.median(sizes)
    longest = demand.groupBy(*ragged.SERIES).count().agg(F.max("count")).first()[0]
    assert longest <= catalog.View(StagedStar(spark, "/root/testdata/sf0.01")).star.dim_date.count()
