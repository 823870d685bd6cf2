"""Forecast models of all horizons are fitted side by side, and each horizon's rows are written once."""

import threading

from supplyspark import catalog
from supplyspark.operators.features import demand as fd
from supplyspark.plans import models
from supplyspark.sources.adapter import StarSchema


def test_horizons_meet_while_they_are_fitted(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("P", "W", "t")], "product_id string, warehouse_id string, horizon string")
    meet, written = threading.Barrier(len(fd.HORIZONS), timeout=60), []

    def made(given, horizon, family):
        if family == models.FORECAST_FAMILIES[0]:
            meet.wait()  # breaks unless every horizon is under way
        return rows

    monkeypatch.setattr(models, "best_forecasts", made)
    monkeypatch.setattr(models, "horizon_rows", lambda features, horizon, *_: rows)
    monkeypatch.setattr(catalog.forecast_store, "store_rows", lambda df, _: df)
    monkeypatch.setattr(catalog, "staged", lambda df, name, *_: written.append(name) or df)
    view = catalog.View(StarSchema(spark, str(tmp_path)))
    view.__dict__["demand_features"] = rows
    assert view.learned_store.count() == len(fd.HORIZONS) * len(models.FORECAST_FAMILIES)
    assert sorted(n for n in written if n.startswith("rows_")) == sorted(f"rows_{h}" for h in fd.HORIZONS)


def test_together_keeps_the_order():
    assert models.together(lambda x: x * x, [3, 1, 2]) == [9, 1, 4] and models.together(str, []) == []
