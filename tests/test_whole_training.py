"""Classifiers learn from every training row, and trees from every level of a column with many."""

import tempfile

import pytest
from pyspark.sql import functions as F

from supplyspark import catalog
from supplyspark.operators import splits
from supplyspark.plans import models, served
from supplyspark.sources.adapter import StarSchema

TRAIN_ROWS = 24_000


class Stop(Exception):
    pass


@pytest.fixture
def view(spark):
    """Order rows with all inputs of the supplier classifiers, more than any of them used to read."""
    ids = spark.range(TRAIN_ROWS + 2000)
    numbers = {c: F.pmod(F.xxhash64("id", F.lit(c)), F.lit(100)).cast("double") for c in splits.SUPPLIER_FEATURES}
    rows = ids.withColumns(numbers | {c: F.lit("a") for c in splits.SUPPLIER_CATEGORICAL})
    split = F.when(F.col("id") < TRAIN_ROWS, splits.TRAIN).when(F.col("id") % 2 == 0, splits.VALIDATION).otherwise(splits.TEST)
    rows = rows.withColumns({"po_id": F.col("id").cast("string"), "split": split, "target_supplier_late": (F.col("id") % 3 == 0).cast("int")})
    out = catalog.View(StarSchema(spark, tempfile.mkdtemp(prefix="no-tables-")))
    out.__dict__["supplier_model_rows"] = rows
    return out


def test_supplier_classifiers_learn_from_every_training_row(view, monkeypatch):
    seen = []

    def fit(rows, *_, **__):
        seen.append(rows.filter(F.col("split") == splits.TRAIN).count())
        raise Stop

    monkeypatch.setattr(models, "fit_candidates", fit)
    with pytest.raises(Stop):
        catalog.QUERIES["supplier_classifiers"](view)
    assert seen == [TRAIN_ROWS]


def test_served_lateness_model_learns_from_every_training_row(view, monkeypatch):
    seen, choose = [], served.choose

    def first(rows, numeric, categorical, keys, settings, **more):
        seen.append(choose(rows, numeric[:2], categorical, keys, settings, families=("logistic",), **more).figures["fit_rows"])
        raise Stop

    monkeypatch.setattr(served, "choose", first)
    with pytest.raises(Stop):
        view.lateness_model
    assert seen == [TRAIN_ROWS]


def many_levels(spark, n=500):
    """Two rows of each level; the label is the level's own, not that of a range of levels."""
    ids = spark.range(4 * n).withColumn("level", F.format_string("S%04d", F.col("id") % n))
    split = F.when(F.col("id") < 2 * n, splits.TRAIN).when(F.col("id") < 3 * n, splits.VALIDATION).otherwise(splits.TEST)
    return ids.withColumns({"x": (F.col("id") % 7).cast("double"), "split": split, "label": (F.col("id") % 2).cast("double")})


def test_trees_tell_all_levels_apart(spark):
    rows = many_levels(spark)
    encoder = models.Encoder(["x"], ["level"], scale=False, for_trees=True).fit(rows)
    assert len(encoder.names) == 500 and encoder.tree_names == ["x", *(f"level digit {k}" for k in range(9))]
    found = {r.level: tuple(r.tree_features.toArray()[1:]) for r in encoder.transform(rows).select("level", "tree_features").collect()}
    assert len(set(found.values())) == 500 and found["S0000"] == (0.0,) * 9
    other = spark.createDataFrame([("never seen", 1.0), (None, 1.0)], "level string, x double")
    assert {tuple(r.tree_features.toArray()) for r in encoder.transform(other).collect()} == {(1.0,) + (0.0,) * 9}


def test_served_trees_learn_a_column_of_many_levels(spark):
    rows = many_levels(spark)
    chosen = served.choose(rows, ["x"], ["level"], ["id"], models.SUPPLIER_SETTINGS, families=("boosted",), rounds=10)
    assert chosen.figures["fit_rows"] == 1000 and chosen.figures["roc_auc"] > 0.95
    registry = served.Registry(spark, tempfile.mkdtemp(prefix="registry-"))
    registry.publish("m", chosen)
    odd = spark.createDataFrame([("never seen", 1.0), (None, None), ("S0007", 2.0)], "level string, x double")
    scores = [r.p for r in served.score(odd, registry.load("m"), "p").collect()]
    assert len(scores) == 3 and all(0 <= p <= 1 for p in scores)
