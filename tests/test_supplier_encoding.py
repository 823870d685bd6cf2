"""The supplier classifiers keep every published feature, the supplier id too."""

from supplyspark import catalog
from supplyspark.operators import splits
from supplyspark.plans import models


def test_indicators_are_sparse_and_keep_their_meaning(spark):
    rows = [(float(i), f"S{i:04d}", "A" if i % 2 else "B") for i in range(500)]
    train = spark.createDataFrame(rows, "x double, supplier_id string, tier string")
    encoder = models.Encoder(["x"], ["supplier_id", "tier"], scale=False).fit(train)
    assert encoder.names == ["x", *(f"supplier_id=S{i:04d}" for i in range(1, 500)), "tier=B"]
    other = spark.createDataFrame(
        [(1.0, "S0000", "A"), (1.0, "S0007", "B"), (1.0, "new", "B"), (1.0, None, None)], train.schema
    )
    vectors = [r.features for r in encoder.transform(other).collect()]
    on = [{encoder.names[i] for i, x in enumerate(v.toArray()) if x} for v in vectors]
    assert on == [{"x"}, {"x", "supplier_id=S0007", "tier=B"}, {"x", "tier=B"}, {"x"}]
    assert all(v.size == len(encoder.names) and type(v).__name__ == "SparseVector" for v in vectors)


def test_supplier_classifiers_use_the_supplier_id(spark, monkeypatch):
    seen = {}

    class Stop(Exception):
        pass

    def fit(rows, categorical, features, **_):
        seen.update(categorical=tuple(categorical), features=tuple(features), columns=rows.columns)
        raise Stop

    monkeypatch.setattr(models, "fit_candidates", fit)
    from supplyspark.sources.adapter import StagedStar

    try:
        catalog.QUERIES["supplier_classifiers"](catalog.View(StagedStar(spark, "/root/testdata/sf0.001")))
    except Stop:
        pass
    assert seen["features"] == splits.SUPPLIER_FEATURES and seen["categorical"] == splits.SUPPLIER_CATEGORICAL
    assert "supplier_id" in seen["columns"]
