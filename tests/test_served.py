"""Served classifiers: choice, calibration, versions, and scores that survive saving and loading."""

from concurrent.futures import ThreadPoolExecutor
import tempfile

import pytest
from pyspark.sql import functions as F

from supplyspark.plans import models, served
from supplyspark.sources.commits import CommitConflict, CommitLog

NUMERIC, CATEGORICAL = ["x", "y"], ["kind"]


@pytest.fixture(scope="module")
def rows(spark):
    h = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    out = spark.range(3000).withColumns({"x": h(1), "noise": h(2), "kind": F.when(F.col("id") % 7 == 0, "b").when(F.col("id") % 11 == 0, F.lit(None)).otherwise("a")})
    out = out.withColumn("y", F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(h(3)))
    out = out.withColumn("label", ((F.col("x") + 0.3 * F.col("noise") > 0.8) | (F.col("kind") == "b")).cast("double"))
    out = out.withColumn("label", F.coalesce("label", F.lit(0.0)))
    split = F.when(F.col("id") % 10 < 6, "TRAIN").when(F.col("id") % 10 < 8, "VAL").otherwise("TEST")
    return out.withColumn("split", split).drop("noise")


@pytest.fixture(scope="module")
def candidate(rows):
    return served.choose(rows, NUMERIC, CATEGORICAL, ["id"], models.INVENTORY_SETTINGS, fit_rows=10_000, rounds=8)


def test_choice_and_calibration(rows, candidate):
    assert candidate.family in served.FAMILIES and candidate.figures["pr_auc"] > 0.9
    assert candidate.figures["brier_calibrated"] < candidate.figures["brier_raw"] + 0.01
    test = served.score(rows.filter("split = 'TEST'"), candidate.pipeline, "p")
    assert test.columns == [*rows.columns, "p"]
    r = test.agg(F.min("p"), F.max("p"), F.avg(F.col("p") - F.col("label"))).first()
    assert 0 <= r[0] < r[1] <= 1 and abs(r[2]) < 0.05


def test_equal_after_save_and_load(spark, rows, candidate):
    registry = served.Registry(spark, tempfile.mkdtemp(prefix="registry-"))
    with pytest.raises(LookupError):
        registry.current("m")
    assert registry.publish("m", candidate) == 1
    loaded = registry.load("m")
    a = {r.id: r.p for r in served.score(rows, candidate.pipeline, "p").select("id", "p").collect()}
    b = {r.id: r.p for r in served.score(rows, loaded, "p").select("id", "p").collect()}
    assert a == b and len(a) == 3000
    # A level and values that training never saw still get a score.
    odd = spark.createDataFrame([(1, None, 5.0, "never seen")], "id long, x double, y double, kind string")
    assert 0 <= served.score(odd, loaded, "p").first().p <= 1


def test_versions(spark, candidate):
    registry = served.Registry(spark, tempfile.mkdtemp(prefix="registry-"))
    other = served.Candidate(candidate.pipeline, "other", {"pr_auc": 0.5})
    assert [registry.publish("m", candidate), registry.publish("m", other)] == [1, 2]
    assert registry.current("m")[1]["family"] == "other"
    assert registry.restore("m", 1) == 3 and registry.current("m")[1]["family"] == candidate.family
    assert registry.load("m", 2).stages


def test_two_writers_get_different_numbers(spark):
    log = CommitLog(spark, tempfile.mkdtemp(prefix="log-"))
    log.put(1, {"by": "a"})
    with pytest.raises(CommitConflict):
        log.put(1, {"by": "b"})
    assert log.read(1) == {"by": "a"} and log.numbers() == [1]
    with ThreadPoolExecutor(8) as pool:
        taken = list(pool.map(lambda k: log.append({"by": k}), range(24)))
    assert sorted(taken) == list(range(2, 26)) and log.numbers() == list(range(1, 26))
    assert sorted(log.read(n)["by"] for n in taken) == list(range(24))
