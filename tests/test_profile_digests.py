"""Duplicate rows are counted on digests of them."""

from pyspark.sql import functions as F

from supplyspark.operators import quality

ROWS = "a string, b string, x double, n long, d date"


def profiled(df):
    return quality.profile(df, "t").first()


def test_equal_rows_and_rows_that_are_nearly_equal(spark):
    same = [("u", "v", 1.0, 1, None)] * 3 + [(None, None, None, None, None)] * 2 + [("z", "z", 0.0, 0, None), ("z", "z", -0.0, 0, None)] + [("q", "q", float("nan"), 2, None)] * 2
    near = [("uv", "", 1.0, 1, None), ("", "uv", 1.0, 1, None), (None, "uv", 1.0, 1, None), ("uv", None, 1.0, 1, None), ("u", "v", 1.0, None, None), ("u", "v", None, 1, None)]
    df = spark.createDataFrame(same + near, ROWS)
    found = profiled(df)
    assert (found.rows, found.duplicate_rows) == (15, 2 + 1 + 1 + 1)
    assert found.duplicate_rows == df.count() - df.distinct().count()
    assert profiled(df.limit(0)).duplicate_rows == 0


def test_whole_rows_are_not_shuffled(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("key"), F.lit("text").alias("other"))
    plan = quality.profile(df, "t")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not [line for line in dealt if "key#" in line or "other#" in line]
