"""One table of all forecasts, and the point-in-time join that reads it.

A row is the forecast that one model made for one series on one day for one
horizon. Baselines and learned models share the table, so they compete on the
same rows, and whoever needs a forecast gets the one that was made on the day
in question by the model that won on validation rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyspark.functions.exprs import half_even
from supplyspark.operators import evaluate
from supplyspark.operators.splits import VALIDATION

SERIES = ("product_id", "warehouse_id")
KEY = (*SERIES, "made_on", "horizon", "model")
COLUMNS = (*SERIES, "made_on", "category", "split", "family", "model", "actual", "forecast", "horizon")
BASELINE, LEARNED = "baseline", "learned"


def store_rows(forecasts: DataFrame, family: str) -> DataFrame:
    """Forecast rows (``date`` is the day they were made) in the form of the store."""
    return forecasts.withColumnRenamed("date", "made_on").withColumn("family", F.lit(family)).select(*COLUMNS)


def known(store: DataFrame) -> DataFrame:
    """Rows whose actual value is known, with ``date`` for the day the forecast was made."""
    return store.filter(F.col("actual").isNotNull()).withColumnRenamed("made_on", "date").drop("family")


def validation_metrics(store: DataFrame) -> DataFrame:
    return evaluate.forecast_metrics(known(store).filter(F.col("split") == VALIDATION), ["model", "horizon"])


def duplicates(store: DataFrame) -> DataFrame:
    """Keys that occur more than once; the store has to have none."""
    return store.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def as_of(
    rows: DataFrame,
    store: DataFrame,
    winners: DataFrame,
    horizon: str,
    column: str,
    day: str = "date",
    digits: int = 2,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """``rows`` with the winner's forecast for ``horizon`` that was made on the row's own day.

    ``winners`` has (horizon, model). The match is by series and day, so a row
    whose day has no forecast gets NULL, and none made later is ever used. Of
    the store only the folder of that horizon is read.
    """
    chosen = winners.filter(F.col("horizon") == horizon).select("model").distinct()
    made = store.filter(F.col("horizon") == horizon).join(chosen, "model", "left_semi")
    value = half_even(F.greatest(F.lit(0.0), F.col("forecast")), digits).alias(column)
    made = made.select(*keys, F.col("made_on").alias(day), value)
    return rows.join(made, [*keys, day], "left")
