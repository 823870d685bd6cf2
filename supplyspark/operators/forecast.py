"""Baseline forecasters and the forecast output table.

A baseline forecast at origin t only reads days up to t, so it is a window
column of the series, not a lookup join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyspark.functions.exprs import half_even
from supplyspark.operators import evaluate, series as S
from supplyspark.operators.quantiles import histogram_percentiles
from supplyspark.operators.splits import TRAIN

# Forecast horizons, season length and moving-average windows.
HORIZONS = (1, 7, 14, 28)
SEASON = 7
WINDOWS = (7, 14, 28)


def seasonal_lag(horizon: int, season: int = SEASON) -> int:
    """Look-back from day t to the latest known day in the target's phase."""
    return season * -(-horizon // season) - horizon


def train_median(df: DataFrame, column: str = "demand_requested") -> Column:
    """Median of the training rows as a scalar subquery (units are integers)."""
    train = df.filter(F.col("split") == TRAIN)
    return histogram_percentiles(train, [], column, {"median": 0.5}).select("median").scalar()


def seasonal_naive(horizon: int, fallback: Column | float, x: str = "demand_requested") -> Column:
    k = seasonal_lag(horizon)
    seen = F.col(x) if k == 0 else S.lag(x, k)
    base = fallback if isinstance(fallback, Column) else F.lit(float(fallback))
    return F.greatest(F.coalesce(seen.cast("double"), base), F.lit(0.0))


def moving_average(window: int, x: str = "demand_requested") -> Column:
    return F.greatest(S.trailing_mean(x, window), F.lit(0.0))


def baseline_forecasts(
    df: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    windows: Sequence[int] = WINDOWS,
    fallback: Column | float | None = None,
    known_only: bool = True,
) -> DataFrame:
    """Long table (keys, split, horizon, model, actual, forecast) of all baselines.

    Forecasts beyond the last day have no actual value yet; ``known_only`` leaves them out.

    Every forecast is one column of a single window pass; the columns are then
    unrolled per row, so the series are sorted once for all horizons and models.
    """
    base = train_median(df) if fallback is None else fallback
    cols = {f"sn_{h}": seasonal_naive(h, base) for h in horizons}
    cols |= {f"ma_{w}": moving_average(w) for w in windows}
    cols |= {f"y_{h}": S.lead("demand_requested", h) for h in horizons}
    keep = [c for c in ("product_id", "warehouse_id", "date", "category", "split") if c in df.columns]
    wide = df.withColumns(cols)
    rows = []
    for h in horizons:
        forecasts = [("Seasonal Naive", f"sn_{h}")] + [(f"Moving Average (W={w})", f"ma_{w}") for w in windows]
        for model, c in forecasts:
            rows.append(
                F.struct(
                    F.lit(f"t+{h}").alias("horizon"),
                    F.lit(model).alias("model"),
                    F.col(f"y_{h}").cast("double").alias("actual"),
                    F.col(c).alias("forecast"),
                )
            )
    long = wide.select(*keep, F.explode(F.array(*rows)).alias("r")).select(*keep, "r.*")
    return long.filter(F.col("actual").isNotNull()) if known_only else long


def best_moving_average(metrics: DataFrame) -> DataFrame:
    """The moving-average window with the lowest WAPE per horizon."""
    averages = metrics.filter(F.col("model").startswith("Moving Average"))
    return evaluate.best_model(averages)


def forecast_output(selected: DataFrame, quantiles: DataFrame) -> DataFrame:
    """Published forecast table: 12 columns, rounded to two decimals."""
    banded = evaluate.with_intervals(selected, quantiles, ["horizon"])
    return banded.select(
        "date",
        "product_id",
        "warehouse_id",
        "category",
        F.col("actual").alias("actual_demand"),
        half_even("forecast", 2).alias("forecast"),
        "horizon",
        "model",
        half_even("lower_prediction_interval", 2).alias("lower_prediction_interval"),
        half_even("upper_prediction_interval", 2).alias("upper_prediction_interval"),
        half_even(F.col("actual") - F.col("forecast"), 2).alias("residual"),
        "split",
    )
