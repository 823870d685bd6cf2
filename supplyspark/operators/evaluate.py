"""Forecast metrics, prediction intervals and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyspark.functions.exprs import clip, flag, half_even
from supplyspark.operators.quantiles import exact_percentiles, histogram_percentiles

METRICS = ("mae", "rmse", "wape", "smape", "bias", "n_samples")
SMAPE_EPSILON = 1e-8


def _r4(c: Column, digits: int | None) -> Column:
    return c if digits is None else half_even(c, digits)


# ------------------------------------------------------------------ forecasts
def forecast_metrics(
    df: DataFrame, keys: Sequence[str], actual: str = "actual", forecast: str = "forecast", digits: int | None = 4
) -> DataFrame:
    """MAE, RMSE, WAPE, sMAPE, bias and n per key, in one aggregate."""
    y, p = F.col(actual).cast("double"), F.col(forecast).cast("double")
    err, n = p - y, F.count(F.lit(1))
    total = F.sum(F.abs(y))
    measures = {
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(F.avg(err * err)),
        "wape": F.when(total == 0, 0.0).otherwise(F.sum(F.abs(err)) / F.nullif(total, F.lit(0.0))),
        "smape": F.avg(2.0 * F.abs(err) / (F.abs(y) + F.abs(p) + SMAPE_EPSILON)) * 100.0,
        "bias": F.avg(err),
    }
    valid = df.filter(y.isNotNull() & p.isNotNull())
    return valid.groupBy(*keys).agg(
        *[_r4(F.coalesce(c, F.lit(0.0)), digits).alias(name) for name, c in measures.items()], n.alias("n_samples")
    )


def best_model(results: DataFrame, by: Sequence[str] = ("horizon",), primary: str = "wape", second: str = "mae") -> DataFrame:
    """Winner per horizon: lowest WAPE, then lowest MAE, then model name."""
    order = F.struct(primary, second, "model")
    row = F.struct(*[c for c in results.columns if c not in by])
    return results.groupBy(*by).agg(F.min_by(row, order).alias("w")).select(
        *by, F.col("w.model").alias("selected_model"), F.col(f"w.{primary}").alias("primary_value"),
        *[F.col(f"w.{m}").alias(m) for m in METRICS if m in results.columns],
    )


def comparison_table(results: DataFrame) -> DataFrame:
    wanted = [c for c in ("model", "horizon", *METRICS) if c in results.columns]
    return results.select(*wanted).orderBy("horizon", "wape")


def interval_quantiles(
    validation: DataFrame,
    keys: Sequence[str],
    actual: str = "actual",
    forecast: str = "forecast",
    coverage: float = 0.80,
) -> DataFrame:
    """Residual quantiles on validation rows, per key."""
    tail = (1.0 - coverage) / 2.0
    residuals = validation.select(*keys, (F.col(actual).cast("double") - F.col(forecast)).alias("residual"))
    return exact_percentiles(residuals, keys, "residual", {"q_lower": tail, "q_upper": 1.0 - tail})


def with_intervals(df: DataFrame, quantiles: DataFrame, keys: Sequence[str], forecast: str = "forecast") -> DataFrame:
    joined = df.join(quantiles, list(keys))
    return (
        joined.withColumn("lower_prediction_interval", F.greatest(F.lit(0.0), F.col(forecast) + F.col("q_lower")))
        .withColumn(
            "upper_prediction_interval",
            F.greatest(F.col("lower_prediction_interval"), F.col(forecast) + F.col("q_upper")),
        )
        .drop("q_lower", "q_upper")
    )


def interval_coverage(df: DataFrame, keys: Sequence[str], actual: str = "actual", digits: int | None = 4) -> DataFrame:
    low, high = F.col("lower_prediction_interval"), F.col("upper_prediction_interval")
    inside = flag(F.col(actual).between(low, high))
    return df.filter(F.col(actual).isNotNull()).groupBy(*keys).agg(
        _r4(F.avg(inside), digits).alias("empirical_coverage"),
        _r4(F.avg(high - low), digits).alias("average_interval_width"),
        F.count(F.lit(1)).alias("n_samples"),
    )


def residual_summary(df: DataFrame, keys: Sequence[str] = ("horizon",), residual: str = "residual") -> DataFrame:
    """Mean, deviation and p10/p50/p90 of two-decimal residuals."""
    r = F.col(residual)
    moments = df.groupBy(*keys).agg(F.avg(r).alias("mean_residual"), F.stddev_samp(r).alias("std_residual"))
    points = histogram_percentiles(
        df, keys, residual, {"p10_residual": 0.1, "p50_residual": 0.5, "p90_residual": 0.9}
    )
    joined = moments.join(points, list(keys))
    return joined.select(*keys, *[half_even(c, 4).alias(c) for c in joined.columns if c not in keys])


def residual_breakdown(df: DataFrame, keys: Sequence[str], actual: str = "actual", residual: str = "residual") -> DataFrame:
    r = F.col(residual)
    return df.groupBy(*keys).agg(
        half_even(F.sum(F.abs(r)) / F.nullif(F.sum(F.col(actual)).cast("double"), F.lit(0.0)), 4).alias("wape"),
        half_even(F.avg(F.abs(r)), 4).alias("mae"),
        half_even(F.avg(-r), 4).alias("bias"),
    )


# ------------------------------------------------------------- classification
PROBABILITY_FLOOR = 1e-7


def confusion_metrics(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score", threshold: float = 0.5
) -> DataFrame:
    """Brier, Brier skill, log loss, confusion counts, precision, recall, F1."""
    y = F.col(label).cast("double")
    p = clip(score, PROBABILITY_FLOOR, 1.0 - PROBABILITY_FLOOR)
    hit = F.col(score) >= threshold
    n = F.count(F.lit(1))
    agg = df.filter(F.col(label).isNotNull()).groupBy(*keys).agg(
        n.alias("n_samples"),
        F.sum(F.col(label).cast("long")).alias("event_count"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(-(y * F.log(p) + (1.0 - y) * F.log(1.0 - p))).alias("log_loss"),
        F.count_if(hit & (y == 1)).alias("tp"),
        F.count_if(hit & (y == 0)).alias("fp"),
        F.count_if(~hit & (y == 1)).alias("fn"),
        F.count_if(~hit & (y == 0)).alias("tn"),
    )
    rate = F.col("event_count") / F.col("n_samples")
    reference = rate * (1.0 - rate)
    precision = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return agg.select(
        *keys,
        "n_samples",
        "event_count",
        half_even(rate, 4).alias("event_rate"),
        half_even("brier", 4).alias("brier_score"),
        half_even(F.when(reference <= 1e-12, 0.0).otherwise(1.0 - F.col("brier") / F.nullif(reference, F.lit(0.0))), 4).alias("brier_skill_score"),
        half_even("log_loss", 4).alias("log_loss"),
        half_even(precision, 4).alias("precision"),
        half_even(recall, 4).alias("recall"),
        half_even(f1, 4).alias("f1"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def score_curve(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score", cells: int = 1024
) -> DataFrame:
    """Running positives and rows from the highest score down, per distinct score.

    Rows are counted per distinct score first. Running sums are then split in
    two levels, score cells and scores inside a cell, so that neither level
    needs one task to see every score.
    """
    keys = list(keys)
    per_score = (
        df.filter(F.col(label).isNotNull())
        .groupBy(*keys, F.col(score).alias("score"))
        .agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
        .withColumn("_cell", F.floor(F.col("score") * cells).cast("int"))
    )
    per_cell = per_score.groupBy(*keys, "_cell").agg(F.sum("pos").alias("_cpos"), F.sum("n").alias("_cn"))
    scope = keys or [F.lit(1)]
    above = Window.partitionBy(*scope).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_cell.select(
        *keys,
        "_cell",
        F.coalesce(F.sum("_cpos").over(above), F.lit(0)).alias("_opos"),
        F.coalesce(F.sum("_cn").over(above), F.lit(0)).alias("_on"),
        F.sum("_cpos").over(Window.partitionBy(*scope)).alias("total_pos"),
        F.sum("_cn").over(Window.partitionBy(*scope)).alias("total_n"),
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    run = per_score.join(offsets, [*keys, "_cell"]).withColumns(
        {
            "tp": F.col("_opos") + F.sum("pos").over(inside),
            "seen": F.col("_on") + F.sum("n").over(inside),
        }
    )
    return run.select(*keys, "score", "pos", "n", "tp", "seen", "total_pos", "total_n")


def ranking_metrics(
    df: DataFrame,
    keys: Sequence[str] = (),
    label: str = "label",
    score: str = "score",
    top: Sequence[float] = (0.05, 0.10, 0.20),
) -> DataFrame:
    """ROC-AUC, average precision and top-k capture from one score curve.

    Score ties at the top-k boundary are taken pro rata (the expected value of
    breaking them at random).
    """
    curve = score_curve(df, keys, label, score)
    pos, n, tp, seen = (F.col(c).cast("double") for c in ("pos", "n", "tp", "seen"))
    p, rows = F.col("total_pos").cast("double"), F.col("total_n").cast("double")
    wins = F.sum((n - pos) * (tp - pos / 2.0))
    aggs = [
        F.max("total_pos").alias("_p"),
        F.max("total_n").alias("_n"),
        wins.alias("_wins"),
        F.sum(pos * (tp / seen)).alias("_ap"),
    ]
    for k in top:
        cut = F.greatest(F.lit(1.0), F.ceil(rows * k).cast("double"))
        share = clip((cut - (seen - n)) / n, 0.0, 1.0)
        aggs.append(F.sum(pos * share).alias(f"_top{int(k * 100)}"))
    out = curve.groupBy(*keys).agg(*aggs)
    p, negatives = F.col("_p").cast("double"), (F.col("_n") - F.col("_p")).cast("double")
    columns = [
        half_even(F.coalesce(F.col("_wins") / F.nullif(p * negatives, F.lit(0.0)), F.lit(0.5)), 4).alias("roc_auc"),
        half_even(F.coalesce(F.col("_ap") / F.nullif(p, F.lit(0.0)), F.lit(0.0)), 4).alias("pr_auc"),
    ]
    for k in top:
        captured = F.coalesce(F.col(f"_top{int(k * 100)}") / F.nullif(p, F.lit(0.0)), F.lit(0.0))
        columns.append(half_even(captured, 4).alias(f"top_{int(k * 100)}pct_capture"))
    return out.select(*keys, *columns)


# Inner edges of five uniform probability bins, upper edge included.
RELIABILITY_EDGES = (0.2, 0.4, 0.6000000000000001, 0.8)


def reliability_curve(
    df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score", edges=RELIABILITY_EDGES
) -> DataFrame:
    """Mean outcome and mean probability per bin; empty bins give no row."""
    index = sum((flag(F.col(score) > e) for e in edges), F.lit(0))
    return (
        df.filter(F.col(label).isNotNull())
        .groupBy(*keys, index.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(label)).alias("prob_true"),
            F.avg(F.col(score)).alias("prob_pred"),
        )
    )


def evaluate_classifier(df: DataFrame, keys: Sequence[str] = (), label: str = "label", score: str = "score") -> DataFrame:
    """Every scalar metric in one row per key."""
    base = confusion_metrics(df, keys, label, score)
    rank = ranking_metrics(df, keys, label, score)
    if keys:
        return base.join(rank, list(keys))
    one = rank.select(F.struct(*rank.columns)).scalar()
    return base.withColumns({c: one[c] for c in rank.columns})
