"""Exact interpolated percentiles that do not gather a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]
) -> DataFrame:
    """Percentiles of values on a coarse grid (integers, rounded numbers).

    Equal values are counted first, so each group reaches its final aggregate
    as one row per distinct value.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(
        *[F.percentile(value, F.lit(p), F.col("_n")).alias(name) for name, p in probs.items()]
    )


def _celled(df: DataFrame, keys: list[str], value: str, buckets: int) -> DataFrame:
    """Rows as (keys, ``_v``, ``_cell``); cells rise with the value."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    quartiles = F.percentile_approx("_v", [0.25, 0.5, 0.75], 1000)
    span = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), quartiles.alias("_quartiles"))
    unit = F.coalesce(
        F.nullif(F.col("_quartiles")[2] - F.col("_quartiles")[0], F.lit(0.0)), F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(1.0)
    )

    def scaled(column: str) -> Column:
        x = (F.col(column) - F.col("_quartiles")[1]) / unit
        return F.signum(x) * F.log1p(F.abs(x))

    width = F.nullif(scaled("_hi") - scaled("_lo"), F.lit(0.0))
    cell = F.least(F.floor((scaled("_v") - scaled("_lo")) / width * buckets), F.lit(buckets - 1))
    return _join(rows, span, keys).withColumn("_cell", F.coalesce(cell, F.lit(0)).cast("int")).drop("_lo", "_hi", "_quartiles")


def cell_counts(df: DataFrame, keys: Sequence[str], value: str, buckets: int = 4096) -> DataFrame:
    """Rows in each cell of the rank search below."""
    return _celled(df, list(keys), value, buckets).groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("rows"))


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], buckets: int = 4096
) -> DataFrame:
    """Percentiles of arbitrary doubles, equal to linear interpolation on the
    sorted group.

    Rank search in three steps: the group range is cut into ``buckets`` cells
    and counted; running counts over the cells tell which cells hold the
    wanted ranks; only rows of those cells are ranked. No task sees more than
    one cell of distinct values. Cells are equal on a logarithmic scale around
    the approximate median, in units of the approximate quartile distance, so a
    far outlier adds a few empty cells and does not press the others together.
    """
    keys = list(keys)
    celled = _celled(df, keys, value, buckets)
    counts = celled.groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_n"))
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn"))
    upto = Window.partitionBy(*keys).orderBy("_cell")
    cells = cells.withColumns(
        {
            "_before": F.sum("_cn").over(upto) - F.col("_cn"),
            "_total": F.sum("_cn").over(Window.partitionBy(*keys)),
        }
    )
    asked = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p")) for name, p in probs.items()])
    position = F.col("_q.p") * (F.col("_total") - 1)
    ranks = (
        cells.withColumn("_q", F.explode(asked))
        .withColumn("_pos", position)
        .withColumn("_side", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("_rank", F.when(F.col("_side") == 0, F.floor("_pos")).otherwise(F.ceil("_pos")))
        .filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_cn")))
        .select(*keys, "_cell", "_before", "_rank", "_pos", "_side", F.col("_q.name").alias("_name"))
    )
    within = Window.partitionBy(*keys, "_cell").orderBy("_v")
    needed = counts.join(ranks.select(*keys, "_cell").distinct(), [*keys, "_cell"], "left_semi")
    ranked = needed.withColumn("_upto", F.sum("_n").over(within))
    hit = ranked.join(ranks, [*keys, "_cell"]).filter(
        (F.col("_rank") - F.col("_before") >= F.col("_upto") - F.col("_n"))
        & (F.col("_rank") - F.col("_before") < F.col("_upto"))
    )
    ends = hit.groupBy(*keys, "_name").agg(
        F.max(F.when(F.col("_side") == 0, F.col("_v"))).alias("_a"),
        F.max(F.when(F.col("_side") == 1, F.col("_v"))).alias("_b"),
        F.max(F.col("_pos") - F.floor("_pos")).alias("_f"),
    )
    point = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")
    return ends.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_name") == name, point)).alias(name) for name in probs]
    )


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Attach one-row-per-key values; without keys through a scalar subquery."""
    if keys:
        return left.join(right, list(keys))
    one = right.select(F.struct(*right.columns)).scalar()
    return left.withColumns({c: one[c] for c in right.columns})
