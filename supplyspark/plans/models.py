"""Learned models on Spark ML: ridge and boosted demand forecasts, risk classifiers.

Training runs on a staged table: Spark ML makes many passes, and a lost
executor must only cost a re-read. The driver keeps fitted models, a few
metric rows and the list of categories, nothing that grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyspark.operators import evaluate, splits
from supplyspark.session import staged

# Ridge strengths and boosted-tree candidates.
ALPHAS = (0.1, 1.0, 10.0, 100.0, 500.0, 1000.0)
TREE_CONFIGS = (
    {"name": "balanced_default", "rounds": 100, "depth": 5, "step": 0.08, "subsample": 0.8, "min_rows": 1},
    {"name": "conservative_regularized", "rounds": 100, "depth": 4, "step": 0.05, "subsample": 0.85, "min_rows": 5},
    {"name": "deep_expressive", "rounds": 120, "depth": 6, "step": 0.06, "subsample": 0.8, "min_rows": 3},
)
SEED = 42
TREE_PARTITION_ROWS = 100_000
# Classifier settings of the two risk models.
INVENTORY_SETTINGS = {
    "logistic": {"c": 0.5},
    "random_forest": {"trees": 120, "depth": 8, "min_rows": 15},
    "boosted": {"rounds": 100, "depth": 5, "step": 0.08},
}
SUPPLIER_SETTINGS = {
    "logistic": {"c": 1.0},
    "random_forest": {"trees": 100, "depth": 6, "min_rows": 10},
    "boosted": {"rounds": 80, "depth": 4, "step": 0.06},
}


FEW_LEVELS = 32  # as many as trees have bins for a number
TREE_FEATURES = "tree_features"


@dataclass
class Encoder:
    """Median imputation, optional scaling and one-hot without the first level.

    Fitted on training rows only. A level that training never saw gets zeros in
    every indicator, like the dropped first level. Indicators are one sparse
    vector per column, so a column may have very many levels.

    Trees hold a dense row of bins for each training row, so with ``for_trees`` there
    is a second vector, ``tree_features``, in which a column of more than ``FEW_LEVELS``
    levels is the number of its level in binary digits.
    """

    numeric: Sequence[str]
    categorical: Sequence[str]
    scale: bool = True
    for_trees: bool = False
    names: list[str] = field(default_factory=list)
    tree_names: list[str] = field(default_factory=list)

    def fit(self, train: DataFrame) -> Encoder:
        doubles = train.select(*[F.col(c).cast("double").alias(c) for c in self.numeric], *self.categorical)
        self._filled = [f"{c}__f" for c in self.numeric]
        self._imputer = Imputer(strategy="median", relativeError=0.0, inputCols=list(self.numeric), outputCols=self._filled).fit(doubles)
        self._levels: dict[str, list[str]] = {}
        for c in self.categorical:
            known = doubles.select(F.coalesce(c, F.lit("missing")).alias(c))
            indexer = StringIndexer(inputCol=c, outputCol="i", stringOrderType="alphabetAsc").fit(known)
            self._levels[c] = list(indexer.labelsArray[0])[1:]
        self._number_vector = VectorAssembler(inputCols=self._filled, outputCol="numbers")
        if self.scale:
            numbers = self._number_vector.transform(self._imputer.transform(doubles))
            self._scaler = StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True).fit(numbers)
        dummies = [f"{c}={level}" for c, levels in self._levels.items() for level in levels]
        self.names = [*self.numeric, *dummies]
        coded = [_digit_names(c, n) if len(n) > FEW_LEVELS else [f"{c}={level}" for level in n] for c, n in self._levels.items()]
        self.tree_names = [*self.numeric, *(name for names in coded for name in names)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        kept = df.columns
        casted = df.withColumns({c: F.col(c).cast("double") for c in self.numeric})
        numbers = self._number_vector.transform(self._imputer.transform(casted))
        if self.scale:
            numbers = self._scaler.transform(numbers)
        inputs = ["scaled" if self.scale else "numbers"]
        tree_inputs = list(inputs)
        for i, (c, levels) in enumerate(self._levels.items()):
            if levels:
                known = numbers.withColumn(f"_c{i}", F.coalesce(F.col(c), F.lit("missing")))
                # Kept as one more index: the first level and those never seen. The encoder drops that last index.
                indexer = StringIndexerModel.from_labels(levels, f"_c{i}", f"_i{i}", handleInvalid="keep")
                indexed = indexer.transform(known)
                numbers = OneHotEncoder(inputCol=f"_i{i}", outputCol=f"_d{i}", dropLast=True).fit(indexed).transform(indexed)
                inputs.append(f"_d{i}")
                if self.for_trees and len(levels) > FEW_LEVELS:
                    digits = digit_columns(f"_i{i}", len(levels))
                    numbers = numbers.withColumns({f"_b{i}_{k}": digit for k, digit in enumerate(digits)})
                    tree_inputs += [f"_b{i}_{k}" for k in range(len(digits))]
                else:
                    tree_inputs.append(f"_d{i}")
        out = VectorAssembler(inputCols=inputs, outputCol="features").transform(numbers)
        if self.for_trees:
            out = VectorAssembler(inputCols=tree_inputs, outputCol=TREE_FEATURES).transform(out)
        vectors = ["features", *([TREE_FEATURES] if self.for_trees else [])]
        return out.select(*[F.col(c) for c in kept if c not in self.numeric], *[F.col(c) for c in kept if c in self.numeric], *vectors)


def digit_columns(index: str, n_levels: int) -> list[Column]:
    """Binary digits that tell all levels apart, of 1 + ``index``; zeros for the index after the last level."""
    number = F.when(F.col(index) < n_levels, F.col(index).cast("long") + 1).otherwise(F.lit(0).cast("long"))
    return [F.shiftright(number, k).bitwiseAND(F.lit(1)).cast("double") for k in range(n_levels.bit_length())]


def _digit_names(column: str, levels: Sequence[str]) -> list[str]:
    return [f"{column} digit {k}" for k in range(len(levels).bit_length())]


# -------------------------------------------------------------------- forecasting
def horizon_rows(features: DataFrame, horizon: int, train_end: str, val_end: str) -> DataFrame:
    """Model inputs, target and split for one horizon, warm-up rows removed from training."""
    target = f"target_demand_t_plus_{horizon}"
    splits.assert_whitelist([*splits.DEMAND_NUMERIC, *splits.DEMAND_CATEGORICAL])
    rows = splits.with_split(features.filter(F.col(target).isNotNull()), "date", train_end, val_end)
    warm = (F.col("split") != splits.TRAIN) | (F.col("has_sufficient_history_28d") == 1)
    keys = ["product_id", "warehouse_id", "date", "split"]
    wanted = [c for c in (*splits.DEMAND_NUMERIC, *splits.DEMAND_CATEGORICAL) if c not in keys]
    return rows.filter(warm).select(*keys, *wanted, F.col(target).cast("double").alias("label"))


def bounded(rows: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """At most about ``limit`` training rows, chosen by the hash of their keys; all rows of the other splits.

    Fitting is iterative, so its cost is bounded by a stated number of labelled
    rows. Validation and test rows are never left out.
    """
    n = _part(rows, splits.TRAIN).count()
    if n <= limit:
        return rows
    drawn = F.pmod(F.xxhash64(*keys), F.lit(1 << 30)) < int(limit / n * (1 << 30))
    return rows.filter((F.col("split") != splits.TRAIN) | drawn)


def _part(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("split") == name)


def together(call: Callable, items: Sequence) -> list:
    """``call`` on each item, all at once: boosting runs thousands of short jobs one after another, which leave most cores idle."""
    with ThreadPoolExecutor(max(1, len(items))) as pool:
        return list(pool.map(call, items))


def _wape(predicted: DataFrame) -> float:
    clipped = predicted.withColumn("forecast", F.greatest(F.col("prediction"), F.lit(0.0)))
    return evaluate.forecast_metrics(clipped, [], "label", "forecast", digits=None).first()["wape"]


def ridge(train: DataFrame, alpha: float):
    """Ridge on ``features``: minimises sum of squared errors + alpha * |w|^2.

    The learner divides the penalty by the label deviation and the loss by the
    row count, so its parameter is alpha * std / n.
    """
    stats = train.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("s")).first()
    strength = alpha * (stats["s"] or 1.0) / stats["n"]
    learner = LinearRegression(
        regParam=strength, elasticNetParam=0.0, standardization=False, solver="normal", featuresCol="features"
    )
    return learner.fit(train)


def tune_ridge(rows: DataFrame, alphas: Sequence[float] = ALPHAS):
    """(encoder, model, alpha, validation wape) of the best strength."""
    encoder = Encoder(splits.DEMAND_NUMERIC, splits.DEMAND_CATEGORICAL).fit(_part(rows, splits.TRAIN))
    encoded = encoder.transform(rows).select("split", "label", "features").persist()
    train, val = _part(encoded, splits.TRAIN), _part(encoded, splits.VALIDATION)
    fits = []
    for alpha in alphas:
        model = ridge(train, alpha)
        fits.append((_wape(model.transform(val)), alpha, model))
    encoded.unpersist()
    wape, alpha, model = min(fits, key=lambda f: (f[0], f[1]))
    return encoder, model, alpha, wape


def tune_trees(rows: DataFrame, configs: Sequence[Mapping] = TREE_CONFIGS, seed: int = SEED):
    """(encoder, model, config name, validation wape) of the best boosted trees."""
    encoder = Encoder(splits.DEMAND_NUMERIC, splits.DEMAND_CATEGORICAL, scale=False).fit(_part(rows, splits.TRAIN))
    # Each level of each tree is a job with a task for each partition, so small partitions cost more than their rows.
    some = max(1, rows.count() // TREE_PARTITION_ROWS)
    encoded = encoder.transform(rows).select("split", "label", "features").coalesce(some).persist()
    train, val = _part(encoded, splits.TRAIN), _part(encoded, splits.VALIDATION)

    def fit(c: Mapping) -> tuple:
        learner = GBTRegressor(
            maxIter=c["rounds"], maxDepth=c["depth"], stepSize=c["step"], subsamplingRate=c["subsample"],
            minInstancesPerNode=c["min_rows"], seed=seed, labelCol="label", featuresCol="features",
        )
        model = learner.fit(train)
        return _wape(model.transform(val)), c["name"], model

    fits = together(fit, configs)
    encoded.unpersist()
    wape, name, model = min(fits, key=lambda f: (f[0], f[1]))
    return encoder, model, name, wape


def forecast_rows(rows: DataFrame, encoder: Encoder, model, label: str, horizon: int) -> DataFrame:
    predicted = model.transform(encoder.transform(rows))
    return predicted.select(
        "product_id",
        "warehouse_id",
        "date",
        "category",
        "split",
        F.lit(f"t+{horizon}").alias("horizon"),
        F.lit(label).alias("model"),
        F.col("label").alias("actual"),
        F.greatest(F.col("prediction"), F.lit(0.0)).alias("forecast"),
    )


FORECAST_FAMILIES = ("ridge", "boosted")


def best_forecasts(rows: DataFrame, horizon: int, family: str) -> DataFrame:
    """Forecasts of the best setting of a family, fitted on all training rows."""
    if family == "ridge":
        encoder, model, alpha, _ = tune_ridge(rows)
        return forecast_rows(rows, encoder, model, f"Ridge (alpha={alpha})", horizon)
    encoder, model, name, _ = tune_trees(rows)
    return forecast_rows(rows, encoder, model, f"Boosted ({name})", horizon)


def importance_rows(spark: SparkSession, names: Sequence[str], values: Sequence[float], top_n: int = 15) -> DataFrame:
    """Feature importances (one number per model input), largest first."""
    pairs = list(zip(names, [float(v) for v in values]))
    return spark.createDataFrame(pairs, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    ).limit(top_n)


# ------------------------------------------------------------------------- risk
# Feature family by name fragment, first match wins.
INVENTORY_FAMILIES = (
    (("supply", "inventory", "buffer", "stock"), "Inventory Buffer"),
    (("demand", "forecast"), "Demand & Forecast"),
    (("stockout", "lost_sales"), "Historical Stockout"),
    (("warehouse",), "Warehouse Utilization"),
    (("category", "criticality"), "Product Dimension"),
)
SUPPLIER_FAMILIES = (
    (("hist_", "recent_", "trend"), "Historical Track Record"),
    (("capacity", "volume", "active"), "Capacity & Volume Pressure"),
    (("lead_time", "delay"), "Lead Time & Variance"),
    (("order_", "quantity", "cost"), "Order Attributes"),
    (("supplier", "tier"), "Supplier Profile"),
)


def with_family(importances: DataFrame, families) -> DataFrame:
    out = None
    for fragments, family in families:
        hit = F.lit(False)
        for fragment in fragments:
            hit = hit | F.col("feature").contains(fragment)
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return importances.withColumn("family", out.otherwise("Other"))


def _learner(family: str, n: int, settings: Mapping, rounds: int | None, seed: int, tree_features: str = TREE_FEATURES):
    vector = "features" if family == "logistic" else tree_features
    common = {"labelCol": "label", "featuresCol": vector, "weightCol": "weight"}
    own = settings[family] if family in settings else {}
    if family == "logistic":
        return LogisticRegression(
            maxIter=1000, regParam=1.0 / (own["c"] * n), elasticNetParam=0.0, standardization=False, **common
        )
    if family == "random_forest":
        return RandomForestClassifier(
            numTrees=rounds or own["trees"], maxDepth=own["depth"], minInstancesPerNode=own["min_rows"], seed=seed, **common
        )
    if family == "boosted":
        return GBTClassifier(
            maxIter=rounds or own["rounds"], maxDepth=own["depth"], stepSize=own["step"], subsamplingRate=0.8, seed=seed, **common
        )
    raise ValueError(f"unknown model family: {family}")


def risk_rows(df: DataFrame, features: Sequence[str], label: str, forbidden: Sequence[str], keys: Sequence[str]) -> DataFrame:
    splits.assert_whitelist(features, features, forbidden, context="risk model")
    extra = [k for k in keys if k not in features]
    return df.select(*extra, "split", *features, F.col(label).cast("double").alias("label"))


def fit_candidates(
    rows: DataFrame,
    categorical: Sequence[str],
    features: Sequence[str],
    families: Sequence[str] = ("logistic", "random_forest", "boosted"),
    rounds: int | None = None,
    seed: int = SEED,
    settings: Mapping = INVENTORY_SETTINGS,
):
    """Fit every family on class-balanced training rows. ``rounds`` overrides the number of trees.

    Returns the encoder, the fitted models and one row of validation metrics
    per model.
    """
    numeric = [f for f in features if f not in categorical]
    encoder = Encoder(numeric, categorical, for_trees=True).fit(_part(rows, splits.TRAIN))
    # Encoded again by each learner, which keeps the rows in its own form: the vectors are far wider than the rows.
    encoded = encoder.transform(rows).select("split", "label", "features", TREE_FEATURES)
    train, val = _part(encoded, splits.TRAIN), _part(encoded, splits.VALIDATION)
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    n, pos = counts["n"], max(counts["pos"] or 0.0, 1.0)
    neg = max(n - pos, 1.0)
    weighted = train.withColumn("weight", F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * neg)))
    models, scored = {}, []
    for family in families:
        model = _learner(family, n, settings, rounds, seed).fit(weighted)
        models[family] = model
        scored.append(
            model.transform(val).select(F.lit(family).alias("model"), "label", positive_probability().alias("score"))
        )
    metrics = staged(evaluate.evaluate_classifier(reduce(DataFrame.unionByName, scored), ["model"]), "classifier_metrics")
    return encoder, models, metrics


def positive_probability():
    return F.get(vector_to_array("probability"), F.lit(1))


def best_family(metrics: DataFrame) -> str:
    """Highest validation average precision, then model name."""
    return metrics.orderBy(F.desc("pr_auc"), "model").first()["model"]


@dataclass
class Calibrated:
    """Sigmoid calibration of a fitted classifier on validation rows only."""

    encoder: Encoder
    model: object
    calibrator: object

    def score(self, rows: DataFrame, out: str = "score") -> DataFrame:
        raw = _raw_vector(self.model.transform(self.encoder.transform(rows)))
        kept = [c for c in raw.columns if c not in ("features", TREE_FEATURES, "rawPrediction", "probability", "prediction", "raw")]
        calibrated = self.calibrator.transform(raw.select(*kept, F.col("raw").alias("features")))
        return calibrated.select(*kept, positive_probability().alias(out))


def _raw_vector(predicted: DataFrame) -> DataFrame:
    """Log-odds of the raw probability as a one-element vector."""
    p = F.least(F.greatest(positive_probability(), F.lit(1e-7)), F.lit(1.0 - 1e-7))
    odds = predicted.withColumn("_z", F.log(p / (1.0 - p)))
    return VectorAssembler(inputCols=["_z"], outputCol="raw").transform(odds).drop("_z")


def calibrate(encoder: Encoder, model, validation: DataFrame) -> Calibrated:
    raw = _raw_vector(model.transform(encoder.transform(validation))).select("label", F.col("raw").alias("features"))
    platt = LogisticRegression(maxIter=100, labelCol="label", featuresCol="features").fit(raw)
    return Calibrated(encoder, model, platt)


def classifier_importances(spark: SparkSession, encoder: Encoder, model, families, top_n: int = 15) -> DataFrame:
    if hasattr(model, "featureImportances"):
        return with_family(importance_rows(spark, encoder.tree_names, model.featureImportances.toArray(), top_n), families)
    return with_family(importance_rows(spark, encoder.names, abs(model.coefficients.toArray()), top_n), families)
