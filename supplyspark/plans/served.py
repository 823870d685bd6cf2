"""Classifiers that are served: chosen on validation rows, calibrated, saved, loaded, and applied to whole tables.

A served model is one fitted Spark ML pipeline from raw columns to a calibrated
probability: casts, medians, scaling, level indicators, the classifier, and a
sigmoid over its margin. It is written once under a new folder; a commit in the
registry's log names that folder, and the newest commit is the current version.
Scores always come from the pipeline as it was loaded, never from the one in memory.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
import uuid

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyspark.operators import evaluate
from supplyspark.operators.splits import TRAIN, VALIDATION
from supplyspark.plans.models import FEW_LEVELS, SEED, TREE_FEATURES, _learner, best_family, bounded, positive_probability
from supplyspark.session import staged
from supplyspark.sources.commits import CommitLog

FAMILIES = ("logistic", "random_forest", "boosted")


def input_pipeline(numeric: Sequence[str], categorical: Sequence[str]) -> Pipeline:
    """From raw columns to ``features``. Levels that training never saw have zeros in all indicators."""
    casts = [f"CAST(`{c}` AS DOUBLE) AS `{c}__n`" for c in numeric] + [f"coalesce(CAST(`{c}` AS STRING), 'missing') AS `{c}__t`" for c in categorical]
    numbers, filled = [f"{c}__n" for c in numeric], [f"{c}__f" for c in numeric]
    texts, places, dummies = ([f"{c}__{x}" for c in categorical] for x in "tid")
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__"),
        Imputer(strategy="median", relativeError=0.0, inputCols=numbers, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True, withStd=True),
    ]
    if categorical:
        stages.append(StringIndexer(inputCols=texts, outputCols=places, stringOrderType="alphabetAsc", handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=places, outputCols=dummies, dropLast=True))
    stages.append(VectorAssembler(inputCols=["scaled", *dummies], outputCol="features"))
    return Pipeline(stages=stages)


def tree_stages(inputs: PipelineModel, categorical: Sequence[str]) -> list:
    """Stages that add ``TREE_FEATURES``, in which a column of many levels is the number of its level in binary digits.

    Trees hold a dense row of bins for each training row, too wide for an indicator of every level."""
    if not categorical:
        return []
    indexer = next(s for s in inputs.stages if isinstance(s, StringIndexerModel))
    many = {c: len(labels) for c, labels in zip(categorical, indexer.labelsArray) if len(labels) > FEW_LEVELS}
    if not many:
        return []
    digits = {
        f"{c}__b{k}": f"CAST(shiftright(IF(`{c}__i` < {n}, CAST(`{c}__i` AS BIGINT) + 1L, 0L), {k}) & 1L AS DOUBLE)"
        for c, n in many.items()
        for k in range(n.bit_length())
    }
    columns = [name for c in categorical for name in ([d for d in digits if d.startswith(f"{c}__b")] if c in many else [f"{c}__d"])]
    return [
        SQLTransformer(statement=f"SELECT *, {', '.join(f'{text} AS `{name}`' for name, text in digits.items())} FROM __THIS__"),
        VectorAssembler(inputCols=["scaled", *columns], outputCol=TREE_FEATURES),
    ]


@dataclass
class Candidate:
    """The chosen pipeline and the validation figures that it was chosen by."""

    pipeline: PipelineModel
    family: str
    figures: dict


def choose(
    rows: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    keys: Sequence[str],
    settings: Mapping,
    *,
    families: Sequence[str] = FAMILIES,
    fit_rows: int | None = None,
    rounds: int | None = None,
) -> Candidate:
    """Fit every family on class-balanced training rows, keep the one with the best
    validation average precision, and calibrate it on validation rows only.

    ``rows`` has ``split``, ``label`` and the inputs. All training and validation rows
    are used, unless the caller sets ``fit_rows``: then at most about so many training rows.
    """
    some = rows if fit_rows is None else bounded(rows, keys, fit_rows)
    used = staged(some.filter(F.col("split").isin(TRAIN, VALIDATION)), "labelled_rows")
    train, val = used.filter(F.col("split") == TRAIN), used.filter(F.col("split") == VALIDATION)
    counts = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("pos")).first()
    n, pos = counts["n"], max(counts["pos"] or 0.0, 1.0)
    weight = F.when(F.col("label") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * max(n - pos, 1.0)))
    inputs = input_pipeline(numeric, categorical).fit(train)
    more = tree_stages(inputs, categorical)
    tree_features = TREE_FEATURES if more else "features"
    # Encoded again by each learner, which keeps the rows in its own form: the vectors are far wider than the rows.
    encoded = PipelineModel([*inputs.stages, *more]).transform(used).select("split", "label", *dict.fromkeys(["features", tree_features]))
    fit_on = encoded.filter(F.col("split") == TRAIN).withColumn("weight", weight)
    held = encoded.filter(F.col("split") == VALIDATION)
    fitted = {family: _learner(family, n, settings, rounds, SEED, tree_features).fit(fit_on) for family in families}
    scored = [m.transform(held).select(F.lit(f).alias("model"), "label", positive_probability().alias("score")) for f, m in fitted.items()]
    metrics = staged(evaluate.evaluate_classifier(reduce(DataFrame.unionByName, scored), ["model"]), "family_metrics")
    family = best_family(metrics)
    slicer = VectorSlicer(inputCol="rawPrediction", outputCol="margin", indices=[1])
    sigmoid = LogisticRegression(
        maxIter=100, labelCol="label", featuresCol="margin", rawPredictionCol="calibratedRaw", probabilityCol="calibrated", predictionCol="calibratedClass"
    ).fit(slicer.transform(fitted[family].transform(held)))
    whole = PipelineModel([*inputs.stages, *(more if family != "logistic" else []), fitted[family], slicer, sigmoid])
    raw = metrics.filter(F.col("model") == family).first().asDict()
    after = evaluate.evaluate_classifier(score(val, whole, "score").select("label", "score")).first().asDict()
    figures = {"pr_auc": raw["pr_auc"], "roc_auc": raw["roc_auc"], "brier_raw": raw["brier_score"], "brier_calibrated": after["brier_score"], "fit_rows": n}
    return Candidate(whole, family, {k: float(v) for k, v in figures.items()})


def score(rows: DataFrame, pipeline: PipelineModel, column: str) -> DataFrame:
    """``rows`` with the calibrated probability; nothing else is added."""
    return pipeline.transform(rows).select(*[F.col(f"`{c}`") for c in rows.columns], F.get(vector_to_array("calibrated"), F.lit(1)).alias(column))


class Registry:
    """Versions of named models in the shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def log(self, name: str) -> CommitLog:
        return CommitLog(self.spark, f"{self.folder}/{name}/log")

    def publish(self, name: str, candidate: Candidate) -> int:
        """Save the pipeline, then make it the current version. A failed save leaves the old one current."""
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        candidate.pipeline.write().save(path)
        return self.log(name).append({"path": path, "family": candidate.family, **candidate.figures})

    def restore(self, name: str, version: int) -> int:
        """Make an older version current again, under a new number."""
        log = self.log(name)
        return log.append(log.read(version))

    def current(self, name: str) -> tuple[int, dict]:
        version = self.log(name).latest()
        if version is None:
            raise LookupError(f"no version of {name} has been published")
        return version, self.log(name).read(version)

    def load(self, name: str, version: int | None = None) -> PipelineModel:
        entry = self.current(name)[1] if version is None else self.log(name).read(version)
        return PipelineModel.load(entry["path"])
