"""Supervised models (E11-E22) with Spark ML estimators.

``train_model`` follows the reference's flow -- encode, impute, detect the
task, split, fit two models, score -- but every step is a Spark job:
statistics and splits are DataFrame expressions, the fits are Spark ML
estimators whose work (gradients, tree statistics) is distributed.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes as C
from . import features as FE
from . import metrics as M
from .cache import hold

REGRESSION_METRICS = ("mse", "rmse", "mae", "r2")
CLASSIFICATION_METRICS = ("accuracy", "precision", "recall", "f1")
# Bytes of the training points of a forest (a bin for each feature, a count for each tree) that one partition holds.
PARTITION_BYTES = 64 * 2**20


@dataclass
class TrainResult:
    task: str
    classification_type: str | None
    features: list
    metrics: DataFrame                  # (model, model_order, metric, value)
    timings: dict
    importances: DataFrame | None       # (model, feature, importance, rank)
    confusion: DataFrame | None         # (model, actual, predicted, n)
    best_model: str
    predictions: dict = field(default_factory=dict)
    label_codes: DataFrame | None = None
    steps: list = field(default_factory=list)

    def metrics_table(self) -> DataFrame:
        """One row per model, one column per metric, plus training time."""
        spark = self.metrics.sparkSession
        t = spark.createDataFrame([(m, float(s)) for m, s in self.timings.items()], "model string, training_seconds double")
        wide = self.metrics.groupBy("model", "model_order").pivot("metric").agg(F.first("value"))
        return wide.join(F.broadcast(t), "model", "left").orderBy("model_order")


def regression_models(seed: int, num_trees: int, max_depth: int):
    return [
        ("Linear Regression", LinearRegression(featuresCol="features", labelCol="label", regParam=0.0,
                                               elasticNetParam=0.0, solver="auto")),
        ("Random Forest Regressor", RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=num_trees,
                                                          maxDepth=max_depth, featureSubsetStrategy="all", seed=seed)),
    ]


def classification_models(seed: int, num_trees: int, max_depth: int, n_train: int):
    return [
        ("Logistic Regression", LogisticRegression(featuresCol="features", labelCol="label", maxIter=1000,
                                                   regParam=1.0 / max(n_train, 1), elasticNetParam=0.0,
                                                   standardization=False)),
        ("Random Forest Classifier", RandomForestClassifier(featuresCol="features", labelCol="label",
                                                            numTrees=num_trees, maxDepth=max_depth,
                                                            featureSubsetStrategy="sqrt", seed=seed)),
    ]


def _importances(spark, model: str, values: list[float], widths: dict[str, int], codes: DataFrame | None) -> DataFrame:
    """(model, feature, importance, rank), one row per number or level (``column_level``), largest first.

    The names of the levels are joined to the slots where the levels are; the driver holds only what the model holds."""
    slots, at = [], 0
    for name, width in widths.items():
        text = width is not None
        slots += [(model, name, width - j if text else None, float(v)) for j, v in enumerate(values[at:at + (width or 1)])]
        at += width or 1
    slots.sort(key=lambda t: -t[3])
    table = spark.createDataFrame([(*t, i + 1) for i, t in enumerate(slots)],
                                  "model string, column_name string, code int, importance double, rank int")
    if codes is None:
        return table.select("model", F.col("column_name").alias("feature"), "importance", "rank")
    feature = F.when(F.col("label").isNull(), F.col("column_name")).otherwise(F.concat_ws("_", "column_name", "label"))
    return table.join(codes, ["column_name", "code"], "left").select("model", feature.alias("feature"), "importance", "rank")


def _partitions_needed(n_rows: int, n_features: int, num_trees: int) -> int:
    """Partitions among which a training table is dealt out, so that no task of a fit holds more than ``PARTITION_BYTES``."""
    return math.ceil(n_rows * (100 + 4 * (n_features + num_trees)) / PARTITION_BYTES)


def prepare(df: DataFrame, target: str, key: str, features=None, model_type: str = "auto",
            test_size: float = 0.2, impute_on: str = "all", num_trees: int = 100):
    """(frame with key, label, features vector, is_test), feature
    names, task, classification type, label codes, steps, slots per feature
    (None: a number), level codes of the text features.

    ``impute_on="all"`` takes the medians over the whole table as the
    reference does; ``"train"`` takes them over the training rows only.

    A table file is far smaller than the points of a fit, so its few partitions
    are dealt out anew where they are too large for one task."""
    if impute_on not in ("all", "train"):
        raise ValueError("impute_on must be 'all' or 'train'")
    steps = []
    x, names, levels, slots = FE.encode_features(df, target, features, key)
    if x.where(F.col(target).isNull()).limit(1).count() > 0:
        raise ValueError(f"target {target!r} has missing values; drop or fill them first")
    task, ctype, n_classes = FE.detect_task(x, target, model_type)
    n_parts = _partitions_needed(df.count(), sum(slots.get(c) or 1 for c in names), num_trees)
    codes = None
    if task == "classification" and not C.is_numeric(C.dtype_of(x, target)):
        x, codes = FE.encode_labels(x, target, "label")
        steps.append(f"label encoding of {target}")
    else:
        x = x.withColumn("label", F.col(target).cast("double"))
    if task == "classification":
        x = FE.stratified_split(x, "label", key, test_size, few_classes=n_parts > 1 and n_classes <= FE.MAX_CLASS_VALUES)
    else:
        x = FE.random_split(x, key, test_size)
    numbers = [c for c in names if C.is_numeric(C.dtype_of(x, c))]
    x, med = FE.median_impute(x, numbers, fit_on=x.where(~F.col("is_test")) if impute_on == "train" else None)
    if med:
        steps.append(f"median imputation ({impute_on} rows): {', '.join(med)}")
    widths = {c: slots.get(c) for c in names}
    va = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    x = va.transform(x).select(key, "label", "features", "is_test")
    if n_parts > 1:
        x = x.repartition(n_parts)
    return x, names, task, ctype, codes, steps, widths, levels


def train_model(df: DataFrame, target: str, key: str, model_type: str = "auto", features=None,
                test_size: float = 0.2, seed: int = 42, num_trees: int = 100, max_depth: int = 5,
                impute_on: str = "all", only: str | None = None) -> TrainResult:
    """Fit and score two models (or the one named ``only``); best by RMSE or accuracy."""
    data, names, task, ctype, codes, steps, widths, levels = prepare(df, target, key, features, model_type, test_size, impute_on, num_trees)
    data = hold(data)
    train = data.where(~F.col("is_test"))
    test = data.where(F.col("is_test"))
    spark = df.sparkSession
    if task == "regression":
        models = regression_models(seed, num_trees, max_depth)
        metric_names = REGRESSION_METRICS
    else:
        models = classification_models(seed, num_trees, max_depth, train.count())
        metric_names = CLASSIFICATION_METRICS
    if only is not None:
        models = [m for m in models if m[0] == only]
        if not models:
            raise ValueError(f"no {task} model named {only!r}")
    rows, timings, imps, confs, preds = [], {}, [], [], {}
    for order, (name, est) in enumerate(models):
        t0 = time.time()
        model = est.fit(train)
        pred = model.transform(test).withColumnRenamed("label", "y").withColumnRenamed("prediction", "p")
        cols = [key, "y", "p"] + (["probability"] if "probability" in pred.columns else [])
        scored = pred.select(*cols)
        if "probability" in cols:
            scored = scored.withColumn("probability", vector_to_array("probability"))
        scored = preds[name] = hold(scored)   # test rows are scored once; all tables below come from this one
        if task == "regression":
            m = M.regression_metrics(scored).collect()[0]
        else:
            avg = "weighted" if ctype == "multiclass" else "binary"
            counts = hold(M.confusion_counts(scored))
            m = M.metrics_of_counts(counts, average=avg).collect()[0]
            confs.append(M.grid_of_counts(counts).withColumn("model", F.lit(name)))
        timings[name] = round(time.time() - t0, 3)
        rows += [(name, order, k, None if m[k] is None else float(m[k])) for k in metric_names]
        if hasattr(model, "featureImportances"):
            imps.append(_importances(spark, name, model.featureImportances.toArray().tolist(), widths, levels))
    metrics = spark.createDataFrame(rows, "model string, model_order int, metric string, value double")
    crit, higher = ("rmse", False) if task == "regression" else ("accuracy", True)
    best = M.best_model(metrics, crit, higher).collect()[0]["best_model"]
    importances = reduce(DataFrame.unionByName, imps) if imps else None
    confusion = None
    for c in confs:
        confusion = c if confusion is None else confusion.unionByName(c)
    return TrainResult(task, ctype, names, metrics, timings, importances, confusion, best, preds, codes, steps)


def top_importances(result: TrainResult, k: int = 15) -> DataFrame:
    """The k most important features per tree model."""
    if result.importances is None:
        raise ValueError("no tree model in this result")
    return result.importances.where(F.col("rank") <= k)
