"""Model evaluation (E15-E18, E20) over a predictions DataFrame.

All metrics are aggregates over (y, p) rows; classification metrics derive
from the confusion counts, which have at most classes^2 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression_metrics(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row (mse, rmse, mae, r2) from one aggregate; r2 of a constant target is 1 (no error) or 0."""
    e = F.col(p) - F.col(y)
    m = pred.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("_vy"))
    return m.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                    F.when(F.col("_vy") != 0, 1 - F.col("mse") / F.col("_vy"))
                    .when(F.col("_vy") == 0, (F.col("mse") == 0).cast("double")).alias("r2"))


def accuracy(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """E16."""
    return pred.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def confusion_counts(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return pred.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(pred: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(actual, predicted, n) for every pair of labels seen as actual or
    predicted (Q13), zeros included; ``confusion_counts`` is the sparse form."""
    return grid_of_counts(confusion_counts(pred, y, p))


def grid_of_counts(counts: DataFrame) -> DataFrame:
    """``confusion_matrix`` from (actual, predicted, n)."""
    seen = counts.select(F.struct(F.col("actual").alias("v")).alias("label")) \
        .union(counts.select(F.struct(F.col("predicted").alias("v"))))
    grid = seen.agg(F.collect_set("label").alias("labels")) \
        .select(F.explode("labels").alias("a"), "labels").select("a", F.explode("labels").alias("b")) \
        .select(F.col("a.v").alias("actual"), F.col("b.v").alias("predicted"))
    same = grid["actual"].eqNullSafe(counts["actual"]) & grid["predicted"].eqNullSafe(counts["predicted"])
    return grid.join(counts, same, "left").select(grid["actual"], grid["predicted"],
                                                  F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support) from confusion counts."""
    a = counts.groupBy(F.col("actual").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("tp"))
    pr = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("pred_n"))
    j = a.join(pr, "label", "full_outer").na.fill(0, ["support", "tp", "pred_n"])
    return j.select("label", "tp", (F.col("pred_n") - F.col("tp")).alias("fp"),
                    (F.col("support") - F.col("tp")).alias("fn"), "support")


def _safe_div(a, b):
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def classification_metrics(pred: DataFrame, y: str = "y", p: str = "p", average: str = "weighted",
                           positive=None) -> DataFrame:
    """(accuracy, precision, recall, f1).

    ``binary``: scores of the positive label (default: the larger label,
    Q12); ``weighted``: support-weighted mean over actual labels.  Zero
    divisions give 0."""
    return metrics_of_counts(confusion_counts(pred, y, p), average, positive)


def metrics_of_counts(counts: DataFrame, average: str = "weighted", positive=None) -> DataFrame:
    """``classification_metrics`` from (actual, predicted, n)."""
    pc = per_class(counts)
    prec = _safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    rec = _safe_div(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = _safe_div(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r"))
    pc = pc.withColumn("_p", prec).withColumn("_r", rec).withColumn("_f", f1)
    acc = (F.sum("tp") / F.sum("support")).alias("accuracy")
    if average == "binary":
        if positive is None:
            # positive = the larger label
            s = pc.agg(acc, F.max_by("_p", "label").alias("precision"), F.max_by("_r", "label").alias("recall"),
                       F.max_by("_f", "label").alias("f1"))
        else:
            is_pos = F.col("label") == F.lit(positive)
            s = pc.agg(acc, F.coalesce(F.max(F.when(is_pos, F.col("_p"))), F.lit(0.0)).alias("precision"),
                       F.coalesce(F.max(F.when(is_pos, F.col("_r"))), F.lit(0.0)).alias("recall"),
                       F.coalesce(F.max(F.when(is_pos, F.col("_f"))), F.lit(0.0)).alias("f1"))
    elif average == "weighted":
        tot = F.sum("support")
        s = pc.agg(acc, (F.sum(F.col("_p") * F.col("support")) / tot).alias("precision"),
                   (F.sum(F.col("_r") * F.col("support")) / tot).alias("recall"),
                   (F.sum(F.col("_f") * F.col("support")) / tot).alias("f1"))
    else:
        raise ValueError(f"unknown average {average!r}")
    return s


def best_model(metrics: DataFrame, metric: str, higher_is_better: bool) -> DataFrame:
    """The model with the best score; ties go to the earlier model
    (``model_order``).  Input: (model, model_order, metric, value) rows."""
    m = metrics.where(F.col("metric") == metric)
    key = F.struct((-F.col("value") if higher_is_better else F.col("value")).alias("s"), F.col("model_order").alias("o"))
    return m.agg(F.min_by("model", key).alias("best_model"))
