"""Classification metrics of hard 0/1 predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty).cast("double"))


def long_predictions(df: DataFrame, preds: Sequence[str], label: str = "label") -> DataFrame:
    """(model, label, pred) from one prediction column for each model."""
    cells = [F.struct(F.lit(p).alias("model"), F.col(p).alias("pred")) for p in preds]
    return df.select(F.col(label).alias("label"), F.inline(F.array(*cells)))


def _cells(by: Sequence[str], preds: DataFrame) -> DataFrame:
    is_ = lambda y, p: F.count_if((F.col("label") == y) & (F.col("pred") == p))
    return preds.groupBy(*by).agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(0, 0).alias("tn"), is_(1, 0).alias("fn"))


def binary_metrics(preds: DataFrame) -> DataFrame:
    """A32. Per model, positive class 1: auc (null with one class), f1, recall, precision, acc; zero denominators give 0."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    auc = (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2
    return _cells(["model"], preds).select(
        "model", auc.alias("auc"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(tp, tp + fn).alias("recall"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
    )


def class_report(preds: DataFrame) -> DataFrame:
    """A33. Per model and class: precision, recall, f1, support."""
    cells = F.array(
        F.struct(F.lit(0).alias("class"), F.col("tn").alias("hit"), F.col("fn").alias("false_"), F.col("fp").alias("miss")),
        F.struct(F.lit(1).alias("class"), F.col("tp").alias("hit"), F.col("fp").alias("false_"), F.col("fn").alias("miss")),
    )
    t = _cells(["model"], preds).select("model", F.inline(cells))
    hit, false_, miss = F.col("hit"), F.col("false_"), F.col("miss")
    return t.select(
        "model", "class", ratio(hit, hit + false_).alias("precision"), ratio(hit, hit + miss).alias("recall"),
        ratio(2 * hit, 2 * hit + false_ + miss).alias("f1"), (hit + miss).alias("support"),
    )


def macro_metrics(preds: DataFrame, digits: int = 4) -> DataFrame:
    """A33. Per model: means over the two classes, accuracy and auc, rounded half to even."""
    means = class_report(preds).groupBy("model").agg(
        F.avg("f1").alias("f1"), F.avg("recall").alias("recall"), F.avg("precision").alias("precision")
    )
    rest = binary_metrics(preds).select("model", "auc", "acc")
    return means.join(rest, "model").select("model", *[F.bround(c, digits).alias(c) for c in ("auc", "f1", "recall", "precision", "acc")])


def confusion(preds: DataFrame) -> DataFrame:
    """A34. (model, label, pred, n, cell_type, proportion)."""
    t = preds.groupBy("model", "label", "pred").agg(F.count("*").alias("n"))
    kind = F.when(F.col("label") == F.col("pred"), F.when(F.col("label") == 1, "TP").otherwise("TN")).otherwise(F.when(F.col("pred") == 1, "FP").otherwise("FN"))
    return t.withColumn("cell_type", kind).withColumn("proportion", F.col("n") / F.sum("n").over(W.partitionBy("model")))


def run_summary(results: DataFrame, metrics: Sequence[str], base: str = "M1", new: str = "M2") -> DataFrame:
    """A40. results: a row for each run with dataset, model and metrics. 'mean±std' (n) with 4 digits for each metric, and on the new
    model its gain over the base model, signed."""
    aggs = [f(m).alias(f"{m}_{n}") for m in metrics for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    t = results.groupBy("dataset", "model").agg(*aggs)
    for m in metrics:
        of_base = F.max(F.when(F.col("model") == base, F.col(f"{m}_mean"))).over(W.partitionBy("dataset"))
        t = t.withColumn(f"{m}_delta", F.when((F.col("model") == new) & of_base.isNotNull(), F.format_string("%+.4f", F.col(f"{m}_mean") - of_base)).otherwise(""))
    text = [F.format_string("%.4f±%.4f", F.col(f"{m}_mean"), F.col(f"{m}_std")).alias(m) for m in metrics]
    return t.select("dataset", "model", *text, *[f"{m}_delta" for m in metrics])
