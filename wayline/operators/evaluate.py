"""Classifier metrics from prediction tables; ``positive`` is always explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.columns import safe_div
from wayline.operators.ordered import quantiles


def confusion(pred: DataFrame, groups: list[str], label: str = "label", predicted: str = "prediction") -> DataFrame:
    return pred.groupBy(*groups, label, predicted).agg(F.count(F.lit(1)).alias("n"))


def binary_report(conf: DataFrame, groups: list[str], positive: Column, predicted_positive: Column) -> DataFrame:
    """Accuracy, precision, recall and F1 of the positive class from confusion counts."""
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    a = conf.groupBy(*groups).agg(
        s(positive & predicted_positive).alias("tp"), s(~positive & predicted_positive).alias("fp"),
        s(positive & ~predicted_positive).alias("fn"), s(~positive & ~predicted_positive).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return a.withColumns({
        "accuracy": safe_div(tp + tn, tp + fp + fn + tn), "precision": z(safe_div(tp, tp + fp)), "recall": z(safe_div(tp, tp + fn)),
        "f1": z(safe_div(2.0 * tp, 2.0 * tp + fp + fn)),
    })


def class_report(conf: DataFrame, groups: list[str], label: str = "label", predicted: str = "prediction") -> DataFrame:
    """Per class precision, recall, F1 and support, plus 'macro avg', 'weighted avg' and 'accuracy' rows."""
    side = conf.select(*groups, "n", (F.col(label) == F.col(predicted)).alias("_hit"), F.inline(F.array(
        F.struct(F.col(label).cast("string").alias("class"), F.lit(True).alias("_actual")),
        F.struct(F.col(predicted).cast("string").alias("class"), F.lit(False).alias("_actual")))))
    c = side.groupBy(*groups, "class").agg(
        F.coalesce(F.sum(F.when(F.col("_actual") & F.col("_hit"), F.col("n"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(F.col("_actual"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("_actual"), F.col("n"))), F.lit(0)).alias("_pp"))
    tp, sup, pp = F.col("_tp").cast("double"), F.col("support"), F.col("_pp")
    z = lambda x: F.coalesce(x, F.lit(0.0))
    c = c.withColumns({"precision": z(safe_div(tp, pp)), "recall": z(safe_div(tp, sup)), "f1": z(safe_div(2.0 * tp, sup + pp))})
    m = ["precision", "recall", "f1"]
    macro = c.groupBy(*groups).agg(F.lit("macro avg").alias("class"), *[F.avg(x).alias(x) for x in m], F.sum("support").alias("support"))
    weighted = c.groupBy(*groups).agg(
        F.lit("weighted avg").alias("class"), *[(F.sum(F.col(x) * sup) / F.nullif(F.sum(sup), F.lit(0))).alias(x) for x in m], F.sum("support").alias("support"))
    acc = c.groupBy(*groups).agg(
        F.lit("accuracy").alias("class"), *[(F.sum(tp) / F.nullif(F.sum(sup), F.lit(0))).alias(x) for x in m], F.sum("support").alias("support"))
    cols = [*groups, "class", *m, "support"]
    return c.select(*cols).unionByName(macro.select(*cols)).unionByName(weighted.select(*cols)).unionByName(acc.select(*cols))


# Swept thresholds.
THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]


def threshold_sweep(pred: DataFrame, groups: list[str], score: str, positive: Column, thresholds: list[float] | None = None) -> DataFrame:
    """Counts and metrics per threshold in one pass; ``best`` marks the highest accuracy (lowest threshold on ties)."""
    ts = thresholds or THRESHOLDS
    p = F.col(score)
    aggs = [x for i, t in enumerate(ts) for x in (
        F.count_if(positive & (p >= t)).alias(f"_tp{i}"), F.count_if(~positive & (p >= t)).alias(f"_fp{i}"))]
    a = pred.groupBy(*groups).agg(F.count_if(positive).alias("_p"), F.count_if(~positive).alias("_n"), *aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"_tp{i}").alias("tp"), (F.col("_n") - F.col(f"_fp{i}")).alias("tn"),
                              F.col(f"_fp{i}").alias("fp"), (F.col("_p") - F.col(f"_tp{i}")).alias("fn")) for i, t in enumerate(ts)])
    r = a.select(*groups, F.inline(rows))
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    r = r.withColumns({"accuracy": safe_div(tp + tn, tp + tn + fp + fn), "precision": z(safe_div(tp, tp + fp)), "recall": z(safe_div(tp, tp + fn))})
    first = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc("accuracy"), "threshold"))
    return r.withColumn("best", first == 1)


def probability_distribution(pred: DataFrame, groups: list[str], score: str, label: str) -> DataFrame:
    """Mean, median, sd, min and max of scores per class, and the share within 0.1 of 0.5."""
    p = F.col(score)
    a = pred.groupBy(*groups, label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"), F.min(p).alias("min"), F.max(p).alias("max"),
        F.count_if(F.abs(p - 0.5) < 0.1).alias("near"))
    return a.join(quantiles(pred, [*groups, label], score, {"median": 0.5}), [*groups, label]).withColumn(
        "near_share", F.col("near") / F.col("n"))


def normalised_importance(df: DataFrame, groups: list[str], value: str = "importance") -> DataFrame:
    """|value| / sum of |value| per group; the rows are features."""
    total = F.sum(F.abs(value)).over(Window.partitionBy(*groups))
    return df.withColumn(value, safe_div(F.abs(value), total))
