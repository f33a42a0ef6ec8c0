"""Rank-based tests and ROC curves from distinct-value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.pvalues import ks_limit_p, ks_p, mann_whitney_p
from wayline.operators.ordered import cumulative


def _two_sides(df: DataFrame, groups: list[str], value: str, first: Column) -> DataFrame:
    one = {"a": F.when(first, 1).otherwise(0).cast("bigint"), "b": F.when(first, 0).otherwise(1).cast("bigint")}
    return cumulative(df.where(F.col(value).isNotNull()), groups, value, one)


def mann_whitney(df: DataFrame, groups: list[str], value: str, first: Column) -> DataFrame:
    """U of the first side and its two-sided p: exact for few values without ties, else normal with tie and continuity correction."""
    c = _two_sides(df, groups, value, first)
    t = (F.col("a") + F.col("b")).cast("double")
    s = c.groupBy(*groups).agg(
        F.sum("a").alias("n1"), F.sum("b").alias("n2"),
        F.sum(F.col("a") * (F.col("b_below") + 0.5 * F.col("b"))).alias("u"), F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0.0))))
    z = F.greatest(F.abs(F.col("u") - n1 * n2 / 2.0) - 0.5, F.lit(0.0)) / F.nullif(sd, F.lit(0.0))
    p = mann_whitney_p(F.col("u"), F.col("n1"), F.col("n2"), F.col("_ties") > 0, z)
    return s.select(*groups, "n1", "n2", "u", z.alias("z"), p.alias("p_value"))


def kolmogorov_smirnov(df: DataFrame, groups: list[str], value: str, first: Column, limit: bool = False) -> DataFrame:
    """Largest distance between the two empirical distributions and its p: exact or finite, on request of the limit distribution."""
    c = _two_sides(df, groups, value, first)
    sizes = c.groupBy(*groups).agg(F.sum("a").alias("n1"), F.sum("b").alias("n2")).select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], "n1", "n2")
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    gap = F.abs((F.col("a_below") + F.col("a")) / F.nullif("n1", F.lit(0)) - (F.col("b_below") + F.col("b")) / F.nullif("n2", F.lit(0)))
    d = c.join(sizes, cond).groupBy(*groups, "n1", "n2").agg(F.max(gap).alias("d"))
    return d.withColumn("p_value", (ks_limit_p if limit else ks_p)(F.col("d"), F.col("n1"), F.col("n2")))


def roc_auc(df: DataFrame, groups: list[str], score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve; ties count half."""
    c = _two_sides(df, groups, score, positive)
    s = c.groupBy(*groups).agg(
        F.sum("a").alias("positives"), F.sum("b").alias("negatives"), F.sum(F.col("a") * (F.col("b_below") + 0.5 * F.col("b"))).alias("_u"))
    pairs = F.nullif(F.col("positives").cast("double") * F.col("negatives"), F.lit(0.0))
    return s.select(*groups, "positives", "negatives", (F.col("_u") / pairs).alias("auc"))


def roc_segments(df: DataFrame, groups: list[str], score: str, positive: Column) -> DataFrame:
    """One curve segment per distinct score: counts above it and at or above it."""
    c = _two_sides(df, groups, score, positive)
    sizes = c.groupBy(*groups).agg(F.sum("a").alias("p"), F.sum("b").alias("n")).select(
        *[F.col(g).alias(f"_g_{g}") for g in groups], "p", "n")
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return c.join(sizes, cond).select(
        *groups, F.col(score).alias("threshold"), "p", "n",
        (F.col("p") - F.col("a_below") - F.col("a")).alias("tp_above"), (F.col("n") - F.col("b_below") - F.col("b")).alias("fp_above"),
        (F.col("p") - F.col("a_below")).alias("tp"), (F.col("n") - F.col("b_below")).alias("fp"),
    )


def roc_points(segments: DataFrame, groups: list[str]) -> DataFrame:
    return segments.select(*groups, "threshold", (F.col("fp") / F.nullif("n", F.lit(0))).alias("fpr"), (F.col("tp") / F.nullif("p", F.lit(0))).alias("tpr"))


def mean_roc(segments: DataFrame, groups: list[str], fold: str, grid: int = 100) -> DataFrame:
    """Mean true-positive rate over folds on an even false-positive grid.

    Every segment with false positives yields the grid points it covers, so the
    interpolation needs no range join.
    """
    g = grid - 1
    ceil_div = lambda c: F.expr(f"({c} * {g} + n - 1) div n")
    seg = segments.where("fp > fp_above AND p > 0").withColumns({"_lo": ceil_div("fp_above"), "_hi": ceil_div("fp") - 1})
    pts = seg.where("_lo <= _hi").withColumn("k", F.explode(F.sequence("_lo", "_hi")))
    slope = (F.col("tp") - F.col("tp_above")) / (F.col("fp") - F.col("fp_above"))
    tpr = (F.col("tp_above") + (F.col("k") * F.col("n") / F.lit(float(g)) - F.col("fp_above")) * slope) / F.col("p")
    inner = pts.select(*groups, fold, "k", F.when(F.col("k") == 0, 0.0).otherwise(tpr).alias("tpr"))
    last = segments.where("p > 0 AND n > 0").groupBy(*groups, fold).agg(F.lit(g).cast("bigint").alias("k"), F.lit(1.0).alias("tpr"))
    every = inner.unionByName(last.select(*groups, fold, "k", "tpr"))
    return every.groupBy(*groups, "k").agg(F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr")).select(
        *groups, (F.col("k") / F.lit(float(g))).alias("fpr"), "mean_tpr", "std_tpr")
