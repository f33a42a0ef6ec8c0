"""Report tables: rankings, summaries, histograms and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.ordered import cumulative, quantiles, top_n


def trend_code_pivot(t: DataFrame, domains: list[str]) -> DataFrame:
    """Feature x model rows, a column per domain: +1 converging, -1 diverging, times 1.5 when significant, 0 when absent."""
    code = F.when(F.col("trend") == "converging", 1.0).when(F.col("trend") == "diverging", -1.0).otherwise(0.0)
    weight = F.when(F.col("significant"), 1.5).otherwise(1.0)
    return (
        t.withColumn("_code", code * weight).groupBy("layer", "feature", "model").pivot("domain", domains).agg(F.first("_code"))
        .fillna(0.0, subset=domains)
    )


def competition_rank(df: DataFrame, groups: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ties share the best rank; descending."""
    return df.withColumn(out, F.rank().over(Window.partitionBy(*groups).orderBy(F.desc(value))))


def sequential_rank(df: DataFrame, groups: list[str], value: str, tiebreak: str, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(value), tiebreak)))


def top_per_group(df: DataFrame, groups: list[str], value: str, tiebreak: str, n: int) -> DataFrame:
    """First n rows per group."""
    return top_n(df, groups, [F.desc(value), F.col(tiebreak)], n, salt=tiebreak, out="rank")


def importance_summary(ranked: DataFrame) -> DataFrame:
    """Per (statistic, feature): average and best importance, best and average rank, number of models."""
    return ranked.groupBy("statistic", "feature").agg(
        F.avg("importance").alias("avg_importance"), F.max("importance").alias("max_importance"), F.min("rank").alias("min_rank"),
        F.avg("rank").alias("avg_rank"), F.count(F.lit(1)).alias("appears_in_models"))


def importance_consistency(summary: DataFrame) -> DataFrame:
    return summary.groupBy("feature").agg(
        F.avg("avg_rank").alias("avg_rank"), F.avg("avg_importance").alias("avg_importance"), F.count(F.lit(1)).alias("num_statistics"))


def best_model(results: DataFrame, groups: list[str], score: str = "accuracy", model: str = "model") -> DataFrame:
    """Model with the highest score per group; the name breaks ties."""
    best = F.max_by(F.col(model), F.struct(F.col(score), F.col(model)))
    return results.groupBy(*groups).agg(best.alias(model), F.max(score).alias(score))


def spread(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Mean, population sd, min, max and range."""
    v = F.col(value)
    return df.groupBy(*groups).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("range"))


def fixed_bins(df: DataFrame, groups: list[str], value: str, low: Column, high: Column, bins: int) -> DataFrame:
    """Histogram of equal bins over [low, high]; the right edge belongs to the last bin, values outside are clipped out."""
    width = (high - low) / F.lit(float(bins))
    v = F.col(value)
    inside = df.where((v >= low) & (v <= high))
    b = F.least(F.floor(F.coalesce((v - low) / F.nullif(width, F.lit(0.0)), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*groups, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantile_histogram(df: DataFrame, groups: list[str], value: str, bins: int, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Histogram of equal bins between two quantiles of each group; values outside are clipped out."""
    q = quantiles(df, groups, value, {"x_min": low, "x_max": high})
    inside = df.join(q, groups)
    counts = fixed_bins(inside, [*groups, "x_min", "x_max"], value, F.col("x_min"), F.col("x_max"), bins)
    return counts.select(*groups, "x_min", "x_max", "bin", "n")


def dispersion(df: DataFrame, label: str, x: str, y: str) -> DataFrame:
    """Spread of 2-D points around their label's centroid; below two points the measures are NULL."""
    c = df.groupBy(label).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"))
    dx, dy = F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")
    out = df.join(c, label).withColumn("_d", F.sqrt(dx * dx + dy * dy)).groupBy(label).agg(
        F.count(F.lit(1)).alias("n_samples"), F.var_pop(x).alias("variance_1"), F.var_pop(y).alias("variance_2"),
        (F.var_pop(x) + F.var_pop(y)).alias("total_variance"), F.avg("_d").alias("mean_distance"), F.stddev_pop("_d").alias("std_distance"),
        F.max("_d").alias("max_distance"))
    measures = [c for c in out.columns if c not in (label, "n_samples")]
    return out.withColumns({m: F.when(F.col("n_samples") >= 2, F.col(m)) for m in measures})


def length_compliance(df: DataFrame, groups: list[str], actual: str, target: str) -> DataFrame:
    """How close lengths are to their targets; the median is the upper one for even counts."""
    diff = F.coalesce(F.abs(F.col(actual) - F.col(target)) * 100.0 / F.nullif(F.col(target), F.lit(0)), F.lit(0.0))
    d = df.withColumn("_d", diff)
    agg = d.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_d") <= 5).alias("within_5pct"), F.count_if(F.col("_d") <= 10).alias("within_10pct"),
        F.avg("_d").alias("avg_diff"))
    cum = cumulative(d, groups, "_d", {"_c": F.lit(1)}).join(agg.select(*groups, "total"), groups)
    mid = F.floor(F.col("total") / 2)
    med = cum.where((F.col("_c_below") <= mid) & (mid < F.col("_c_below") + F.col("_c"))).select(*groups, F.col("_d").alias("median_diff"))
    return agg.join(med, groups)


def level_comparison(df: DataFrame, key: str, level: str, value: str, levels: list[str]) -> DataFrame:
    """One column per level and their range."""
    p = df.groupBy(key).pivot(level, levels).agg(F.first(value))
    return p.withColumn("range", F.greatest(*levels) - F.least(*levels))
