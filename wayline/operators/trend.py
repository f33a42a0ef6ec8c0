"""Yearly human-versus-model effects and their trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.columns import safe_div
from wayline.functions.pvalues import t_p, trend_class
from wayline.operators.geometry import REST


def slope_of(y: Column, x: Column) -> Column:
    """Aggregate: least-squares slope; one that moves y by less than rounding noise over the range of x is 0."""
    s, at = F.regr_slope(y, x), F.when(y.isNotNull(), x)
    return F.when(F.abs(s) * (F.max(at) - F.min(at)) <= REST * F.max(F.abs(y)), 0.0).otherwise(s)


def moments(df: DataFrame, groups: list[str], features: list[str]) -> DataFrame:
    """n, mean and sum of squared deviations per group and feature.

    All features are aggregated in one pass over the rows; only the small
    result is turned long.
    """
    aggs = [x for i, f in enumerate(features) for x in (
        F.count(f).alias(f"_n{i}"), F.avg(f).alias(f"_a{i}"), (F.var_pop(f) * F.count(f)).alias(f"_v{i}"))]
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_n{i}").alias("n"), F.col(f"_a{i}").alias("mean"),
                              F.col(f"_v{i}").alias("m2")) for i, f in enumerate(features)])
    return df.groupBy(*groups).agg(*aggs).select(*groups, F.inline(rows)).where("n > 0")


def yearly_effects(m: DataFrame, keys: list[str], reference: Column, model: str = "model", year: str = "year") -> DataFrame:
    """Means, difference, Cohen's d and Student's t per (keys, model, year).

    ``m`` holds moments per side; years without both sides are left out.
    """
    w = Window.partitionBy(*keys, year)
    ref = lambda c: F.max(F.when(reference, F.col(c))).over(w)
    both = m.withColumns({"hn": ref("n"), "hm": ref("mean"), "hv": ref("m2")}).where(~reference & (F.col("hn") > 0))
    n1, n2 = F.col("hn"), F.col("n")
    dof = n1 + n2 - 2
    pooled = F.sqrt(safe_div(F.col("hv") + F.col("m2"), dof))
    diff = F.col("hm") - F.col("mean")
    t = safe_div(diff, pooled * F.sqrt(1.0 / n1 + 1.0 / n2))
    return both.select(
        *keys, model, year, F.col("hm").alias("human_mean"), F.col("mean").alias("llm_mean"), diff.alias("mean_difference"),
        F.when(pooled == 0, 0.0).otherwise(safe_div(diff, pooled)).alias("cohens_d"),
        F.coalesce(t, F.lit(0.0)).alias("t_statistic"), F.coalesce(t_p(t, dof), F.lit(1.0)).alias("p_value"),
        n1.alias("human_n"), n2.alias("llm_n"),
    )


def regress(df: DataFrame, groups: list[str], x: str, y: Column, prefix: str = "") -> DataFrame:
    """Least-squares line per group: slope, intercept, r, p and standard error.

    One point gives NULLs; a constant y gives slope 0, r 0, p 1.
    """
    d = df.withColumn("_y", y)
    y_, x_ = F.col("_y"), F.col(x).cast("double")
    known = y_.isNotNull() & x_.isNotNull()
    a = d.where(known).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("_n"), slope_of(y_, x_).alias("_s"), F.regr_intercept("_y", x_).alias("_i"),
        F.var_pop("_y").alias("_vy"), F.var_pop(x_).alias("_vx"), F.covar_pop("_y", x_).alias("_c"),
    )
    flat = F.col("_vy") == 0
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_c") / F.nullif(F.sqrt(F.col("_vy") * F.col("_vx")), F.lit(0.0))))
    dof = F.col("_n") - 2
    a = a.withColumn("_r", F.when(flat, 0.0).otherwise(r))
    t = F.col("_r") * F.sqrt(dof / F.nullif((1 - F.col("_r")) * (1 + F.col("_r")), F.lit(0.0)))
    p = F.when(flat, 1.0).when(dof <= 0, 0.0).otherwise(F.coalesce(t_p(t, dof), F.lit(0.0)))
    few = F.col("_n") < 2
    se = F.when(dof > 0, F.sqrt((1 - F.col("_r") * F.col("_r")) * F.col("_vy") / F.col("_vx") / F.nullif(dof, F.lit(0))))
    out = {"slope": F.when(flat, 0.0).otherwise(F.col("_s")), "intercept": F.col("_i"), "correlation": F.col("_r"), "p_value": p, "std_err": se}
    return a.select(*groups, F.col("_n").alias(prefix + "n"), *[F.when(~few, v).alias(prefix + k) for k, v in out.items()])


def effect_trends(yearly: DataFrame, keys: list[str], year: str = "year", alpha: float = 0.05) -> DataFrame:
    """Trend of |mean difference| and |d| over the years; groups below two years are left out."""
    rows = yearly.select(*keys, year, F.inline(F.array(
        F.struct(F.lit("mean_difference").alias("measure"), F.abs("mean_difference").alias("v")),
        F.struct(F.lit("cohens_d").alias("measure"), F.abs("cohens_d").alias("v")))))
    t = regress(rows, [*keys, "measure"], year, F.col("v")).where("n >= 2")
    return t.select(*keys, "measure", trend_class(F.col("slope")).alias("trend"), "slope", "correlation", "p_value",
                    (F.col("p_value") < alpha).alias("significant"))


def yearly_differences(means: DataFrame, keys: list[str], reference: Column, model: str = "model", year: str = "year",
                       value: str = "mean") -> DataFrame:
    """human - model yearly means for the years both sides have."""
    ref = F.max(F.when(reference, F.col(value))).over(Window.partitionBy(*keys, year))
    return means.withColumn("_h", ref).where(~reference & F.col("_h").isNotNull()).select(
        *keys, model, year, (F.col("_h") - F.col(value)).alias("difference"))


def convergence(diffs: DataFrame, keys: list[str], year: str = "year") -> DataFrame:
    """Slope of |difference| over the years and its class; one year is 'insufficient'."""
    agg = diffs.where("difference IS NOT NULL").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), slope_of(F.abs("difference"), F.col(year).cast("double")).alias("slope_abs"))
    slope = F.when(F.col("_n") >= 2, F.col("slope_abs"))
    return agg.select(*keys, slope.alias("slope_abs"), trend_class(slope, flat="flat").alias("trend"))


def layer_summary(trends: DataFrame, groups: list[str]) -> DataFrame:
    """Features per layer by trend class and the converging share of the decided ones."""
    n = lambda t: F.count_if(F.col("trend") == t)
    return trends.groupBy(*groups, "layer").agg(
        F.count(F.lit(1)).alias("total"), n("converging").alias("converging"), n("diverging").alias("diverging"),
        n("insufficient").alias("insufficient"),
        F.round(F.coalesce(n("converging") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)), 3).alias("convergence_ratio"),
    )


def min_max_scaled(df: DataFrame, keys: list[str], value: Column, out: str = "scaled") -> DataFrame:
    """|value| scaled to [0, 1] per group; a range of 0 gives 0."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min(F.abs(value)).over(w), F.max(F.abs(value)).over(w)
    return df.withColumn(out, F.when(hi - lo == 0, 0.0).otherwise((F.abs(value) - lo) / F.nullif(hi - lo, F.lit(0.0))))
