"""Outlier masking by interquartile range, per group and feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.ordered import quantiles

EDGE = 1e-9


def group_defaults(df: DataFrame, model: str = "model", domain: str = "domain") -> DataFrame:
    """NULL model is the group 'ALL', NULL domain the group 'UNKNOWN'."""
    return df.withColumns({model: F.coalesce(model, F.lit("ALL")), domain: F.coalesce(domain, F.lit("UNKNOWN"))})


def iqr_bounds(df: DataFrame, groups: list[str], value: str = "value", k: float = 1.5) -> DataFrame:
    """q1, q3 and the limits [q1 - k IQR, q3 + k IQR]; IQR 0 has no limits.

    A value on a limit is inside. ``EDGE`` keeps it there when sums were added
    in another order and the last digits differ.
    """
    k = k + EDGE
    q = quantiles(df, groups, value, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({
        "lower": F.when(iqr != 0, F.col("q1") - k * iqr), "upper": F.when(iqr != 0, F.col("q3") + k * iqr),
    })


def mask_outliers(df: DataFrame, groups: list[str], value: str = "value", k: float = 1.5) -> DataFrame:
    """Set cells outside the limits to NULL and flag them; no row is dropped."""
    b = iqr_bounds(df, groups, value, k).select(*[F.col(g).alias(f"_g_{g}") for g in groups], "lower", "upper")
    cond = F.lit(True)
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    out = F.coalesce((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")), F.lit(False))
    return (
        df.join(b, cond, "left").withColumn("is_outlier", out)
        .withColumn(value, F.when(~F.col("is_outlier"), F.col(value)))
        .drop("lower", "upper", *[f"_g_{g}" for g in groups])
    )


def outlier_report(masked: DataFrame, groups: list[str]) -> DataFrame:
    """Cells, outliers and their share; each outlier counts once."""
    return masked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_outlier").alias("outliers"),
        (F.count_if("is_outlier") * 100.0 / F.count(F.lit(1))).alias("outlier_pct"),
    )
