"""Variability of ordered series: successive differences and dispersion.

NULL values are skipped before differencing, so a step bridges a gap. With a
``block`` column (any column that grows with the order, such as the day) a long
series is split over tasks; blocks are joined by the one step between the last
value of a block and the first of the next, so the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.columns import safe_div

STATS = ["variance", "cv", "rmssd", "masd", "rmssd_norm", "masd_norm"]


def _order(order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def time_key(order: list[str]) -> Column:
    """Sort key for min_by and max_by that agrees with the windows: NULLs come last."""
    return F.struct(*[c for i, name in enumerate(order) for c in (F.col(name).isNull().alias(f"n{i}"), F.col(name).alias(f"v{i}"))])


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: str, block: str | None = None,
                   out: str = "prev") -> DataFrame:
    """Last non-NULL value before each row of its series.

    With ``block`` each block is ordered on its own, and the last values of the
    earlier blocks (one row per block) fill in at the block's start. The key is
    a struct, so NULL keys form a series and the join reuses the window's
    partitioning.
    """
    k = F.struct(*keys, *([block] if block else []))
    keyed = df.withColumn("_k", k)
    before = Window.partitionBy("_k").orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    local = keyed.withColumn("_prev", F.last(value, ignorenulls=True).over(before))
    if not block:
        return local.withColumnRenamed("_prev", out).drop("_k")
    at = F.when(F.col(value).isNotNull(), time_key(order))
    earlier = Window.partitionBy(*[f"_k.{c}" for c in keys]).orderBy(F.col(f"_k.{block}").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        keyed.groupBy("_k").agg(F.max_by(value, at).alias("_last"))
        .select("_k", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    )
    return local.join(ends, "_k").withColumn(out, F.coalesce("_prev", "_before")).drop("_k", "_prev", "_before")


def successive_differences(df: DataFrame, keys: list[str], order: list[str], value: str = "value",
                           block: str | None = None, out: str = "diff") -> DataFrame:
    """Difference to the previous non-NULL value of the series (NULL at its start)."""
    return previous_value(df, keys, order, value, block, "_p").withColumn(out, F.col(value) - F.col("_p")).drop("_p")


def position(df: DataFrame, keys: list[str], order: list[str], block: str, out: str = "position") -> DataFrame:
    """1-based position in the series: rank inside the block plus the rows of earlier blocks.

    A NULL block comes last.
    """
    keyed = df.withColumn("_k", F.struct(*keys, block))
    local = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(*_order(order))))
    earlier = Window.partitionBy(*[f"_k.{c}" for c in keys]).orderBy(F.col(f"_k.{block}").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("_k").agg(F.count(F.lit(1)).alias("_c")).select("_k", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    return local.join(sizes, "_k").withColumn(out, F.col("_r") + F.col("_o")).drop("_k", "_r", "_o")


def _partials(df, keys, order, value, block):
    """One row per (keys, block): moments, step sums and the end values."""
    part = keys + ([block] if block else [])
    before = Window.partitionBy(*part).orderBy(*_order(order)).rowsBetween(Window.unboundedPreceding, -1)
    d = F.col("_d")
    at = F.when(F.col(value).isNotNull(), time_key(order))
    return (
        df.withColumn("_d", F.col(value) - F.last(value, ignorenulls=True).over(before))
        .groupBy(*part).agg(
            F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_n"), F.avg(value).alias("_mean"),
            (F.var_pop(value) * F.count(value)).alias("_m2"),
            F.count(d).alias("_nd"), F.sum(d * d).alias("_d2"), F.sum(F.abs(d)).alias("_da"),
            F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"),
        )
    )


def variability(df: DataFrame, keys: list[str], order: list[str], value: str = "value",
                block: str | None = None, mode: str = "author") -> DataFrame:
    """Variance, CV, RMSSD, MASD and their normalised forms per series.

    ``mode="author"``: sample variance, division by abs(mean), NULL below two
    values or at mean 0. ``mode="macro"``: population deviation, division by the
    signed mean, 0.0 instead of NULL.
    """
    if mode not in ("author", "macro"):
        raise ValueError(f"unknown mode {mode}")
    p = _partials(df, keys, order, value, block)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    if block:
        series, seq = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col(block).asc_nulls_last())
        earlier = seq.rowsBetween(Window.unboundedPreceding, -1)
        p = p.withColumn("_b", F.col("_first") - F.last("_last", ignorenulls=True).over(earlier))
        grand = F.sum(F.col("_n") * F.col("_mean")).over(series) / F.nullif(F.sum("_n").over(series), F.lit(0))
        p = p.withColumn("_dev", F.col("_mean") - grand)
        b = F.col("_b")
        p = p.groupBy(*keys).agg(
            F.sum("_rows").alias("_rows"), F.sum("_n").alias("_n"),
            (F.sum(F.col("_n") * F.col("_mean")) / F.nullif(F.sum("_n"), F.lit(0))).alias("_mean"),
            F.sum(z(F.col("_m2")) + F.col("_n") * z(F.col("_dev") * F.col("_dev"))).alias("_m2"),
            (F.sum("_nd") + F.count(b)).alias("_nd"),
            F.sum(z(F.col("_d2")) + z(b * b)).alias("_d2"), F.sum(z(F.col("_da")) + z(F.abs(b))).alias("_da"),
        )
    n, mean, nd = F.col("_n"), F.col("_mean"), F.col("_nd")
    enough = n >= 2
    ddof = 1 if mode == "author" else 0
    variance = F.when(enough, F.col("_m2") / F.nullif(n - ddof, F.lit(0)))
    rmssd, masd = F.sqrt(safe_div(F.col("_d2"), nd)), safe_div(F.col("_da"), nd)
    by = F.abs(mean) if mode == "author" else mean
    out = {
        "variance": variance, "cv": safe_div(F.sqrt(variance), by), "rmssd": rmssd, "masd": masd,
        "rmssd_norm": safe_div(rmssd, by), "masd_norm": safe_div(masd, by),
    }
    if mode == "macro":
        out = {k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()}
    return p.select(*keys, F.col("_rows").alias("sample_count"), n.alias("n_values"), mean.alias("mean"),
                    *[v.alias(k) for k, v in out.items()])


def stats_table(stats: DataFrame, keys: list[str], features: list[str], stat_names: list[str] = STATS) -> DataFrame:
    """Long statistics -> one row per series with ``<feature>_<stat>`` columns."""
    return stats.groupBy(*keys).pivot("feature", features).agg(*[F.first(s).alias(s) for s in stat_names])


def null_report(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Excluded (NULL) and total cells per group."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(value).isNull()).alias("excluded"), F.count(F.lit(1)).alias("total"),
        (F.count_if(F.col(value).isNull()) / F.count(F.lit(1))).alias("excluded_share"),
    )
