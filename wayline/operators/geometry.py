"""Geometry of a vector path: step distances, net displacement, tortuosity.

``path_metrics`` expects series of bounded length (an author's years).
``document_path`` takes series of any length, cut into blocks.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.vectors import dot, l2, minus, norm
from wayline.operators.series import previous_value, time_key

REST = 1e-12

METRICS = ["mean_distance", "std_distance", "net_displacement", "path_length", "tortuosity", "direction_consistency"]


def yearly_vectors(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Elementwise mean per key; NULL elements are left out of their position's mean."""
    filled = array_to_vector(F.transform(vec, lambda x: F.coalesce(x, F.lit(0.0))))
    present = array_to_vector(F.transform(vec, lambda x: F.when(x.isNull(), 0.0).otherwise(1.0)))
    return (
        df.where(F.col(vec).isNotNull()).select(*keys, filled.alias("_v"), present.alias("_p"))
        .groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_items"),
            vector_to_array(Summarizer.sum(F.col("_v"))).alias("_s"), vector_to_array(Summarizer.sum(F.col("_p"))).alias("_c"),
        )
        .select(*keys, "n_items", F.zip_with("_s", "_c", lambda s, c: s / F.nullif(c, F.lit(0.0))).alias(vec))
    )


def feature_vectors(df: DataFrame, features: list[str], out: str = "vec") -> DataFrame:
    return df.withColumn(out, F.array(*[F.col(f).cast("double") for f in features]))


def space_vectors(df: DataFrame, keys: list[str], spaces: dict[str, list[str]]) -> DataFrame:
    """One row per item and feature space, so all spaces share one shuffle."""
    structs = [F.struct(F.lit(s).alias("space"), F.array(*[F.col(c).cast("double") for c in cols]).alias("vec")) for s, cols in spaces.items()]
    return df.select(*keys, F.inline(F.array(*structs)))


def _at_rest(distance: Column, vec: Column) -> Column:
    """Distances below rounding noise (relative to the vector) are 0, so the order of summation does not matter."""
    return F.when(distance <= REST * norm(vec), F.lit(0.0)).otherwise(distance)


def steps(df: DataFrame, keys: list[str], order: list[str], vec: str = "vec") -> DataFrame:
    """Distance and direction change of every step; one sort serves all of it."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (
        df.withColumn("step", minus(F.col(vec), F.lag(vec).over(w)))
        .withColumn("distance", _at_rest(norm(F.col("step")), F.col(vec)))
        .withColumns({"_ps": F.lag("step").over(w), "_pd": F.lag("distance").over(w)})
        .withColumn("cosine", dot(F.col("step"), F.col("_ps")) / F.nullif(F.col("distance") * F.col("_pd"), F.lit(0.0)))
        .drop("_ps", "_pd")
    )


def _tortuosity(path: Column, net: Column, zero_net: float | None) -> Column:
    return F.when(net > 0, path / net).when(net == 0, F.lit(zero_net).cast("double"))


def path_metrics(df: DataFrame, keys: list[str], order: list[str], vec: str = "vec",
                 zero_net: float | None = 1.0, prefix: str = "") -> DataFrame:
    """Path metrics per series; below two points they are NULL and the row stays.

    ``zero_net`` is the tortuosity of a path that ends where it began.
    """
    t = time_key(order)
    agg = steps(df, keys, order, vec).groupBy(*keys).agg(
        F.avg("distance").alias("mean_distance"), F.stddev_pop("distance").alias("std_distance"),
        F.sum("distance").alias("path_length"), F.avg("cosine").alias("direction_consistency"),
        F.count(F.lit(1)).alias("n_years"), F.min_by(vec, t).alias("_a"), F.max_by(vec, t).alias("_b"),
    )
    net = F.when(F.col("n_years") >= 2, _at_rest(l2(F.col("_a"), F.col("_b")), F.col("_b")))
    agg = agg.withColumn("net_displacement", net)
    agg = agg.withColumn("tortuosity", _tortuosity(F.col("path_length"), F.col("net_displacement"), zero_net))
    return agg.select(*keys, *[F.col(m).alias(prefix + m) for m in METRICS], F.col("n_years").alias(prefix + "n_years"))


def document_path(df: DataFrame, keys: list[str], order: list[str], block: str, vec: str = "vec",
                  zero_net: float | None = None) -> DataFrame:
    """Every item is a step; series below two items are left out.

    Blocks are measured on their own and linked by one step each.
    """
    w = Window.partitionBy(*keys, block).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    t = time_key(order)
    d = F.col("_d")
    parts = (
        df.withColumn("_d", l2(F.col(vec), F.lag(vec).over(w))).groupBy(*keys, block).agg(
            F.count(F.lit(1)).alias("_n"), F.count(d).alias("_nd"), F.avg(d).alias("_md"), (F.var_pop(d) * F.count(d)).alias("_m2"),
            F.min_by(vec, t).alias("_a"), F.max_by(vec, t).alias("_z"),
        )
    )
    series, seq = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(F.col(block).asc_nulls_last())
    z = lambda c: F.coalesce(c, F.lit(0.0))
    linked = parts.withColumn("_link", l2(F.col("_a"), F.lag("_z").over(seq)))
    count = F.sum("_nd").over(series) + F.count("_link").over(series)
    total = F.sum(z(F.col("_nd") * F.col("_md")) + z(F.col("_link"))).over(series)
    linked = linked.withColumn("_mean", total / F.nullif(count, F.lit(0)))
    sq = lambda c: c * c
    m2 = F.sum(z(F.col("_m2")) + z(F.col("_nd") * sq(F.col("_md") - F.col("_mean"))) + z(sq(F.col("_link") - F.col("_mean"))))
    out = linked.groupBy(*keys).agg(
        F.sum("_n").alias("n_years"), F.first("_mean").alias("mean_yearly_distance"),
        (F.sum("_nd") + F.count("_link")).alias("_steps"), m2.alias("_ss"),
        F.sum(z(F.col("_nd") * F.col("_md")) + z(F.col("_link"))).alias("path_length"),
        F.min_by("_a", time_key([block])).alias("_a"), F.max_by("_z", time_key([block])).alias("_z"),
    ).where(F.col("n_years") >= 2)
    out = out.withColumn("net_displacement", _at_rest(l2(F.col("_a"), F.col("_z")), F.col("_z")))
    return out.select(
        *keys, "mean_yearly_distance", F.sqrt(F.col("_ss") / F.col("_steps")).alias("std_yearly_distance"),
        "path_length", "net_displacement",
        _tortuosity(F.col("path_length"), F.col("net_displacement"), zero_net).alias("tortuosity"), "n_years",
    )


def adjacent_distances(df: DataFrame, keys: list[str], order: list[str], block: str, vec: str = "vec") -> DataFrame:
    """Distance of every item to the one before it in a series of any length."""
    return previous_value(df, keys, order, vec, block, "_p").withColumn("distance", l2(F.col(vec), F.col("_p"))).drop("_p")


def pair_spread(df: DataFrame, keys: list[str], vec: str = "vec") -> DataFrame:
    """Number of pairs and mean squared pair distance per group, without making pairs.

    The sum over pairs of squared distances is n * sum|v|^2 - |sum v|^2.
    """
    v = F.col(vec)
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum(dot(v, v)).alias("_sq"),
        vector_to_array(Summarizer.sum(array_to_vector(v))).alias("_s"),
    )
    pairs = F.col("n_items") * (F.col("n_items") - 1) / 2
    return agg.select(
        *keys, "n_items", pairs.cast("bigint").alias("n_pairs"),
        ((F.col("n_items") * F.col("_sq") - dot(F.col("_s"), F.col("_s"))) / F.nullif(pairs, F.lit(0.0))).alias("mean_sq_distance"),
    )
