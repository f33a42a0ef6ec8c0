"""Reproducible splits, folds, samples and class weights by hashing ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.ordered import global_rank, hash_cuts, top_n


def id_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("#", key.cast("string"), F.lit(str(seed))))


def unit_hash(key: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits."""
    return F.conv(F.substring(id_hash(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def split(df: DataFrame, key: str, label: str, train_share: float, seed: int = 42, exact: bool = False, out: str = "is_train") -> DataFrame:
    """Train/test flag by id. Default needs no shuffle; ``exact`` meets each class share exactly, by the hash that cuts it off."""
    if not exact:
        return df.withColumn(out, unit_hash(F.col(key), seed) < train_share)
    hashed = df.withColumn("_h", F.concat(id_hash(F.col(key), seed), F.col(key).cast("string")))
    cuts = hash_cuts(hashed.select(label, "_h"), label, "_h", train_share).withColumnRenamed(label, "_l")
    return hashed.join(F.broadcast(cuts), F.col(label).eqNullSafe(F.col("_l"))).withColumn(out, F.col("_h") < F.col("_cut")).drop("_h", "_cut", "_l")


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, exact: bool = False, out: str = "fold") -> DataFrame:
    """Fold number by id; ``exact`` makes fold sizes differ by at most one per class."""
    if not exact:
        return df.withColumn(out, F.floor(unit_hash(F.col(key), seed) * k).cast("int"))
    ranked = global_rank(df.withColumn("_h", F.concat(id_hash(F.col(key), seed), F.col(key).cast("string"))), [label], "_h", "_r")
    return ranked.withColumn(out, F.pmod(F.col("_r"), F.lit(k)).cast("int")).drop("_h", "_r")


def sample_per_group(df: DataFrame, groups: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows per group by hash order; the limit is applied before the shuffle as well."""
    h = df.withColumn("_h", id_hash(F.col(key), seed))
    return top_n(h, groups, [F.col("_h"), F.col(key)], n, salt=key, out="_r").drop("_h", "_r")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight) with weight = rows / (classes x rows of the class)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return c.join(F.broadcast(t)).select(label, "n", (F.col("_t") / (F.col("_k") * F.col("n"))).alias("weight"))


def with_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Row weights; the class table has one row per class."""
    w = class_weights(df, label).select(F.col(label).alias("_l"), F.col("weight").alias(out))
    return df.join(F.broadcast(w), F.col(label) == F.col("_l")).drop("_l")


def has_two_classes(df: DataFrame, groups: list[str], label: str) -> DataFrame:
    return df.groupBy(*groups).agg((F.count_distinct(label) >= 2).alias("usable"))
