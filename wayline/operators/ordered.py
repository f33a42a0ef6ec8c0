"""Order statistics over groups of any size.

A group is first reduced to its distinct values. These are dealt out by Spark's range partitioning on (group, value), so
every partition holds a stretch of values and a group of any size spans as many partitions as it needs. Each stretch is
ordered on its own, and the totals of a group's earlier stretches, one row each, are added back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.columns import null_safe_equal
from wayline.session import materialize


def cumulative(df: DataFrame, groups: list[str], value: str, weights: dict[str, Column]) -> DataFrame:
    """Distinct values per group with each weight's sum and its sum over smaller values.

    Returns ``groups, value, <w>, <w>_below``. The stretches are fixed by a checkpoint, because splitters are sampled
    anew whenever a plan runs again.
    """
    distinct = df.groupBy(*groups, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    placed = materialize(distinct.repartitionByRange(*groups, value).withColumn("_blk", F.spark_partition_id()))
    below = Window.partitionBy(*groups, "_blk").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumns({f"{n}_below": F.coalesce(F.sum(n).over(below), F.lit(0)) for n in weights})
    before = Window.partitionBy(*groups).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*groups, "_blk").agg(*[F.sum(n).alias(n) for n in weights])
        .withColumns({f"_off_{n}": F.sum(n).over(before) for n in weights}).where(F.col(f"_off_{next(iter(weights))}").isNotNull())
        .select(*[F.col(g).alias(f"_g_{g}") for g in groups], F.col("_blk").alias("_b"), *[f"_off_{n}" for n in weights])
    )
    cond = F.col("_blk") == F.col("_b")
    for g in groups:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    return local.join(offsets, cond, "left").select(
        *groups, value, *weights,
        *[(F.col(f"{n}_below") + F.coalesce(F.col(f"_off_{n}"), F.lit(0))).alias(f"{n}_below") for n in weights],
    )


def quantiles(df: DataFrame, groups: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per group with linear interpolation; NULL values are ignored."""
    valued = df.select(*groups, value).where(F.col(value).isNotNull())
    cum = cumulative(valued, groups, value, {"_c": F.lit(1)})
    sizes = cum.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    placed = cum.join(sizes, null_safe_equal(cum, sizes, groups)).select(cum["*"], "_n") if groups else cum.crossJoin(sizes)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_c_below") <= rank) & (rank < F.col("_c_below") + F.col("_c")), F.col(value).cast("double")))

    outs = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        outs += [at(F.floor(pos)).alias(f"_lo_{name}"), at(F.ceil(pos)).alias(f"_hi_{name}")]
    found = placed.groupBy(*groups, "_n").agg(*outs)
    part = lambda p: (F.col("_n") - 1) * F.lit(float(p)) - F.floor((F.col("_n") - 1) * F.lit(float(p)))
    return found.select(*groups, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * part(p)).alias(n) for n, p in probs.items()])


#: Rows of a block of ranked rows, and rows among which the last step of a selection looks, on average.
BLOCK_ROWS = 20_000
DIGITS = 4


def global_rank(df: DataFrame, groups: list[str], hash_col: str, out: str = "_rank") -> DataFrame:
    """0-based rank of every row inside its group by a uniform hex hash.

    The first hex digits are the block, as many as make blocks of about BLOCK_ROWS rows, so no task orders a whole group. The
    struct key lets the join reuse the window's partitioning and matches NULL groups.
    """
    digits = max(1, math.ceil(math.log(max(1, df.count() / BLOCK_ROWS), 16)))
    pre = df.withColumn("_gk", F.struct(*groups, F.substring(hash_col, 1, digits).alias("_blk")))
    local = pre.withColumn("_local", F.row_number().over(Window.partitionBy("_gk").orderBy(hash_col)) - 1)
    before = Window.partitionBy(*[f"_gk.{g}" for g in groups]).orderBy("_gk._blk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        pre.groupBy("_gk").agg(F.count(F.lit(1)).alias("_t"))
        .select("_gk", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    )
    return local.join(totals, "_gk").withColumn(out, F.col("_off") + F.col("_local")).drop("_gk", "_off", "_local")


def hash_cuts(df: DataFrame, group: str, hash_col: str, share: float) -> DataFrame:
    """(group, _cut): the hex hash below which exactly floor(rows x share) rows of the group lie.

    Selection by radix: rows are counted by the next DIGITS hex digits, and only those in the bucket that holds the cut are
    counted again by the digits after them, until that bucket is small enough to order. The rows are never shuffled; a
    step exchanges at most 16^DIGITS counts for each group. Groups are few (classes, slices).
    """
    where, done = F.col(group).eqNullSafe(F.col("_g")), 0
    state = df.groupBy(F.col(group).alias("_g")).agg(F.lit("").alias("_p"), F.floor(F.count(F.lit(1)) * share).alias("_need"), F.count(F.lit(1)).alias("_n"))
    # A cut behind the last row lies above every hash.
    state, whole = state.where("_need < _n"), state.where("_need >= _n").select(F.col("_g").alias(group), F.lit("~").alias("_cut"))
    state = materialize(state)
    while state.where(F.col("_n") > BLOCK_ROWS).limit(1).count():
        inside = df.join(F.broadcast(state), where & F.col(hash_col).startswith(F.col("_p")))
        counts = inside.groupBy("_g", F.substring(hash_col, 1, done + DIGITS).alias("_q"), "_need").agg(F.count(F.lit(1)).alias("_n"))
        below = Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_below", F.coalesce(F.sum("_n").over(below), F.lit(0)))
        state = materialize(counts.where("_below <= _need AND _need < _below + _n").select("_g", F.col("_q").alias("_p"), (F.col("_need") - F.col("_below")).alias("_need"), "_n"))
        done += DIGITS
        if done >= 32:  # hashes that agree in all digits of the digest are told apart by what follows them
            break
    last = df.join(F.broadcast(state), where & F.col(hash_col).startswith(F.col("_p")))
    place = F.row_number().over(Window.partitionBy("_g").orderBy(hash_col)) - 1
    found = last.select("_g", F.col(hash_col).alias("_cut"), "_need", place.alias("_i")).where("_i = _need").select(F.col("_g").alias(group), "_cut")
    return found.union(whole)


def top_n(df: DataFrame, groups: list[str], order: list, n: int, salt: str, out: str = "_rank", salts: int = 64) -> DataFrame:
    """First n rows per group in a total order.

    Every salted part of a group is cut to n rows first, so the last step sees
    at most ``salts * n`` rows of a group, whatever the group's size.
    """
    part = Window.partitionBy(*groups, "_salt").orderBy(*order)
    cut = (
        df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts))).withColumn("_pre", F.row_number().over(part))
        .where(F.col("_pre") <= n).drop("_pre", "_salt")
    )
    return cut.withColumn(out, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(out) <= n)
