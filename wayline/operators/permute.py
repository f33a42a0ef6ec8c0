"""Random permutations of row numbers by a keyed bijection, without sorting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from wayline.operators.ordered import global_rank
from wayline.session import materialize

ROUNDS = 6


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def permuted_numbers(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a permutation of 0 .. n - 1 puts each number.

    A network of Feistel rounds permutes the numbers of an even count of bits; one that leaves the range is put through again
    until it is back inside, which is a bijection of the range.
    """
    half = max(1, ((max(2, n) - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(numbers, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (_mixed(right, key * ROUNDS + r) & mask)
        out[todo] = left << bits | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def permutation(number: Column, n: int, key: Column) -> Column:
    """Column form of ``permuted_numbers``."""

    @pandas_udf("long")
    def run(x: pd.Series, k: pd.Series) -> pd.Series:
        out = np.zeros(len(x), np.int64)
        for one in k.unique():
            use = (k == one).to_numpy()
            out[use] = permuted_numbers(x.to_numpy()[use], n, int(one))
        return pd.Series(out)

    return run(number, key)


def shuffled_partners(df: DataFrame, key: str, columns: list[str], repeats: int, seed: int) -> DataFrame:
    """Every row with ``_others``: for each repeat the ``columns`` of the row that a random permutation puts in its place.

    Rows are numbered once. The columns of a row travel to the number that each repeat's permutation gives it, and are put
    together there: one shuffle of the columns, one join by number, no row is copied or ordered for a repeat.
    """
    numbered = materialize(global_rank(df.withColumn("_h", F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed))))), [], "_h", "_i").drop("_h"))
    n = numbered.count()
    sent = numbered.select("_i", F.struct(*columns).alias("_row"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    sent = sent.select(permutation(F.col("_i"), n, F.col("repeat") + seed * 1009).alias("_to"), "repeat", "_row")
    met = sent.groupBy("_to").agg(F.array_sort(F.collect_list(F.struct("repeat", F.col("_row").alias("row")))).alias("_others"))
    return numbered.join(met, F.col("_i") == F.col("_to")).drop("_i", "_to")
