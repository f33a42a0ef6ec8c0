"""Small column helpers shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 or NULL."""
    return a / F.nullif(b, F.lit(0.0))


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round the named columns (all doubles when none is named); -0.0 becomes 0.0."""
    names = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names})


def null_safe_equal(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def unpivot(df: DataFrame, ids: list[str], values: list[str], feature: str = "feature", value: str = "value") -> DataFrame:
    """Wide to long."""
    return df.unpivot(ids, values, feature, value)
