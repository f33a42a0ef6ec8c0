"""Standardisation and matrix assembly."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zscore(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population deviation; a constant column becomes 0.

    The moments are one row, joined by broadcast.
    """
    m = df.agg(*[F.avg(c).alias(f"_m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"_s_{c}") for c in cols])
    joined = df.join(F.broadcast(m))
    out = {c: F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.col(c) - F.col(f"_m_{c}")) for c in cols}
    return joined.withColumns(out).drop(*[f"_m_{c}" for c in cols], *[f"_s_{c}" for c in cols])


def assemble(df: DataFrame, features: list[str], keys: list[str], out: str = "features") -> DataFrame:
    """NULL -> 0 and one vector column."""
    filled = df.fillna(0.0, subset=features)
    return VectorAssembler(inputCols=features, outputCol=out).transform(filled).select(*keys, out)


def principal_components(df: DataFrame, features: list[str], keys: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Scores on the first k components of the standardised features, and their variance shares."""
    z = assemble(zscore(df.fillna(0.0, subset=features), features), features, keys)
    m = PCA(k=k, inputCol="features", outputCol="_pc").fit(z)
    pc = m.transform(z).withColumn("_pc", vector_to_array("_pc"))
    return pc.select(*keys, *[F.col("_pc")[i].alias(f"pc{i + 1}") for i in range(k)]), [float(v) for v in m.explainedVariance]


def family_correlation(df: DataFrame, families: dict[str, list[str]]) -> DataFrame:
    """Average absolute Pearson correlation between feature families; NULLs count as 0.

    One correlation matrix (features x features) serves all pairs of families;
    constant features have no correlation and are left out.
    """
    features = [f for cols in families.values() for f in cols]
    m = Correlation.corr(assemble(df, features, []), "features").head()[0].toArray()
    pos = {f: i for i, f in enumerate(features)}
    names, rows = list(families), []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            r = [abs(m[pos[x], pos[y]]) for x in families[a] for y in families[b] if not math.isnan(m[pos[x], pos[y]])]
            if r:
                rows.append((a, b, float(sum(r) / len(r)), len(r)))
    return df.sparkSession.createDataFrame(rows, "family_1 string, family_2 string, avg_abs_r double, n long")
