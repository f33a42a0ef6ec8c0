"""Names of features and statistics: groups, layers, selection by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Document features by layer.
LAYERS = {
    "Cognitive": ["Openness", "Conscientiousness", "Extraversion", "Agreeableness", "Neuroticism"],
    "Emotional": ["polarity", "subjectivity", "vader_compound", "vader_pos", "vader_neu", "vader_neg"],
    "Stylistic": [
        "word_diversity", "flesch_reading_ease", "gunning_fog", "average_word_length", "num_words",
        "avg_sentence_length", "verb_ratio", "function_word_ratio", "content_word_ratio",
    ],
}
GEOMETRY = ["mean_distance", "std_distance", "net_displacement", "path_length", "tortuosity", "direction_consistency"]
SPACES = ["ce", "tfidf", "sbert"]
STAT_SUFFIX = r"_(cv|rmssd_norm|masd_norm|rmssd|masd|variance)$"
GROUP_ORDER = ["CE-VAR", "CE-GEO", "TF-IDF-GEO", "SBERT-GEO", "OVERALL"]
META = ["filename", "path", "label", "domain", "field", "author_id", "year", "item_index", "model", "level", "provider"]
ALIASES = {"author_id": ["author_id", "batch"], "field": ["field", "subfield"], "domain": ["domain", "genre"]}


def feature_group(feature: Column) -> Column:
    """CE-VAR, CE-GEO, TF-IDF-GEO, SBERT-GEO or OTHER."""
    geo = "|".join(GEOMETRY)
    return (
        F.when(feature.rlike(r"_(cv|rmssd_norm|masd_norm)$"), "CE-VAR")
        .when(feature.rlike(f"^ce_({geo})$"), "CE-GEO").when(feature.rlike(f"^tfidf_({geo})$"), "TF-IDF-GEO")
        .when(feature.rlike(f"^sbert_({geo})$"), "SBERT-GEO").otherwise("OTHER")
    )


def base_feature(name: Column) -> Column:
    return F.regexp_replace(name, STAT_SUFFIX, "")


def stat_suffix(name: Column) -> Column:
    s = F.regexp_extract(name, STAT_SUFFIX, 1)
    return F.when(s != "", s)


def feature_dim(spark: SparkSession, layers: dict[str, list[str]] | None = None) -> DataFrame:
    """Dimension table (feature, layer); fixed and small."""
    rows = [(f, layer) for layer, fs in (layers or LAYERS).items() for f in fs]
    return spark.createDataFrame(rows, "feature string, layer string")


def with_layer(df: DataFrame, dim: DataFrame, feature: str = "feature") -> DataFrame:
    """Layer of a feature, after its statistic suffix is stripped; unknown features get NULL."""
    d = F.broadcast(dim.withColumnRenamed("feature", "_dim_feature"))
    return df.join(d, base_feature(F.col(feature)) == F.col("_dim_feature"), "left").drop("_dim_feature")


def group_rank(group: Column) -> Column:
    """Position in the fixed report order."""
    r = F.array_position(F.array(*[F.lit(g) for g in GROUP_ORDER]), group)
    return F.when(r > 0, r).otherwise(len(GROUP_ORDER) + 1)


def resolve_column(df: DataFrame, target: str, required: bool = True) -> DataFrame:
    """Rename the first present alias of ``target`` to it."""
    for name in ALIASES.get(target, [target]):
        if name in df.columns:
            return df.withColumnRenamed(name, target)
    if required:
        raise ValueError(f"no column for {target}; have {df.columns}")
    return df.withColumn(target, F.lit(None).cast("string"))


def numeric_features(df: DataFrame, meta: list[str] | None = None) -> list[str]:
    """Numeric columns outside the metadata."""
    skip = set(META if meta is None else meta)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def feature_sets(df: DataFrame) -> dict[str, list[str]]:
    """Named column sets: variability, geometry per space and all, unified."""
    var = [c for s in ("_cv", "_rmssd_norm", "_masd_norm") for c in df.columns if c.endswith(s)]
    geo = {f"geometry_{s}": [f"{s}_{m}" for m in GEOMETRY if f"{s}_{m}" in df.columns] for s in SPACES}
    all_geo = [c for cols in geo.values() for c in cols]
    return {"variability": var, **geo, "geometry_all": all_geo, "unified": var + all_geo}


def with_prefix(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keys])


def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Fill missing key values, adding the column where it is absent."""
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()
    })


def strip_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def lenient_double(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast to double; text that is no number becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def mean_of(cols: list[str]) -> Column:
    """Mean of the known values among columns of one row."""
    known = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(known), F.lit(0))
