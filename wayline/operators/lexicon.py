"""Lexicon features: token table joined with a lexicon of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.functions.text import tokens


def token_counts(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, token, n): the tokens of a document are combined before the shuffle."""
    return df.select(*keys, F.explode(tokens(F.col(text))).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


def _lookup(df: DataFrame, text: str, lexicon: DataFrame) -> DataFrame:
    """Tokens with lexicon columns; whether the lexicon is broadcast is left to Spark, which knows its measured size."""
    return df.withColumn("token", F.explode_outer(tokens(F.col(text)))).drop(text).join(lexicon, "token", "left")


def valence(df: DataFrame, keys: list[str], lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Positive, neutral and negative shares and the compound score s / sqrt(s^2 + 15).

    ``lexicon``: (token, valence). Scored tokens weigh |score| + 1, others 1.
    """
    v = F.coalesce("valence", F.lit(0.0))
    has = F.col("token").isNotNull()
    agg = _lookup(df.select(*keys, text), text, lexicon).groupBy(*keys).agg(
        F.sum(v).alias("_s"), F.sum(F.when(v > 0, v + 1.0).otherwise(0.0)).alias("_p"),
        F.sum(F.when(v < 0, 1.0 - v).otherwise(0.0)).alias("_g"), F.sum(F.when(has & (v == 0), 1.0).otherwise(0.0)).alias("_z"),
    )
    total = F.nullif(F.col("_p") + F.col("_g") + F.col("_z"), F.lit(0.0))
    share = lambda c: F.coalesce(F.col(c) / total, F.lit(0.0))
    return agg.select(
        *keys, share("_p").alias("vader_pos"), share("_z").alias("vader_neu"), share("_g").alias("vader_neg"),
        (F.col("_s") / F.sqrt(F.col("_s") * F.col("_s") + 15.0)).alias("vader_compound"),
    )


def mean_scores(df: DataFrame, keys: list[str], lexicon: DataFrame, text: str = "text") -> DataFrame:
    """Mean polarity and subjectivity of the matched tokens, 0 without a match."""
    return _lookup(df.select(*keys, text), text, lexicon).groupBy(*keys).agg(
        F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"), F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("subjectivity"))


def class_ratio(df: DataFrame, keys: list[str], classes: DataFrame, wanted: str,
                text: str = "text", out: str = "verb_ratio") -> DataFrame:
    """Share of tokens of one class; ``classes``: (token, class)."""
    n = F.nullif(F.count("token"), F.lit(0))
    return _lookup(df.select(*keys, text), text, classes).groupBy(*keys).agg(
        F.coalesce(F.count_if(F.col("class") == wanted) / n, F.lit(0.0)).alias(out))
