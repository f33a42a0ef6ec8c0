"""Text-corpus source: one row per file, lenient decoding, path-based filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.text import is_blank


def decode_text(content: Column) -> Column:
    """UTF-8 where valid, else Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def decode_dropping(content: Column) -> Column:
    """UTF-8 with malformed bytes dropped."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def scan_texts(spark: SparkSession, root: str | list[str], drop_bad_bytes: bool = False, glob: str = "*.txt") -> DataFrame:
    """(path, text) of every matching file below ``root``; whole files."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
        .load(root if isinstance(root, list) else [root])
    )
    body = decode_dropping(F.col("content")) if drop_bad_bytes else decode_text(F.col("content"))
    return files.select(F.col("path"), body.alias("text"))


def not_blank(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop blank documents; placed before feature extraction."""
    return df.where(F.col(text).isNotNull() & ~is_blank(F.col(text)))


def with_existing_text(rows: DataFrame, texts: DataFrame, path: str = "path") -> DataFrame:
    """Rows whose path is set and whose text exists."""
    return rows.where(F.trim(F.coalesce(F.col(path), F.lit(""))) != "").join(texts.select(path), path, "left_semi")


def write_texts(df: DataFrame, out: str, partitions: list[str], mode: str = "overwrite") -> None:
    """Document table (filename, text) partitioned by its split."""
    df.write.mode(mode).partitionBy(*partitions).parquet(out)
