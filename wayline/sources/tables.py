"""Partitioned feature tables, ordered CSV, nested JSON and an append-only log."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayline.session import ensure_checkpoint_dir

SPLIT = ["label", "model", "level", "domain"]


def scratch(spark: SparkSession, name: str) -> str:
    """New folder below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_splits(df: DataFrame, out: str, partitions: list[str] = SPLIT, mode: str = "overwrite") -> None:
    """One folder per split; rows of a split are brought together only within a task."""
    df.write.mode(mode).partitionBy(*partitions).parquet(out)


def read_splits(spark: SparkSession, root: str, schema: StructType, where: Column | None = None, fmt: str = "parquet", **options) -> DataFrame:
    """Read a partitioned layout with a fixed schema; ``where`` on partition columns skips folders."""
    df = spark.read.schema(schema).options(**options).format(fmt).load(root)
    return df if where is None else df.where(where)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    return next((p for p in paths if _exists(spark, p)), None)


def existing_paths(spark: SparkSession, paths: list[str]) -> list[str]:
    """Splits that are there; a missing split is skipped."""
    return [p for p in paths if _exists(spark, p)]


def ordered_columns(df: DataFrame, meta: list[str]) -> list[str]:
    """Metadata first, then features and statistics by name."""
    return [c for c in meta if c in df.columns] + sorted(c for c in df.columns if c not in meta)


def write_csv(df: DataFrame, out: str, meta: list[str], order: list[str] | None = None, mode: str = "overwrite") -> None:
    t = df.select(*ordered_columns(df, meta))
    (t.orderBy(*order) if order else t).write.mode(mode).option("header", True).csv(out)


def write_nested_json(df: DataFrame, out: str, keys: list[str], items: list[str], name: str, mode: str = "overwrite") -> None:
    """One object per key with its rows as a list; the lists are as short as a series of years."""
    nested = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*items))).alias(name))
    nested.write.mode(mode).json(out)


def read_nested_json(spark: SparkSession, path: str, schema: StructType, keys: list[str], name: str, multi_line: bool = False) -> DataFrame:
    """Flatten the nested list back to rows."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path).select(*keys, F.inline(name))


def append_log(df: DataFrame, out: str, fields: list[str], stamp: Column | None = None) -> None:
    """Append ``time<TAB>key=value...`` lines; missing values are UNKNOWN."""
    ts = F.date_format(stamp if stamp is not None else F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    pairs = [F.concat(F.lit(f"{f}="), F.coalesce(F.nullif(F.col(f).cast("string"), F.lit("")), F.lit("UNKNOWN"))) for f in fields]
    df.select(F.concat_ws("\t", ts, *pairs).alias("value")).write.mode("append").text(out)


def read_log(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    lines = spark.read.text(path)
    m = F.str_to_map(F.regexp_replace("value", r"^[^\t]*\t", ""), F.lit("\t"), F.lit("="))
    return lines.select(F.to_timestamp(F.substring_index("value", "\t", 1)).alias("ts"), m.alias("_m")).select("ts", *[F.col("_m")[f].alias(f) for f in fields])
