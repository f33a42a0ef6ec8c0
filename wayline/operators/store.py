"""Results that several reports read: computed once, kept under a key of what they were made from."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.session import ensure_checkpoint_dir

PARALLEL_WRITES = 8


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's columns and rows, whatever their order."""
    total = df.select(F.xxhash64(*df.columns).cast("decimal(38,0)").alias("h"), F.xxhash64(F.lit(7), *df.columns).cast("decimal(38,0)").alias("g"))
    r = total.agg(F.sum("h").alias("h"), F.sum("g").alias("g"), F.count(F.lit(1)).alias("n")).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{r['n']}|{r['h']}|{r['g']}".encode()).hexdigest()[:32]


def stored(spark: SparkSession, name: str, key: str, make: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Tables that ``make`` gives, written in the shared folder under ``name`` and ``key`` the first time and read from there afterwards."""
    return stored_parts(spark, [name], {name: key}, lambda _: {name: make()})[name]


def stored_parts(spark: SparkSession, names: list[str], keys: dict[str, str], make: Callable[[list[str]], dict[str, dict[str, DataFrame]]]) -> dict[str, dict[str, DataFrame]]:
    """The tables of several parts, each kept under its own key; ``make`` gets the parts that no folder of ``names`` holds, and they
    are kept under the last name.

    The last thing written is a list of a part's tables; a folder without it is made again.
    """
    ensure_checkpoint_dir(spark)
    at = lambda name, part: f"{spark.sparkContext.getCheckpointDir()}/wayline-results/{name}-{keys[part]}"

    def whole(folder: str) -> bool:
        listing = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/tables/_SUCCESS")
        return listing.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(listing)

    folders = {part: next((at(n, part) for n in names if whole(at(n, part))), None) for part in keys}
    missing = [part for part, folder in folders.items() if folder is None]
    if missing:
        made = make(missing)
        folders |= {part: at(names[-1], part) for part in missing}
        with ThreadPool(PARALLEL_WRITES) as pool:
            pool.map(lambda x: x[1].write.mode("overwrite").parquet(x[0]), [(f"{folders[part]}/{t}", df) for part in missing for t, df in made[part].items()])
            pool.map(lambda part: spark.createDataFrame([(t,) for t in made[part]], "name string").coalesce(1).write.mode("overwrite").parquet(f"{folders[part]}/tables"), missing)
    return {part: {r["name"]: spark.read.parquet(f"{folder}/{r['name']}") for r in spark.read.parquet(f"{folder}/tables").collect()} for part, folder in folders.items()}
