"""Session set-up and the two places where lineage is cut."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "*", shuffle_partitions: int = 8, app: str = "wayline") -> SparkSession:
    """Session for tests and local runs; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="wayline-ckpt-"))


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for a table that several actions read."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a partition of a table that is fitted repeatedly.
FIT_ROWS = 20_000


def materialize_spread(df: DataFrame) -> DataFrame:
    """Checkpoint for a table that is fitted repeatedly, dealt evenly into partitions of about FIT_ROWS rows."""
    out = materialize(df)
    return materialize(out.repartition(max(1, -(-out.count() // FIT_ROWS))))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan over all cores by key before heavy per-row work.

    Only inputs with fewer partitions than cores are shuffled (a few files with
    one row group each); a large scan keeps its partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
