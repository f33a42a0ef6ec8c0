"""Feature extraction over an arriving corpus.

The batch form of 'skip what is already done' is an anti-join
(``operators.genplan.pending``). For a folder that keeps growing, a file stream
with a checkpoint does the same: every file is read once, and a restart goes on
where the last run stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wayline.functions import names as N
from wayline.functions.text import style_features
from wayline.sources.corpus import not_blank


def arriving_texts(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """(path, text) of text files as they appear below ``root``."""
    reader = spark.readStream.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def document_rows(texts: DataFrame) -> DataFrame:
    """Metadata from the name and style features from the text."""
    rows = style_features(not_blank(texts)).drop("text")
    return rows.withColumn("_m", N.any_name(N.basename(F.col("path")))).select("*", "_m.*").drop("_m")


def append_features(spark: SparkSession, root: str, out: str, checkpoint: str, max_files: int | None = None) -> StreamingQuery:
    """Process what has arrived since the last run, then stop."""
    rows = document_rows(arriving_texts(spark, root, max_files))
    return (
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
