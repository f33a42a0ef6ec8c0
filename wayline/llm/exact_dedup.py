"""Exact deduplication by content sort, in DataFrame operations only.

Sampled splitters (Spark's range partitioning) deal the normalised texts out by content, an external sort places equal
texts next to each other, and windows over full texts compare neighbours. The splitters see a short prefix, a hash and a
salt, so their sample stays small; equality is always decided on the whole normalised text.

A text with more than one thousandth of all rows (there are fewer than 1,000 of them) is cut into salted pieces, sorted
apart; the pieces' winners meet in a second, small aggregation whose result is broadcast: at most one row for each such
text.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import SPACES, with_columns

#: A text is cut into pieces when it has more than this share of the rows.
HOT_SHARE = 1 / 1000
PREFIX = 48
ADDED = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text):
    """The text without ASCII white space; null counts as empty."""
    return functools.reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), SPACES, F.coalesce(text, F.lit("")))


def _sorted(dealt: DataFrame) -> DataFrame:
    """Place equal texts of a piece side by side and note the piece's winner, its length and the piece's size."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    dealt = dealt.repartitionByRange("prefix", "h", "salt").withColumns({"norm": normalised(F.col("row.text")), "chars": F.char_length(text)})
    near = Window.partitionBy("prefix", "h", "salt", "norm").orderBy(F.desc("chars"), F.asc_nulls_last("row.id"))
    whole = near.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return dealt.withColumns({
        "place": F.row_number().over(near),
        "first_id": F.first("row.id").over(whole),
        "first_chars": F.first("chars").over(whole),
        "size": F.count(F.lit(1)).over(whole),
    }).withColumn("sha", F.sha2("norm", 256)).drop("norm", "chars")


def classify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: DataFrame | None = None, all_columns: bool = False) -> DataFrame:
    """One row per input row: struct ``row`` (id, text and, on request, ``all``), keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. The longest original text stays, then the smallest id (null ids
    last); of repeated rows with the same id exactly one stays.
    """
    fields = [F.col(id_col).alias("id"), F.col(text_col).alias("text")] + ([F.struct("*").alias("all")] if all_columns else [])
    norm = normalised(F.col(text_col))
    base = df.select(F.struct(*fields).alias("row"), F.left(norm, F.lit(PREFIX)).alias("prefix"), F.xxhash64(norm).alias("h"))
    limit = max(64, int(df.count() * HOT_SHARE))
    hot = base.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    hot = hot.select("h", (F.col("n") / limit).cast("int").alias("pieces"))
    salted = base.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("pieces") > 0, 1 + F.pmod(F.xxhash64("row.id"), F.col("pieces"))).otherwise(0))
    winners = _sorted(salted.where(F.col("pieces") > 0)).where(F.col("place") == 1).groupBy("h", "sha")
    winners = winners.agg(F.min(F.struct((-F.col("first_chars")).alias("chars"), F.col("first_id").isNull().alias("none"), F.col("first_id").alias("id"))).alias("best"), F.sum("size").alias("total"))
    winners = winners.select(F.col("h").alias("wh"), F.col("sha").alias("wsha"), F.col("best.id").alias("best_id"), "total", F.lit(True).alias("cut"))
    found = _sorted(salted).join(F.broadcast(winners), (F.col("pieces") > 0) & (F.col("h") == F.col("wh")) & (F.col("sha") == F.col("wsha")), "left")
    keep = F.when(F.col("cut"), F.col("best_id")).otherwise(F.col("first_id"))
    return found.select(
        "row", keep.alias("keep_id"), F.coalesce("total", "size").alias("group_size"),
        ((F.col("place") == 1) & F.col("first_id").eqNullSafe(keep)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with keep_id, group_size, kept and text_sha256; input columns of those names are replaced."""
    return classify(df, id_col, text_col, all_columns=True).select("row.all.*", *ADDED).select(*with_columns(df, ADDED), *ADDED) if not {c.lower() for c in df.columns} & set(ADDED) else exact_duplicates(df.select(*with_columns(df, ADDED)), id_col, text_col)


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the input's columns as they are."""
    return classify(df, id_col, text_col, all_columns=True).where("kept").select("row.all.*")
