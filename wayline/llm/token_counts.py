"""Exact histogram of encoded lengths, and what it answers for every context limit.

Documents are aggregated by their encoded length, so what is left has one row per distinct length. Suffix sums over that
histogram give, for a context limit equal to any length: how many documents and tokens are longer, how many tokens remain
when every document is truncated there, and which share of documents fits.

The suffix sums run over blocks of lengths: totals of whole blocks first, then inside each block, so no task holds the
whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import scratch
from wayline.llm.encode import encoder

GROUP_ROWS = 256


def encoded_lengths(df: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """n_tokens for every row; null and empty texts have 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP_ROWS):
                ids = enc.encode(batch.column(0).slice(at, GROUP_ROWS).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([len(x) // 2 for x in ids], pa.int64())], names=["n_tokens"])

    return df.select(text_col).mapInArrow(run, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: one row per distinct length; null lengths count as 0."""
    return lengths.groupBy(F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """What every context limit that is some document's length leaves and cuts.

    n_tokens (the limit), n_docs and tokens of that very length, docs_longer and tokens_longer, truncated_tokens (the
    total when every document is cut at the limit), quantile (share of documents that fit). No row for an empty input.
    Limits between two lengths behave as the lower one, with truncated_tokens growing by docs_longer for each token.
    """
    # A block holds the lengths with the same square root, rounded down: n lengths make about sqrt(n) blocks of sqrt(n).
    h = scratch(histogram, "histogram").withColumns({"tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.sqrt("n_tokens"))})
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(after), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("bt").over(after), F.lit(0)).alias("tokens_after"), F.sum("bd").over(everything).alias("all_docs"), F.sum("bt").over(everything).alias("all_tokens"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = h.join(blocks, "block").withColumns({
        "docs_longer": F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("docs_after"),
        "tokens_longer": F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("tokens_after"),
    })
    return out.select(
        "n_tokens", "n_docs", "tokens", "docs_longer", "tokens_longer",
        (F.col("all_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def quantile_lengths(limits: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of documents does not exceed."""
    each = limits.select("n_tokens", "quantile", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    return each.where(F.col("quantile") >= F.col("share") - 1e-12).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
