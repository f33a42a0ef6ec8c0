"""Batch scorer harness: a model loaded once per task, applied to Arrow batches.

The built-in scorer is linear over hashed tokens and reads the whole text; any
callable that maps a list of texts to an array of logits can replace it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions.text import tokens

# Trait order.
TRAITS = ["Openness", "Conscientiousness", "Extraversion", "Agreeableness", "Neuroticism"]


def map_texts(df: DataFrame, keys: list[str], load: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "text",
              out: str = "vec") -> DataFrame:
    """Apply a loaded model to the texts, batch by batch; ``load`` runs once per task."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            scored = model(b[text].fillna("").tolist())
            yield b[keys].assign(**{out: [np.asarray(r, dtype=float).tolist() for r in scored]})

    return df.select(*keys, text).mapInPandas(run, schema)


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def hashed_logits(df: DataFrame, text: str = "text", dims: int = len(TRAITS), out: str = "logits") -> DataFrame:
    """Deterministic linear scorer: token lengths spread over ``dims`` by the token's first md5 digit, per token.

    Column expressions only; whole texts.
    """
    slot = lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 2), 16, 10).cast("int"), F.lit(dims))
    df = df.withColumn("_slots", F.transform(tokens(F.col(text)), slot))
    n = F.greatest(F.size("_slots"), F.lit(1))
    share = [(F.size("_slots") - F.size(F.array_remove("_slots", F.lit(i)))) / n for i in range(dims)]
    return df.withColumn(out, F.array(*[s * float(dims) for s in share])).drop("_slots")


def trait_scores(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Five trait scores that sum to one."""
    scored = hashed_logits(df.select(*keys, text), text).withColumn("_p", softmax(F.col("logits")))
    return scored.select(*keys, *[F.col("_p")[i].alias(t) for i, t in enumerate(TRAITS)])
