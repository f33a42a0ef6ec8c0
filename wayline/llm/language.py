"""Languages of whole texts as a mixture, by expectation-maximisation over n-gram likelihoods.

Each learned language is a table of smoothed byte trigram probabilities. A word has a likelihood in every language, the
product over its trigrams (its neighbouring white space included), and a document is a mixture of languages over its words.
For nested sets of languages (the likeliest one, the two likeliest, ...) expectation-maximisation estimates the document's
proportions; the set with the highest log-likelihood less PENALTY * log(words) for each language is chosen. The prediction
is the language with the largest proportion in that set, its proportion is the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import text_slices, with_columns

#: Bound of the training sample: documents with the smallest hash of their id, of each language.
SAMPLE_DOCS = 2000
BUCKETS = 1 << 15
SMOOTH = 0.5
ROUNDS = 8
#: Units of log(words) / 2 that one more language must gain.
PENALTY = 2.0
#: A word's evidence in nats is cut here, so that one odd word outvotes nothing.
WORD_RANGE = 12.0
UNKNOWN = "und"
ADDED = ["lang_pred", "score", "proportions"]

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[9:14] = 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True


def trigrams(low: np.ndarray) -> np.ndarray:
    """Bucket of the trigram that starts one byte before each position of ``low``, which has a space at either side."""
    x = low.astype(np.uint32)
    return (((x[:-2] | x[1:-1] << 8 | x[2:] << 16) * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a space before every row and two at the end, and the rows' offsets in them."""
    counts = np.diff(offsets)
    out = np.full(len(data) + len(counts) + 1, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(counts) + 1), counts)
    out[at] = _CLEAN[data]
    return out, offsets + np.arange(len(offsets))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # language x bucket

    def mixtures(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions of the chosen set, row x language; words of each row)."""
        rows, size = len(offsets) - 1, len(self.langs)
        low, begin = _padded(data, offsets)
        solid = low != 32
        starts = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
        ends = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]])) + 1
        bounds = np.searchsorted(starts, begin)
        count = np.diff(bounds)
        out = np.zeros((rows, size))
        if not len(starts) or not size:
            return out, count
        tri = trigrams(low)
        word = np.empty((size, len(starts)), np.float32)
        sums = np.zeros(len(tri) + 1)
        for i in range(size):
            np.cumsum(self.logp[i][tri], out=sums[1:])
            word[i] = sums[ends - 1] - sums[starts - 1]
        word = np.exp(np.maximum(word - word.max(axis=0), -WORD_RANGE))
        full = np.flatnonzero(count)  # rows with words
        count_f, first = count[full], bounds[:-1][full]
        best = self._fit(word, np.full((size, len(full)), 1 / size), count_f, first)[0]
        rank = np.argsort(np.argsort(-best, axis=0, kind="stable"), axis=0, kind="stable")
        chosen, value = best, np.full(len(full), -np.inf)
        for k in range(1, size + 1):
            p = np.where(rank < k, np.maximum(best, 1e-6), 0)
            p, likelihood = self._fit(word, p / p.sum(axis=0), count_f, first)
            now = likelihood - k * PENALTY * np.log(count_f + 1) / 2
            better = now > value
            chosen = np.where(better, p, chosen)
            value = np.where(better, now, value)
        out[full] = chosen.T
        return out, count

    @staticmethod
    def _fit(word: np.ndarray, p: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihood of each row; a proportion of 0 stays 0."""
        rounds = ROUNDS if (p > 0).sum(axis=0).max() > 1 else 0
        for _ in range(rounds):
            each = word * np.repeat(p, count, axis=1)
            each /= each.sum(axis=0)
            p = np.add.reduceat(each, first, axis=1) / count
        total = np.log((word * np.repeat(p, count, axis=1)).sum(axis=0))
        return p, np.add.reduceat(total, first)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn every non-null language of ``docs`` from at most SAMPLE_DOCS of its documents; no language, no predictions."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = docs.where("lang IS NOT NULL").select("lang", "id")
    # The window's rank limit is applied in the map tasks, so no task gathers a language.
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = known.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= SAMPLE_DOCS).select("id", "lang").distinct()
    sample = docs.join(F.broadcast(picked), ["id", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for first, end, data, offsets in text_slices(batch.column(1)):
                for at in range(end - first):
                    low, _ = _padded(data[offsets[at] : offsets[at + 1]], np.array([0, offsets[at + 1] - offsets[at]]))
                    have = total.setdefault(langs[first + at], np.zeros(BUCKETS, np.int64))
                    have += np.bincount(trigrams(low), minlength=BUCKETS)
        for lang, have in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * BUCKETS), pa.array(np.arange(BUCKETS)), pa.array(have)], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(run, "lang string, bucket long, n long").where("n > 0").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in counts})
    table = np.full((len(langs), BUCKETS), SMOOTH)
    for r in counts:
        table[langs.index(r.lang), r.bucket] += r.n
    return Model(langs, np.log(table / table.sum(axis=1, keepdims=True)))


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The input's columns with lang_pred, score and proportions (map of the chosen languages).

    ``und`` with score 0 if the text is null, has no letter, or no language was learned. Input columns of those names are
    replaced.
    """
    kept = df.select(*with_columns(df, ADDED))
    at = kept.columns.index(text_col)
    kinds = [T.StringType(), T.DoubleType(), T.MapType(T.StringType(), T.DoubleType())]
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in zip(ADDED, kinds))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, value, share = [], [], []
            texts = batch.column(at)
            for first, end, data, offsets in text_slices(texts):
                p, words = model.mixtures(data, offsets)
                letters = np.add.reduceat(np.append(_LETTER[_CLEAN[data]], False).astype(np.int64), np.minimum(offsets[:-1], len(data))) * (np.diff(offsets) > 0)
                top = p.argmax(axis=1) if model.langs else np.zeros(len(p), int)
                for i in range(end - first):
                    known = model.langs and words[i] and (letters[i] or any(map(str.isalpha, texts[first + i].as_py() or "")))
                    pred.append(model.langs[top[i]] if known else UNKNOWN)
                    value.append(float(min(1.0, p[i, top[i]])) if known else 0.0)
                    share.append([(model.langs[j], float(p[i, j])) for j in np.flatnonzero(p[i])] if known else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(value, pa.float64()), pa.array(share, pa.map_(pa.string(), pa.float64()))], names=schema.names)

    return kept.mapInArrow(run, schema)
