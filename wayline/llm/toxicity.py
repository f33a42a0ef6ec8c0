"""Toxicity of whole texts: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

Features are the byte n-grams of the lower-cased text (white space counts as a space) that a document holds at least once.
From a bounded sample of labelled rows Spark counts, for each n-gram, the toxic and the other documents that hold it; the
``FEATURES`` n-grams whose shares differ most, by the two-proportion z statistic, are kept. A feature's value is its naive
Bayes log-count ratio, and logistic regression with an L2 penalty learns the weights on those values. Scoring looks n-grams
up in a table of the kept ones and compares them in full, so it reads each text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import mix, text_slices

#: Lengths of the n-grams in bytes, from 5 to 8.
LENGTHS = (5, 6, 7, 8)
#: Bound of the training sample: rows with the smallest hash of their id, of each class.
SAMPLE_TOXIC = 4000
SAMPLE_OTHER = 8000
#: An n-gram is a candidate if at least so many documents of the sample hold it, and a feature if its |z| reaches LEAST_Z.
LEAST_DOCS = 5
LEAST_Z = 5.0
FEATURES = 2048
TASKS = 12
STEPS = 400
PENALTY = 1e-3
TABLE_BITS = 18
LIMIT = 0.7

_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[65:91] += 32
_CLEAN[9:14] = 32


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, value of the n-gram at every position, whether it lies inside its row)."""
    low = _CLEAN[data].astype(np.uint64)
    n = len(low)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    value = np.zeros(n, np.uint64)
    for i in range(max(LENGTHS)):
        if i < n:
            value[: n - i] |= low[i:] << np.uint64(8 * i)
        if i + 1 in LENGTHS:
            yield i + 1, value, np.arange(i + 1, n + i + 1) <= ends


def _tagged(n: int, value: np.ndarray) -> np.ndarray:
    """n-grams of different lengths never meet: the byte put above the shorter ones, 0xF5 and up, occurs in no UTF-8 text."""
    return value | np.uint64((0xF0 | n) << 56) if n < 8 else value


@dataclass
class Model:
    values: np.ndarray
    weights: np.ndarray  # already times the log-count ratio
    bias: float

    def __post_init__(self):
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.next = np.full(len(self.values), -1, np.int32)
        for i, at in enumerate(self._place(self.values)):
            self.next[i] = self.table[at]
            self.table[at] = i

    @staticmethod
    def _place(values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def found(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (row, feature) pairs of the rows."""
        keys = [np.zeros(0, np.int64)]
        for n, value, inside in grams(data, offsets):
            value = _tagged(n, value)
            at = self.table[self._place(value)]
            hit = np.flatnonzero((at >= 0) & inside)
            at = at[hit]
            while len(hit):
                same = self.values[at] == value[hit]
                row = np.searchsorted(offsets, hit[same], side="right") - 1
                keys.append(np.unique(row * len(self.values) + at[same]))
                at = self.next[at]
                hit, at = hit[at >= 0], at[at >= 0]
        keys = np.unique(np.concatenate(keys))
        size = max(1, len(self.values))
        return keys // size, keys % size

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        row, feature = self.found(data, offsets)
        total = np.bincount(row, self.weights[feature], minlength=len(offsets) - 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """label, text of at most SAMPLE_TOXIC + SAMPLE_OTHER rows; labels has the id column and ``label`` 0 or 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1)).groupBy(id_col).agg(F.max("label").alias("label"))
    part = lambda label, most: known.where(F.col("label") == label).orderBy(F.xxhash64(id_col), id_col).limit(most)
    picked = part(1, SAMPLE_TOXIC).union(part(0, SAMPLE_OTHER)).withColumnRenamed(id_col, "__id")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(picked), F.col("id") == F.col("__id")).select("label", "text")
    return rows.mapInArrow(_keyed, "label int, text string, family long").dropDuplicates(["label", "family"]).select("label", "text")


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the least hash of a text's n-grams: copies share it, and would otherwise vote many times for what only they hold."""
    longest = max(LENGTHS)
    for batch in batches:
        family = []
        for first, end, data, offsets in text_slices(batch.column(1)):
            for at in range(end - first):
                own = data[offsets[at] : offsets[at + 1]]
                value, inside = next(((v, i) for n, v, i in grams(own, np.array([0, len(own)])) if n == longest), (np.zeros(0, np.uint64), np.zeros(0, bool)))
                family.append(int(mix(value[inside]).min().view(np.int64)) if inside.any() else len(own))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(1), pa.array(family, pa.int64())], names=["label", "text", "family"])


def _counts(sample: DataFrame) -> DataFrame:
    """gram, toxic, other: documents of each class that hold the n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array(batch.column(0).to_pylist())
            for first, end, data, offsets in text_slices(batch.column(1)):
                held = [np.zeros(0, np.uint64)]
                toxic = [np.zeros(0, bool)]
                for at in range(end - first):
                    own = data[offsets[at] : offsets[at + 1]]
                    for n, value, inside in grams(own, np.array([0, len(own)])):
                        held.append(np.unique(_tagged(n, value[inside])))
                        toxic.append(np.full(len(held[-1]), label[first + at] == 1))
                gram, where = np.unique(np.concatenate(held), return_inverse=True)
                t = np.bincount(where, np.concatenate(toxic), minlength=len(gram)).astype(np.int64)
                both = np.bincount(where, minlength=len(gram))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(t), pa.array(both - t)], names=["gram", "toxic", "other"])

    return sample.repartition(TASKS).mapInArrow(run, "gram long, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def _design(sample: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, and the (row, feature) pairs of the sample; bounded by the sample times FEATURES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_pylist()
            out = []
            for first, end, data, offsets in text_slices(batch.column(1)):
                row, feature = model.found(data, offsets)
                bounds = np.searchsorted(row, np.arange(end - first + 1))
                out.extend(feature[a:b].astype("<i2").tobytes() for a, b in zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(out, pa.binary())], names=["label", "features"])

    rows = sample.select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, features binary").collect()
    lists = [np.frombuffer(r.features, "<i2").astype(np.int64) for r in rows]
    return np.array([r.label for r in rows], float), np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([*lists, np.zeros(0, np.int64)])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on a bounded sample of the labelled rows.

    Without both classes, or without an n-gram that tells them apart, every score is the share of toxic labels, but at most
    one half: nothing is rejected without evidence.
    """
    sample = training_sample(docs, labels, id_col, text_col)
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Model(np.zeros(0, np.uint64), np.zeros(0), float(min(0.0, np.log((n1 + 0.5) / (n0 + 0.5)))))
    if not n1 or not n0:
        return nothing
    t, o = F.col("toxic"), F.col("other")
    share = (t + o) / F.lit(n1 + n0)
    z = (t / n1 - o / n0) / F.sqrt(share * (1 - share) * F.lit(1 / n1 + 1 / n0) + F.lit(1e-12))
    best = _counts(sample).where(t + o >= LEAST_DOCS).withColumn("z", F.abs(z)).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "gram").limit(FEATURES).collect()
    if not best:
        return nothing
    values = np.array([r.gram for r in best], np.int64).view(np.uint64)
    p, q = np.array([r.toxic for r in best]) + 1.0, np.array([r.other for r in best]) + 1.0
    ratio = np.log(p / (n1 + 2)) - np.log(q / (n0 + 2))
    y, row, feature = _design(sample, Model(values, ratio, 0.0))
    weights, bias = _logistic(y, row, feature, ratio)
    return Model(values, weights * ratio, bias)


def _logistic(y: np.ndarray, row: np.ndarray, feature: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the penalised log-loss; both classes weigh as in the sample."""
    x, size = ratio[feature], len(ratio)
    order = np.lexsort((row, feature))
    w = np.full(size, 0.01)
    b = float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    row_f, feature_f, x_f = row[order], feature[order], x[order]
    for step in range(1, STEPS + 1):
        score = np.bincount(row, w[feature] * x, minlength=len(y)) + b
        error = (1 / (1 + np.exp(-np.clip(score, -500, 500))) - y) / len(y)
        g = np.append(np.bincount(feature_f, error[row_f] * x_f, minlength=size) + PENALTY * w, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        change = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - change[:-1], b - change[-1]
    return w, float(b)


def score(df: DataFrame, model: Model, text_col: str = "text", added: str = "score") -> DataFrame:
    """The input with ``added``, a double from 0 to 1 for every row; null counts as empty. A column of that name is replaced."""
    df = df.drop(added)
    at = df.columns.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(added, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.scores(data, offsets) for _, _, data, offsets in text_slices(batch.column(at))]
            found = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=schema.names)

    return df.mapInArrow(run, schema)
