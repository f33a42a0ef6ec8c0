"""Mixing a corpus to target weights with soft domain membership.

A classifier trained on a labelled table gives every document posterior probabilities over the domains. Each document gets
a nonnegative rate (how many times it is expected in the mix), and the expected tokens of a domain are the sum over
documents of rate * tokens * posterior. Rates solve a least-squares problem within their bounds:

    minimise  1/2 miss' W miss,   miss = (E(rates) - targets) / total,   least <= rates <= most.

W is the inverse of the posteriors' moments (weighed by tokens), so a scarce domain's miss weighs as its size asks for, and a
gradient step of length 1 never overshoots. With a least rate the total is free: the miss is E(rates) less its domain's share of
all expected tokens.

The search is projected gradient from rate 1: a round moves every rate along its document's part of the gradient, which is
posteriors . push with one push for all documents, and projects it to its bounds. Expected totals are linear in the rates, so
the gradient needs them alone, also at the extrapolated rates of an accelerated step. A round tries many step lengths, with and without
acceleration, in one pass and takes the one with the least miss. Only totals by domain travel: a task works a document's rate
out of its posteriors and the pushes so far, so no round writes the documents anew.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import Rolling, scratch, text_slices, with_columns, words

#: Bound of the training sample: labelled rows with the smallest hash of their id, of each domain.
SAMPLE_ROWS = 3000
BITS = 14
STEPS = 200
PENALTY = 1e-4
#: The rounds end when no domain misses by more than SETTLED of all tokens, or no step lowers the sum of squares by more than STALLED of it.
SETTLED = 1e-7
STALLED = 1e-9
#: Guards only, with a warning.
ROUNDS = 200
#: Step lengths that a round tries. Longer ones than 1 serve where most documents are held at a bound.
LENGTHS = 2.0 ** np.arange(-1, 18)
#: Share of the moments' trace that is added to them before they are inverted.
RIDGE = 1e-10
#: A domain that misses its target by more than this share of all tokens is warned of.
MISSED = 0.005
ADDED = ["tokens", "posteriors", "rate"]
#: Copies of one row that one task writes.
REPEATS = 64


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the hashed words of each row, weighed by log counts and scaled to length 1, and words per row."""
    low, starts, ends, row = words(data, offsets)
    rows = len(offsets) - 1
    count = np.bincount(row, minlength=rows)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), count
    bucket = (Rolling(low).of(starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    keys, n = np.unique(row << BITS | bucket, return_counts=True)
    row, value = keys >> BITS, np.log1p(n)
    return row, keys & ((1 << BITS) - 1), value / np.sqrt(np.bincount(row, value**2, minlength=rows))[row], count


@dataclass
class Classifier:
    domains: list[str]
    weights: np.ndarray  # bucket x domain
    bias: np.ndarray

    def posteriors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, bucket, value, count = bags(data, offsets)
        score = np.tile(self.bias, (len(count), 1))
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            score[row[first]] += np.add.reduceat(self.weights[bucket] * value[:, None], first, axis=0)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True), count


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Multinomial logistic regression on a bounded sample; ``labels`` has the id column and ``domain``.

    An id with several labels counts with the smallest. Without labels there is one domain, ``all``.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.where(F.col(id_col).isNotNull() & F.col("domain").isNotNull()).groupBy(id_col).agg(F.min(F.col("domain").cast("string")).alias("domain"))
    known = known.withColumnRenamed(id_col, "__id").select("__id", "domain")
    domains = sorted(r.domain for r in known.select("domain").distinct().collect())
    if not domains:
        return Classifier(["all"], np.zeros((1 << BITS, 1)), np.zeros(1))
    picked = None
    for d in domains:  # a handful of domains
        part = known.where(F.col("domain") == d).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE_ROWS)
        picked = part if picked is None else picked.union(part)
    sample = docs.join(F.broadcast(picked), F.col("id") == F.col("__id")).select("domain", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, data, offsets in text_slices(batch.column(1)):
                row, bucket, value, _ = bags(data, offsets)
                bounds = np.searchsorted(row, np.arange(end - first + 1))
                out.extend((bucket[a:b].astype("<i2").tobytes(), value[a:b].astype("<f4").tobytes()) for a, b in zip(bounds[:-1], bounds[1:]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], names=["domain", "bucket", "value"])

    rows = sample.mapInArrow(run, "domain string, bucket binary, value binary").collect()
    y = np.array([domains.index(r.domain) for r in rows], int)
    bucket = np.concatenate([np.frombuffer(r.bucket, "<i2") for r in rows] + [np.zeros(0, "<i2")]).astype(np.int64)
    value = np.concatenate([np.frombuffer(r.value, "<f4") for r in rows] + [np.zeros(0, "<f4")]).astype(float)
    row = np.repeat(np.arange(len(rows)), [len(r.bucket) // 2 for r in rows])
    w, b = np.zeros((1 << BITS, len(domains))), np.log(np.bincount(y, minlength=len(domains)) + 1.0)
    if not len(rows):
        return Classifier(domains, w, b)
    m, v = np.zeros_like(w), np.zeros_like(w)
    hot = np.eye(len(domains))[y]
    for step in range(1, STEPS + 1):
        score = np.stack([np.bincount(row, w[bucket, j] * value, minlength=len(y)) for j in range(len(domains))], axis=1) + b
        p = np.exp(score - score.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - hot) / len(y)
        g = np.stack([np.bincount(bucket, error[row, j] * value, minlength=len(w)) for j in range(len(domains))], axis=1) + PENALTY * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        b = b - error.sum(axis=0)
    return Classifier(domains, w, b)


def memberships(df: DataFrame, model: Classifier, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The carried columns, tokens (words of the whole text) and posteriors in the order of ``model.domains``."""
    kept = df.select(*(carry or []), F.col(text_col).alias("__text"))
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.posteriors(data, offsets) for _, _, data, offsets in text_slices(batch.column(batch.num_columns - 1))]
            p = np.concatenate([x for x, _ in found] or [np.zeros((0, len(model.domains)))])
            count = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(count.astype(np.int64)), lists], names=schema.names)

    return kept.mapInArrow(run, schema)


def walk(posteriors: np.ndarray, path: list[tuple[float, np.ndarray]], least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the rounds of ``path``, (carry, push) each, and before the last one."""
    now = before = np.full(len(posteriors), np.clip(1.0, least, most))
    for carry, push in path:
        now, before = np.clip(now + carry * (now - before) + posteriors @ push, least, most), now
    return now, before


@dataclass
class Solution:
    domains: list[str]
    targets: np.ndarray  # tokens
    path: list[tuple[float, np.ndarray]]  # of every round, what it carried on of the one before and its push by domain
    expected: np.ndarray
    most: float = np.inf
    least: float = 0.0
    settled: bool = True

    def rates(self, posteriors: np.ndarray) -> np.ndarray:
        """Nonnegative rates of documents with these posteriors (document x domain)."""
        return walk(posteriors, self.path, self.least, self.most)[0]


def _sums(members: DataFrame, shape: tuple[int, ...], add) -> np.ndarray:
    """``add(tokens, posteriors)`` over batches of documents, summed up; an array of that shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                sums += add(np.asarray(batch.column(0)).astype(float), np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "v"])

    out = np.zeros(int(np.prod(shape)))
    for r in members.select("tokens", "posteriors").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(shape)


def solve(members: DataFrame, domains: list[str], weights: dict[str, float], most: float | None = None, least: float = 0.0) -> Solution:
    """Rates whose expected domain totals match ``weights`` (normalised; absent domains 0) times all tokens.

    With ``most`` no rate exceeds it, and the targets are as many tokens as the scarcest wanted domain then allows. With
    ``least`` no rate is below it, and the mix is as large as the weights then ask for: scarce domains are repeated. Then
    a domain is only added by documents that hold more of it than its weight.

    A document's weight in the problem is its tokens, so its rate depends on its posteriors alone. A domain that no
    document can hold stays short of its target, with a warning; without tokens nothing is solved and every rate is 1.
    """
    size = len(domains)
    high = np.inf if most is None else most
    first = _sums(members, (size,), lambda n, p: n @ p)  # at rate 1
    total = float(first.sum())
    wanted = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    if total <= 0 or wanted.sum() <= 0:
        return Solution(domains, first, [], first)
    wanted = wanted / wanted.sum()
    budget = total if most is None else most * float((first[wanted > 0] / wanted[wanted > 0]).min())
    targets = wanted * budget
    # Tokens by domain to misses; posteriors sum to 1.
    turn = np.eye(size) - wanted if least else np.eye(size)
    goal = np.zeros(size) if least else targets
    moments = _sums(members, (size, size), lambda n, p: (p * n[:, None]).T @ p)
    moments = turn.T @ moments @ turn / total
    metric = np.linalg.pinv(moments + RIDGE * np.trace(moments) * np.eye(size), hermitian=True)

    def miss(expected: np.ndarray) -> np.ndarray:
        return (expected @ turn - goal) / total

    def squares(expected: np.ndarray) -> float:
        return float(miss(expected) @ metric @ miss(expected)) / 2

    path: list[tuple[float, np.ndarray]] = []
    now = before = first * float(np.clip(1, least, high))
    pace, settled = 1.0, False
    for _ in range(ROUNDS):
        settled = bool(np.abs(miss(now)).max() < SETTLED)
        if settled:
            break
        next_pace = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        tried = []
        for carry in sorted({0.0, (pace - 1) / next_pace}):
            slope = turn @ metric @ miss(now + carry * (now - before))
            tried.extend((carry, -length * slope) for length in LENGTHS)

        def add(n, p, path=tuple(path), tried=tuple(tried)):
            rate, last = walk(p, path, least, high)
            return np.stack([(n * np.clip(rate + carry * (rate - last) + p @ push, least, high)) @ p for carry, push in tried])

        found = _sums(members, (len(tried), size), add)
        values = np.array([squares(e) for e in found])
        best = int(values.argmin())
        if values[best] >= squares(now) * (1 - STALLED):
            settled = True
            break
        pace = next_pace if tried[best][0] or not path else 1.0
        path.append(tried[best])
        now, before = found[best], now
    if least:
        targets = wanted * now.sum()
    missed = {d: f"{e:.0f} of {t:.0f} tokens" for d, e, t in zip(domains, now, targets) if abs(e - t) > MISSED * total}
    if missed or not settled:
        warnings.warn(f"mixing: targets {'missed' if missed else 'met'}, rounds {'settled' if settled else 'not settled'}: {missed}", stacklevel=2)
    return Solution(domains, targets, path, now, high, least, settled)


def with_rates(members: DataFrame, solution: Solution) -> DataFrame:
    """``members`` with the rate of every document."""
    at = members.columns.index("posteriors")
    size = len(solution.domains)
    schema = T.StructType([*members.schema.fields, T.StructField("rate", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = np.asarray(batch.column(at).flatten()).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(solution.rates(p), pa.float64())], names=schema.names)

    return members.mapInArrow(run, schema)


def copies(rate, id_col):
    """Whole copies of a document: the rate rounded up or down by a hash of the id, with the rate as its mean."""
    chance = F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 24)) / F.lit(float(1 << 24))
    return (F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mix(df: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns (but the text) with tokens, posteriors (map by domain), rate and copies.

    Null and empty texts have no tokens and the classifier's prior as posteriors. Input columns of the added names are
    replaced; repeated rows are documents of their own.
    """
    clash = {"tokens", "posteriors", "rate", "copies", text_col.lower()}
    carry = [c for c in df.columns if c.lower() not in clash]
    model = fit(df, labels, id_col, text_col)
    members = scratch(memberships(df, model, text_col, [f"`{c}`" for c in carry]), "members")
    solution = solve(members, model.domains, weights)
    named = F.map_from_arrays(F.array(*[F.lit(d) for d in model.domains]), F.col("posteriors"))
    return with_rates(members, solution).withColumn("posteriors", named).withColumn("copies", copies(F.col("rate"), id_col))


def mixed_rows(df: DataFrame, labels: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", most: float | None = None, least: float = 0.0) -> DataFrame:
    """The rows of the mix with the input's columns as they are: every row as often as its copies say.

    With ``least`` of 1 every row is there at least once.
    """
    model = fit(df, labels, id_col, text_col)
    whole = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    members = scratch(memberships(whole, model, "t", ["row", "id"]), "members")
    solution = solve(members, model.domains, weights, most, least)
    dealt = with_rates(members, solution).withColumn("copies", copies(F.col("rate"), "id"))
    rows = lambda df, n: df.withColumn("nth", F.explode(F.sequence(F.lit(1), n))).select("row")
    few = rows(dealt.where(F.col("copies").between(1, REPEATS)), F.col("copies"))
    # A row that is repeated often is dealt to the tasks in portions.
    many = dealt.where(F.col("copies") > REPEATS).withColumn("portion", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / REPEATS).cast("int"))))
    many = many.repartition(F.xxhash64("id", "portion"))
    return few.union(rows(many, F.least(F.lit(REPEATS), F.col("copies") - F.col("portion") * REPEATS))).select("row.*")
