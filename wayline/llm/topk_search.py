"""Exact top-k by inner product over an impact-ordered index, score at a time.

The vectors of a block are indexed by postings: for every dimension, the places of its non-zero components, cut into
segments of equal quantised impact (the size of the component, in LEVELS steps). A query meets the segments of all its
dimensions in descending order of what they can add, |component of the query| times the segment's largest component, and
adds their products to the scores so far. What a vector can still gain or lose is at most the product of two lengths: that of
the query over the dimensions in which the vector has not been met yet, and that of the vector's components not met yet. Once the vectors
whose upper bound reaches the k-th best lower bound, or the k-th best score of earlier blocks, are few, no other can be a
member: processing stops on that proof, and the possible members are scored again exactly from the stored vectors.

Queries are sent in batches of bounded size to the tasks that hold the vectors; a task keeps the k best of each query, and these
meet in a ranking. Components are whole numbers; where sums may pass 2^53 the bounds allow for rounding and the exact scores are
worked out with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import scratch

LEVELS = 16
#: Components of the vectors of one block, and of the queries of one batch.
BLOCK_VALUES = 1 << 19
BATCH_VALUES = 1 << 20
#: Postings of a block are processed in this many steps; after each one the proof is tried.
STEPS = 16
#: Processing may stop when at most this share of a block's vectors can still be members.
RESCORED = 0.02
EXACT = float(1 << 53)
#: Rounding of bounds, as a share of the product of two lengths.
ROUNDED = 1e-11
FOUND = "query_id long, vec_id long, score decimal(38,0)"


class Block:
    """Postings of a block's vectors: segments of one dimension and impact level, by dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        many, dims = vectors.shape
        turned = np.ascontiguousarray(vectors.T)
        size = np.abs(turned)
        self.largest = size.max(initial=0)
        level = np.ceil(size * (LEVELS / np.maximum(size.max(axis=1, initial=0), 1))[:, None]).astype(np.int64)
        at = np.flatnonzero(level)
        key = (np.arange(dims)[:, None] * (LEVELS + 1) + LEVELS - level).ravel()[at]
        order = np.argsort(key, kind="stable")
        key, at = key[order], at[order]
        self.place, self.value = at % max(1, many), turned.ravel()[at]
        self.start = np.flatnonzero(np.diff(key, prepend=-1))
        self.count = np.diff(np.append(self.start, len(key)))
        self.dim = key[self.start] // (LEVELS + 1)
        self.top = np.maximum.reduceat(np.abs(self.value), self.start) if len(key) else np.zeros(0)
        self.square = (vectors**2).sum(axis=1)

    def members(self, query: np.ndarray, mine: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, int]:
        """(places of all possible members of the k best that reach ``floor``, postings processed); places ``mine`` are no candidates."""
        many = len(self.ids)
        impact = self.top * np.abs(query)[self.dim]
        order = np.argsort(-impact, kind="stable")[: np.count_nonzero(impact)]
        count, dim, start = self.count[order], self.dim[order], self.start[order]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        score, met, seen = np.zeros(many), np.zeros(many), np.zeros(many)
        square = float(query @ query)
        slack = ROUNDED * np.sqrt(square * self.square) + ROUNDED
        few = max(4 * k, int(RESCORED * many))
        a = done = 0
        while True:
            last = a == len(order)
            rest = 0.0 if last else np.sqrt(np.maximum(square - met, 0) * np.maximum(self.square - seen, 0))
            low, high = score - rest - slack, score + rest + slack
            low[mine] = high[mine] = -np.inf
            kth = max(floor, np.partition(low, many - k)[many - k] if many > k else -np.inf)
            possible = np.flatnonzero((high >= kth) & (high > -np.inf))
            if last or len(possible) <= few:
                return possible, done
            b = max(a + 1, int(np.searchsorted(ends, done + total / STEPS, side="right")))
            n = count[a:b]
            at = np.arange(n.sum()) + np.repeat(start[a:b] - np.cumsum(n) + n, n)
            place, value, own = self.place[at], self.value[at], np.repeat(query[dim[a:b]], n)
            score += np.bincount(place, value * own, minlength=many)
            met += np.bincount(place, own * own, minlength=many)
            seen += np.bincount(place, value * value, minlength=many)
            a, done = b, int(ends[b - 1])

    def scores(self, query: np.ndarray, places: np.ndarray) -> list[int]:
        """Exact scores, from the vectors."""
        if self.largest * np.abs(query).max(initial=0) * max(1, len(query)) < EXACT:
            return (self.vectors[places] @ query).astype(np.int64).tolist()
        need = [int(c) for c in query]
        return [sum(int(x) * y for x, y in zip(v, need)) for v in self.vectors[places].tolist()]


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, v: floor(scale * component); vectors that are null, or hold null or non-finite components, and null ids leave."""
    usable = F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("v"))


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    """Blocks of the rows of each vector length."""
    ids, offsets, flat = np.asarray(batch.column(0)), np.asarray(batch.column(1).offsets), np.asarray(batch.column(1).values)
    sizes = np.diff(offsets)
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        step = max(1, BLOCK_VALUES // max(1, dims))
        for a in range(0, len(at), step):
            rows = at[a : a + step]
            yield Block(ids[rows], flat[offsets[rows][:, None] + np.arange(dims)].reshape(len(rows), dims))


def _scan(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[int, np.ndarray]] = sent.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]  # (-score, id), the best first
        for batch in batches:
            for block in _blocks(batch):
                for i, (ident, query) in enumerate(asked):
                    if len(query) != block.vectors.shape[1]:
                        continue
                    floor = float(-best[i][k - 1][0]) if len(best[i]) == k else -np.inf
                    floor -= abs(floor) * ROUNDED if np.isfinite(floor) else 0
                    places, _ = block.members(query, np.flatnonzero(block.ids == ident), k, floor)
                    found = zip((-s for s in block.scores(query, places)), block.ids[places].tolist())
                    best[i] = sorted([*best[i], *found])[:k]
        rows = [(ident, x, Decimal(-s)) for (ident, _), kept in zip(asked, best) for s, x in kept]
        kinds = [pa.int64(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names=["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, queries, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, batch_values: int = BATCH_VALUES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other vectors; all if there are fewer.

    ``queries`` is a condition on ``id`` that states the query set. Ties go to the smaller id. Vectors of different lengths
    do not meet; vectors of no component score 0. Rows that repeat an id are each a candidate, but no candidate of a
    query with that id; of repeated queries the one with the least vector counts.
    """
    spark = df.sparkSession
    whole = scratch(quantised(df, id_col, vector_col, scale), "vectors")
    asked = scratch(whole.where(queries).groupBy("id").agg(F.min("v").alias("v")), "queries")
    values = asked.agg(F.sum(F.size("v") + 1)).first()[0] or 0
    many = max(1, -(-int(values) // batch_values))
    out = None
    for i in range(many):
        batch = [(r["id"], np.array(r["v"], float)) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(many)) == i).orderBy("id").toLocalIterator()]
        sent = spark.sparkContext.broadcast(batch)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = whole.mapInArrow(_scan(sent, k), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = scratch(found.select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score")), "best")
        sent.destroy()
        out = found if out is None else out.union(found)
    return out
