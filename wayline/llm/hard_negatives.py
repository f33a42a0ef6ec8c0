"""Hard-negative mining by exact scores from subset-sum tables (the method of four Russians).

Components are whole numbers. For every anchor and every group of eight dimensions a table holds the sums of all 256 subsets of
the anchor's eight components. A candidate is cut into bit planes: for each binary digit of its components, one byte for each
group of dimensions. A plane's byte looks up how much the plane adds in its group, lookups are added over the groups and
shifted by the digit's place (the sign digit counts negative), which makes the full inner product without a multiplication.

Anchors are a stated part of all rows. They are dealt into batches of bounded size; a batch is sent to all tasks, each of which
goes through its rows and keeps its best for each anchor, so only those are shuffled. The first pass over the rows finds a
batch's positives, the second one the negatives between the limits that each positive's score sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.llm.common import scratch, whole_numbers

#: Anchors sent to all tasks at once, on average; they are dealt by a hash of their id.
BATCH = 4096
#: Anchors and candidates of one table of scores.
SIDE, ROWS = 256, 512
#: Candidates waiting to be cut to the best.
HELD = 1 << 20
GROUP = 8
FOUND = "slot int, id long, score long"


def planes(vectors: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
    """(place, sign, bytes by group) of every binary digit of whole numbers (rows x dimensions) in two's complement."""
    n, dims = vectors.shape
    wide = np.zeros((n, -(-dims // GROUP) * GROUP), np.int64)
    wide[:, :dims] = vectors
    digits = max(int(wide.max(initial=0)), -int(wide.min(initial=0)) - 1, 0).bit_length() + 1
    return [(b, -1 if b == digits - 1 else 1, np.packbits(((wide >> b) & 1).astype(np.uint8), axis=1)) for b in range(digits)]


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(group, byte, anchor): the sum of the anchor's components whose bit the byte holds, the first dimension in the highest bit."""
    m, dims = anchors.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((m, groups * GROUP), np.int64)
    wide[:, :dims] = anchors
    small = int(np.abs(wide).sum(axis=1).max(initial=0)) < 1 << 31
    table = np.zeros((groups, 1, m), np.int32 if small else np.int64)
    for bit in range(GROUP):
        part = wide.reshape(m, groups, GROUP)[:, :, GROUP - 1 - bit].T[:, None, :]
        table = np.concatenate([table, table + part.astype(table.dtype)], axis=1)
    return table


def scores(digits: list[tuple[int, int, np.ndarray]], table: np.ndarray, rows: slice) -> np.ndarray:
    """Inner products (rows x anchors) by lookups, additions and shifts."""
    n, m = len(digits[0][2][rows]), table.shape[2]
    total = np.zeros((n, m), np.int64)
    added, looked = np.zeros((n, m), table.dtype), np.empty((n, m), table.dtype)
    for place, sign, code in digits:
        added[:] = 0
        for group in range(len(table)):
            np.take(table[group], code[rows, group], axis=0, out=looked)
            added += looked
        part = added.astype(np.int64) << place
        total = total + part if sign > 0 else total - part
    return total


class Best:
    """The k best (score, then smaller id) of each slot among the candidates added so far."""

    def __init__(self, slots: int, k: int):
        self.k, self.least = k, np.full(slots, np.iinfo(np.int64).min)
        self.parts, self.waiting = [], 0

    def add(self, slot: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append(np.stack([slot, ids, score]))
        self.waiting += len(slot)
        if self.waiting > HELD:
            self.cut()

    def cut(self) -> np.ndarray:
        slot, ids, score = np.concatenate(self.parts, axis=1) if self.parts else np.zeros((3, 0), np.int64)
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        first = np.searchsorted(slot, slot)
        keep = np.arange(len(slot)) - first < self.k
        last = np.arange(len(slot)) - first == self.k - 1
        self.least[slot[last]] = score[last]
        out = np.stack([slot[keep], ids[keep], score[keep]])
        self.parts, self.waiting = [out], 0
        return out


def _columns(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimensions, ids, labels, vectors) of the rows of each vector length."""
    lists = batch.column(2)
    offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    sizes = np.diff(offsets)
    ids, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    for dims in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dims)
        yield dims, ids[at], labels[at], flat[offsets[at][:, None] + np.arange(dims)].reshape(len(at), dims)


class Asked:
    """Anchors of one vector length, and slots: for an anchor, which candidates count and within which scores."""

    def __init__(self, rows: list, limits: dict[int, list[tuple[int, int]]] | None, start: int):
        self.ids = np.array([r["id"] for r in rows], np.int64)
        self.labels = np.array([r["label"] for r in rows], np.int64)
        self.vectors = np.array([r["v"] for r in rows], np.int64).reshape(len(rows), -1)
        every = [(i, low, high) for i, a in enumerate(self.ids.tolist()) for low, high in ([(None, None)] if limits is None else limits.get(a, []))]
        self.alike = limits is None
        self.owner = np.array([i for i, _, _ in every], np.int64)
        self.low = np.array([np.iinfo(np.int64).min if x is None else x for _, x, _ in every], np.int64)
        self.high = np.array([np.iinfo(np.int64).max if x is None else x for _, _, x in every], np.int64)
        self.slot = start + np.arange(len(every))


def _scan(sent, slots: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[int, Asked] = sent.value
        best = Best(slots, k)
        for batch in batches:
            for dims, ids, labels, vectors in _columns(batch):
                asked = groups.get(dims)
                if asked is None or not len(asked.slot):
                    continue
                digits = planes(vectors)
                for a in range(0, len(asked.ids), SIDE):
                    table = subset_sums(asked.vectors[a : a + SIDE])
                    s, e = np.searchsorted(asked.owner, [a, a + SIDE])
                    owner, slot, low, high = asked.owner[s:e] - a, asked.slot[s:e], asked.low[s:e], asked.high[s:e]
                    for r in range(0, len(ids), ROWS):
                        rows = slice(r, r + ROWS)
                        same = labels[rows, None] == asked.labels[None, a : a + SIDE]
                        meets = (same if asked.alike else ~same) & (ids[rows, None] != asked.ids[None, a : a + SIDE])
                        score = scores(digits, table, rows)
                        held, now = meets[:, owner], score[:, owner]
                        i, j = np.nonzero(held & (now >= np.maximum(low, best.least[slot])) & (now <= high))
                        best.add(slot[j], ids[rows][i], now[i, j])
        slot, ids, score = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(ids), pa.array(score)], names=["slot", "id", "score"])

    return run


def _ranked(numbers: DataFrame, groups: dict[int, Asked], k: int) -> DataFrame:
    """slot, id, score, rank of each slot's k best over all rows."""
    slots = sum(len(g.slot) for g in groups.values())
    sent = numbers.sparkSession.sparkContext.broadcast(groups)
    order = Window.partitionBy("slot").orderBy(F.desc("score"), "id")
    found = numbers.mapInArrow(_scan(sent, slots, k), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    out = scratch(found, "best")
    sent.destroy()
    return out


def _by_length(rows: list, limits: dict | None) -> dict[int, Asked]:
    groups, start = {}, 0
    for dims in sorted({len(r["v"]) for r in rows}):
        groups[dims] = Asked([r for r in rows if len(r["v"]) == dims], limits, start)
        start += len(groups[dims].slot)
    return groups


def mine(df: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10,
         low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on ``id``. An anchor's positives are its best other rows of the same label; a positive's
    negatives are the best rows of other labels that score from ``low`` to ``high`` percent of it. Ties go to the smaller id.
    Rows with a null id, label or vector, or with a null or non-finite component, take no part (nor do components so large that a
    score would leave 62 bits); vectors of different lengths do not meet. Rows that repeat an id are candidates each, but none of
    an anchor with that id; of repeated anchors the one with the least vector counts.
    """
    spark = df.sparkSession
    usable, v = whole_numbers(vector_col, scale, 62)
    rows = df.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    numbers = scratch(rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(label_col).cast("string")).alias("label"), v.alias("v")), "numbers")
    asked = numbers.where(anchors).groupBy("id").agg(F.min(F.struct("v", "label")).alias("own")).select("id", "own.v", "own.label")
    asked = scratch(asked, "anchors")
    many = max(1, -(-asked.count() // BATCH))
    out = spark.createDataFrame([], "anchor_id long, positive_id long, positive_rank int, rank int, negative_id long, positive_score long, negative_score long")
    for i in range(many):
        batch = asked.where(F.pmod(F.xxhash64("id"), F.lit(many)) == i).orderBy("id").collect()
        if not batch:
            continue
        first = _by_length(batch, None)
        owner = {int(s): int(g.ids[o]) for g in first.values() for s, o in zip(g.slot, g.owner)}
        held = [(owner[r["slot"]], r["id"], r["score"], r["rank"]) for r in _ranked(numbers, first, positives).orderBy("slot", "rank").collect()]
        limits: dict[int, list[tuple[int, int]]] = {}
        known = []
        for anchor, positive, score, rank in held:
            limits.setdefault(anchor, []).append((-(-low * score // 100), high * score // 100))
            known.append((anchor, positive, score, rank))
        second = _by_length(batch, limits)
        slot_of = {(int(g.ids[o]), n): int(s) for g in second.values() for s, o, n in zip(g.slot, g.owner, np.arange(len(g.owner)) - np.searchsorted(g.owner, g.owner) + 1)}
        places = spark.createDataFrame([(slot_of[a, rank], a, p, score, rank) for a, p, score, rank in known], "slot int, anchor_id long, positive_id long, positive_score long, positive_rank int")
        found = _ranked(numbers, second, negatives).join(F.broadcast(places), "slot")
        out = out.union(found.select("anchor_id", "positive_id", "positive_rank", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    return out
