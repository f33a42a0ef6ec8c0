"""Vector codes by product quantisation, with adaptive bounds that spare most distances (the method of Drake and Hamerly).

Vectors of whole numbers are cut into parts; each part position has a codebook that moves for a fixed number of rounds. Of each
part a row keeps, from round to round, its b closest entries in order: an upper bound of the distance to the first one, lower
bounds of the distances to the others, and one outer bound for all entries not listed. When entries move, bounds widen by as
much. A part whose upper bound stays under all others keeps its entry. Otherwise the distance to its entry is worked out; if that
does not settle it, the listed entries up to the first bound that lies above; and all entries only if none does. Everything that
the bounds leave open, ties included, is decided on exact squared distances in whole numbers, so codes are those of the plain
method. b follows, for each part position, how far the lists had to be read.

The rows travel with their bounds as a table in the shared folder, written anew each round; the one before is deleted. Sums and
counts for the next codebooks come out of the same pass, one row for each batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import release, scratch, whole_numbers

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Labels whose sums are broadcast; with more of them, the join is left to Spark.
FEW_LABELS = 100_000
NONE = 255
#: Bounds are kept in 32 bits, moved apart by this share and this much.
SLACK, LEAST = 1e-6, 1e-3
KEPT = "v binary, state binary, sums array<long>, code string, error long"


def cuts(dims: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end; equal parts if the length can be divided, else as equal as can be."""
    return [-(-i * dims // parts) for i in range(parts + 1)]


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # then doubles hold every sum exactly
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return ((x[:, None, :].astype(np.int64) - book[None, :, :]) ** 2).sum(-1)


def squared_to(x: np.ndarray, book: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own entry; the largest number where there is none."""
    d = x.astype(np.int64) - book[np.minimum(entry, len(book) - 1)]
    return np.where(entry == NONE, np.iinfo(np.int64).max, (d * d).sum(1))


class Bounds:
    """Lists and bounds of one part position: ``order`` (rows x b), ``up``, ``low`` (rows x b - 1), ``outer``."""

    def __init__(self, order: np.ndarray, up: np.ndarray, low: np.ndarray, outer: np.ndarray):
        self.order, self.up, self.low, self.outer = order, up, low, outer

    @classmethod
    def blank(cls, n: int, b: int) -> Bounds:
        """Nothing is known: every row is measured against all entries."""
        return cls(np.zeros((n, b), np.uint8), np.full(n, np.inf), np.full((n, b - 1), np.inf), np.zeros(n))

    def moved(self, far: np.ndarray) -> None:
        """Entries have moved by ``far``."""
        padded = np.zeros(256)
        padded[: len(far)] = far
        self.up = self.up + padded[self.order[:, 0]]
        self.low = np.maximum(0, self.low - padded[self.order[:, 1:]])
        self.outer = np.maximum(0, self.outer - far.max(initial=0))

    def resized(self, b: int) -> None:
        """Lists of b entries; what a shorter list drops goes into the outer bound."""
        have = self.order.shape[1]
        if b < have:
            self.outer = np.minimum(self.outer, self.low[:, b - 1 :].min(axis=1))
            self.order, self.low = self.order[:, :b], self.low[:, : b - 1]
        elif b > have:
            more = np.full((len(self.up), b - have), NONE, np.uint8)
            self.order = np.concatenate([self.order, more], axis=1)
            self.low = np.concatenate([self.low, np.full(more.shape, np.inf)], axis=1)

    def assign(self, x: np.ndarray, book: np.ndarray) -> np.ndarray:
        """Set the first entry of every list to the nearest one; returns how many rows were settled by the bounds alone, by their
        own distance, by the list up to each place, and by all entries."""
        b = self.order.shape[1]
        self.order, self.low = self.order.copy(), self.low.copy()
        beyond = np.minimum.accumulate(np.concatenate([self.low, self.outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1]
        used = np.zeros(b + 2, np.int64)
        open_ = np.flatnonzero(~(self.up < beyond[:, 0]))
        used[0] = len(x) - len(open_)
        if len(open_):
            self.up[open_] = np.sqrt(squared_to(x[open_], book, self.order[open_, 0])) * (1 + SLACK) + LEAST
            still = open_[~(self.up[open_] < beyond[open_, 0])]
            used[1] = len(open_) - len(still)
            # The first place of the list behind which all lower bounds lie above the own distance.
            enough = self.up[still, None] < beyond[still, 1:]
            place = np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, b)
            for p in range(1, b):
                rows = still[place == p]
                used[1 + p] = len(rows)
                if len(rows):
                    self._read(rows, x[rows], book, p)
            rows = still[place == b]
            used[b + 1] = len(rows)
            if len(rows):
                self._all(rows, x[rows], book)
        return used

    def _read(self, rows: np.ndarray, x: np.ndarray, book: np.ndarray, place: int) -> None:
        listed = self.order[rows, : place + 1]
        far = np.stack([squared_to(x, book, listed[:, i]) for i in range(place + 1)], axis=1)
        sort = np.lexsort((listed, far), axis=1)
        far, listed = np.take_along_axis(far, sort, 1), np.take_along_axis(listed, sort, 1)
        self.order[rows, : place + 1] = listed
        self.up[rows] = np.sqrt(far[:, 0]) * (1 + SLACK) + LEAST
        self.low[rows, :place] = np.where(listed[:, 1:] == NONE, np.inf, np.sqrt(far[:, 1:].astype(float)) * (1 - SLACK) - LEAST)

    def _all(self, rows: np.ndarray, x: np.ndarray, book: np.ndarray) -> None:
        far = squared(x, book)
        sort = np.argsort(far, axis=1, kind="stable")
        b, k = self.order.shape[1], len(book)
        root = np.sqrt(np.take_along_axis(far, sort, 1).astype(float))
        n = min(b, k)
        self.order[rows, :n], self.order[rows, n:] = sort[:, :n], NONE
        self.up[rows] = root[:, 0] * (1 + SLACK) + LEAST
        self.low[rows, : n - 1], self.low[rows, n - 1 :] = root[:, 1:n] * (1 - SLACK) - LEAST, np.inf
        self.outer[rows] = root[:, b] * (1 - SLACK) - LEAST if b < k else np.inf

    def packed(self) -> np.ndarray:
        """Bytes of each row; bounds in 32 bits, moved apart by more than their rounding."""
        up = (self.up * (1 + SLACK) + LEAST).astype("<f4")
        low = (np.concatenate([self.low, self.outer[:, None]], axis=1) * (1 - SLACK) - LEAST).astype("<f4")
        n = len(up)
        return np.concatenate([self.order, np.ascontiguousarray(up).view(np.uint8).reshape(n, -1), np.ascontiguousarray(low).view(np.uint8).reshape(n, -1)], axis=1)

    @classmethod
    def unpacked(cls, raw: np.ndarray, b: int) -> Bounds:
        n = len(raw)
        up = np.ascontiguousarray(raw[:, b : b + 4]).view("<f4").reshape(n).astype(float)
        low = np.ascontiguousarray(raw[:, b + 4 :]).view("<f4").reshape(n, b).astype(float)
        return cls(raw[:, :b], up, np.maximum(0, low[:, :-1]), np.maximum(0, low[:, -1]))


def _bytes(column: pa.Array, n: int) -> np.ndarray:
    """A binary column of equal lengths as rows of bytes."""
    if not n:
        return np.zeros((0, 0), np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros((n, 0), np.uint8)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(n, -1)


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


class Round:
    """One pass: codebooks, how far their entries have moved, and the lists' lengths before and now."""

    def __init__(self, books: list[np.ndarray], far: list[np.ndarray] | None, had: list[int], lists: list[int], kind: str, last: bool):
        self.books, self.far, self.had, self.lists, self.kind, self.last = books, far, had, lists, kind, last

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "label", "v", "state", "sums", "code", "error"]
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            vectors = _bytes(batch.column(2), n).view(self.kind)
            before = _bytes(batch.column(3), n) if self.far is not None else None
            at = start = 0
            states, sums, codes, error, used = [], [], [], np.zeros(n, np.int64), []
            for p, book in enumerate(self.books):
                x = vectors[:, start : start + book.shape[1]].astype(np.int64)
                start += book.shape[1]
                if before is None:
                    bounds = Bounds.blank(n, self.lists[p])
                else:
                    width = 5 * self.had[p] + 4
                    bounds = Bounds.unpacked(before[:, at : at + width], self.had[p])
                    at += width
                    bounds.moved(self.far[p])
                    bounds.resized(self.lists[p])
                steps = bounds.assign(x, book)
                used.append(np.concatenate([steps, np.zeros(ENTRIES_MOST + 2 - len(steps), np.int64)]))
                own = bounds.order[:, 0]
                if self.last:
                    codes.append(own)
                    error += squared_to(x, book, own)
                else:
                    states.append(bounds.packed())
                    sums += [np.bincount(own, minlength=len(book)), *(np.bincount(own, weights=x[:, j], minlength=len(book)) for j in range(x.shape[1]))]
            if self.last:
                text = [r.hex() for r in np.ascontiguousarray(np.stack(codes, axis=1)).view(f"V{len(codes)}").ravel().tolist()]
                nothing = [pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *nothing, pa.array(text, pa.string()), pa.array(error)], names=names)
                continue
            rest = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), _binary(np.concatenate(states, axis=1)), *rest], names=names)
            total = np.concatenate([*sums, *used]).astype(np.int64).tolist()
            kinds = [batch.column(0).type, batch.column(1).type, pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, k) for k in kinds), pa.array([total], pa.list_(pa.int64())), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64())], names=names)


#: Entries of a codebook at most; a code is a byte and 255 stands for none.
ENTRIES_MOST = 254


def _listed(used: np.ndarray, b: int, k: int) -> int:
    """Length of the lists in the next round: longer if over a tenth of the rows needed all entries, else what nearly all needed."""
    rows = max(1, int(used.sum()))
    if used[b + 1] * 10 > rows:
        return max(2, min(b + 1, k))
    deep = np.flatnonzero(np.cumsum(used[: b + 1]) >= 0.99 * used[: b + 1].sum())
    return max(2, k // 8, min(b, int(deep[0]) + 1)) if len(deep) else b


def _packer(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lists = batch.column(2)
            offsets = np.asarray(lists.offsets)
            flat = np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(kind) if n else np.zeros(0, kind)
            rows = np.ascontiguousarray(flat).view(np.uint8).reshape(n, -1) if len(flat) else np.zeros((n, 0), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(rows)], names=["id", "label", "v"])

    return run


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """The id column, label, code (two hex digits a part), error, label_error, codebooks_sha256; one row for each row that takes part.

    A codebook starts as the part of the rows with the smallest ids (ties: smaller vector; null ids last), ``entries`` of them or
    all if there are fewer. Nearest: squared distance in whole numbers, then the lower index. Rounds replace each entry by its
    parts' floor of the mean; unused entries stay. Rows leave if the vector or a component is null or not finite, if a component
    is so large that an error would leave 62 bits, or if the vector is not as long as that of the first row. Repeated rows are
    coded each. label_error sums the errors of equal labels, nulls together. An empty table gives an empty result.
    """
    if not 1 <= entries <= ENTRIES_MOST:
        raise ValueError(f"entries must be from 1 to {ENTRIES_MOST}")
    usable, v = whole_numbers(vector_col, scale, 60)
    rows = df.where(usable).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    order = [F.asc_nulls_last("id"), "v"]
    schema = T.StructType([*(T.StructField(c, rows.schema[c].dataType) for c in ("id", "label")), *T._parse_datatype_string(KEPT).fields])
    head = rows.orderBy(*order).limit(1).select(F.size("v")).first()
    dims = head[0] if head else 0
    rows = rows.where(F.size("v") == dims)
    held = rows.orderBy(*order).limit(entries).select("v").collect()
    first = np.array([r["v"] for r in held], np.int64).reshape(len(held), dims)
    if not len(first):
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(id_col, rows.schema["id"].dataType), schema["label"], *T._parse_datatype_string("code string, error long, label_error long, codebooks_sha256 string").fields]))
    largest = rows.agg(F.max(F.greatest(F.array_max("v"), -F.array_min("v")))).first()[0] or 0
    kind = "<i2" if largest < 1 << 15 else "<i4"
    at = cuts(dims, parts)
    books = [np.ascontiguousarray(first[:, a:b]) for a, b in zip(at[:-1], at[1:])]
    k = len(first)
    lists = had = [max(2, min(k, -(-k // 4)))] * parts
    table = rows.mapInArrow(_packer(kind), T.StructType([*schema.fields[:2], schema["v"]])).withColumn("state", F.lit(None).cast("binary"))
    far, written = None, None
    for i in range(rounds + 1):
        last = i == rounds
        step = Round(books, far, had, lists, kind, last)
        kept = scratch(table.select("id", "label", "v", "state").mapInArrow(step.run, schema), "codes")
        if written is not None:
            release(written)
        if last:
            break
        sums = kept.where("sums IS NOT NULL").select(F.posexplode("sums")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("total"))
        total = {r["pos"]: int(r["total"]) for r in sums.collect()}
        place, new, far, had = 0, [], [], lists
        for book in books:
            width = book.shape[1]
            count = [total[place + e] for e in range(k)]
            grown = np.array([[total[place + k * (1 + j) + e] // count[e] if count[e] else int(book[e, j]) for j in range(width)] for e in range(k)], np.int64).reshape(k, width)
            place += k * (1 + width)
            far.append(np.sqrt(((grown - book) ** 2).sum(1).astype(float)) * (1 + SLACK))
            new.append(grown)
        used = [np.array([total[place + p * (ENTRIES_MOST + 2) + j] for j in range(ENTRIES_MOST + 2)]) for p in range(parts)]
        lists = [_listed(u, b, k) for u, b in zip(used, had)]
        books, written = new, kept
        table = kept.where("sums IS NULL")
    digest = hashlib.sha256(",".join(str(int(c)) for book in books for e in book for c in e).encode()).hexdigest()
    errors = scratch(kept.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    errors = F.broadcast(errors) if errors.count() <= FEW_LABELS else errors
    out = kept.join(errors, F.col("label").eqNullSafe(F.col("of")))
    return out.select(F.col("id").alias(id_col), "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
