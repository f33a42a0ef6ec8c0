"""Packing of whole documents into fixed windows by best-fit decreasing.

A document that is longer than a window is first cut into full windows. Its rest, and every shorter document, is placed
into the open window with the least room that still holds it; pieces come longest first. The open windows are found with a
segment tree over remaining capacities. Pieces are packed in the task that read them, over runs of at most ``RUN_TOKENS``
tokens, so no token is shuffled and no task holds more than a run. The windows of a run that stay less than
``FULL_SHARE`` full are cut at powers of two, which need no padding; what is left of them is packed together, by best fit
again, and of those windows the ones that stay less full are cut down to single tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayline.llm.encode import encoder

WINDOW = 4096
#: Tokens that are packed together.
RUN_TOKENS = 8_000_000
#: Windows filled less than this are cut at powers of two, down to pieces of LEAST_CUT tokens.
FULL_SHARE = 0.97
LEAST_CUT = 64
#: Sequences that one partition may number.
NUMBERS = 1 << 33
GROUP_ROWS = 256


class Capacities:
    """Open windows by remaining capacity; a segment tree over the capacities holds how many are open in each range."""

    def __init__(self, window: int):
        self.size = 1 << int(window).bit_length()
        self.count = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, window: int) -> None:
        self.open[room].append(window)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """(room, window) of the open window with the least room >= length, which leaves the tree."""
        at, count = length + self.size, self.count
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        window = self.open[room].pop()
        while at:
            count[at] -= 1
            at >>= 1
        return room, window


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> list[list[int]]:
    """The indexes of the pieces of each window, in the order in which they were placed; 0 < length <= window."""
    rooms, out = Capacities(window), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        if found is None:
            found = window, len(out)
            out.append([])
        room, at = found
        out[at].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], at)
    return out


def cut_to_powers(pieces: list[tuple[int, int, int]], least: int = LEAST_CUT) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Pieces (row, start, length) of one window dealt over sequences whose sizes are powers of two, and the last below ``least`` aside."""
    left, out = sum(p[2] for p in pieces), []
    queue = list(reversed(pieces))
    while left >= least:
        size = 1 << (left.bit_length() - 1)
        sequence, need = [], size
        while need:
            row, start, length = queue.pop()
            sequence.append((row, start, min(length, need)))
            if length > need:
                queue.append((row, start + need, length - need))
            need -= min(length, need)
        out.append(sequence)
        left -= size
    return out, queue[::-1]


def pack_run(lengths: list[int], window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of these lengths."""
    out = [[(i, at, window)] for i, n in enumerate(lengths) for at in range(0, n - window + 1, window)]
    units = [[(i, n - n % window, n % window)] for i, n in enumerate(lengths) if n % window]
    for least in (LEAST_CUT, 1):
        aside = []
        for members in best_fit_decreasing([sum(p[2] for p in unit) for unit in units], window):
            pieces = [p for m in members for p in units[m]]
            if sum(p[2] for p in pieces) >= FULL_SHARE * window:
                out.append(pieces)
                continue
            cut, rest = cut_to_powers(pieces, least)
            out.extend(cut)
            if rest:
                aside.append(rest)
        units = aside
    return out


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, window: int = WINDOW) -> DataFrame:
    """One row per piece: the id column, start, length, ids (bytes, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null text counts as empty: such a document is the end id alone, or nothing without one. Repeated rows are packed
    each by itself. ``path`` is a tokenizer file.
    """
    # Fixed value: the id that closes a document.
    end = b"" if end_id is None else end_id.to_bytes(2, "little")
    id_field = df.schema[id_col]
    schema = T.StructType([T.StructField(id_col, id_field.dataType), *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens", "sequence_id", "offset")), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() * NUMBERS
        enc = encoder(path)
        names: list = []
        docs: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, names, docs, held
            sequences = pack_run([len(x) // 2 for x in docs], window)
            rows = []
            for sequence in sequences:
                offset = 0
                for d, start, length in sequence:
                    ids = np.frombuffer(docs[d], "<u2", length, 2 * start).astype("<u4").tobytes()
                    rows.append((names[d], start, length, len(docs[d]) // 2, number, offset, ids))
                    offset += length
                number += 1
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
            names, docs, held = [], [], 0

        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, GROUP_ROWS):
                part = enc.encode(texts.slice(at, GROUP_ROWS).to_pylist())
                names.extend(batch.column(0).slice(at, GROUP_ROWS).to_pylist())
                docs.extend(x + end for x in part)
                held += sum(len(x) // 2 for x in part)
                if held >= RUN_TOKENS:
                    yield from flush()
        if docs:
            yield from flush()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.select(id_col, text_col).mapInArrow(run, schema)
