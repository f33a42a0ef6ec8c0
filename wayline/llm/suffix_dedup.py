"""Removal of every byte covered by a string of ``length`` bytes that also starts elsewhere in the corpus.

Suffix arrays are only built over text that can hold a repeated string:

1. The string that starts at a position is owned by an anchor: the place of the least hash among its KGRAM-byte substrings.
   Equal strings have equal anchors, and the positions owned by an anchor follow one another, so each anchor has one
   segment, the text from its first owned position to the end of the string at its last. Anchors whose KGRAM bytes occur
   once in the corpus own no repeated string. Segments that are equal as a whole (128-bit digest) repeat as a whole.
2. What is left, different segments around equal anchors, is dealt by anchor into shards of about SHARD segments. A shard
   builds a suffix array over its segments by Larsson-Sadakane refinement (only groups still tied are sorted again, each
   time by the rank twice as far ahead), and common prefixes of neighbouring suffixes by Kasai's rule, in its permuted form:
   a prefix shrinks by at most one from a position to the next, so only positions whose neighbour does not follow the
   former one's neighbour are compared.
3. An anchor with more segments than a shard takes is spread over several; the fingerprints of these shards' strings are
   dealt by ranges of their first hash, as many as their counted number asks for, and strings without a partner in their
   own shard are found by binary search among a range's sorted fingerprints of all shards.

A long document is read in slices that overlap by a string; which anchor owns a position depends on its string alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import SLICE_BYTES, Rolling, scratch, text_slices, with_columns

KGRAM = 100
SHARD = 1024
#: Fingerprints of spread anchors that one task merges, on average.
MERGE_ROWS = 1 << 20
#: Low bits of an anchor's order that hold its place in a slice.
PLACE_BITS = np.uint64(32)
ADDED = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]

ANCHORS = "key long, d1 long, d2 long, n long, rk long, id long, start long, stop long"


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, kgram: int) -> tuple[np.ndarray, ...]:
    """(row, start, stop, anchor, key, d1, d2) of every anchor: owned positions [start, stop) of the slice."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(3))
    n = len(data)
    if n < length:
        return none
    one, two = Rolling(data, 1), Rolling(data, 2)
    at = np.arange(n - kgram + 1)
    gram = one.of(at, at + kgram)
    least = (gram >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    width, have = length - kgram + 1, 1
    while have < width:  # least over windows of twice the width
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    owner = (least & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    sizes = np.diff(offsets)
    row_of = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - length + 1))
    skipped = offsets[:-1] - np.concatenate([[0], np.cumsum(np.maximum(0, sizes - length + 1))[:-1]])
    start = np.arange(len(row_of)) + skipped[row_of]
    if not len(start):
        return none
    own = owner[start]
    first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row_of[1:] != row_of[:-1])]))
    last = np.append(first[1:], len(start)) - 1
    a, b, p = start[first], start[last] + 1, own[first]
    return row_of[first], a, b, p, gram[p], one.of(a, b + length - 1), two.of(a, b + length - 1)


def _pieces(column: pa.Array, length: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, bytes before, bytes, offsets) of slices; rows of slices over ``most`` bytes come one by one, in pieces that share length - 1 bytes."""
    step = max(1, most - length + 1)
    for first, end, data, offsets in text_slices(column):
        if len(data) <= most:
            yield first, 0, data, offsets
            continue
        for row in range(end - first):
            one = data[offsets[row] : offsets[row + 1]]
            for at in range(0, len(one) - length + 1, step):
                piece = one[at : at + step + length - 1]
                yield first + row, at, piece, np.array([0, len(piece)])


def _anchor_rows(length: int, kgram: int, most: int = SLICE_BYTES):
    """rk, id, text -> ANCHORS. Segments that a slice holds several times leave one row that counts them; the others are marked (n = 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rk, ids = np.asarray(batch.column(0)), batch.column(1)
            for first, before, data, offsets in _pieces(batch.column(2), length, most):
                row, a, b, _, key, d1, d2 = anchors(data, offsets, length, kgram)
                if not len(row):
                    continue
                order = np.lexsort((d2, d1))
                head = np.concatenate([[True], (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])])
                count = np.diff(np.append(np.flatnonzero(head), len(order)))
                n = np.zeros(len(row), np.int64)
                n[order[head]] = count
                rest = np.flatnonzero(n == 0)
                joined = np.flatnonzero(np.concatenate([[True], (row[rest][1:] != row[rest][:-1]) | (a[rest][1:] != b[rest][:-1])])) if len(rest) else rest
                stops = b[rest[np.append(joined[1:], len(rest)) - 1]] if len(rest) else b[rest]
                use = np.concatenate([np.flatnonzero(n), rest[joined]])
                stop = np.concatenate([b[n > 0], stops])
                where = first + row[use]
                base = offsets[row[use]] - before
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[use].view(np.int64)), pa.array(d1[use].view(np.int64)), pa.array(d2[use].view(np.int64)), pa.array(n[use]),
                     pa.array(rk[where]), ids.take(pa.array(where)), pa.array(a[use] - base), pa.array(stop - base)],
                    names=["key", "d1", "d2", "n", "rk", "id", "start", "stop"],
                )

    return run


def suffix_array(data: np.ndarray, bounds: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``data`` sorted by their suffixes inside their own segment, to at least ``depth`` bytes.

    The first sort reads the largest power of two of bytes, up to 8, that divides ``depth``; the refinement then compares
    multiples of it, so strings of ``depth`` bytes at the very end of a segment are compared in full as well.
    """
    n = len(data)
    base = min(8, depth & -depth)
    left = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(n)
    word = np.zeros(n, np.uint64)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for i in range(base):
        word = word << np.uint64(8) | wide[i : i + n]
    short = np.flatnonzero(left < base)  # these have no partner; they come first, each with a rank of its own
    full = np.flatnonzero(left >= base)
    sa = np.concatenate([short, full[np.argsort(word[full], kind="stable")]])
    head = np.ones(n, bool)
    head[len(short) + 1 :] = word[sa[len(short) + 1 :]] != word[sa[len(short) : -1]] if len(full) else True
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = base
    while h < depth:
        tied = ~(head & np.append(head[1:], True))
        slots = np.flatnonzero(tied)
        if not len(slots):
            break
        i = sa[slots]
        ahead = np.where(left[i] > h, rank[np.minimum(i + h, n - 1)], -1 - i)
        group = rank[i]
        order = np.lexsort((ahead, group))
        i, ahead, group = i[order], ahead[order], group[order]
        sa[slots] = i
        head[slots] = np.concatenate([[True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])])
        rank[i] = np.maximum.accumulate(np.where(head[slots], slots, 0))
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, bounds: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each slot of ``sa`` the common prefix with the slot before it, inside both segments, cut at ``most``."""
    n = len(data)
    end = np.repeat(bounds[1:], np.diff(bounds))
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (before[1:] == before[:-1] + 1) & (before[:-1] >= 0) & (end[1:] == end[:-1])
    follows[1:] &= (end[np.maximum(before[1:], 0)] == end[np.maximum(before[:-1], 0)]) & (data[:-1] == data[np.maximum(before[:-1], 0)])
    todo = np.flatnonzero(~follows & (before >= 0))
    reach = np.zeros(n, np.int64)
    other = before[todo]
    room = np.minimum(end[todo] - todo, end[other] - other)
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.sliding_window_view(wide, 8)[:n].copy().view(np.uint64).ravel()
    same = np.zeros(len(todo), np.int64)
    active = np.arange(len(todo))
    while len(active):
        x, y = todo[active] + same[active], other[active] + same[active]
        inside = same[active] < room[active]
        active, x, y = active[inside], x[inside], y[inside]
        differ = word[x] ^ word[y]
        low = differ & (~differ + np.uint64(1))
        zeros = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype(np.float64)).astype(np.int64) >> 3)
        same[active] += zeros
        active = active[zeros == 8]
    reach[todo] = np.minimum(same, room)
    # Kasai: from a position to the next a common prefix shrinks by at most one where the neighbours follow each other.
    line = np.maximum.accumulate(np.where(follows, -1, np.arange(n)))
    plcp = np.maximum(0, reach[line] - (np.arange(n) - line))
    return np.minimum(plcp[sa], most)


def repeated_groups(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions whose string of ``length`` lies in its segment, group of equal strings of each)."""
    sa = suffix_array(data, bounds, length)
    joined = common_prefixes(data, bounds, sa, length) >= length
    end = np.repeat(bounds[1:], np.diff(bounds))
    group = np.cumsum(~joined)
    whole = end[sa] - sa >= length
    return sa[whole], group[whole]


def _shard(frame: pd.DataFrame, length: int, parts: int) -> pd.DataFrame:
    """Repeated strings of one shard as marks, and the sorted fingerprints of those of spread anchors."""
    raw = [np.frombuffer(x, np.uint8) for x in frame["bytes"]]
    bounds = np.cumsum([0, *(len(x) for x in raw)])
    data = np.concatenate(raw)
    at, group = repeated_groups(data, bounds, length)
    segment = np.searchsorted(bounds, at, side="right") - 1
    copies = frame["n"].to_numpy()[segment]
    many = np.bincount(group, np.where(copies > 1, 2, 1), minlength=int(group.max(initial=0)) + 1)[group] > 1
    start, rk = frame["start"].to_numpy(), frame["rk"].to_numpy()
    ids = frame["id"].to_numpy()
    rows = []
    single = copies == 1
    for s, a, b in _runs(segment[many & single], (at - bounds[segment])[many & single]):
        rows.append((rk[s], ids[s], start[s] + a, start[s] + b, None, None, None))
    spread = (frame["pieces"].to_numpy() > 1)[segment]
    if spread.any():
        first = np.unique(group[spread], return_index=True)[1]
        use = np.flatnonzero(spread)[first]
        d1 = Rolling(data, 3).of(at[use], at[use] + length)
        d2 = Rolling(data, 4).of(at[use], at[use] + length)
        lone = ~many[use]
        place = start[segment[use]] + at[use] - bounds[segment[use]]
        table = np.zeros(len(use), _PRINT)
        for name, v in (("d1", d1), ("d2", d2), ("lone", lone), ("rk", rk[segment[use]]), ("id", np.where(pd.isna(ids[segment[use]]), 0, ids[segment[use]]).astype(np.int64)), ("none", pd.isna(ids[segment[use]])), ("at", place)):
            table[name] = v
        table.sort(order=["d1", "d2"])
        part = (table["d1"] >> np.uint64(32)).astype(np.int64) * parts >> 32
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(table)]):
            rows.append((0, None, 0, 0, int(part[a]), int(frame["shard"].iloc[0]), table[a:b].tobytes()))
    return pd.DataFrame(rows, columns=["rk", "id", "start", "stop", "part", "shard", "prints"]).astype({"rk": "int64", "id": "Int64", "start": "int64", "stop": "int64", "part": "Int64", "shard": "Int64"})


_PRINT = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("lone", "?"), ("rk", "<i8"), ("id", "<i8"), ("none", "?"), ("at", "<i8")])
SHARD_OUT = "rk long, id long, start long, stop long, part long, shard long, prints binary"


def _runs(segment: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal runs [a, b) of positions in each segment."""
    if not len(segment):
        return
    order = np.lexsort((at, segment))
    segment, at = segment[order], at[order]
    head = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(head[1:], len(at)) - 1
    yield from zip(segment[head].tolist(), at[head].tolist(), (at[last] + 1).tolist())


def _merge(frame: pd.DataFrame) -> pd.DataFrame:
    """Strings without a partner in their own shard that another shard holds: binary search in a range's sorted fingerprints.

    A shard names each of its strings once, so a fingerprint that is there twice comes from two shards.
    """
    table = np.concatenate([np.frombuffer(x, _PRINT) for x in frame["prints"]])
    order = np.lexsort((table["d2"], table["d1"]))
    d1, d2 = table["d1"][order], table["d2"][order]
    rank = np.cumsum(np.concatenate([[True], (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])]))
    lone = np.flatnonzero(table["lone"][order])
    hit = np.searchsorted(rank, rank[lone], side="right") - np.searchsorted(rank, rank[lone], side="left") > 1
    found = table[order[lone[hit]]]
    ids = pd.array(np.where(found["none"], 0, found["id"]), dtype="Int64")
    ids[found["none"]] = pd.NA
    return pd.DataFrame({"rk": found["rk"], "id": ids, "start": found["at"], "stop": found["at"] + 1})


def removed_spans(starts: np.ndarray, stops: np.ndarray, length: int) -> np.ndarray:
    """Maximal runs of bytes covered by the strings that start in [start, stop), as rows (from, to)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(stops[order] + length - 1)
    head = np.concatenate([[True], a[1:] > b[:-1]])
    return np.stack([a[head], b[np.append(np.flatnonzero(head)[1:], len(a)) - 1]], axis=1)


def _result(raw: bytes, spans: np.ndarray) -> tuple[int, int, int, str, str]:
    kept, at = [], 0
    for a, b in spans.tolist():
        kept.append(raw[at:a])
        at = b
    kept.append(raw[at:])
    rest = b"".join(kept)
    return len(raw), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(rest).hexdigest(), rest.decode(errors="replace")


def _finish(length: int, with_text: bool, cut: bool):
    """rk, id, text, found -> results for documents whose marks are all known; others keep their text and segments to come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts, found = batch.column(2).to_pylist(), batch.column(3)
                flat, offs = found.flatten(), np.concatenate([[0], np.cumsum([len(x) if x is not None else 0 for x in found])])
                start, stop, opened = (np.asarray(flat.field(i).fill_null(0)) for i in range(3))
                out = []
                for k, text in enumerate(texts):
                    s = slice(offs[k], offs[k + 1])
                    known = opened[s] == 0
                    if cut and not known.all():
                        out.append((None, None, None, None, None, text))
                        continue
                    out.append((*_result((text or "").encode(), removed_spans(start[s][known], stop[s][known], length)), None))
                cols = list(zip(*out))
                kept = cols[4] if with_text else [None] * len(out)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(kept, pa.string()), pa.array(cols[5], pa.string()), found],
                    names=["rk", "id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", "text", "found"],
                )

    return run


FOUND = "array<struct<start:long,stop:long,open:long,key:long,n:long,pieces:long,m:long>>"
FINISHED = f"rk long, id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string, text string, found {FOUND}"
SEGMENTS = "key long, n long, pieces long, rk long, id long, start long, bytes binary"


def _segments(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for rk, ident, text, found in zip(*(batch.column(i).to_pylist() for i in range(4))):
                raw = (text or "").encode()
                for x in found:
                    if x["open"]:
                        rows.append((x["key"], x["n"], x["pieces"], rk, ident, x["start"], raw[x["start"] : x["stop"] + length - 1]))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["key", "n", "pieces", "rk", "id", "start", "bytes"])

    return run


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, kgram: int = KGRAM, shard: int = SHARD, with_text: bool = True,
                     merge_rows: int = MERGE_ROWS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per input row: the id column, n_bytes, n_removed, n_spans, kept_sha256 and, on request, kept_text.

    Texts are UTF-8 bytes, null counts as empty; strings never cross rows and are judged on the input. Texts shorter than
    ``length`` lose nothing. Repeated rows are occurrences of their own, so both lose what they share. kept_text shows
    bytes of cut characters as replacement characters; kept_sha256 is over the bytes.
    """
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.select(F.xxhash64("id", "text").alias("rk"), "id", "text")
    seen = scratch(docs.where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length, kgram, slice_bytes), ANCHORS), "anchors")
    live = seen.where("n > 0").groupBy("key").agg(F.sum("n").alias("total")).where("total > 1").select("key")
    held = scratch(seen.where("n > 0").join(live, "key"), "held")
    segments = scratch(held.groupBy("key", "d1", "d2").agg(F.sum("n").alias("n"), F.min(F.struct("rk", "id", "start", "stop")).alias("at")), "segments")
    place = ["rk", "id", "start", "stop"]
    known = seen.where("n = 0 OR n > 1").select(*place)
    equal = held.where("n = 1").join(segments.where("n > 1").select("key", "d1", "d2"), ["key", "d1", "d2"]).select(*place)
    nothing = [F.lit(0).cast("long").alias(c) for c in ("open", "key", "n", "pieces", "m")]
    mixed = segments.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("lone")).where("m > 1 AND lone > 0")
    mixed = scratch(mixed, "mixed")  # read back, so that Spark may split a hot anchor's side of the join
    opened = segments.join(mixed, "key").select("at.*", F.lit(1).cast("long").alias("open"), "key", "n", F.ceil(F.col("m") / shard).cast("long").alias("pieces"), "m")
    marks = known.union(equal).select(*place, *nothing).union(opened)
    info = marks.groupBy("rk", "id").agg(F.collect_list(F.struct("start", "stop", "open", "key", "n", "pieces", "m")).alias("found"))
    a, b = docs.alias("a"), info.alias("b")
    met = a.join(b, (F.col("a.rk") == F.col("b.rk")) & F.col("a.id").eqNullSafe(F.col("b.id")), "left").select("a.rk", "a.id", "a.text", F.coalesce("b.found", F.array().cast(FOUND)).alias("found"))
    first = scratch(met.mapInArrow(_finish(length, with_text, True), FINISHED), "documents")

    waiting = first.where("n_bytes IS NULL").select("rk", "id", "text", "found")
    # A repeated row is one occurrence here; its twin has marked it as repeated already.
    cut = waiting.mapInArrow(_segments(length), SEGMENTS)
    prints = F.aggregate("found", F.lit(0).cast("long"), lambda n, x: n + F.when((x["open"] == 1) & (x["pieces"] > 1), x["stop"] - x["start"]).otherwise(0))
    counted = waiting.agg(F.sum(F.size(F.filter("found", lambda x: x["open"] == 1))), F.sum(prints)).first()
    shards, parts = (max(1, -(-int(n or 0) // size)) for n, size in zip(counted, (shard, merge_rows)))
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("key", F.pmod(F.xxhash64("rk", "start"), F.col("pieces"))), F.lit(shards)))
    sorted_shards = scratch(dealt.groupBy("shard").applyInPandas(lambda f: _shard(f, length, parts), SHARD_OUT), "shards")
    merged = sorted_shards.where("part IS NOT NULL").groupBy("part").applyInPandas(_merge, "rk long, id long, start long, stop long")
    more = sorted_shards.where("part IS NULL").select(*place).union(merged)
    more = more.select(*place, *nothing).groupBy("rk", "id").agg(F.collect_list(F.struct("start", "stop", "open", "key", "n", "pieces", "m")).alias("more"))
    w, m = waiting.alias("a"), more.alias("b")
    closed = w.join(m, (F.col("a.rk") == F.col("b.rk")) & F.col("a.id").eqNullSafe(F.col("b.id")), "left")
    closed = closed.select("a.rk", "a.id", "a.text", F.concat("a.found", F.coalesce("b.more", F.array().cast(FOUND))).alias("found"))
    last = closed.mapInArrow(_finish(length, with_text, False), FINISHED)
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept_text"] if with_text else [])
    return first.where("n_bytes IS NOT NULL").union(last).select(F.col("id").alias(id_col), *columns)
