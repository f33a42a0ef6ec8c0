"""Benchmark decontamination with suffix arrays over the training documents.

1. The benchmark's words are hashed in tasks and dealt into blocks of bounded size; one block at a time is sent to all tasks.
2. A task turns the words of its documents into numbers of the block's vocabulary. A word that the block lacks ends a run,
   since no match crosses it, and runs shorter than the shortest window hold none. Over the runs of a shard it builds a suffix
   array: sorted by the first words packed in one number, refined by the rank twice as far ahead where still tied.
3. Every suffix of every benchmark item is binary-searched in every shard. Its neighbours there give its longest verbatim
   match and the place of it; where that reaches a whole window, the window's range of suffixes gives all occurrences.
4. What the blocks found is put together for each document: hit words and items with occurring windows.

A window is ``window`` consecutive words of an item, or all words of a shorter one. Words are runs of digits, letters a-z
after lower-casing A-Z, and bytes beyond ASCII; they are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.llm.common import SLICE_BYTES, Rolling, scratch, text_slices, with_columns, words

WINDOW = 10
#: Words of a suffix array; more are cut into overlapping stretches.
SHARD_WORDS = 1 << 20
#: Benchmark words that are sent to all tasks at once; a longer item is cut into pieces of a sixteenth, which overlap by a window.
BLOCK_WORDS = 1 << 21
ADDED = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]

_WITHIN = np.zeros(256, bool)
_WITHIN[48:58] = _WITHIN[97:123] = _WITHIN[128:] = True


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, words of each row) for runs of rows; a long row is hashed piece by piece."""
    for first, end, data, offsets in text_slices(column):
        if len(data) <= 2 * SLICE_BYTES or end - first > 1:
            low, starts, ends, row = words(data, offsets, _WITHIN)
            h = Rolling(low).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
            yield first, end, h, np.bincount(row, minlength=end - first)
            continue
        found, at = [], 0
        while at < len(data):
            to = min(at + SLICE_BYTES, len(data))
            while to < len(data):  # a cut is made beside a byte that belongs to no word
                lower = data[to : to + 65536]
                outside = np.flatnonzero(~(_WITHIN[lower] | (lower >= 65) & (lower <= 90)))
                if len(outside):
                    to += int(outside[0])
                    break
                to += len(lower)
            part = data[at:to]
            low, starts, ends, _ = words(part, np.array([0, len(part)]), _WITHIN)
            found.append(Rolling(low).of(starts, ends) if len(starts) else np.zeros(0, np.uint64))
            at = to
        h = np.concatenate(found)
        yield first, end, h, np.array([len(h)])


@dataclass
class Block:
    """Items of one block as numbers from 1, each item followed by a 0."""

    items: list[str]
    vocabulary: np.ndarray
    codes: np.ndarray
    end: np.ndarray
    item: np.ndarray
    window: int

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]], window: int) -> Block:
        hashes = [np.frombuffer(w, np.uint64) for _, w in rows]
        sizes = np.array([len(h) for h in hashes])
        vocabulary, code = np.unique(np.concatenate(hashes), return_inverse=True)
        stops = np.cumsum(sizes + 1)
        codes = np.zeros(stops[-1], np.int32)
        inside = np.ones(stops[-1], bool)
        inside[stops - 1] = False
        codes[inside] = code + 1
        names = sorted({name for name, _ in rows})
        number = {name: i for i, name in enumerate(names)}
        return cls(names, vocabulary, codes, np.repeat(stops - 1, sizes + 1), np.repeat([number[name] for name, _ in rows], sizes + 1), window)

    def needs(self) -> np.ndarray:
        """Words of the window that starts at each place: 0 where none does."""
        sizes = self.end - np.arange(len(self.codes))
        start = np.concatenate([[True], self.codes[:-1] == 0])
        whole = np.where(start & (sizes < self.window), sizes, 0)
        return np.where(sizes >= self.window, self.window, whole)


def packed(codes: np.ndarray, bits: int, wide: int) -> np.ndarray:
    """The first ``wide`` words from each place in one number; zeros behind a run's end."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(wide, codes.dtype)]).astype(np.uint64)
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(wide):
        c = padded[j : j + n]
        alive &= c > 0
        key = (key << np.uint64(bits)) | np.where(alive, c, np.uint64(0))
    return key


def run_ends(codes: np.ndarray) -> np.ndarray:
    """The place of the 0 that ends each place's run; the codes end with a 0."""
    zeros = np.flatnonzero(codes == 0)
    return zeros[np.searchsorted(zeros, np.arange(len(codes)))]


class Shard:
    """Suffix array over the runs of ``codes`` (numbers from 1, runs ended by 0), right to at least ``depth`` words."""

    def __init__(self, codes: np.ndarray, size: int, depth: int):
        self.codes, self.end = codes, run_ends(codes)
        self.bits = max(1, int(size).bit_length())
        self.wide = max(1, min(8, 64 // self.bits))
        key = packed(codes, self.bits, self.wide)
        places = np.flatnonzero(codes)
        sa = places[np.argsort(key[places])]
        self.keys = key[sa]
        n = len(sa)
        head = np.concatenate([[True], self.keys[1:] != self.keys[:-1]])[:n]
        rank = np.zeros(len(codes), np.int64)
        rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        h = self.wide
        while h < depth:
            slots = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(slots):
                break
            i = sa[slots]
            ahead = np.where(self.end[i] - i > h, rank[np.minimum(i + h, len(codes) - 1)], -1 - i)
            group = rank[i]
            order = np.lexsort((ahead, group))
            i, ahead, group = i[order], ahead[order], group[order]
            sa[slots] = i
            head[slots] = np.concatenate([[True], (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])])
            rank[i] = np.maximum.accumulate(np.where(head[slots], slots, 0))
            h *= 2
        self.sa = sa

    def common(self, slot: np.ndarray, codes: np.ndarray, at: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Equal words at the start of the suffix in each slot and of ``codes[at:stop]``."""
        place = self.sa[slot]
        most = np.minimum(self.end[place] - place, stop - at)
        same = np.zeros(len(slot), np.int64)
        open_ = np.flatnonzero(most > 0)
        while len(open_):
            equal = self.codes[place[open_] + same[open_]] == codes[at[open_] + same[open_]]
            open_ = open_[equal]
            same[open_] += 1
            open_ = open_[same[open_] < most[open_]]
        return same

    def bound(self, codes: np.ndarray, at: np.ndarray, stop: np.ndarray, after: bool) -> np.ndarray:
        """The first slot that is not below each pattern ``codes[at:stop]``, or with ``after`` the first one beyond all that start with it."""
        wide, bits = self.wide, self.bits
        room = np.minimum(stop - at, wide)
        key = packed(codes, bits, wide)[at]
        spare = ((wide - room) * bits).astype(np.uint64)
        low = key >> spare << spare
        high = low | ((np.uint64(1) << spare) - np.uint64(1))
        lo = np.searchsorted(self.keys, low, side="left")
        hi = np.searchsorted(self.keys, high, side="right")
        short = stop - at <= wide  # the packed words say all
        out = np.where(short & after, hi, lo)
        open_ = np.flatnonzero(~short & (lo < hi))
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            same = self.common(mid, codes, at[open_], stop[open_])
            place = self.sa[mid]
            whole = at[open_] + same == stop[open_]
            ended = place + same == self.end[place]
            below = np.where(whole, after, ended | (self.codes[place + same] < codes[np.minimum(at[open_] + same, len(codes) - 1)]))
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
            open_ = open_[lo[open_] < hi[open_]]
        return np.where(short, out, lo)

    def longest(self, codes: np.ndarray, at: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place) of the longest match of the start of each pattern; place -1 without one."""
        slot = self.bound(codes, at, stop, False)
        best, where = np.zeros(len(at), np.int64), np.full(len(at), -1, np.int64)
        for near in (slot - 1, slot):
            ok = np.flatnonzero((near >= 0) & (near < len(self.sa)))
            same = self.common(near[ok], codes, at[ok], stop[ok])
            better = same > best[ok]
            best[ok[better]], where[ok[better]] = same[better], self.sa[near[ok[better]]]
        return best, where


def _stretches(codes: np.ndarray, least: int, overlap: int, shard: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes of the runs of at least ``least`` words, each ended by a 0; their places) in stretches of about ``shard`` words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (codes > 0).view(np.int8), [0]])))
    first, last = edge[::2], edge[1::2]
    long = last - first >= least
    # The 0 behind a run stays with it.
    step = np.bincount(first[long], minlength=len(codes) + 2) - np.bincount(last[long] + 1, minlength=len(codes) + 2)
    inside = np.cumsum(step)[: len(codes) + 1] > 0
    places = np.flatnonzero(inside)
    all_codes = np.append(codes, 0)
    for a in range(0, len(places), shard):
        part = places[a : a + shard + overlap]
        yield np.append(all_codes[part], 0).astype(np.int32), part


def _search(block: Block, codes: np.ndarray, row: np.ndarray, shard_words: int):
    """Occurrences of the block's windows in the words of some rows.

    ``codes`` has a 0 behind each row; ``row`` is the row of each place. Returns hit marks by place, (row, item) pairs, and
    the longest match of every suffix of the block: words and place.
    """
    needs = block.needs()
    suffix = np.flatnonzero(block.codes)
    if not len(suffix):
        return np.zeros(len(codes), bool), np.zeros((0, 2), np.int64), (suffix, np.zeros(0, np.int64), np.zeros(0, np.int64))
    depth = int((block.end[suffix] - suffix).max())
    least = int(needs[needs > 0].min())
    best, where = np.zeros(len(suffix), np.int64), np.full(len(suffix), -1, np.int64)
    marks, pairs = np.zeros(len(codes) + 1, np.int64), []
    for part, places in _stretches(codes, least, depth, shard_words):
        shard = Shard(part, len(block.vocabulary), depth)
        same, place = shard.longest(block.codes, suffix, block.end[suffix])
        better = same > best
        best[better], where[better] = same[better], places[place[better]]
        use = suffix[(needs[suffix] > 0) & (same >= needs[suffix])]
        if not len(use):
            continue
        lo, hi = (shard.bound(block.codes, use, use + needs[use], after) for after in (False, True))
        # Windows with the same words have the same range; its suffixes are gone through once for each item.
        known = np.unique(np.stack([lo, hi, block.item[use], needs[use]], axis=1), axis=0)
        ranges, number = np.unique(known[:, [0, 1, 3]], axis=0, return_inverse=True)
        for i, (a, b, need) in enumerate(ranges.tolist()):
            at = places[shard.sa[a:b]]
            marks[at] += 1  # the places of a range differ
            marks[at + need] -= 1
            rows = np.unique(row[at])
            items = known[number.ravel() == i, 2]
            pairs.append(np.stack([np.repeat(rows, len(items)), np.tile(items, len(rows))], axis=1))
    both = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)
    return np.cumsum(marks)[:-1] > 0, both, (suffix, best, where)


def _coded(block: Block, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the words with a 0 behind each row, row of each place)."""
    at = np.minimum(np.searchsorted(block.vocabulary, hashes), len(block.vocabulary) - 1)
    code = np.where(block.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)
    stops = np.cumsum(counts + 1)
    codes = np.zeros(int(stops[-1]), np.int32)
    inside = np.ones(len(codes), bool)
    inside[stops - 1] = False
    codes[inside] = code
    return codes, np.repeat(np.arange(len(counts)), counts + 1)


def _gathered(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``hashed_words`` put together to about ``most`` words."""
    held, words_held = [], 0
    for x in hashed_words(column):
        held.append(x)
        words_held += len(x[2])
        if words_held >= most:
            yield held[0][0], held[-1][1], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
            held, words_held = [], 0
    if held:
        yield held[0][0], held[-1][1], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])


HIT = "array<struct<start:long,stop:long>>"


def _documents(sent, shard_words: int, every_row: bool):
    """rk, id, text -> rk, id, n_words, hits, items of each row (of rows with hits only, unless ``every_row``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for batch in batches:
            for first, end, hashes, counts in _gathered(batch.column(2), shard_words):
                codes, row = _coded(block, hashes, counts)
                hit, pairs, _ = _search(block, codes, row, shard_words)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
                begins = np.cumsum(counts + 1) - (counts + 1)
                start, stop = edge[::2], edge[1::2]
                owner = row[start]
                n = end - first
                runs = np.bincount(owner, minlength=n)
                found = np.bincount(pairs[:, 0], minlength=n)
                offsets = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]), pa.int32())
                spans = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(stop - begins[owner])], names=["start", "stop"])
                names = pa.array([block.items[i] for i in pairs[:, 1].tolist()], pa.string())
                use = np.arange(n) if every_row else np.flatnonzero(runs)
                own = batch.slice(first, n)
                out = pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(counts.astype(np.int64)), pa.ListArray.from_arrays(offsets(runs), spans), pa.ListArray.from_arrays(offsets(found), names)],
                    names=["rk", "id", "n_words", "hits", "items"],
                )
                yield out if every_row else out.take(pa.array(use))

    return run


def _matches(sent, shard_words: int):
    """id, text -> item, length, id, doc_word, item_word: the longest match of each item that some rows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        start = np.concatenate([[True], block.codes[:-1] == 0])
        begin = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
        for batch in batches:
            for first, _, hashes, counts in _gathered(batch.column(1), shard_words):
                codes, row = _coded(block, hashes, counts)
                _, _, (suffix, best, where) = _search(block, codes, row, shard_words)
                some = np.flatnonzero(best > 0)
                order = some[np.lexsort((suffix[some], -best[some], block.item[suffix[some]]))]
                item = block.item[suffix[order]]
                order = order[np.concatenate([[True], item[1:] != item[:-1]])[: len(order)]]
                at = where[order]
                begins = np.cumsum(counts + 1) - (counts + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.items[i] for i in block.item[suffix[order]].tolist()], pa.string()), pa.array(best[order]), batch.column(0).take(pa.array(first + row[at])),
                     pa.array(at - begins[row[at]]), pa.array(suffix[order] - begin[suffix[order]])],
                    names=["item", "length", "id", "doc_word", "item_word"],
                )

    return run


def _pieces(window: int, most: int):
    """item, text -> item, words (hashes), n; an item of more than ``most`` words in pieces that overlap by a window less one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts = [], []
            for first, _, hashes, counts in hashed_words(batch.column(1)):
                stops = np.cumsum(counts)
                for i, (stop, n) in enumerate(zip(stops.tolist(), counts.tolist())):
                    name = batch.column(0)[first + i].as_py()
                    step = most if n > most else max(n, 1)
                    for at in range(0, n, step):
                        part = hashes[stop - n + at : min(stop, stop - n + at + step + window - 1)]
                        if at == 0 or len(part) >= window:
                            names.append(name)
                            parts.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(parts, pa.binary()), pa.array([len(p) // 8 for p in parts], pa.int64())], names=["item", "words", "n"])

    return run


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[Block]:
    """The benchmark's items, at most about ``block_words`` words at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = scratch(items.mapInArrow(_pieces(window, max(window, block_words // 16)), "item string, words binary, n long").where("n > 0"), "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    many = -(-total // block_words)
    dealt = lambda: pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(many)))
    while many and dealt().groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] > 2 * block_words and many < total:
        many *= 2
    for i in range(many):
        rows = [(r["item"], bytes(r["words"])) for r in dealt().where(F.col("block") == i).select("item", "words").orderBy("item", "words").collect()]
        if rows:
            yield Block.of(rows, window)


def classify(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
             window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """rk (hash of id and text), the id column and ADDED, one row for every row of ``docs``.

    n_words; n_hit: words inside an occurrence of a window; items: ids of items with occurring windows as sorted strings, n_items
    of them, and the digest of their comma-joined list; contaminated: n_hit > 0. Null and empty texts have no words. Repeated
    rows each get a row of their own. Benchmark rows that repeat an id count as one item; a null id shows as ''. Items without
    words, and an empty benchmark, hit nothing.
    """
    spark = docs.sparkSession
    rows = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("rk"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = T.StructType([*rows.schema.fields[:2], *T._parse_datatype_string(f"n_words long, hits {HIT}, items array<string>").fields])
    found = None
    for number, block in enumerate(blocks_of(benchmark, item_col, item_text, window, block_words)):
        sent = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(_documents(sent, shard_words, number == 0), schema).withColumn("copies", F.lit(int(number == 0)))
        part = scratch(part, "hits")
        sent.destroy()
        found = part if found is None else found.union(part)
    if found is None:
        nothing = Block([], np.zeros(1, np.uint64), np.zeros(1, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64), window)
        sent = spark.sparkContext.broadcast(nothing)
        found = rows.mapInArrow(_documents(sent, shard_words, True), schema).withColumn("copies", F.lit(1))
    # A repeated row shows in the first block's part as often as it stands in the table; all its rows have the same hits.
    merged = found.groupBy("rk", "id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.sum("copies").alias("copies"))
    covered = F.expr("aggregate(hits, named_struct('n', 0L, 'to', 0L), (s, x) -> named_struct('n', s.n + greatest(0L, x.stop - greatest(s.to, x.start)), 'to', greatest(s.to, x.stop)), s -> s.n)")
    merged = merged.withColumn("n_hit", covered).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))))
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return merged.select("rk", F.col("id").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", listed.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
                    window: int = WINDOW, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """item (as a string), length, the id column, doc_word, item_word: each item's longest verbatim match in words, and one place of it.

    Only runs of words as long as the benchmark's shortest window are looked at, so shorter matches may not show. The match
    that starts first in the item is given, in the smallest id (as a string), at its first word.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    places = T._parse_datatype_string("doc_word long, item_word long").fields
    schema = T.StructType([*T._parse_datatype_string("item string, length long").fields, rows.schema["id"], *places])
    found = docs.sparkSession.createDataFrame([], schema)
    for block in blocks_of(benchmark, item_col, item_text, window, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)
        found = found.union(scratch(rows.mapInArrow(_matches(sent, shard_words), schema), "matches"))
        sent.destroy()
    first = F.struct((-F.col("length")).alias("l"), "item_word", F.col("id").cast("string").alias("i"), "doc_word")
    best = found.groupBy("item").agg(F.min_by(F.struct("length", "id", "doc_word", "item_word"), first).alias("m"))
    return best.select("item", "m.length", F.col("m.id").alias(id_col), "m.doc_word", "m.item_word")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no window of a benchmark item."""
    bad = classify(docs, benchmark, id_col, text_col, **options).where("contaminated").select(F.col("rk").alias("__rk")).distinct()
    clean = docs.withColumn("__key", F.xxhash64(F.col(id_col), F.col(text_col))).join(bad, F.col("__key") == F.col("__rk"), "left_anti")
    return clean.select(*with_columns(docs, []))
