"""Shared helpers: scratch tables in the shared folder, Arrow text slices, numpy hashes."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
SLICE_BYTES = 2 << 20
SPACES = " \t\n\x0b\x0c\r"

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='wayline-shared-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The result's ``scratch_path`` is what ``release`` takes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wayline-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    # Spark's cleaner removes the shuffle files of plans that the driver's garbage collection has found unused.
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def release(table: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    spark, path = table.sparkSession, table.scratch_path
    _delete(spark, path)
    _written.remove((spark, path))


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear_scratch() -> None:
    """Delete every scratch table of this process; call it once the results have been written."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaning of the folder takes over
            continue


atexit.register(clear_scratch)


def bucket_of(id_col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: decides what is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def with_columns(df: DataFrame, drop: list[str]) -> list[str]:
    """The columns of ``df`` that do not clash with the ones an operator adds."""
    taken = {c.lower() for c in drop}
    return [f"`{c}`" for c in df.columns if c.lower() not in taken]


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``SLICE_BYTES``; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    width = np.int64 if large else np.int32
    offsets = np.frombuffer(offs, dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
        end = min(end, n)
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on uint64 arrays."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any byte ranges of an array by prefix sums of a polynomial modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        table = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed * 1000 + 7))
        power, inverse = self.powers(n + 1, seed)
        self.inverse = inverse
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * power[:n], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(seed)
        if have is None or len(have[0]) < n:
            size = max(n, SLICE_BYTES + 1)
            base = int(mix(np.array([seed], np.uint64))[0]) | 5
            back = pow(base, -1, 1 << 64)
            have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (base, back))
            if n <= SLICE_BYTES + 1:
                cls._powers[seed] = have
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def words(data: np.ndarray, offsets: np.ndarray, within: np.ndarray = ~_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, row of each word): runs of bytes marked in ``within`` (non-space ones) inside each row."""
    low = _LOWER[data]
    n = len(low)
    if not n:
        none = np.zeros(0, np.int64)
        return low, none, none, none
    solid = within[low]
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row begins
    starts = np.flatnonzero(solid & np.concatenate([[True], ~solid[:-1]]) | solid & first[:n])
    ends = np.flatnonzero(solid & (np.concatenate([~solid[1:], [True]]) | first[1:])) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def whole_numbers(vector: str, scale: int, bits: int) -> tuple[Column, Column]:
    """(whether a vector takes part, its components as whole numbers floor(scale * x)).

    A vector takes part if it and its components are neither null nor infinite nor NaN, and if a sum of products of any two of
    them stays under 2^bits: a component of 64 must be below 2^((bits - 6) / 2) after scaling.
    """
    x = lambda c: c.cast("double") * scale
    most = F.pow(F.lit(2.0), F.floor((bits - F.ceil(F.log2(F.greatest(F.size(vector), F.lit(1))))) / 2))
    usable = F.coalesce(F.col(vector).isNotNull() & F.forall(vector, lambda c: F.abs(x(c)) < most), F.lit(False))
    return usable, F.transform(vector, lambda c: F.floor(x(c)).cast("int"))
