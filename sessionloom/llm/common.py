"""Shared helpers: written tables that cut lineage, UTF-8 buffers of Arrow columns, digests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.session import checkpoint_folder


class Scratch:
    """Tables of one run below the shared checkpoint folder.

    A written table cuts the plan and survives a lost executor. A temporary folder serves only where no
    checkpoint folder is set, as in tests."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        try:
            top = checkpoint_folder(spark)
        except ValueError:
            top = tempfile.mkdtemp(prefix="sessionloom-")
        self.folder = f"{top.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        frame.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def remove(self, name: str) -> None:
        """Delete a table of this run that no later step reads; nothing happens where there is none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def held_out(column: Column, modulus: int, remainder: int) -> Column:
    """Rows kept back from learning: crc32 of the id as text; a null id is never kept back."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A plain string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "")


def utf8_pieces(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) over consecutive rows of some `limit` bytes.

    A longer text comes alone and whole, so memory is bounded by `limit` or the longest text."""
    column = text_array(column)
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, starts, data = column.buffers()
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, len(column))
        yield first, last, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i+1]] for each i, zero for an empty range."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def mix64(values: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values over the whole range."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(32))


_RANDOM = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = [_RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1) for _ in range(2)]
BASES = [0x9E3779B97F4A7C15, 0xD1342543DE82EF95]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(which: int, n: int, inverse: bool) -> np.ndarray:
    """1, b, b^2, ... modulo 2^64 for the base or its inverse, grown on demand."""
    found = _POWERS.get((which, inverse))
    if found is None or len(found) < n:
        base = pow(BASES[which], -1, 1 << 64) if inverse else BASES[which]
        steps = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        steps[0] = 1
        found = _POWERS[which, inverse] = np.multiply.accumulate(steps)
    return found[:n]


class RollingHash:
    """Hashes of any stretch of a byte array, modulo 2^64 over random byte codes."""

    def __init__(self, raw: np.ndarray, which: int = 0) -> None:
        n = len(raw)
        self.which = which
        self.inverse = _powers(which, n + 1, True)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[which][raw] * _powers(which, n, False), out=self.total[1:])

    def at(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Scattered hashes of raw[starts:stops]; the length takes part."""
        value = (self.total[stops] - self.total[starts]) * self.inverse[starts]
        return mix64(value + (stops - starts).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
