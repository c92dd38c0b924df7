"""Helpers shared by the operators: cut lineage, checked broadcasts, vectorised text access.

The numpy helpers work on the UTF-8 bytes of an Arrow column without building Python strings.
A block of text is bounded by ``BLOCK_BYTES`` (one document at least), so that a task's memory does
not depend on the size of its partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlake.session import scratch_path

BLOCK_BYTES = 1 << 20
#: Rows of two numbers that may be broadcast: about 32 MB.
BROADCAST_ROWS = 2_000_000

U64 = np.uint64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back: lost executors never recompute what is below it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores before it until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it has at most ``limit`` rows, else as it is (a shuffled join).

    The frame has to be cheap to count: pass one that ``cut`` returned.
    """
    return F.broadcast(df) if df.count() <= limit else df


# ---------------------------------------------------------------------------------------------- arrow

def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return flat[:0], np.zeros(1, np.int64)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``limit`` bytes, or of one longer document."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every segment, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - (ends - lengths), lengths)


# -------------------------------------------------------------------------------------------- hashing

#: Odd multiplier of the rolling hash and its inverse modulo 2**64; random numbers for the 256 bytes.
_M = 0x9E3779B97F4A7C15
_M_INV = pow(_M, -1, 1 << 64)
_BYTE = np.random.default_rng(20240517).integers(0, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the process up to a few blocks."""
    key = f"{base:x}"
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 4 * BLOCK_BYTES:
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def segment_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each segment of bytes, by prefix sums of a rolling polynomial."""
    sums = np.zeros(len(flat) + 1, U64)
    np.cumsum(_BYTE[flat] * _power(_M, len(flat)), out=sums[1:])
    value = (sums[ends] - sums[starts]) * _power(_M_INV, len(flat) + 1)[starts]
    return mix(value + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word ``[^\\x20\\x09-\\x0D]+``; offsets[0] must be 0."""
    solid = ~_SPACE[flat]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(flat))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def windows(hashes: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every run of k words that lies in one document."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(docs[:n] == docs[k - 1 :])
    value = np.zeros(n, U64)
    for j in range(k):
        value += hashes[j : j + n] * U64(pow(_M_INV, j + 1, 1 << 64) | 1)
    return mix(value[at]), at


def lowered(flat: np.ndarray) -> np.ndarray:
    """A-Z in lower case; every other byte as it is."""
    return _LOWER[flat]
