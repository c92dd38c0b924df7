"""Byte-level BPE encoding and decoding of whole texts.

Every task merges the distinct words of its part of the corpus at once: an index from token pair to word
positions is replayed in rank order and only the neighbours of a merge are touched (``pairs.Merges``).
Documents never move; the vocabulary is a broadcast of the size of its file.

Null texts count as empty and encode to no ids; null ids decode to no bytes and an
id outside the vocabulary is an error.
Repeated rows are encoded each. Only the key and the text are read, so other columns, whatever their
names, change nothing. A task's memory is that of one Arrow batch, or of one longer text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm import pairs
from churnlake.llm.common import utf8

_loaded: dict[int, pairs.Merges] = {}


def _merges(file: bytes) -> pairs.Merges:
    """The vocabulary of a .tiktoken file, kept by the worker process."""
    if hash(file) not in _loaded:
        _loaded.clear()
        _loaded[hash(file)] = pairs.Merges(pairs.read_ranks(file))
    return _loaded[hash(file)]


def binary_column(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column of consecutive pieces of an array."""
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def encode(docs: DataFrame, ranks_file: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids): ids as little-endian unsigned 32-bit integers, without special tokens.

    With ``decoded`` also what ``decode`` makes of them, in the same pass.
    """
    with open(ranks_file, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared.value)
        for batch in batches:
            for at, ids, counts in pairs.encode_texts(batch.column(1), merges):
                columns = [batch.column(0).slice(at, len(counts)), binary_column(ids.astype("<u4"), counts * 4)]
                if decoded:
                    columns.append(_spelled(ids, counts, merges))
                yield pa.record_batch(columns, [key, "ids", "decoded"][: len(columns)])

    narrow = docs.select(F.col(key), F.col(text))
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, ids binary" + ", decoded binary" * decoded)


def _spelled(ids: np.ndarray, counts: np.ndarray, merges: pairs.Merges) -> pa.Array:
    """The bytes of each run of ids."""
    if len(ids) and ids.max() >= len(merges.sizes):
        raise ValueError(f"id {ids.max()} is not in the vocabulary")
    out, sizes = merges.spell(ids)
    ends = np.append(0, np.cumsum(sizes))
    return binary_column(out, np.diff(ends[np.append(0, np.cumsum(counts))]))


def decode(encoded: DataFrame, ranks_file: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the bytes that the ids stand for."""
    with open(ranks_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _merges(shared.value)
        for batch in batches:
            rows = max(1, int(batch.num_rows * (2 << 20) / max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                flat, offsets = utf8(part.column(1))
                ids_ = np.frombuffer(flat.tobytes(), "<u4")
                yield pa.record_batch([part.column(0), part.column(1), _spelled(ids_, np.diff(offsets) // 4, merges)], [key, "ids", "decoded"])

    narrow = encoded.select(F.col(key), F.col(ids).alias("ids"))
    kind = narrow.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, ids binary, decoded binary")
