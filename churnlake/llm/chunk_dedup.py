"""Exact dedup of texts by recipes of content-defined chunks.

Each text becomes its recipe: the ordered list of its chunks' identifiers (128-bit digests). Chunk edges
depend on nearby bytes only, so equal texts have equal recipes. Identifiers are verified: of the texts whose
recipes occur more than once, each task sends every distinct chunk's bytes once, and all bytes under one
identifier have to be equal. If two chunks ever share a digest, recipes are made again with a longer digest
for it. Then ordered lists are compared by a grouping of narrow rows; whole texts never move, except those
that a shuffled join meets where repeated recipes exceed the bound of a broadcast.

Texts are equal when they are so after lower-casing A-Z. Null counts as empty, and empty texts are equal.
Of equal texts the row with the largest id stays; a null id is smaller than any other; of fully repeated
rows one stays. Other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.common import _M, _M_INV, _BYTE, _power, blocks, cut, free_name, lowered, mix, small_side, utf8

WINDOW = 16
MEAN_BITS = 11
LEAST, MOST = 256, 16_384
BROADCAST_BYTES = 32 << 20


def chunk_edges(flat: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Ends of the chunks of each document: where a hash of the last WINDOW bytes has MEAN_BITS zero bits.

    Chunks have LEAST to MOST bytes; the last of a document may be shorter.
    """
    n = len(flat)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[flat] * _power(_M, n), out=sums[1:])
    rolled = mix((sums[WINDOW:] - sums[: max(0, n + 1 - WINDOW)]) * _power(_M_INV, n + 1)[: max(0, n + 1 - WINDOW)])
    marks = np.flatnonzero((rolled & np.uint64((1 << MEAN_BITS) - 1)) == 0) + WINDOW
    found = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        ends, last = [], a
        lo, hi = np.searchsorted(marks, (a + max(WINDOW, LEAST), b))
        for m in marks[lo:hi].tolist():
            if m - last < LEAST:
                continue
            while m - last > MOST:
                last += MOST
                ends.append(last)
            if m - last >= LEAST:
                ends.append(m)
                last = m
        while b - last > MOST:
            last += MOST
            ends.append(last)
        if b > last:
            ends.append(b)
        found.append(np.array(ends, np.int64))
    return found


def _digest(chunk: bytes, strong: frozenset[bytes]) -> bytes:
    short = hashlib.blake2b(chunk, digest_size=16).digest()
    return short if short not in strong else short + hashlib.sha512(chunk).digest()


def _chunked(batch: pa.RecordBatch, column: int):
    """Yields (row, bytes of the normalised text, ends of its chunks)."""
    flat, offsets = utf8(batch.column(column))
    for a, b in blocks(offsets):
        part, edges = lowered(flat[offsets[a] : offsets[b]]), offsets[a : b + 1] - offsets[a]
        raw = part.tobytes()
        for i, ends in enumerate(chunk_edges(part, edges)):
            start = int(edges[i])
            yield a + i, raw[start : int(edges[i + 1])], (ends - start).tolist()


def recipes(docs: DataFrame, strong: frozenset[bytes] = frozenset()) -> DataFrame:
    """(doc_id, text_sha256, recipe): the recipe is the digests of the chunks, one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, lists = [], []
            for _, raw, ends in _chunked(batch, 1):
                shas.append(hashlib.sha256(raw).hexdigest())
                lists.append(b"".join(_digest(raw[x:y], strong) for x, y in zip([0, *ends], ends)))
            yield pa.record_batch([batch.column(0), pa.array(shas, pa.string()), pa.array(lists, pa.binary())], ["doc_id", "text_sha256", "recipe"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, text_sha256 string, recipe binary")


def chunks(docs: DataFrame, strong: frozenset[bytes] = frozenset()) -> DataFrame:
    """(chunk_id, content): chunks of whole texts, each once for every batch of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            ids, contents, size = [], [], 0
            for _, raw, ends in _chunked(batch, 0):
                for x, y in zip([0, *ends], ends):
                    chunk = raw[x:y]
                    name = _digest(chunk, strong)
                    # what tells contents apart here is a digest of another kind, so a clash is still sent
                    if (key := name + hashlib.sha256(chunk).digest()) not in seen:
                        seen.add(key)
                        ids.append(name)
                        contents.append(chunk)
                        size += len(chunk)
                if size > 8 << 20:
                    yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], ["chunk_id", "content"])
                    ids, contents, size = [], [], 0
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array(contents, pa.binary())], ["chunk_id", "content"])

    return docs.select("text").mapInArrow(run, "chunk_id binary, content binary")


def verified_recipes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Recipes with verified identifiers, and the recipes that occur more than once, both as written tables."""
    strong: frozenset[bytes] = frozenset()
    while True:
        found = cut(recipes(docs, strong), "recipes")
        repeated = cut(
            found.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).filter("group_size > 1"),
            "repeated",
        )
        ids = cut(found.join(_bounded(repeated.select("recipe")), "recipe", "left_semi").select("doc_id").distinct(), "copies")
        d, c = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").alias("d"), small_side(ids).alias("c")
        contents = chunks(d.join(c, F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), "left_semi"), strong)
        # equal identifiers with different bytes; none is expected, each one costs another pass
        clash = contents.groupBy("chunk_id").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a != b")
        clashes = frozenset(bytes(r[0])[:16] for r in clash.select("chunk_id").limit(10_000).collect())
        if not clashes:
            return found, repeated
        strong |= clashes


def _bounded(by_recipe: DataFrame) -> DataFrame:
    size = by_recipe.agg(F.sum(F.length("recipe") + 64)).first()[0] or 0
    return F.broadcast(by_recipe) if size <= BROADCAST_BYTES else by_recipe


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found, repeated = verified_recipes(docs)
    same = Window.partitionBy("recipe", "doc_id").orderBy(F.lit(1))
    rows = found.withColumn("n", F.row_number().over(same)).join(_bounded(repeated), "recipe", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("n") == 1)).alias("kept"), "text_sha256",
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all their columns."""
    gone = cut(exact_dedup(docs).filter(~F.col("kept")).select("doc_id", "keep_id", "text_sha256"), "dropped")
    id_, sha_, n_ = (free_name(docs, x) for x in ("lost_id", "lost_sha", "lost_n"))
    lost = gone.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_)).distinct()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), upper, lower), 256)
    left = docs.join(small_side(lost), F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (sha == F.col(sha_)), "left_anti")
    # what is left of a text has the largest id; rows that repeat it under the same id go too
    twice = gone.filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    if not twice.take(1):
        return left
    n = F.row_number().over(Window.partitionBy("doc_id", sha).orderBy(F.lit(1)))
    return left.withColumn(n_, n).filter(F.col(n_) == 1).drop(n_)
