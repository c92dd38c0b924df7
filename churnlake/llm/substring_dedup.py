"""Removal of passages that occur in an earlier document, by relative Lempel-Ziv parsing.

The reference is every document of the corpus, indexed by its phrases of ``k`` words. The index is dealt by
phrase hash over reference blocks, and the phrases of every document are looked up in every block that
holds them: a phrase refers to its first place in the document with the smallest id. Along a document,
consecutive phrases whose references advance together form one factor, a copy of a passage of the reference;
where references jump a new factor begins. A factor has at least ``k`` words, and since every phrase is
looked up by itself, phrases that cross the edge of two factors are judged as all others are. The words
that factors from documents with a smaller id cover are removed.

Within a task, phrases that an earlier document of the same part of the corpus has are settled at once and
not sent, so a passage that a third of all documents share costs one entry per part. Phrases are compared
by 64-bit hashes of their words' 64-bit hashes. Rows with the same id never remove words of each other. A
null id counts as larger than all others; a null text has no words. Other columns are not read. The input
should be a table in files (see ``common.cut``), so that a repeated task sees the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import BROADCAST_ROWS, blocks, cut, ragged, segment_hashes, utf8, windows, words

PART_WORDS = 500_000
NO_ID = np.iinfo(np.int64).max
SENT = "bucket int, part long, a binary, b binary, c binary, d binary"
FOUND = "part long, a binary, b binary, c binary, d binary"


def _pack(x: np.ndarray) -> bytes:
    """Numbers as differences, their low bytes first, which compress well."""
    return np.diff(x, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _send(part: int, ids: np.ndarray, keys: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, places: np.ndarray, buckets: int) -> Iterator[dict]:
    """Entries of one part of the corpus: its directory, what is settled in it, and its phrases by bucket.

    places are numbers of words within the part; ids and sizes (in words) are those of its documents.
    """
    yield {"bucket": part % buckets, "part": part, "a": ids.tobytes(), "b": keys.tobytes(), "c": sizes.tobytes(), "d": None}
    if not len(hashes):
        return
    doc = ids[np.searchsorted(np.cumsum(sizes), places, "right")]
    order = np.argsort(hashes, kind="stable")
    heads = np.flatnonzero(np.append(True, np.diff(hashes[order]) != 0))
    counts = np.diff(np.append(heads, len(order)))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(doc[order], heads), counts)
    first = doc == least
    if not first.all():
        # the place in the part that a settled phrase refers to
        at = np.where(first, places, NO_ID)
        ref = np.empty(len(order), np.int64)
        ref[order] = np.repeat(np.minimum.reduceat(at[order], heads), counts)
        yield {"bucket": part % buckets, "part": part, "a": _pack(places[~first]), "b": _pack(np.full((~first).sum(), part)), "c": _pack(ref[~first]), "d": _pack(least[~first])}
    hashes, places, doc = hashes[first], places[first], doc[first]
    bucket = (hashes >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in range(buckets):
        at = order[edges[b] : edges[b + 1]]
        if len(at):
            yield {"bucket": b, "part": -part - 1, "a": hashes[at].tobytes(), "b": _pack(places[at]), "c": _pack(doc[at]), "d": None}


def _phrases(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, count
            if held:
                ids, keys, sizes, hashes, places = (np.concatenate(x) for x in zip(*held))
                held, size, count = [], 0, count + 1
                for rows in batched(_send(task << 32 | (count - 1), ids, keys, sizes, hashes, places, buckets), 64):
                    yield pa.RecordBatch.from_pylist(list(rows), schema)

        schema = pa.schema([("bucket", pa.int32()), ("part", pa.int64()), *((c, pa.binary()) for c in "abcd")])
        for batch in batches:
            ids = batch.column(0).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            flat, offsets = utf8(batch.column(2))
            for x, y in blocks(offsets):
                part, edges = flat[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x]
                starts, ends, doc = words(part, edges)
                hashes, at = windows(segment_hashes(part, starts, ends), doc, k)
                held.append((ids[x:y], keys[x:y], np.bincount(doc, minlength=y - x), hashes, at + size))
                size += len(starts)
                if size >= PART_WORDS:
                    yield from flush()
        yield from flush()
        pa.default_memory_pool().release_unused()

    narrow = docs.select(F.col("doc_id").cast("long"), _text_key(), "text")
    return narrow.mapInArrow(run, SENT)


def _text_key():
    return F.xxhash64("text").alias("key")


def _lookup(table: pa.Table) -> pa.Table:
    """One reference block: the phrases of one bucket. What is no phrase passes through."""
    part = table.column("part").to_numpy()
    out = table.filter(pa.array(part >= 0)).select(["part", "a", "b", "c", "d"])
    rows = table.filter(pa.array(part < 0))
    if not rows.num_rows:
        return out
    hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in rows.column("a")])
    places = np.concatenate([_unpack(x.as_py()) for x in rows.column("b")])
    doc = np.concatenate([_unpack(x.as_py()) for x in rows.column("c")])
    owner = np.repeat(-rows.column("part").to_numpy() - 1, [len(x.as_py()) // 8 for x in rows.column("a")])
    order = np.argsort(hashes, kind="stable")
    fresh = np.append(True, np.diff(hashes[order]) != 0)
    alone = fresh & np.append(fresh[1:], True)
    at = order[~alone]
    if not len(at):
        return out
    at = at[np.lexsort((places[at], owner[at], doc[at], hashes[at]))]
    heads = np.flatnonzero(np.append(True, np.diff(hashes[at]) != 0))
    ref = np.repeat(at[heads], np.diff(np.append(heads, len(at))))
    later = doc[at] > doc[ref]
    at, ref = at[later], ref[later]
    order = np.lexsort((places[at], owner[at]))
    at, ref = at[order], ref[order]
    cuts = np.flatnonzero(np.diff(owner[at])) + 1
    found = [
        {"part": int(owner[x[0]]), "a": _pack(places[x]), "b": _pack(owner[y]), "c": _pack(places[y]), "d": _pack(doc[y])}
        for x, y in zip(np.split(at, cuts), np.split(ref, cuts)) if len(x)
    ]
    return pa.concat_tables([out, pa.Table.from_pylist(found, out.schema)])


def factors(places: np.ndarray, ref_part: np.ndarray, ref_place: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First phrase, first word and number of words of each factor, from the phrases' places in order."""
    if not len(places):
        return places, places, places
    jump = (np.diff(places) != 1) | (np.diff(ref_part) != 0) | (np.diff(ref_place) != 1)
    heads = np.flatnonzero(np.append(True, jump))
    return heads, places[heads], np.diff(np.append(heads, len(places))) + k - 1


def _parse(k: int):
    """Factors of every document of one part, from its directory and what the reference blocks found."""
    names = ["doc_id", "key", "starts", "ends", "refs"]
    kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3]

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        ids, keys, sizes = next((np.frombuffer(r[c], np.int64) for c in "abc") for r in rows if r["d"] is None)
        found = [r for r in rows if r["d"] is not None]
        out: list[list] = [[], [], [], [], []]
        if found:
            place, ref_part, ref_place, ref_doc = (np.concatenate([_unpack(r[c]) for r in found]) for c in "abcd")
            order = np.argsort(place, kind="stable")
            place, ref_part, ref_place, ref_doc = place[order], ref_part[order], ref_place[order], ref_doc[order]
            edges = np.append(0, np.cumsum(sizes))
            cuts = np.searchsorted(place, edges)
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = cuts[i], cuts[i + 1]
                heads, starts, lengths = factors(place[a:b] - edges[i], ref_part[a:b], ref_place[a:b], k)
                row = (None if ids[i] == NO_ID else int(ids[i]), int(keys[i]), starts, starts + lengths, ref_doc[a:b][heads])
                for to, value in zip(out, row):
                    to.append(value)
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds)], names)

    return run


def parse(docs: DataFrame, k: int = 13, buckets: int | None = None) -> DataFrame:
    """Factors of every document that has any, as a written table.

    Columns: doc_id, key (a hash of the text), and arrays starts, ends (in words; factors may overlap by
    up to k - 1 words) and refs (the documents they are copied from).
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(_phrases(docs, k, buckets).groupBy("bucket").applyInArrow(_lookup, FOUND), "phrases")
    listed = found.groupBy("part").applyInArrow(_parse(k), "doc_id long, key long, starts array<long>, ends array<long>, refs array<long>")
    return cut(listed, "factors")


def remove_passages(docs: DataFrame, k: int = 13, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words joined by one space."""
    spans = parse(docs, k, buckets).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "starts", "ends").dropDuplicates(["__id", "__key"])
    size = spans.agg(F.sum(F.size("starts") + 4)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for x, y in blocks(offsets):
                count, removed, kept = [], [], []
                raw, edges = flat[offsets[x] : offsets[y]].tobytes(), (offsets[x : y + 1] - offsets[x]).tolist()
                for i in range(y - x):
                    found = raw[edges[i] : edges[i + 1]].split()  # bytes split at exactly these six signs
                    count.append(len(found))
                    starts = batch.column(2)[x + i].as_py()
                    if starts:
                        gone = np.zeros(len(found), bool)
                        ends = batch.column(3)[x + i].as_py()
                        gone[ragged(np.array(starts), np.array(ends) - np.array(starts))] = True
                        found = [w for w, g in zip(found, gone.tolist()) if not g]
                    removed.append(count[-1] - len(found))
                    kept.append(b" ".join(found))
                yield pa.record_batch(
                    [batch.column(0).slice(x, y - x), pa.array(count, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _text_key())
    side = F.broadcast(spans) if size <= 2 * BROADCAST_ROWS else spans
    joined = narrow.join(side, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    return joined.select("doc_id", "text", "starts", "ends").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
