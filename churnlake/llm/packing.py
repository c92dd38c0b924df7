"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Only documents longer than a sequence are cut: into full pieces and a first piece with the rest. Pieces
are dealt evenly over partitions of a bounded number of rows; each packs its own by best-fit decreasing
and certifies its count with lower bounds from dual-feasible functions. Partitions with a gap between
count and bound release the sequences that are not full; these are pooled over partitions, dealt anew and
packed again, and the new packing is taken where it saves sequences. Rounds end when no gap is left or when
a round saves nothing; then the part-filled sequences of all partitions, certified ones too, are pooled once. Only lengths and checksums move, never text.

A null or empty text is one piece with the end token alone. Rows with the same id are packed each on its
own. Other columns of the input are not read. A task holds ``rows_per_part`` rows of numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm import pairs
from churnlake.llm.common import blocks, cut

ROWS_PER_PART = 65_536
#: Text whose distinct words are merged at once, whatever the size of Arrow's batches (or one longer text).
SLICE_BYTES = 8 << 20
_loaded: dict[int, pairs.Merges] = {}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, part long, bin long, offset long, bins long, bound long"


def tokenise(docs: DataFrame, tokenizer_file: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32 (and the ids as bytes)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = shared.value
        if hash(file) not in _loaded:
            _loaded.clear()
            _loaded[hash(file)] = pairs.Merges(*pairs.read_merges(file), whole=False, added=pairs.read_added(file))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for p, q in blocks(np.append(0, np.cumsum(sizes, dtype=np.int64)), SLICE_BYTES):
                yield from slice_pieces(batch.slice(p, q - p), _loaded[hash(file)])
        pa.default_memory_pool().release_unused()

    def slice_pieces(batch: pa.RecordBatch, merges: pairs.Merges) -> Iterator[pa.RecordBatch]:
        names = batch.column(0).to_pylist()
        for at, ids, counts in pairs.encode_texts(batch.column(1), merges):
            ends = np.cumsum(counts)
            flat = np.insert(ids, ends, end_id).astype("<u4")  # the end token of each document
            rows: list[list] = [[], [], [], [], [], []]
            for i, (a, b) in enumerate(zip((ends - counts + np.arange(len(counts))).tolist(), (ends + np.arange(len(counts)) + 1).tolist())):
                first = (b - a - 1) % capacity + 1
                edges = [a, *range(a + first, b + 1, capacity)]
                for k, (x, y) in enumerate(zip(edges, edges[1:])):
                    for to, value in zip(rows, (names[at + i], k, x - a, y - x, zlib.crc32(flat[x:y]), flat[x:y].tobytes() if with_ids else None)):
                        to.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(r, k) for r, k in zip(rows, kinds)][: 5 + with_ids], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """A number of sequences below which no packing of these lengths (each ``times`` often) can get.

    The largest bound of three families of dual-feasible functions: identity, rounding
    (floor((k+1) x) / k) and threshold (large pieces count whole, small ones nothing).
    """
    if not len(lengths):
        return 0
    sizes, many = np.unique(lengths, return_counts=True)
    if times is not None:
        many = np.bincount(np.searchsorted(sizes, lengths), times, len(sizes)).astype(np.int64)
    best = -(-int((sizes * many).sum()) // capacity)
    for k in range(1, 65):
        whole, rest = divmod(sizes * (k + 1), capacity)
        # in units of 1 / (k * capacity): exact integers, no rounding error
        value = np.where(rest == 0, sizes * k, whole * capacity)
        best = max(best, -(-int((value * many).sum()) // (k * capacity)))
    small = sizes[sizes * 2 <= capacity]
    total, mass = np.append(0, np.cumsum(sizes * many)), np.append(0, np.cumsum(many))
    low = np.append(small, capacity // 2 + 1)
    a = np.searchsorted(sizes, low, "left")
    b = np.searchsorted(sizes, capacity - low, "right")
    large = mass[-1] - mass[np.maximum(a, b)]
    middle = total[np.maximum(a, b)] - total[a]
    return max(best, int((large + -(-middle // capacity)).max()))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of every piece: longest first, each into the fullest sequence that takes it."""
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a sequence with room r is open
    count = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            seq = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, seq, count = capacity, count, count + 1
        where[i], offset[i] = seq, capacity - room
        left = room - size
        if left:
            open_by_room[left].append(seq)
            rooms |= 1 << left
    return where, offset


def _pack_parts(pieces: DataFrame, capacity: int, rows_per_part: int) -> DataFrame:
    """Packs every partition of pieces; each row gets its partition's count and bound."""
    parts = -(-max(1, pieces.count()) // rows_per_part)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = frame["length"].to_numpy(np.int64)
        frame["bin"], frame["offset"] = best_fit(lengths, capacity)
        return frame.assign(bins=int(frame["bin"].max()) + 1, bound=lower_bound(lengths, capacity))

    dealt = pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.expr(f"pmod(monotonically_increasing_id() + shiftright(monotonically_increasing_id(), 33), {parts})").alias("part"))
    return dealt.groupBy("part").applyInPandas(run, PLACED)


def pack(pieces: DataFrame, capacity: int = 2048, rounds: int | None = None, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """Adds sequence_id and offset to pieces (rows as ``tokenise`` gives them, cut to a written table).

    ``rounds`` may limit the exchanges between partitions with a gap; None goes on while they save sequences.
    """
    packed = cut(_pack_parts(pieces, capacity, rows_per_part), "pack").withColumn("round", F.lit(0))
    lengths = pieces.groupBy("length").count().orderBy("length").toPandas()  # at most one row per length
    bound = lower_bound(lengths["length"].to_numpy(np.int64), capacity, lengths["count"].to_numpy(np.float64))
    key = ["round", "part", "bin"]

    def repacked(some: DataFrame, number: int) -> tuple[DataFrame, DataFrame] | None:
        """What stays of the rows and their new packing, if releasing the part-filled sequences saves any."""
        fill = some.groupBy(*key).agg(F.sum("length").alias("fill")).filter(F.col("fill") < capacity)
        pool = cut(some.join(fill.drop("fill"), key), "pool")
        before = pool.select(*key).distinct().count()
        if before < 2:
            return None
        again = cut(_pack_parts(pool, capacity, rows_per_part), "pack").withColumn("round", F.lit(number))
        if again.select("part", "bin").distinct().count() >= before:
            return None
        return pool.select(*key).distinct(), again

    kept: list[DataFrame] = []
    number = 1
    while rounds is None or number <= rounds:
        found = repacked(packed.filter(F.col("bins") > F.col("bound")), number)
        if found is None:
            break
        kept.append(packed.join(found[0], key, "left_anti"))
        packed, number = found[1], number + 1
    for part in kept:
        packed = packed.unionByName(part)
    # every certified partition may still waste the rest of a sequence: all that are not full, once
    if packed.select(*key).distinct().count() > bound:
        found = repacked(packed, number)
        if found is not None:
            packed = packed.join(found[0], key, "left_anti").unionByName(found[1])
    return packed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("round").cast("long") * (1 << 54) + F.col("part") * (1 << 20) + F.col("bin")).alias("sequence_id"), "offset",
    )


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, **options) -> DataFrame:
    """Tokenises whole texts and packs their pieces; see ``pack``."""
    return pack(cut(tokenise(docs, tokenizer_file, capacity), "pieces"), capacity, **options)


def sequences(pieces_with_ids: DataFrame, placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the tokens of each sequence, from ``tokenise(..., with_ids=True)`` and a placement.

    Needs distinct (doc_id, piece); a sequence holds at most ``capacity`` tokens, so its group is bounded.
    """
    rows = placed.select("doc_id", "piece", "sequence_id", "offset").join(pieces_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return rows.groupBy("sequence_id").agg(F.expr("1").alias("_"), parts.alias("p")).select("sequence_id", F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
