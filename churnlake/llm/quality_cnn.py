"""Quality of whole texts by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks: CHUNK window starts, STRIDE bytes apart, each window WIDTH bytes wide,
so that every byte lies in some window. Learned filters answer to each window; a chunk keeps the largest
answer of each filter, the document the largest, the mean and the smallest of its chunks, and a
logistic layer combines these into one probability. Training is stochastic gradient descent on a
bounded sample of labelled rows (``per_class`` of either label, ``chunks_per_text`` evenly spaced chunks of
each); scoring reads every byte of every text, a task at a time in blocks of bounded size.

Only bytes of the text enter a score. Null counts as empty; an empty text is one window of zero bytes.
Repeated rows get equal scores. Labels that are null are not learnt from; with labels of one kind only, or
none, every score is the share of label 1 (0.5 without any). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import blocks, ragged, utf8

WIDTH, STRIDE, CHUNK = 8, 2, 256
DIMS, FILTERS = 6, 24
CHUNK_BYTES = CHUNK * STRIDE + WIDTH
SLICE = 128  # chunks whose windows are in memory at once


@dataclass
class Network:
    letters: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray
    weights: np.ndarray  # 3 * FILTERS: largest, mean, smallest of the chunks
    offset: float


def windows_of(chunks: np.ndarray, net: Network) -> np.ndarray:
    """Windows of rows of CHUNK_BYTES bytes: chunks x CHUNK x (WIDTH * DIMS)."""
    x = net.letters[chunks]
    a, b, c = x.strides
    return np.lib.stride_tricks.as_strided(x, (len(chunks), CHUNK, WIDTH * DIMS), (a, b * STRIDE, c))


def chunk_rows(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of each document as rows of bytes (zero behind its end), their document, and their windows."""
    sizes = np.diff(offsets)
    many = np.maximum(1, -(-sizes // (CHUNK * STRIDE)))
    owner = np.repeat(np.arange(len(sizes)), many)
    start = ragged(np.zeros(len(many), np.int64), many) * (CHUNK * STRIDE)
    real = np.clip(sizes[owner] - start, 0, CHUNK_BYTES)
    rows = np.zeros((len(owner), CHUNK_BYTES), np.uint8)
    at = ragged(np.arange(len(owner)) * CHUNK_BYTES, real)
    rows.reshape(-1)[at] = flat[ragged(offsets[:-1][owner] + start, real)]
    used = np.clip(-(-(sizes[owner] - start) // STRIDE), 1, CHUNK)
    return rows, owner, used


def answers(rows: np.ndarray, used: np.ndarray, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of each filter in each chunk, and the window that gave it."""
    out = windows_of(rows, net).reshape(len(rows) * CHUNK, -1) @ net.filters
    out = out.reshape(len(rows), CHUNK, FILTERS)
    if (used < CHUNK).any():
        out[np.arange(CHUNK)[None, :] >= used[:, None]] = -np.inf
    best = out.argmax(axis=1)
    return np.tanh(np.take_along_axis(out, best[:, None, :], 1)[:, 0] + net.bias), best


def pooled(z: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.append(True, np.diff(owner) != 0))
    count = np.diff(np.append(heads, len(owner)))
    return np.concatenate([np.maximum.reduceat(z, heads), np.add.reduceat(z, heads) / count[:, None], np.minimum.reduceat(z, heads)], axis=1), heads, count


def probability(flat: np.ndarray, offsets: np.ndarray, net: Network) -> np.ndarray:
    rows, owner, used = chunk_rows(flat, offsets)
    z = np.concatenate([answers(rows[a : a + SLICE], used[a : a + SLICE], net)[0] for a in range(0, len(rows), SLICE)])
    return 1 / (1 + np.exp(-np.clip(pooled(z, owner)[0] @ net.weights + net.offset, -30, 30).astype(np.float64)))


def train(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 800, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Network:
    """A network for texts given as (rows of chunk bytes, used windows of each)."""
    rng = np.random.default_rng(seed)
    net = Network(
        rng.normal(0, 0.5, (256, DIMS)).astype(np.float32), rng.normal(0, 0.3, (WIDTH * DIMS, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS).astype(np.float32), 0.0,
    )
    parts = [net.letters, net.filters, net.bias, net.weights, np.zeros(1, np.float32)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    step = 0
    while step < steps:
        order = rng.permutation(len(texts))
        for at in range(0, min(len(order), (steps - step) * batch), batch):
            pick = order[at : at + batch]
            rows = np.concatenate([texts[i][0] for i in pick])
            used = np.concatenate([texts[i][1] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(texts[i][1]) for i in pick])
            z, best = answers(rows, used, net)
            features, heads, count = pooled(z, owner)
            p = 1 / (1 + np.exp(-np.clip(features @ net.weights + parts[4][0], -30, 30)))
            g = ((p - labels[pick]) / len(pick)).astype(np.float32)
            back = g[:, None] * net.weights[None, :]
            top, mean, low = back[:, :FILTERS], back[:, FILTERS : 2 * FILTERS], back[:, 2 * FILTERS :]
            dz = (mean / count[:, None])[owner]
            for value, share in ((features[:, :FILTERS], top), (features[:, 2 * FILTERS :], low)):
                hit = z == value[owner]
                dz += hit * (share / np.maximum(1, np.add.reduceat(hit, heads)))[owner]
            dz *= 1 - z * z
            win = windows_of(rows, net)
            n, f = len(rows), FILTERS
            chosen = win[np.repeat(np.arange(n), f), best.reshape(-1)].reshape(n, f, -1)
            dx = (dz[:, :, None] * net.filters.T[None]).reshape(n * f * WIDTH, DIMS)
            places = best.reshape(-1)[:, None] * STRIDE + np.arange(WIDTH)[None, :]
            bytes_ = rows[np.repeat(np.arange(n), f)[:, None], places].reshape(-1)
            letters = np.stack([np.bincount(bytes_, dx[:, d], 256) for d in range(DIMS)], axis=1)
            grads = [letters, np.einsum("nf,nfk->kf", dz, chosen), dz.sum(0), features.T @ g + 1e-4 * net.weights, np.array([g.sum()])]
            step += 1
            pace = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
            for p_, m, v, d in zip(parts, first, second, grads):  # Adam
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                p_ -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.offset = float(parts[4][0])
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, chunks_per_text: int = 12) -> Network | float:
    """Learns from labelled rows; returns a constant if there are not two kinds of labels."""
    spark = docs.sparkSession
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return float(next(iter(counts), 0.5))
    sample = []
    for y in (0, 1):  # a fixed pseudo-random choice
        sample += known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()
    wanted = spark.createDataFrame([(r["doc_id"], r["y"]) for r in sample], "__id long, y int").dropDuplicates(["__id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                rows, owner, used = chunk_rows(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out = []
                for i in range(b - a):
                    own = np.flatnonzero(owner == i)
                    own = own[np.unique(np.linspace(0, len(own) - 1, min(len(own), chunks_per_text)).astype(int))]
                    out.append((rows[own].tobytes(), used[own].astype(np.int64).tolist()))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.list_(pa.int64()))], ["y", "rows", "used"])

    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(wanted), "__id").dropDuplicates(["__id"])
    got = texts.select("y", "text").mapInArrow(run, "y int, rows binary, used array<long>").collect()
    got.sort(key=lambda r: (r["y"], bytes(r["rows"])))
    y = np.array([r["y"] for r in got], np.float64)
    if len(set(y.tolist())) < 2:
        return counts[1] / (counts[0] + counts[1])
    net = train([(np.frombuffer(r["rows"], np.uint8).reshape(-1, CHUNK_BYTES), np.array(r["used"])) for r in got], y)
    # the sample has other shares of the labels than all labelled rows
    net.offset += float(np.log(counts[1] / counts[0]) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score(docs: DataFrame, net: Network | float) -> DataFrame:
    """(doc_id, score): probability of label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets):
                if isinstance(shared.value, float):
                    value = np.full(b - a, shared.value)
                else:
                    value = probability(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(value)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def held_out(doc_id: str = "doc_id"):
    """The fold that no label is learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    net = fit(docs, labels.filter(~held_out()))
    return score(docs, net).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that score 0.5 or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels.filter(~held_out())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            if isinstance(net, float):
                if net >= 0.5:
                    yield batch
                continue
            flat, offsets = utf8(batch.column(batch.schema.get_field_index("text")))
            value = [probability(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], net) for a, b in blocks(offsets)]
            if value:
                yield batch.filter(pa.array(np.concatenate(value) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
