"""N-gram Jaccard join of whole documents, exact, with signature trees.

1. Every text becomes its set of distinct word n-grams (64-bit hashes). Equal sets are one node.
2. Two sets that reach the threshold share one of their first ``n - ceil(t n) + 1`` grams in any order that
   is the same for all; here grams that repeat often come last, then by hash. Nodes that share such a
   gram form a group; equal groups are one, and groups are cut where sizes differ too much to link.
3. In each group nodes are tried against a centre, the node with the most shared grams. Groups whose
   nodes are then in one component are done.
4. In every other group signature trees are built: a leaf is a node's bitmap (4 to 8 bits a gram) and
   size, an inner node the OR of its children's bitmaps, their range of sizes and their component if it is
   one. A traversal of two trees descends only into pairs whose largest possible overlap can reach the
   threshold and that are not in one component already. Nodes of one bitmap width share a tree, and
   the next wider ones are folded to it (sizes that link are never further apart). Groups over ``BLOCK`` nodes
   are dealt into blocks, and trees of every two blocks are traversed by different tasks.
5. In larger groups first only every node's best partner is verified on the full sets, so that copies of one
   text soon are one component; then all pairs that are left between components. Components of the links
   label the documents.

Only the order in step 2 uses a bounded list (the ``HOT`` most repeated grams); any list gives the same
result. A set is identified by a 64-bit digest: two different sets among N have the same one with a
probability of about N * N / 2**65.

Null and empty texts have no grams and link with nothing; texts shorter than n words are one gram. Rows with
one id are documents of their own. A null id is never the smallest of a component that has others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import U64, blocks, cut, free_name, lowered, mix, ragged, segment_hashes, small_side, utf8, windows, words
from churnlake.llm.components import components

HOT = 200_000
HOT_PER_PART = 20_000
PART_GRAMS = 2_000_000
LEAST_BITS, BITS_PER_GRAM = 256, 4
BLOCK = 1024
FANOUT = 8


# -------------------------------------------------------------------------------------------------- sets

def gram_sets(flat: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each document, sorted, laid end to end, and how many each has."""
    n = len(offsets) - 1
    flat = lowered(flat)
    starts, ends, doc = words(flat, offsets)
    hashes = segment_hashes(flat, starts, ends)
    grams, at = windows(hashes, doc, k)
    owner = doc[at]
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    for size in range(1, k):  # short texts: all their words as one gram
        short = np.flatnonzero(count == size)
        value = np.full(len(short), size, U64)
        for j in range(size):
            value = mix(value + hashes[first[short] + j])
        grams, owner = np.append(grams, value), np.append(owner, short)
    order = np.argsort(grams)
    order = order[np.argsort(owner[order].astype(np.int16 if n < 32_000 else np.int64), kind="stable")]
    grams, owner = grams[order], owner[order]
    fresh = np.append(True, (np.diff(grams) != 0) | (np.diff(owner) != 0))[: len(grams)]
    return grams[fresh], np.bincount(owner[fresh], minlength=n)


def _nodes(grams: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """One number for each set; empty sets get 0."""
    sums = np.append(U64(0), np.cumsum(mix(grams ^ U64(0x5851F42D4C957F2D))))
    ends = np.cumsum(sizes)
    return np.where(sizes > 0, mix(sums[ends] - sums[ends - sizes] + sizes.astype(U64)), U64(0)).view(np.int64)


def _sets_of(batch: pa.RecordBatch, column: int, k: int):
    flat, offsets = utf8(batch.column(column))
    for a, b in blocks(offsets):
        grams, sizes = gram_sets(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)
        yield a, b, grams, sizes, _nodes(grams, sizes)


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """Documents with a hash of their text, the node and size of their set, and grams that repeat within a part of the corpus."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("gram", pa.int64()), ("times", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, seen
            if held:
                grams, times = np.unique(np.concatenate(held), return_counts=True)
                grams, times = grams[times > 2], times[times > 2]
                most = np.argsort(-times, kind="stable")[:HOT_PER_PART]
                none = pa.nulls(len(most), pa.int64())
                yield pa.record_batch([none, none, none, none, pa.array(grams[most].view(np.int64)), pa.array(times[most])], schema=schema)
            held, size, seen = [], 0, set()

        for batch in batches:
            for a, b, grams, sizes, node in _sets_of(batch, 2, k):
                none = pa.nulls(b - a, pa.int64())
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node), pa.array(sizes.astype(np.int64)), none, none], schema=schema)
                fresh = np.zeros(b - a, bool)
                for i, x in enumerate(node.tolist()):  # copies count once
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                held.append(grams[np.repeat(fresh, sizes)])
                size += len(held[-1])
                if size >= PART_GRAMS:
                    yield from flush()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, "doc_id long, key long, node long, n long, gram long, times long")


# ------------------------------------------------------------------------------------------------ groups

def _prefixes(docs: DataFrame, k: int, share: tuple[int, int], hot, buckets: int) -> DataFrame:
    """The prefix of every distinct set of a task, by bucket of the gram."""
    schema = pa.schema([("bucket", pa.int32()), ("grams", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary())])
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, level = hot.value
        held: list[tuple] = []
        seen: set[int] = set()
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if held:
                grams, nodes, sizes = (np.concatenate(x) for x in zip(*held))
                bucket = ((grams >> U64(33)) % U64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = []
                for b in range(buckets):
                    at = order[edges[b] : edges[b + 1]]
                    if len(at):
                        rows.append({"bucket": b, "grams": grams[at].tobytes(), "nodes": nodes[at].tobytes(), "sizes": sizes[at].astype(np.int32).tobytes()})
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema)
            held, size = [], 0

        for batch in batches:
            for a, b, grams, sizes, node in _sets_of(batch, 0, k):
                fresh = np.zeros(b - a, bool)
                for i, x in enumerate(node.tolist()):
                    if x and x not in seen:
                        seen.add(x)
                        fresh[i] = True
                grams, sizes, node = grams[np.repeat(fresh, sizes)], sizes[fresh], node[fresh]
                owner = np.repeat(np.arange(len(sizes)), sizes)
                if len(known):
                    at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                    rank = np.where(known[at] == grams, level[at], 0)
                    if rank.any():
                        order = np.lexsort((rank, owner))  # stable: by hash within a rank
                        grams = grams[order]
                prefix = sizes - -(-sizes * num // den) + 1
                grams = grams[ragged(np.cumsum(sizes) - sizes, prefix)]
                held.append((grams, np.repeat(node, prefix), np.repeat(sizes, prefix)))
                size += len(grams)
                if size >= PART_GRAMS // 2:
                    yield from flush()
            if len(seen) > 1_000_000:
                seen.clear()
        yield from flush()

    return docs.select("text").mapInArrow(run, "bucket int, grams binary, nodes binary, sizes binary")


def _grouped(share: tuple[int, int]):
    """Nodes that share a gram of one bucket: group, node, n, centre. Equal groups of the bucket come once."""
    num, den = share
    names = ["grp", "node", "n", "centre", "size"]

    def run(table: pa.Table) -> pa.Table:
        gram = np.concatenate([np.frombuffer(x.as_py(), U64) for x in table.column("grams")])
        node = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("nodes")])
        n = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in table.column("sizes")])
        order = np.argsort(gram, kind="stable")
        fresh = np.append(True, np.diff(gram[order]) != 0)
        at = order[~(fresh & np.append(fresh[1:], True))]
        at = at[np.lexsort((node[at], n[at], gram[at]))]
        gram, node, n = gram[at], node[at], n[at].astype(np.int64)
        if len(at):
            keep = np.append(True, (np.diff(gram) != 0) | (np.diff(node) != 0) | (np.diff(n) != 0))
            gram, node, n = gram[keep], node[keep], n[keep]
            # a new group at each gram and wherever the next size is too large for all before it
            head = np.append(True, (np.diff(gram) != 0) | (n[:-1] * den < n[1:] * num))
            heads = np.flatnonzero(head)
            many = np.diff(np.append(heads, len(n)))
            value = mix(node.view(U64))
            key = mix(np.add.reduceat(value, heads) + many.astype(U64))
            # the centre is the member that shares the most grams of this bucket; ties by a hash of it. A group of
            # two goes by the hash alone: its centre is the same in every bucket, so that its pair is always one row
            _, own, shared = np.unique(node, return_inverse=True, return_counts=True)
            shared = np.where(np.repeat(many, many) > 2, np.minimum(shared[own], 1 << 20), 0)
            value = (U64(1 << 20) - shared.astype(U64)) << U64(43) | value >> U64(21)
            low = np.minimum.reduceat(value, heads)
            _, pick = np.unique(key, return_index=True)
            pick = pick[many[pick] > 1]
            rows = ragged(heads[pick], many[pick])
            grp, centre = np.repeat(key[pick].view(np.int64), many[pick]), np.repeat(low[pick], many[pick])
            node, n, value = node[rows], n[rows], value[rows]
            owner = np.repeat(np.arange(len(pick)), many[pick])
            lowest = np.flatnonzero(value == centre)  # members with that value; the last one of each group counts
            chosen = np.empty(len(pick), np.int64)
            chosen[owner[lowest]] = node[lowest]
            centre = chosen[owner]
            return pa.table([pa.array(grp), pa.array(node), pa.array(n), pa.array(centre), pa.array(many[pick][owner])], names)
        none = pa.array([], pa.int64())
        return pa.table([none] * 5, names)

    return run


# ---------------------------------------------------------------------------------------------- verifying

def bitmap_of(grams: np.ndarray) -> np.ndarray:
    """Bitmap of a set, as wide as a power of two over BITS_PER_GRAM bits a gram."""
    width = max(LEAST_BITS, 1 << (BITS_PER_GRAM * len(grams) - 1).bit_length())
    flags = np.zeros(width, np.uint8)
    flags[(grams >> U64(20)) % U64(width)] = 1
    return np.packbits(flags).view(U64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of bitmaps folded to fewer words: a gram keeps its place modulo the width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, words), axis=1)


def _full_sets(docs: DataFrame, k: int, bitmap: bool) -> DataFrame:
    """(node, n, data): the sets of these documents as sorted grams or as bitmaps, each once for a batch."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = {0}
            for a, b, grams, sizes, node in _sets_of(batch, 0, k):
                ends = np.cumsum(sizes)
                rows = []
                for i, x in enumerate(node.tolist()):
                    if x not in seen:
                        seen.add(x)
                        own = grams[ends[i] - sizes[i] : ends[i]]
                        if bitmap:
                            own = bitmap_of(own)
                        rows.append({"node": x, "n": int(sizes[i]), "data": own.tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return docs.select("text").mapInArrow(run, "node long, n long, data binary")


def _sets_for(nodes: DataFrame, docs: DataFrame, copies: DataFrame, k: int, bitmap: bool) -> DataFrame:
    """The sets (or bitmaps) of these nodes, worked out from one document of each, as a written table."""
    wanted = cut(copies.join(nodes, "node", "left_semi").select(F.col("doc_id").alias("wanted")).distinct(), "wanted")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(_full_sets(narrow.join(small_side(wanted), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi"), k, bitmap), "sets")


def _with_data(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the data of both; the second join is the only one that moves data if the pairs are few."""
    left = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("data").alias("a")).join(small_side(pairs.select("x", "y")), "x")
    ends = small_side(cut(pairs.select("y").distinct(), "ends"))
    right = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("data").alias("b")).join(ends, "y", "left_semi")
    return left.join(right, "y").select("x", "y", "nx", "ny", "a", "b")


def _possible(pairs: DataFrame, bitmaps: DataFrame, share: tuple[int, int]) -> DataFrame:
    """The pairs that bitmaps and sizes do not rule out, as a written table."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nx, ny = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            most = np.zeros(len(nx), np.int64)
            for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5))):
                a, b = np.frombuffer(a.as_buffer(), U64)[None], np.frombuffer(b.as_buffer(), U64)[None]
                width = min(a.shape[1], b.shape[1])
                a, b = folded(a, width), folded(b, width)
                most[i] = min(nx[i] - np.bitwise_count(a & ~b).sum(dtype=np.int64), ny[i] - np.bitwise_count(b & ~a).sum(dtype=np.int64))
            yield batch.select([0, 1]).filter(pa.array(most * (num + den) >= num * (nx + ny)))

    return cut(_with_data(pairs, bitmaps).mapInArrow(run, "x long, y long").distinct(), "possible")


def _verify(pairs: DataFrame, docs: DataFrame, copies: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """Those of the pairs (x, y) whose sets reach the threshold, as a written table."""
    num, den = share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (a, b) in enumerate(zip(batch.column(4), batch.column(5))):
                a, b = np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64)
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                common = int((b[at] == a).sum())
                keep[i] = den * common >= num * (len(a) + len(b) - common)
            yield batch.select([0, 1]).filter(pa.array(keep))

    nodes = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    sets = _sets_for(nodes, docs, copies, k, bitmap=False)
    return cut(_with_data(pairs, sets).mapInArrow(run, "x long, y long").distinct(), "links")


# -------------------------------------------------------------------------------------------------- trees

class Tree:
    """Levels from the leaves to the root; each has bitmaps, sizes, least number of bits, components."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, label: np.ndarray):
        pop = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        one = np.ones(len(n), bool)
        self.levels = [(bits, n, n, pop, label, one)]
        while len(self.levels[-1][1]) > 1:
            bits, low, high, pop, label, one = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            a, b = np.minimum.reduceat(label, at), np.maximum.reduceat(label, at)
            self.levels.append((
                np.bitwise_or.reduceat(bits, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                np.minimum.reduceat(pop, at), a, (a == b) & np.logical_and.reduceat(one, at),
            ))


def traverse(a: Tree, b: Tree, same: bool, share: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of a and of b that may reach the threshold and are in different components, and how many
    grams they have in common at most."""
    num, den = share
    deep = max(len(a.levels), len(b.levels)) - 1
    x = y = np.zeros(1, np.int64)
    for depth in range(deep, -1, -1):
        la, lb = a.levels[min(depth, len(a.levels) - 1)], b.levels[min(depth, len(b.levels) - 1)]
        keep, bound = np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        step = max(64, (2 << 20) // max(1, la[0].shape[1]))  # 16 MB of bitmaps at once
        for at in range(0, len(x), step):
            i, j = x[at : at + step], y[at : at + step]
            low_a, high_a, pop_a, low_b, high_b, pop_b = la[1][i], la[2][i], la[3][i], lb[1][j], lb[2][j], lb[3][j]
            ok = (high_a * den >= low_b * num) & (high_b * den >= low_a * num)
            ok &= ~(la[5][i] & lb[5][j] & (la[4][i] == lb[4][j]))
            if same:
                ok &= i <= j
            live = np.flatnonzero(ok)
            common = np.bitwise_count(la[0][i[live]] & lb[0][j[live]]).sum(axis=1, dtype=np.int64)
            most = np.minimum(high_a[live] - np.maximum(0, pop_a[live] - common), high_b[live] - np.maximum(0, pop_b[live] - common))
            # overlap / union reaches num / den only if the overlap reaches num / (num + den) of both sizes together
            ok[live] = most * (num + den) >= num * (low_a[live] + low_b[live])
            bound[at : at + step][live] = most
            keep[at : at + step] = ok
        x, y, bound = x[keep], y[keep], bound[keep]
        if depth:
            x, y = _children(x, y, a, b, depth)
    return x, y, bound


def _children(x: np.ndarray, y: np.ndarray, a: Tree, b: Tree, depth: int) -> tuple[np.ndarray, np.ndarray]:
    def spread(i: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
        if depth >= len(tree.levels):
            return i, np.ones(len(i), np.int64)
        return i * FANOUT, np.minimum(FANOUT, len(tree.levels[depth - 1][1]) - i * FANOUT)

    first_a, many_a = spread(x, a)
    first_b, many_b = spread(y, b)
    left = ragged(first_a, many_a)
    owner = np.repeat(np.arange(len(x)), many_a)
    return np.repeat(left, many_b[owner]), ragged(first_b[owner], many_b[owner])


def _group_pairs(bits: list[np.ndarray], n: np.ndarray, label: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, share: tuple[int, int]):
    """Yields (rows of one side, rows of the other, bound) for the members of one group or pair of blocks."""
    width = np.array([len(b) for b in bits])
    for w in np.unique(width).tolist():
        trees: dict[tuple[int, bool], tuple[np.ndarray, Tree]] = {}

        def tree(side: int, wider: bool):
            if (side, wider) not in trees:
                rows = (left, right)[side]
                rows = rows[width[rows] == w * (1 + wider)]
                stack = folded(np.stack([bits[i] for i in rows]), w) if len(rows) else np.zeros((0, w), U64)
                trees[side, wider] = rows, Tree(stack, n[rows], label[rows]) if len(rows) else None
            return trees[side, wider]

        # equal widths, then this width against the next; between two blocks also the other way round
        sides = [((0, False), (0, False), True), ((0, False), (0, True), False)] if same else [((0, False), (1, False), False), ((0, False), (1, True), False), ((0, True), (1, False), False)]
        for one, two, alike in sides:
            (rows_a, a), (rows_b, b) = tree(*one), tree(*two)
            if a is not None and b is not None:
                i, j, bound = traverse(a, b, alike, share)
                yield rows_a[i], rows_b[j], bound


def _search(share: tuple[int, int], best: bool):
    """Traverses the trees of every group (or pair of blocks) of a bundle: pairs, or each node's best pair."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("grp", "ascending"), ("one", "ascending"), ("two", "ascending"), ("label", "ascending"), ("n", "ascending")])
        grp, one, two, own, node, n, label = (table.column(c).to_numpy() for c in ("grp", "one", "two", "own", "node", "n", "label"))
        bits = [np.frombuffer(x.as_buffer(), U64) for x in table.column("bits")]
        cuts = np.flatnonzero((np.diff(grp) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)) + 1
        xs, ys, scores = [], [], []
        for rows in np.split(np.arange(len(grp)), cuts):
            same = bool(one[rows[0]] == two[rows[0]])
            left, right = rows[own[rows] == one[rows]], rows[own[rows] == two[rows]]
            for i, j, bound in _group_pairs(bits, n, label, left, right, same, share):
                score = bound / (n[i] + n[j])
                if best and len(i):
                    i, j, score = np.append(i, j), np.append(j, i), np.append(score, score)
                    order = np.lexsort((node[j], -score, i))
                    order = order[np.append(True, np.diff(i[order]) != 0)]
                    i, j, score = i[order], j[order], score[order]
                xs.append(node[i])
                ys.append(node[j])
                scores.append(score)
        x, y, score = (np.concatenate(v) if v else np.zeros(0) for v in (xs, ys, scores))
        if best:
            order = np.lexsort((y, -score, x))
            order = order[np.append(True, np.diff(x[order]) != 0)[: len(order)]]
            x, y, score = x[order], y[order], score[order]
        else:
            x, y = np.minimum(x, y), np.maximum(x, y)
            if len(x):
                x, y = np.unique(np.stack([x, y]), axis=1)
            score = np.zeros(len(x))
        return pa.table([pa.array(x.astype(np.int64)), pa.array(y.astype(np.int64)), pa.array(score.astype(np.float64))], ["x", "y", "score"])

    return run


def _open_pairs(groups: DataFrame, labels: DataFrame, bitmaps: DataFrame, share: tuple[int, int], best: bool) -> DataFrame:
    """Pairs of unlinked components that trees cannot rule out, from the groups that hold several components."""
    named = groups.join(small_side(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = cut(named, "named")
    size = named.groupBy("grp").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("a"), F.max("label").alias("b")).filter("a != b")
    size = cut(size.select("grp", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "open")
    rows = named.join(small_side(size), "grp")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("one"), F.greatest(o, F.col("own")).alias("two"))))
    rows = rows.select("grp", "own", "node", "n", "label", pair.alias("p")).select("grp", "own", "node", "n", "label", "p.*")
    rows = cut(rows, "blocks")
    bundles = rows.count() // (8 * BLOCK) + 1
    rows = rows.join(bitmaps.select("node", F.col("data").alias("bits")).dropDuplicates(["node"]), "node")
    rows = rows.withColumn("bundle", F.pmod(F.xxhash64("grp", "one", "two"), F.lit(bundles)))
    found = rows.groupBy("bundle").applyInArrow(_search(share, best), "x long, y long, score double")
    if best:
        found = found.groupBy("x").agg(F.max_by("y", F.struct("score", "y")).alias("y"))
        found = found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return cut(found.select("x", "y").distinct(), "pairs")


# -------------------------------------------------------------------------------------------------- join

def _labelled(docs: DataFrame, k: int = 5, share: tuple[int, int] = (80, 100), buckets: int | None = None) -> DataFrame:
    """One row per document, as a written table: doc_id, key (a hash of the text), n, label (of its component)."""
    spark = docs.sparkSession
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    survey = cut(_survey(docs, k), "survey")
    owned = survey.filter("node is not null").select("doc_id", "key", "node", "n")
    hot = survey.filter("gram is not null").groupBy("gram").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "gram").limit(HOT).toPandas()
    order = np.argsort(hot["gram"].to_numpy(np.int64).view(U64))
    level = np.frexp(hot["times"].to_numpy(np.float64))[1].astype(np.int64)
    shared = spark.sparkContext.broadcast((hot["gram"].to_numpy(np.int64).view(U64)[order], level[order]))

    found = _prefixes(docs, k, share, shared, buckets).groupBy("bucket").applyInArrow(_grouped(share), "grp long, node long, n long, centre long, size long")
    groups = cut(found.dropDuplicates(["grp", "node"]), "groups")

    members = groups.select("node").distinct()
    copies = cut(owned.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(members, "node", "left_semi"), "copies")
    bitmaps = _sets_for(members, docs, copies, k, bitmap=True)

    # the pair of every group of two, and of larger groups the centre that a node meets most often
    star = groups.filter("size > 2 and node != centre").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("times"))
    star = star.groupBy("node").agg(F.max_by("centre", F.struct("times", "centre")).alias("y")).withColumnRenamed("node", "x")
    two = groups.filter("size = 2 and node != centre").select(F.col("node").alias("x"), F.col("centre").alias("y"))
    star = star.unionByName(two).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    star = cut(star.distinct(), "star")
    links = _verify(_possible(star, bitmaps, share), docs, copies, k, share)
    members = groups.filter("size > 2").select("grp", "node", "n")
    # labels spare pairs that are connected already; for the best partners a rough contraction is enough
    labels, settled = cut(components(links, 2, settled=False), "labels"), False
    for best in (True, False):
        if not best and not settled:
            labels, settled = cut(components(links), "labels"), True
        pairs = _open_pairs(members, labels, bitmaps, share, best=best)
        if pairs.take(1):
            more = _verify(pairs, docs, copies, k, share)
            if more.take(1):
                links, settled = cut(links.unionByName(more), "links"), False
    if not settled:
        labels = cut(components(links), "labels")

    named = owned.join(small_side(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    return cut(named.select("doc_id", "key", "n", "label"), "named")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that links lead to)."""
    named = _labelled(docs, **options)
    least = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    out = named.join(small_side(cut(least, "least")), "label", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of documents without those that another text of their component stands for.

    The text with the smallest id stands for a component; among texts under that id, one of them. Rows that
    repeat an id and its text go or stay together, and rows with a null id stay.
    """
    id_, key_ = (free_name(docs, x) for x in ("near_id", "near_key"))
    named = _labelled(docs, **options).filter("n > 0 and doc_id is not null")
    first = named.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
    gone = named.join(small_side(cut(first, "first")), "label").filter("doc_id != first.doc_id or key != first.key")
    gone = cut(gone.select(F.col("doc_id").alias(id_), F.col("key").alias(key_)).distinct(), "near")
    return docs.join(small_side(gone), (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(key_)), "left_anti")
