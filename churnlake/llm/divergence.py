"""Audit of how sources differ: exact chi-square-like divergences of term shares, for all pairs of sources.

Terms are counted per block of text inside a task (distinct words of a block by an exact dictionary), then
summed by (lang, source, term). The terms that at least ``least_docs`` documents of a language hold are kept
and numbered within bounded ranges of the vocabulary (``TERMS`` a range on average). A group, which is one
(lang, source), is a sorted sparse array (term number, count) in each range.

Pairs of groups are priced by co-groups: groups are dealt into tiles of about ``TILE``, and one co-group holds
the arrays of two tiles for one range of terms; every unordered pair that meets there is merged once and
priced both ways. The shorter array is searched in the longer one (numpy starts each search where the one
before it ended, as galloping does); overlapping, one-sided and absent terms each have their price, absent
ones by their number. So no task holds more than two tiles of bounded arrays, however large a source is,
and prices add up over the ranges.

All arithmetic is on integers. Null text, lang or source counts as ''. Every row is a document of its own, also
one that repeats another or has no doc_id; doc_id and further columns are not read. A group without kept
terms has count 0 everywhere. A language without kept terms gives pairs of value 0 and no terms; a language
of one source gives no pairs. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.common import blocks, cut, lowered, small_side, utf8

#: Terms of a range on average, and groups of a tile on average.
TERMS = 65_536
TILE = 8
#: Shares are counted in units of one in UNIT.
UNIT = 1_000_000_000
TEXT_BYTES = 4 << 20

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def term_array(flat: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Every run of letters or bytes from 0x80 on, A-Z lower-cased, in order, with its document's number."""
    solid = _LETTER[flat]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(flat))]
    first[edges] = solid[edges]
    last[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(lowered(flat[solid]))])
    return words, np.searchsorted(offsets, starts, "right") - 1


def _counted(words: pa.Array, docs: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of every (group, term) of a block."""
    coded = words.dictionary_encode()
    size = len(coded.dictionary)
    both, times = np.unique(docs * size + coded.indices.to_numpy(), return_counts=True)
    which, back = np.unique(groups[both // size] * size + both % size, return_inverse=True)
    n, of = np.zeros(len(which), np.int64), np.bincount(back, minlength=len(which))
    np.add.at(n, back, times)
    return which // size, coded.dictionary.take(pa.array(which % size)), n, of


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term in every group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(0))
            lang, source = batch.column(1).dictionary_encode(), batch.column(2).dictionary_encode()
            many = max(1, len(source.dictionary))
            group = lang.indices.to_numpy().astype(np.int64) * many + source.indices.to_numpy()
            for a, b in blocks(offsets, TEXT_BYTES):
                words, owner = term_array(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(words):
                    g, term, n, of = _counted(words, owner, group[a:b])
                    yield pa.record_batch(
                        [lang.dictionary.take(pa.array(g // many)), source.dictionary.take(pa.array(g % many)), term.cast(pa.binary()), pa.array(n), pa.array(of)],
                        ["lang", "source", "term", "n", "docs"],
                    )

    raw = docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return raw.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, n, all_n, lead): counts of the kept terms; all_n is the language's count, one row a term leads."""
    same = Window.partitionBy("lang", "term")
    seen = term_counts(docs).withColumn("of", F.sum("docs").over(same))
    return seen.withColumn("all_n", F.sum("n").over(same)).withColumn("lead", F.min("source").over(same) == F.col("source")).filter(F.col("of") >= least_docs).drop("docs", "of")


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total), exact for counts of any size."""
    if len(counts) and int(counts.max()) >= (1 << 63) // UNIT - 1:
        return np.array([1 + UNIT * (int(c) + 1) // total for c in counts], np.int64)
    return 1 + UNIT * (counts.astype(np.int64) + 1) // total


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); the square of a difference of shares fits 64 bits."""
    return (p - q) ** 2 // q


def merge(a: tuple, b: tuple, absent: int) -> tuple[int, int]:
    """Prices of a against b and of b against a over one range of terms.

    Each is (term numbers, shares, share of a term that the group has not); ``absent`` is the size of the range.
    """
    if len(a[0]) > len(b[0]):
        return merge(b, a, absent)[::-1]
    (ids, p, p0), (others, q, q0) = a, b
    at = np.searchsorted(others, ids)
    hit = at < len(others)
    hit[hit] = others[at[hit]] == ids[hit]
    alone = np.ones(len(others), bool)
    alone[at[hit]] = False
    p1, q1, pa_, qb = p[hit], q[at[hit]], p[~hit], q[alone]
    none = absent - len(ids) - len(qb)
    there = int(price(p1, q1).sum()) + int(price(pa_, q0).sum()) + int(price(p0, qb).sum()) + none * int(price(p0, q0))
    back = int(price(q1, p1).sum()) + int(price(q0, pa_).sum()) + int(price(qb, p0).sum()) + none * int(price(q0, p0))
    return there, back


def _priced(left: pa.Table, right: pa.Table) -> pa.Table:
    """Prices of the pairs of two tiles in one range of terms, both ways."""

    def groups(table: pa.Table):
        found = []
        for row in range(table.num_rows):
            v, n = table["v"][row].as_py(), table["total"][row].as_py()
            ids = np.asarray(table["ids"][row].values if table["ids"][row].is_valid else [], np.int64)
            counts = np.asarray(table["counts"][row].values if table["counts"][row].is_valid else [], np.int64)
            zero = np.zeros(1, np.int64)
            found.append((table["source"][row].as_py(), (ids, shares(counts, n + v), shares(zero, n + v)[0]) if v else None))
        return sorted(found, key=lambda g: g[0])

    out = {"lang": [], "source": [], "item": [], "value": []}
    if left.num_rows and right.num_rows:
        lang, one, size = left["lang"][0].as_py(), left["ta"][0].as_py() == left["tb"][0].as_py(), left["size"][0].as_py()
        others = groups(right)
        for name, mine in groups(left):
            for other, yours in others:
                if one and name >= other:
                    continue
                there, back = merge(mine, yours, size) if mine else (0, 0)
                out["lang"] += [lang, lang]
                out["source"] += [name, other]
                out["item"] += [other, name]
                out["value"] += [there, back]
    return pa.table(out, schema=pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def pair_values(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language.

    groups: (lang, source, total); langs: (lang, v, all_total, sources).
    """
    langs = langs.select("lang", "v", F.expr(f"greatest(1, int(ceil(v / {TERMS})))").alias("ranges"), F.expr(f"int(ceil(sources / {TILE}))").alias("tiles"))
    inside = Window.partitionBy("lang", "range").orderBy("term")
    numbered = kept.join(small_side(langs.select("lang", "ranges")), "lang").withColumn("range", F.expr("int(pmod(xxhash64(term), ranges))")).withColumn("id", F.dense_rank().over(inside) - 1)
    numbered = cut(numbered.select("lang", "source", "range", "id", "n"), "numbered")
    sizes = cut(numbered.groupBy("lang", "range").agg((F.max("id") + 1).alias("size")), "range_sizes")
    sparse = numbered.groupBy("lang", "source", "range").agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("t"))
    sparse = sparse.select("lang", "source", "range", F.col("t.id").alias("ids"), F.col("t.n").alias("counts"))
    every = groups.join(small_side(langs), "lang").withColumn("range", F.explode(F.expr("sequence(0, ranges - 1)"))).withColumn("tile", F.expr("int(pmod(xxhash64(source), tiles))"))
    every = every.join(sparse, ["lang", "source", "range"], "left").join(small_side(sizes), ["lang", "range"], "left")
    every = cut(every.select("lang", "source", "range", "tile", "tiles", "v", "total", F.coalesce("size", F.lit(0)).alias("size"), "ids", "counts"), "group_arrays")
    keys, columns = ["lang", "range", "ta", "tb"], ["source", "v", "total", "size", "ids", "counts"]
    left = every.withColumn("ta", F.col("tile")).withColumn("tb", F.explode(F.expr("sequence(tile, tiles - 1)"))).select(*keys, *columns)
    right = every.withColumn("ta", F.explode(F.expr("sequence(0, tile)"))).withColumn("tb", F.col("tile")).select(*keys, *columns)
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_priced, "lang string, source string, item string, value long")
    return met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(count: str, total: str):
    return F.expr(f"1 + (cast({UNIT} as decimal(10,0)) * cast({count} + 1 as decimal(19,0))) div cast({total} as decimal(19,0))")


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200) -> DataFrame:
    """One row per pair of sources of a language, and per term that a source overuses up to rank ``top``.

    Columns: lang, source, part ('pair' or 'term'), item, value, rank.
    """
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    kept = cut(kept_terms(docs, least_docs), "kept_terms")
    seen = docs.select("lang", "source").distinct()
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("lead").cast("long")).alias("v"))
    groups = cut(seen.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "v"]), "groups")
    langs = cut(groups.groupBy("lang").agg(F.sum("v").alias("v"), F.sum("total").alias("all_total"), F.count(F.lit(1)).alias("sources")), "langs")
    groups = groups.drop("v")

    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(kept, groups, langs).withColumn("rank", F.row_number().over(by_value)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    used = kept.join(small_side(groups), ["lang", "source"]).join(small_side(langs), "lang")
    used = used.withColumn("p", _share("n", "total + v")).withColumn("q", _share("all_n", "all_total + v")).filter("p > q")
    terms = used.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).filter(F.col("rank") <= top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
