"""Document fingerprints as invertible Bloom lookup sketches of paragraphs, with DataFrame functions only.

The distinct paragraphs (lines) of a text are hashed to 64-bit digests. A sketch has CELLS cells; every digest
lies in three of them, which keep the number of digests, the XOR of the digests and the XOR of their check
hashes. The sketch of one version minus that of another has only the digests that differ; cells that
hold one digest are peeled until the difference is recovered or peeling gets stuck. On failure the
digests are dealt over four sketches by another hash, which together are four times as large, and those that
fail again are dealt further. Equal texts have equal sketches, and the recovered difference gives the
likeness of two texts: common paragraphs over all paragraphs (1 if neither has any).

Null counts as empty and has no paragraphs. Neighbours are found in descending order of id (then by a hash of
the text); a null id comes last. Repeated rows are documents of their own. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.common import cut, small_side

CELLS, HASHES, FANOUT = 12, 3, 4
PEELS = 12
CHECK = 7
MOST_LEVELS = 24
COARSE = 64


def paragraphs(text: Column) -> Column:
    """Distinct digests of the non-empty lines."""
    lines = F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x != ""))
    return F.transform(lines, lambda x: F.xxhash64(x))


def _cells(digest: Column, level: Column) -> Column:
    """The three cells of a digest, one in each third of the sketch."""
    h = F.xxhash64(digest, level)
    third = CELLS // HASHES
    return F.array(*[F.lit(j * third) + F.pmod(F.shiftright(h, 16 * j), F.lit(third)).cast("int") for j in range(HASHES)])


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` looks at it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sketch(digests: Column, level: Column) -> Column:
    """CELLS structs: n (digests), k (their XOR), c (XOR of their check hashes)."""
    placed = F.transform(digests, lambda d: F.struct(d.alias("k"), F.xxhash64(d, F.lit(CHECK)).alias("c"), _cells(d, level).alias("at")))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))

    def cells(entries: Column) -> Column:
        def cell(i: Column) -> Column:
            mine = F.filter(entries, lambda p: F.array_contains(p["at"], i))
            return F.aggregate(mine, empty, lambda s, p: F.struct((s["n"] + 1).alias("n"), s["k"].bitwiseXOR(p["k"]).alias("k"), s["c"].bitwiseXOR(p["c"]).alias("c")))

        return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)

    return _once(placed, cells)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, level: Column) -> Column:
    """Digests recovered from a difference of sketches, or null if peeling gets stuck."""
    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("found"))

    def pure(x: Column) -> Column:
        return (F.abs(x["n"]) == 1) & (x["c"] == F.xxhash64(x["k"], F.lit(CHECK)))

    def step(s: Column, _: Column) -> Column:
        # one digest a step
        def remove(one: Column) -> Column:
            return _once(F.struct(one["k"].alias("k"), one["n"].alias("n"), _cells(one["k"], level).alias("at"), F.xxhash64(one["k"], F.lit(CHECK)).alias("c")), without)

        def without(one: Column) -> Column:
            key, sign, at = one["k"], one["n"], one["at"]
            rest = F.transform(s["cells"], lambda x, i: F.when(
                F.array_contains(at, i),
                F.struct((x["n"] - sign).alias("n"), x["k"].bitwiseXOR(key).alias("k"), x["c"].bitwiseXOR(one["c"]).alias("c")),
            ).otherwise(x))
            return F.struct(rest.alias("cells"), F.concat(s["found"], F.array(key)).alias("found"))

        first = F.slice(F.filter(s["cells"], pure), 1, 1)
        return F.coalesce(F.get(F.transform(first, remove), F.lit(0)), s)

    done = F.aggregate(F.sequence(F.lit(1), F.lit(PEELS)), start, step)
    return _once(done, lambda d: F.when(F.forall(d["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0)), d["found"]))


def differences(pairs: DataFrame) -> DataFrame:
    """(pair, differ): how many digests are in one of the arrays a and b only, by peeling sketches.

    ``pairs`` has a column ``pair`` and arrays a and b of distinct digests. What cannot be peeled is dealt
    over FANOUT sketches at the next level. Every level is a written table.
    """
    work = pairs.select("pair", "a", "b")
    done: list[DataFrame] = []
    for level in range(MOST_LEVELS):
        at = F.lit(level)
        tried = cut(work.withColumn("found", F.size(peel(subtract(sketch(F.col("a"), at), sketch(F.col("b"), at)), at))), f"level{level}")
        done.append(tried.filter("found >= 0").select("pair", F.col("found").alias("differ")))
        stuck = tried.filter("found < 0 or found is null")
        if not stuck.take(1):
            break
        part = lambda x, g, at=at: F.filter(x, lambda d: F.pmod(F.xxhash64(d, at, F.lit(1)), F.lit(FANOUT)) == g)
        split = stuck.select("pair", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1))).alias("g"))
        work = split.select("pair", part("a", F.col("g")).alias("a"), part("b", F.col("g")).alias("b")).filter("size(a) + size(b) > 0")
    else:
        raise RuntimeError("a difference could not be peeled")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy("pair").agg(F.sum("differ").alias("differ"))


def fingerprint(digests: Column) -> Column:
    """The sketch at the first level as text: number of digests, then count, XOR and check of each cell."""
    parts = F.transform(sketch(digests, F.lit(0)), lambda x: F.concat_ws(".", F.hex(x["n"]), F.lower(F.hex(x["k"])), F.lower(F.hex(x["c"]))))
    return F.concat(F.size(digests).cast("string"), F.lit(":"), F.array_join(parts, "-"))


def with_next(docs: DataFrame, bytes_per_range: int = 16 << 20) -> DataFrame:
    """(doc_id, text, digests, next_text, next_digests): each document with the next one by descending id.

    Ids are cut at COARSE quantiles, and what lies between two of them evenly into ranges of about equal
    size; a range is one window. The first document of each range is also sent to the range
    before it, so whole texts are shuffled once. The driver sees a row for each coarse range only.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"k": F.coalesce("doc_id", F.lit(-(1 << 63))), "tie": F.xxhash64("text")})
    edges = sorted({int(e) for e in rows.approxQuantile("k", [i / COARSE for i in range(1, COARSE)], 0.2 / COARSE)})
    bounds = F.array(*[F.lit(e).cast("long") for e in edges]).cast("array<bigint>")
    rows = rows.withColumn("c", F.size(F.filter(bounds, lambda e: e <= F.col("k"))))
    stats = rows.groupBy("c").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.length("text")).alias("size")).collect()
    low, step, most = {}, {}, {}
    for r in stats:
        parts = r["size"] // bytes_per_range + 1
        low[r["c"]], step[r["c"]], most[r["c"]] = float(r["lo"]), (float(r["hi"]) - float(r["lo"]) + 1) / parts, parts - 1
    at = lambda values, kind: F.get(F.array(*[F.lit(values.get(c, 1)).cast(kind) for c in range(len(edges) + 1)]), F.col("c"))
    fine = F.least(at(most, "long"), F.floor((F.col("k").cast("double") - at(low, "double")) / at(step, "double")))
    rows = rows.withColumn("f", fine)

    # the first document of each range, and the range that it follows: the next one up, around the end
    heads = cut(rows.groupBy("c", "f").agg(F.max(F.struct("k", "tie")).alias("h")), "heads")
    heads = heads.withColumn("up", F.lead("f").over(Window.partitionBy("c").orderBy("f")))
    present = sorted(low)
    above = {c: present[(i + 1) % len(present)] for i, c in enumerate(present)}
    lowest = {r["c"]: r["f"] for r in heads.groupBy("c").agg(F.min("f").alias("f")).collect()}
    inside = F.col("up").isNotNull()
    guests = cut(heads.select(
        F.col("h.k").alias("gk"), F.col("h.tie").alias("gt"),
        F.when(inside, F.col("c")).otherwise(at(above, "int")).alias("hc"),
        F.when(inside, F.col("up")).otherwise(at({c: lowest[a] for c, a in above.items()}, "long")).alias("hf"),
    ), "guests")
    found = rows.join(small_side(guests, 400_000), (F.col("k") == F.col("gk")) & (F.col("tie") == F.col("gt")))
    found = found.dropDuplicates(["k", "tie", "hc", "hf"]).select("doc_id", "text", "k", "tie", F.col("hc").alias("c"), F.col("hf").alias("f"), F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(found).withColumn("digests", paragraphs(F.col("text")))
    window = Window.partitionBy("c", "f").orderBy("guest", F.desc("k"), F.desc("tie"))
    after = {"next_text": F.lead("text").over(window), "next_digests": F.lead("digests").over(window)}
    return both.withColumns(after).filter("not guest").select("doc_id", "text", "digests", "next_text", "next_digests")


def compare_with_edit(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit, whose last third comes from the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = with_next(docs).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring("next_text", F.lit(1), third)))
    rows = rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.col("digests").alias("own"), paragraphs(F.col("edited")).alias("edit"), F.col("next_digests").alias("next"),
    )
    rows = cut(rows, "digests").withColumn("row", F.monotonically_increasing_id())
    kinds = [F.struct(F.lit(0).alias("kind"), F.col("edit").alias("b")), F.struct(F.lit(1).alias("kind"), F.col("next").alias("b"))]
    rows = cut(rows, "rows")
    pairs = rows.select("row", F.col("own").alias("a"), F.explode(F.array(*kinds)).alias("x")).select(F.struct("row", F.col("x.kind").alias("kind")).alias("pair"), "a", F.col("x.b").alias("b"))
    found = differences(pairs).groupBy(F.col("pair.row").alias("row")).agg(
        F.sum(F.when(F.col("pair.kind") == 0, F.col("differ"))).alias("d0"), F.sum(F.when(F.col("pair.kind") == 1, F.col("differ"))).alias("d1"),
    )

    def likeness(other: str, differ: str) -> Column:
        both, d = F.size("own") + F.size(other), F.coalesce(differ, F.lit(0))
        return F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d))

    out = rows.join(found, "row", "left")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("edit")).alias("edited_fingerprint"),
        likeness("edit", "d0").alias("near_edited"), likeness("next", "d1").alias("near_next"),
    )
