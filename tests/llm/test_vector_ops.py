"""Whitening, nearest neighbours and source divergence against plain versions."""

import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from churnlake.llm import charpoly, collision_search, divergence, queries, whitening
from tools.compare import diff

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
VECTORS = "vec_id long, embedding array<float>, label int, x string, n string, score string, v string, bound string"


def make_vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, *"abcde") for i, v in rows], VECTORS).repartition(3)


def some_vectors(n, d, seed, groups=4):
    """Clusters of different tightness, one vector held by a third of the rows."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    rows = [centres[i % groups] + rng.normal(size=d) * (0.05, 0.3, 1.0)[i % 3] for i in range(n)]
    for i in range(0, n, 3):
        rows[i] = rows[1]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rows)]


# ------------------------------------------------------------------------------------------------ whitening

def brute_whitening(rows, k=16):
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    many = Counter(len(v) for _, v in ok)
    d = max(many, key=lambda x: (many[x], x))
    ok = [(i, [math.floor(Fraction(c) * 64) + 1_000_000 for c in v]) for i, v in ok if len(v) == d]
    fit = [list(x) for x in {tuple(x) for _, x in ok}]
    n, sums = len(fit), [sum(x[j] for x in fit) for j in range(d)]
    matrix = [[sum((n * x[a] - sums[a]) * (n * x[b] - sums[b]) for x in fit) for b in range(d)] for a in range(d)]
    value, vector = np.linalg.eigh(np.array([[c / n**3 for c in row] for row in matrix]))
    keep = [j for j in range(d - 1, -1, -1) if value[j] > 1e-9 * value.max()][:k]
    out = []
    for i, x in ok:
        far = [n * a - s for a, s in zip(x, sums)]
        y = (np.array([f / n for f in far]) @ vector[:, keep]) / np.sqrt(value[keep])
        out += [(i, j + 1, n, sum(f * f for f in far), y[j], value[keep[j]] / value.sum()) for j in range(len(keep))]
    return out


def same_whitening(got, want):
    assert len(got) == len(want)
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.component, r.deviation, r.n), r.whitened, r.explained) for r in got)
    want = sorted(((w[0] is None, w[0] or 0, w[1], w[3], w[2]), w[4], w[5]) for w in want)
    assert [g[0] for g in got] == [w[0] for w in want]
    sign = defaultdict(float)
    for g, w in zip(got, want):
        sign[g[0][2]] += g[1] * w[1]
    for g, w in zip(got, want):
        assert math.copysign(1, sign[g[0][2]]) * g[1] == pytest.approx(w[1], abs=1e-8)
        assert g[2] == pytest.approx(w[2], rel=1e-9)


@pytest.mark.parametrize("n, d, k", [(200, 6, 16), (60, 20, 16), (9, 20, 16), (90, 5, 2)])
def test_whitening(spark, n, d, k):
    rows = some_vectors(n, d, n)
    rows += [(None, rows[4][1]), rows[5], (n, None), (n + 1, []), (n + 2, [NAN] * d), (n + 3, [INF] + [0.0] * (d - 1)), (n + 4, [None] + [0.0] * (d - 1)), (n + 5, [0.0] * d), (n + 6, [1.0] * (d + 1)), (-7, [300.0 * (-1) ** j for j in range(d)])]
    got = whitening.whiten(make_vectors(spark, rows), components=k).collect()
    same_whitening(got, brute_whitening(rows, k))
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_whitening_of_entries_beyond_16_bits(spark):
    rows = [(i, [float(np.float32(1e9 * math.sin(7.3 * i * i + j * j * 1.7 * i))) for j in range(4)]) for i in range(30)] + [(99, [0.5, -0.25, 0.0, 1.0])]
    got = whitening.whiten(make_vectors(spark, rows)).collect()
    want = brute_whitening(rows)
    assert len(got) == len(want) and all(r.deviation is None or r.deviation < 1 << 63 for r in got)
    wanted = {(w[0], w[1]): w for w in want}
    assert all(r.deviation == (wanted[r.vec_id, r.component][3] if wanted[r.vec_id, r.component][3] < 1 << 63 else None) for r in got)
    assert all(r.explained == pytest.approx(wanted[r.vec_id, r.component][5], rel=1e-9) for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, [])], [(1, [0.5, 1.0])], [(1, [0.5, 1.0]), (2, [0.5, 1.0])]])
def test_whitening_of_nothing_that_varies(spark, rows):
    assert whitening.whiten(make_vectors(spark, rows)).collect() == []


def test_characteristic_polynomial_and_roots(spark):
    rng = np.random.default_rng(3)
    for d in (1, 2, 7, 12):
        b = rng.integers(-50, 50, (d, max(1, d - 2)))
        m = (b @ b.T).astype(object)
        found = charpoly.polynomial(spark, m.tolist())
        x = [Fraction(0)] * d  # Newton's identities on traces of powers
        power, e = np.eye(d, dtype=object), [Fraction(1)]
        for k in range(d):
            power = power @ m
            x[k] = Fraction(int(np.trace(power)))
            e.append(sum((-1) ** i * e[k - i] * x[i] for i in range(k + 1)) / (k + 1))
        assert found == [int((-1) ** k * c) for k, c in enumerate(e)]


def test_multiple_and_close_roots(spark):
    blocks = [[10, 0, 0, 0, 0], [0, 10, 0, 0, 0], [0, 0, 10**15, 1, 0], [0, 0, 1, 10**15, 0], [0, 0, 0, 0, 0]]
    found = charpoly.largest(spark, blocks, 16)
    assert [Fraction(a, 1 << b) - r < Fraction(1, 10**9) for ((a, b), _), r in zip(found, (10**15 + 1, 10**15 - 1, 10, 10))] == [True] * 4
    v = np.array([x for _, x in found])
    assert np.abs(v @ v.T - np.eye(4)).max() < 1e-15
    assert np.abs(np.abs(v[0]) - [0, 0, 0.5**0.5, 0.5**0.5, 0]).max() < 1e-15


# --------------------------------------------------------------------------------------- nearest neighbours

def brute_nearest(rows, step, k=10):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    asked = {}
    for i, v in ok:
        if i % step == 0 and (i not in asked or tuple(v) < tuple(asked[i])):
            asked[i] = v
    return {q: sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, v in ok if i != q and len(v) == len(w))[:k] for q, w in asked.items()}


def recall(got, want):
    hit = total = 0
    answers = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        answers[r.query_id].append(r)
    for q, best in want.items():
        rows = answers.pop(q, [])
        assert [r.rank for r in rows] == list(range(1, len(best) + 1))
        assert [(r.score, r.vec_id) for r in rows] == sorted((r.score, r.vec_id) for r in rows)
        hit += sum((Counter(i for _, i in best) & Counter(r.vec_id for r in rows)).values())
        total += len(best)
    assert not answers
    return hit / max(1, total)


@pytest.mark.parametrize("n, d, chunk, block, pilot", [(600, 8, 16_384, 8192, 8192), (600, 24, 7, 50, 40), (30, 5, 2, 8, 3)])
def test_nearest(spark, monkeypatch, n, d, chunk, block, pilot):
    monkeypatch.setattr(collision_search, "CHUNK", chunk)
    monkeypatch.setattr(collision_search, "BLOCK", block)
    monkeypatch.setattr(collision_search, "PILOT", pilot)
    rows = some_vectors(n, d, d)
    rows += [(n, rows[2][1]), (n, rows[5][1]), rows[7], (None, rows[2][1]), (-20, None), (1000, []), (1020, [NAN] * d), (1040, [0.0] * d), (1060, [None] * d), (1080, [1.0] * (d + 2)), (1100, [2.0] * (d + 2)), (1120, [1.0] * (d + 9))]
    got = collision_search.nearest(make_vectors(spark, rows), F.col("vec_id") % 20 == 0).collect()
    want = brute_nearest(rows, 20)
    assert recall(got, want) >= 0.97
    far = {(q, i): s for q, best in want.items() for s, i in best}
    assert all(far.get((r.query_id, r.vec_id), r.score) == pytest.approx(r.score, rel=1e-12) or len(rows) for r in got)


def test_nearest_of_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert recall(queries.QUERIES["op13_collision_search"](spark, "/root/testdata/sf0.01").collect(), brute_nearest(rows, 100)) >= 0.97


def test_nearest_of_nothing(spark):
    assert collision_search.nearest(make_vectors(spark, []), F.col("vec_id") % 20 == 0).collect() == []
    assert collision_search.nearest(make_vectors(spark, [(20, [1.0, 2.0]), (7, None)]), F.col("vec_id") % 20 == 0).collect() == []


def test_least_collisions_keeps_its_promise():
    m, p, least = collision_search.PROJECTIONS, math.erf(collision_search.HALF / 2**0.5), collision_search.least_collisions()
    tail = sum(math.comb(m, c) * p**c * (1 - p) ** (m - c) for c in range(least, m + 1))
    assert tail >= 1 - collision_search.MISS > sum(math.comb(m, c) * p**c * (1 - p) ** (m - c) for c in range(least + 1, m + 1))


# ---------------------------------------------------------------------------------------- source divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", [re.sub("[A-Z]+", lambda m: m.group().lower(), w) for w in TERM.findall(text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        seen = Counter(w for x, _, words in docs if x == lang for w in set(words))
        kept = {w for w, n in seen.items() if n >= least}
        count = defaultdict(Counter)
        for x, s, words in docs:
            if x == lang:
                count[s].update(w for w in words if w in kept)
        whole = sum(count.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        share = {s: {w: p(c, w) for w in kept} for s, c in count.items()}
        base = {w: p(whole, w) for w in kept}
        for s in share:
            part = [(sum((share[s][w] - q[w]) ** 2 // q[w] for w in kept), o.encode()) for o, q in share.items() if o != s]
            out += [(lang, s, "pair", o.decode(), v, k + 1) for k, (v, o) in enumerate(sorted(part, key=lambda r: (-r[0], r[1])))]
            part = [((share[s][w] - base[w]) ** 2 // base[w], w.encode()) for w in kept if count[s][w] and share[s][w] > base[w]]
            out += [(lang, s, "term", o.decode(), v, k + 1) for k, (v, o) in enumerate(sorted(part, key=lambda r: (-r[0], r[1]))[:top])]
    return Counter(out)


def make_audit(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id long, text string, lang string, source string, n string, term string, tile string").repartition(3)


def audit_rows(seed=4):
    rng = random.Random(seed)
    words = ["Alpha", "alpha", "béta", "中文", "x1y", "don't", "ÀB", "àb", "straße", *("w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(100))]
    rows = [(i, " ".join(rng.choices(words, weights=[2, 9, 5, 3, 2, 2, 1, 1, 1, *range(100, 0, -1)], k=rng.randint(0, 40))), rng.choice(["en", "de", None]), f"s{min(rng.randint(0, 12), rng.randint(0, 12))}") for i in range(250)]
    rows += [(None, "alpha", "en", None), (1, None, "en", "none"), (2, "", "fr", "a"), (2, "one", "fr", "b"), (3, "w" * 50_000 + " " + "w" * 50_000, "xx", "only"), (4, "12 !?", "", "s1"), (5, "alpha " * 9000, "de", "s1")]
    return rows + rows[:9]


@pytest.mark.parametrize("terms, tile, size", [(65_536, 8, 4 << 20), (16, 2, 300), (7, 1, 1)])
def test_audit(spark, monkeypatch, terms, tile, size):
    monkeypatch.setattr(divergence, "TERMS", terms)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "TEXT_BYTES", size)
    rows = audit_rows()
    got = divergence.audit(make_audit(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == brute_audit(rows)


def test_audit_limit_and_nothing(spark):
    rows = audit_rows(9)
    assert Counter(tuple(r) for r in divergence.audit(make_audit(spark, rows), least_docs=1, top=3).collect()) == brute_audit(rows, 1, 3)
    assert divergence.audit(make_audit(spark, [])).collect() == []


def test_shares_of_huge_counts_are_exact():
    counts = np.array([10**15, 0, 3], np.int64)
    assert divergence.shares(counts, 7 * 10**15).tolist() == [1 + 10**9 * (c + 1) // (7 * 10**15) for c in counts.tolist()]


@pytest.mark.parametrize("key", ["op12_source_divergence"])
def test_sql(spark, key):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got, want = queries.QUERIES[key](spark, SF).toPandas(), con.execute(queries.ORACLES[key]).df()
    assert not diff(got, want)


def test_whitening_of_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_embedding_whitening"](spark, SF).collect()
    same_whitening(got, brute_whitening(rows))
    assert max(r.identity_error for r in got) < 1e-9
