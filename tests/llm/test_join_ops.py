"""Near-duplicates, fingerprints, chat windows and archives against plain versions."""

import hashlib
import io
import random
import re
import zipfile
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from churnlake.llm import chat_format, jaccard_join, paragraph_sketch, warc_zip
from churnlake.llm.components import components

from .conftest import make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(corpus):
    sets = [shingles(t) for _, t in corpus]
    root = list(range(len(corpus)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(corpus):
        ids[find(i)].append(d)
    least = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(corpus))


@pytest.mark.parametrize("block, hot, part", [(1024, 200_000, 2_000_000), (4, 10, 500)])
def test_near_duplicates(spark, corpus, monkeypatch, block, hot, part):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "PART_GRAMS", part)
    rows = jaccard_join.near_duplicates(make_docs(spark, corpus), buckets=5).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == brute_components(corpus)


def test_near_duplicates_of_nothing_and_what_stays(spark, corpus):
    docs = make_docs(spark, corpus)
    assert jaccard_join.near_duplicates(docs.limit(0)).collect() == []
    left = jaccard_join.one_of_each(docs)
    assert left.columns == docs.columns
    gone = {d for d, _, c in brute_components(corpus) if d is not None and d != c}
    assert Counter(r.doc_id for r in left.collect()) == Counter(d for d, _ in corpus if d not in gone)


def test_one_of_each_tells_texts_of_one_id_apart(spark, vocabulary):
    near, clean, third = (" ".join(vocabulary[a : a + 60]) for a in (0, 100, 200))
    rows = [(1, near), (2, near + " more"), (2, clean), (3, clean + " more"), (4, near + " x y"), (4, near + " x z"), (5, ""), (5, None), (7, third), (7, third + " more")]
    left = [(r.doc_id, r.text) for r in jaccard_join.one_of_each(make_docs(spark, rows)).collect()]
    assert Counter(x for x in left if x[0] != 7) == Counter([rows[0], rows[2], *rows[6:8]])
    assert len(left) == 5 and left.count(rows[8]) + left.count(rows[9]) == 1


def test_a_pair_has_one_centre_in_all_buckets():
    p, q, r, s = 11, 12, 13, 14

    def groups(*grams):  # a bucket from (gram, nodes that hold it)
        rows = [(g, x) for g, nodes in grams for x in nodes]
        gram, node, size = (np.array(v, t).tobytes() for v, t in ((([g for g, _ in rows]), np.uint64), ([x for _, x in rows], np.int64), ([100] * len(rows), np.int32)))
        return jaccard_join._grouped((80, 100))(pa.table({"bucket": pa.array([0], pa.int32()), "grams": [gram], "nodes": [node], "sizes": [size]})).to_pylist()

    found = groups((1, (p, q)), (2, (p, r)), (3, (p, r))) + groups((4, (p, q)), (5, (q, s)), (6, (q, s)))
    pair = [x for x in found if x["node"] in (p, q) and x["grp"] in {y["grp"] for y in found if y["node"] == p} & {y["grp"] for y in found if y["node"] == q}]
    assert len(pair) == 4 and len({x["grp"] for x in pair}) == 1
    for one in (x for x in pair if x["node"] == p):  # whichever rows stay, one of them names the other node
        for two in (x for x in pair if x["node"] == q):
            assert (one["centre"] != p) != (two["centre"] != q)


def test_trees_find_every_pair():
    rng = np.random.default_rng(2)
    base = [rng.choice(4000, 300, replace=False) for _ in range(6)]
    sets, label = [], []
    for i in range(150):
        s = set(base[i % 6].tolist())
        for x in rng.choice(list(s), rng.integers(0, 60), replace=False):
            s.remove(x)
        sets.append(np.array(sorted(s | set(rng.choice(9000, rng.integers(0, 60)).tolist()))))
        label.append(i if i % 3 else i % 6)
    bits = np.zeros((len(sets), 4096), np.uint8)
    for i, s in enumerate(sets):
        bits[i, s % 4096] = 1
    words = np.packbits(bits, axis=1).view(np.uint64)
    n, label = np.array([len(s) for s in sets]), np.array(label)
    order = np.lexsort((n, label))
    tree = jaccard_join.Tree(words[order], n[order], label[order])
    x, y, bound = jaccard_join.traverse(tree, tree, True, (80, 100))
    assert all(b >= len(np.intersect1d(sets[order[i]], sets[order[j]])) for i, j, b in zip(x, y, bound))
    found = {(min(order[a], order[b]), max(order[a], order[b])) for a, b in zip(x, y)}
    checked = 0
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            common = len(np.intersect1d(sets[a], sets[b]))
            if label[a] != label[b] and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                assert (a, b) in found
                checked += 1
    assert checked > 20 and len(found) < 150 * 149 / 4
    one, two = jaccard_join.Tree(words[:40], n[:40], label[:40]), jaccard_join.Tree(words[40:], n[40:], label[40:])
    across = set(zip(*(v.tolist() for v in jaccard_join.traverse(one, two, False, (80, 100))[:2])))
    assert {(a, b - 40) for a, b in found if a < 40 <= b} <= across


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(50)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}


def lines(text):
    return {x for x in (text or "").split("\n") if x}


@pytest.mark.parametrize("size", [16 << 20, 3000])
def test_fingerprints(spark, corpus, size):
    rows = [(i, t) for i, t in dict(corpus).items() if i is not None] + [(200, "\n".join(f"line {i}" for i in range(400)))]
    docs = make_docs(spark, rows)
    if size < 1 << 20:
        found = paragraph_sketch.with_next(docs, size).select("doc_id", "next_text").collect()
        order = sorted(rows, key=lambda r: -r[0])
        after = {order[k - 1][0]: order[k][1] or "" for k in range(len(order))}
        assert {r.doc_id: r.next_text for r in found} == after
        return
    got = {r.doc_id: r for r in paragraph_sketch.compare_with_edit(docs).collect()}
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: -r[0])
    like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(like(lines(text), lines(edited))) and r.near_next == pytest.approx(like(lines(text), lines(after)))
        assert (r.fingerprint == r.edited_fingerprint) == (lines(text) == lines(edited))
    assert got[106].fingerprint == got[107].fingerprint == got[3].fingerprint


def test_fingerprints_of_few_rows(spark):
    assert paragraph_sketch.compare_with_edit(make_docs(spark, [(1, "x")]).limit(0)).collect() == []
    (only,) = paragraph_sketch.compare_with_edit(make_docs(spark, [(1, "abc\nabc\nabcd")])).collect()
    assert only.n_chars == 12 and only.near_next == 1.0
    rows = paragraph_sketch.compare_with_edit(make_docs(spark, [(1, "a\nb"), (1, "a\nb"), (None, None), (None, "z")])).collect()
    assert Counter(r.doc_id for r in rows) == {1: 2, None: 2}


def test_sketches_run_without_python(spark, corpus):
    plan = paragraph_sketch.compare_with_edit(make_docs(spark, corpus[:5]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


TALK = [
    (1, 0, "system", "Be brief."), *[(1, i, ("user", "assistant")[i % 2 == 0], f"turn {i} " + "word " * (i * 7 % 60)) for i in range(1, 40)],
    (2, 0, "user", None), (2, 1, "assistant", ""), (3, 5, "system", "alone"), (4, None, "user", "a"), (4, 0, "assistant", "b\\</s>[INST]<|im_end|>"), (4, 0, "assistant", "b\\</s>[INST]<|im_end|>"),
    (5, 0, "system", "s"), (5, 1, "assistant", "long " * 900), (5, 2, "user", "ok"), (5, 3, "assistant", "<|im_start|>x<|im_sep|>"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (6, 0, None, "no role"), (6, 1, "a<s>", "odd role"),
]


def talks(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in TALK], "conv_id long, turn long, role string, text string, window string, pos string")


def test_chat_windows(spark):
    budget = 160
    windows = chat_format.windows(talks(spark), budget, 40)
    got = chat_format.read_back(windows).collect()
    shape = {(r.conv_id, r.window): r for r in windows.collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    by = defaultdict(list)
    for r in TALK:
        by[r[0]].append(r)
    back, loss = defaultdict(list), defaultdict(list)
    for r in sorted(got, key=lambda r: r.window):
        back[r.conv_id] += [(t.role, t.text) for t in r.turns]
        loss[r.conv_id] += r.targets
    for conv, rows in by.items():
        rows.sort(key=key)
        assert back[conv] == [(r[2] or "", r[3] or "") for r in rows]
        assert loss[conv] == [r[3] or "" for r in rows if r[2] == "assistant"]
    whole = [r for r in shape.values() if r.conv_id == 1]
    assert len(whole) > 5 and all(r.formatted.startswith("<|im_start|>system<|im_sep|>Be brief.<|im_end|>") for r in whole)
    assert all(r.n_tokens <= budget for r in whole) and any(r.n_context > 1 for r in whole)
    assert sum(r.n_tokens > budget for r in shape.values()) == 1  # the one long turn
    done = {r.conv_id: r for r in chat_format.digests(windows).collect()}
    assert done[1].n_turns == 40 and done[1].formatted_chars == sum(len(r.formatted) for r in whole)
    assert done[2].loss_sha256 == hashlib.sha256(b"").hexdigest()
    assert chat_format.digests(chat_format.windows(talks(spark).limit(0))).collect() == []


def test_chat_blocks_of_turns(spark, monkeypatch):
    want = {(r.conv_id, r.window): r.formatted for r in chat_format.windows(talks(spark), 160, 40).collect()}
    monkeypatch.setattr(chat_format, "BLOCK_TURNS", 3)
    assert {(r.conv_id, r.window): r.formatted for r in chat_format.windows(talks(spark), 160, 40).collect()} == want


def test_escapes_are_reversible_and_complete(spark):
    from pyspark.sql import functions as F

    rng = random.Random(5)
    parts = ["\\", "<", "|", "im_start", ">", "[INST]", "</s>", "a", "\n", "<|im_end|>", "<<SYS>>", "$", "<s", "[/INST", "[", "]", "<|im_sep|>"]
    rows = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))),) for _ in range(1500)]
    for r in spark.createDataFrame(rows, "t string").select("t", chat_format.escaped(F.col("t")).alias("e"), chat_format.plain(chat_format.escaped(F.col("t"))).alias("p")).collect():
        assert r.t == r.p and not any(c in r.e for c in chat_format.CONTROL)


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * (i % 60)}{i % 9}</p>" * 3) for i in range(50)]
    rows += [(60, None, None), (61, "a\nb", ""), (62, "u", "same" * 50), (63, "u", "same" * 50), (63, "u", "same" * 50), (None, "u", "same" * 50), (None, "u", "z"), (64, "u", "tiny"), (65, "u", "tiny"), (66, "u", "x" * 300_000)]
    return rows, spark.createDataFrame([(*r, "q", b"q") for r in rows], "page_id long, url string, html string, digest string, payload binary").repartition(3)


def test_archives(spark, monkeypatch):
    rows, frame = pages(spark)
    monkeypatch.setattr(warc_zip, "PACKAGE_RECORDS", 9)
    got = warc_zip.round_trip(frame).collect()
    least = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(least.get(h, i), i)
    want = Counter()
    for i, u, h in rows:
        body = (h or "").encode()
        refers = least.get(h) if least.get(h) != i else None
        want[i, None if u is None else u.replace("\n", "%0A"), "revisit" if refers is not None else "response", None if refers is not None else body, len(body), hashlib.sha256(body).hexdigest(), refers] += 1
    assert Counter((r.page_id, r.url, r.record_type, None if r.payload is None else bytes(r.payload), r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == want
    assert warc_zip.round_trip(frame.limit(0)).collect() == []


@pytest.mark.parametrize("comment", [b"", b"a comment with PK\x05\x06 inside it, long enough to hold a record"])
@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(comment, wide, monkeypatch):
    if wide:  # sizes and offsets that only ZIP64 fields hold
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = io.BytesIO(b"before")
    data.seek(0, 2)
    with zipfile.ZipFile(data, "w") as z:
        z.comment = comment
        for name in ("a", "ü/b", "c"):
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=wide) as f:
                f.write(name.encode() * 50)
    raw = data.getvalue()
    found = warc_zip.directory(io.BytesIO(raw), len(raw))
    assert list(found) == ["a", "ü/b", "c"]
    for name, (method, packed, real, place) in found.items():
        start = warc_zip.data_start(io.BytesIO(raw), place)
        assert method == 0 and packed == real and raw[start : start + packed] == name.encode() * 50


def test_a_damaged_payload_is_refused():
    import gzip

    body = gzip.decompress(warc_zip.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None))
    assert warc_zip.parse(body)[3] == b"payload"
    with pytest.raises(ValueError, match="not the one"):
        warc_zip.parse(body.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="not a ZIP"):
        warc_zip.directory(io.BytesIO(b"x" * 100), 100)


def test_attempts_in_another_order_keep_their_records(spark, tmp_path, monkeypatch):
    """Two attempts write the same rows in another order, packages split elsewhere; each manifest reads every page once."""
    monkeypatch.setattr(warc_zip, "PACKAGE_RECORDS", 3)
    pages = [(i, f"http://x/{i}", f"page {i} " * 30) for i in range(20)]
    schema = "page_id long, url string, html string"
    folder = f"file://{tmp_path}/packages"
    first = warc_zip.write(warc_zip.mark(spark.createDataFrame(pages, schema).coalesce(1)), folder)
    again = warc_zip.write(warc_zip.mark(spark.createDataFrame(pages[::-1][:17] + pages[:3], schema).coalesce(1)), folder)
    for manifest in (first, again):
        assert sorted(r.page_id for r in warc_zip.read(warc_zip.ranges(manifest)).collect()) == list(range(20))
    assert not set(r.path for r in first.collect()) & set(r.path for r in again.collect())
