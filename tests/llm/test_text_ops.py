"""Tokens, packing, chunk dedup and passages against plain versions."""

import base64
import hashlib
import json
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from churnlake.llm import byte_bpe, chunk_dedup, packing, pairs, substring_dedup
from churnlake.llm.common import blocks, cut, segment_hashes, utf8, words

from .conftest import make_docs

MULTI, SINGLE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


@pytest.fixture(scope="module")
def library():
    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def merges():
    with open(MULTI, "rb") as f:
        return pairs.Merges(pairs.read_ranks(f.read()))


def plain_ids(texts, merges):
    out = []
    for _, ids, counts in pairs.encode_texts(pa.array(texts, pa.string()), merges):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@settings(max_examples=60, deadline=None, derandomize=True)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aabcdestrvelm'' \n\t.,!?129\x1c\x85 éß中😀")), st.characters(codec="utf-8")), max_size=60), min_size=1, max_size=20))
def test_merge_replay_equals_the_library(library, merges, texts):
    assert plain_ids(texts, merges) == [library.encode_ordinary(t) for t in texts]


def test_replay_of_long_runs(library, merges):
    texts = ["a" * 4001, "!" * 3000, " " * 999, "ab" * 1500, "\n" * 77, None, ""]
    assert plain_ids(texts, merges) == [library.encode_ordinary(t or "") for t in texts]


def test_a_lower_rank_that_arises_goes_first():
    # 'aba' outranks 'ab': merging the first 'ab' of abab must be followed by 'aba' at once
    ranks = {b"a": 0, b"b": 1, b"aba": 2, b"ab": 3, b"bb": 4}
    own = pairs.Merges([t for t, _ in sorted(ranks.items(), key=lambda x: x[1])])
    model = tiktoken.Encoding("x", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    for text in ("abab", "ababab", "abbabab", "aababb", "babababab"):
        flat = np.frombuffer(text.encode(), np.uint8)
        assert own.encode(flat, np.array([len(flat)]))[0].tolist() == model.encode_ordinary(text)


def test_encode_and_decode(spark, corpus, library):
    docs = make_docs(spark, corpus)
    rows = byte_bpe.decode(byte_bpe.encode(docs, MULTI), MULTI).collect()
    both = byte_bpe.encode(docs, MULTI, decoded=True).collect()
    want = Counter((i, struct.pack(f"<{len(x)}I", *x), (t or "").encode()) for i, t in corpus for x in [library.encode_ordinary(t or "")])
    for got in (rows, both):
        assert Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got) == want
    assert byte_bpe.encode(docs.limit(0), MULTI, decoded=True).collect() == []


def test_decode_rejects_an_unknown_id(spark):
    with pytest.raises(Exception, match="not in the vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, bytearray(struct.pack("<I", 999_999)))], "doc_id long, ids binary"), MULTI).collect()


def test_added_tokens_are_taken_out_of_the_text(spark):
    library = Tokenizer.from_file(SINGLE)
    end = "<|endoftext|>"
    texts = ["a" + end + "b", end, end * 3, f"don't {end} 'll  {end}", f" x{end[:-1]}", f"{end[:5]}{end}\n\n{end}", end[:6], end[6:], None, "", "plain  text", f"é中 {end}é中"]
    with open(SINGLE, encoding="utf-8") as f:
        file = f.read()
    own = pairs.Merges(*pairs.read_merges(file), whole=False, added=pairs.read_added(file))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert want[0] == [64, 50256, 65] and plain_ids(texts, own) == want
    rows = packing.tokenise(make_docs(spark, list(enumerate(texts))), SINGLE, 512, with_ids=True).collect()
    assert {r.doc_id: list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in rows} == {i: [*x, 0] for i, x in enumerate(want)}


def test_added_tokens_leftmost_and_longest():
    file = json.dumps({"added_tokens": [{"id": 300, "content": "ab"}, {"id": 301, "content": "abc"}, {"id": 302, "content": "cd"}], "model": {}})
    own = pairs.Merges([bytes([i]) for i in range(256)], [], whole=False, added=pairs.read_added(file))
    assert plain_ids(["abcd", "xabd", "a", "bcd", "cdab"], own) == [[301, 100], [120, 300, 100], [97], [98, 302], [302, 300]]


def test_packing(spark, corpus):
    library = Tokenizer.from_file(SINGLE)
    docs = make_docs(spark, corpus)
    rows = packing.pack_documents(docs, SINGLE, 512).collect()
    want = Counter()
    for i, t in corpus:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range((len(ids) - 1) % 512 + 1, len(ids) + 1, 512)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    lengths = np.array([r.length for r in rows])
    assert packing.lower_bound(lengths, 512) <= len(held) <= packing.best_fit(lengths, 512)[0].max() + 1
    assert packing.pack_documents(docs.limit(0), SINGLE).collect() == []


def test_sequences_hold_the_tokens(spark):
    library = Tokenizer.from_file(SINGLE)
    texts = [(1, "one two three"), (2, None), (3, "four " * 40)]
    pieces = cut(packing.tokenise(make_docs(spark, texts), SINGLE, 32, with_ids=True), "p")
    got = [list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids)) for r in packing.sequences(pieces, packing.pack(pieces, 32)).collect()]
    assert sorted(sum(got, [])) == sorted(sum(([*library.encode(t or "").ids, 0] for _, t in texts), []))


def test_packing_of_many_partitions_exchanges(spark):
    rng = np.random.default_rng(3)
    lengths = rng.choice([501, 700, 701, 800, 1023], 3000)
    frame = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES).repartition(7)
    first = sum(packing.best_fit(lengths[i::30], 2048)[0].max() + 1 for i in range(30))
    rows = packing.pack(cut(frame, "p"), 2048, rounds=3, rows_per_part=100).collect()
    assert len(rows) == 3000 and len({r.doc_id for r in rows}) == 3000
    used = len({r.sequence_id for r in rows})
    assert packing.lower_bound(lengths, 2048) <= used <= first


@settings(max_examples=80, deadline=None, derandomize=True)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_lower_bound_is_below_the_optimum(sizes):
    def fits(left, bins):
        if not left:
            return True
        return any(b >= left[0] and fits(left[1:], [*bins[:i], b - left[0], *bins[i + 1 :]]) for i, b in enumerate(bins))

    best = next(n for n in range(1, len(sizes) + 1) if fits(sorted(sizes, reverse=True), [20] * n))
    assert packing.lower_bound(np.array(sizes), 20) <= best <= packing.best_fit(np.array(sizes), 20)[0].max() + 1


def test_exact_dedup(spark, corpus):
    docs = make_docs(spark, corpus)
    groups = defaultdict(list)
    for i, t in corpus:
        groups[lower(t)].append(i)
    rows = chunk_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(corpus)
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((i, top(groups[lower(t)]), len(groups[lower(t)]), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t in corpus)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows) == want
    assert Counter(r.text_sha256 for r in rows if r.kept) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)
    left = chunk_dedup.kept_documents(docs)
    assert left.columns == docs.columns
    assert Counter(lower(r.text) for r in left.collect()) == Counter(groups.keys())
    assert chunk_dedup.exact_dedup(docs.limit(0)).collect() == []


def test_chunk_edges_follow_the_content(vocabulary):
    text = (" ".join(vocabulary) * 3).encode()
    found = []
    for raw in (text, b"another start " + text):
        flat = np.frombuffer(raw, np.uint8)
        ends = chunk_dedup.chunk_edges(flat, np.array([0, len(flat)]))[0]
        found.append({raw[a:b] for a, b in zip([0, *ends], ends)})
        sizes = np.diff([0, *ends])
        assert ends[-1] == len(raw) and sizes.max() <= chunk_dedup.MOST and (sizes[:-1] >= chunk_dedup.LEAST).all()
    assert len(found[0] & found[1]) >= len(found[0]) - 2


def test_a_digest_clash_is_found_and_mended(spark, monkeypatch):
    docs = make_docs(spark, [(1, "same"), (2, "same"), (3, "else"), (4, "else")])
    real = chunk_dedup._digest
    monkeypatch.setattr(chunk_dedup, "_digest", lambda c, s: (b"0" * 16) if not s else b"0" * 16 + hashlib.sha512(c).digest())
    rows = chunk_dedup.exact_dedup(docs).collect()
    monkeypatch.setattr(chunk_dedup, "_digest", real)
    assert {(r.doc_id, r.keep_id) for r in rows} == {(1, 2), (2, 2), (3, 4), (4, 4)}


def brute_passages(corpus, k):
    key = lambda i: float("inf") if i is None else i
    split = [(i, SPACE.findall((t or "").encode())) for i, t in corpus]
    first = {}
    for i, w in split:
        for j in range(len(w) - k + 1):
            gram = tuple(w[j : j + k])
            first[gram] = min(first.get(gram, float("inf")), key(i))
    out = []
    for i, w in split:
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < key(i):
                gone.update(range(j, j + k))
        out.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    return out


@pytest.mark.parametrize("k, part_words", [(13, 2_000_000), (13, 700), (3, 300)])
def test_passages(spark, corpus, monkeypatch, k, part_words):
    monkeypatch.setattr(substring_dedup, "PART_WORDS", part_words)
    docs = cut(make_docs(spark, corpus), "docs")
    rows = substring_dedup.remove_passages(docs, k=k, buckets=5).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows) == Counter(brute_passages(corpus, k))


def test_passages_of_no_documents(spark, corpus):
    assert substring_dedup.remove_passages(make_docs(spark, corpus).limit(0)).collect() == []


def test_factors_break_where_references_jump():
    heads, starts, lengths = substring_dedup.factors(np.array([4, 5, 6, 9, 10]), np.array([1, 1, 2, 2, 2]), np.array([7, 8, 3, 6, 7]), 13)
    assert heads.tolist() == [0, 2, 3] and starts.tolist() == [4, 6, 9] and lengths.tolist() == [14, 13, 14]


def test_words_and_blocks():
    flat, offsets = utf8(pa.array(["a b", None, "", "c\x0bd e ", "f"]))
    starts, ends, doc = words(flat, offsets)
    raw = flat.tobytes()
    assert [raw[a:b].decode() for a, b in zip(starts, ends)] == ["a", "b", "c", "d e", "f"]
    assert doc.tolist() == [0, 0, 3, 3, 4]
    assert list(blocks(offsets, 4)) == [(0, 3), (3, 4), (4, 5)]
    assert len(set(segment_hashes(flat, starts, ends).tolist())) == 5
