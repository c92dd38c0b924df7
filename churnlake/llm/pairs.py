"""Byte-level BPE over a block of text at once.

``split`` cuts text as the public pattern of these vocabularies does, ``Merges`` replays merges over
all distinct words of a block. Both are numpy code for the inside of a task.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import unicodedata

import numpy as np

from churnlake.llm.common import BLOCK_BYTES, blocks, ragged, segment_hashes, utf8

NONE = np.int32(2**31 - 1)
LETTER, NUMBER, SPACE = 1, 2, 3
#: Unicode's White_Space property (fixed values).
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Class of every code point: letter, number, white space, or 0 for the rest."""
    if not _kinds:
        table = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
        table[WHITE] = SPACE
        _kinds.append(table)
    return _kinds[0]


def code_points(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte at which each begins."""
    at = np.flatnonzero((flat & 0xC0) != 0x80)
    lead = flat[at].astype(np.int32)
    if len(at) == len(flat):
        return lead, at
    wide = np.flatnonzero(lead >= 0x80)
    padded = np.concatenate([flat, np.zeros(3, np.uint8)])
    b0, p = lead[wide], at[wide]
    b1, b2, b3 = (padded[p + j].astype(np.int32) & 0x3F for j in (1, 2, 3))
    lead[wide] = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
    return lead, at


def split(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of every match of the pattern, and the number of matches in each document.

    The pattern takes contractions, then runs of letters, of numbers or of other signs with one
    space before them, then white space, whose last sign is left to what follows it.
    """
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    points, at = code_points(flat)
    kind = kinds()[points]
    n = len(points)
    opens = np.zeros(n + 1, bool)
    opens[np.searchsorted(at, offsets)] = True  # the first sign of a document; its place n is past the end
    new = opens[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    begin = new.copy()
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], n) - 1
    blank = (kind[heads] == SPACE) & ~opens[tails + 1]  # white space with more text behind it
    tails = tails[blank]
    begin[tails] = True
    begin[tails[points[tails] == 0x20] + 1] = False
    quote = np.flatnonzero((points == 0x27) & begin)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~opens[quote + 1]]
    if len(quote):
        wide = np.concatenate([points, np.zeros(2, points.dtype)])
        a, b = wide[quote + 1], wide[quote + 2]
        shut = opens[quote + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ~shut & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        size = np.where(one, 1, np.where(two, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        begin[quote + 1] = False
        after = quote + 1 + size
        after = after[after < n]
        begin[after[(kind[after] == LETTER) & ~opens[after]]] = True
    places = np.flatnonzero(begin)
    owner = np.searchsorted(offsets, at[places], "right") - 1
    return at[places], np.bincount(owner, minlength=len(offsets) - 1)


def read_ranks(lines: bytes) -> list[bytes]:
    """Tokens by rank from the text of a .tiktoken file."""
    pairs = [line.split() for line in lines.splitlines() if line]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def read_merges(text: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """Tokens by id and merges (left, right, result) in their order from a byte-level tokenizer's JSON."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    model = json.loads(text)["model"]
    vocab = model["vocab"]
    tokens = [b""] * (max(vocab.values()) + 1)
    for word, i in vocab.items():
        if all(c in byte for c in word):
            tokens[i] = bytes(byte[c] for c in word)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return tokens, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]


def read_added(text: str) -> dict[bytes, int]:
    """Ids of the tokens that a tokenizer's JSON adds to the vocabulary; they are taken out of a text before its pattern."""
    added = json.loads(text).get("added_tokens") or []
    if any(t.get(x) for t in added for x in ("single_word", "lstrip", "rstrip")) or len({bool(t.get("normalized")) for t in added}) > 1:
        raise ValueError("added tokens that look at their neighbours, or of which only some are normalized, are not supported")
    return {t["content"].encode(): t["id"] for t in added if t["content"]}


class Merges:
    """Replays merges in rank order over many words: an index from pair to positions, linked neighbours.

    ``whole`` takes a word that is a token as that token at once. Ranks are those of the results, or the
    place in ``merges`` if given. ``added`` has tokens that ``encode_texts`` takes out of a text first.
    """

    BAND = 2048

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]] | None = None, whole: bool = True, added: dict[bytes, int] | None = None):
        if added:
            tokens = tokens + [b""] * (max(added.values()) + 1 - len(tokens))
            for word, i in added.items():
                tokens[i] = word
        self.tokens, self.whole, self.added = tokens, whole, added or {}
        ids = {t: i for i, t in enumerate(tokens) if t}
        self.ids = ids
        if merges is None:
            merges = sorted(((ids[t[:k]], ids[t[k:]], i) for t, i in ids.items() for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids), key=lambda m: m[2])
            order = np.array([m[2] for m in merges], np.int32)
        else:
            order = np.arange(len(merges), dtype=np.int32)
        table = np.array(merges, np.int64).reshape(-1, 3)
        code = table[:, 0] << 32 | table[:, 1]
        at = np.argsort(code, kind="stable")
        self.code, self.rank = np.append(code[at], np.int64(2**62)), np.append(order[at], NONE)
        self.result = np.zeros(int(order.max(initial=0)) + 1, np.int32)
        self.result[order] = table[:, 2]
        self.top = len(self.result)
        self.byte = np.array([ids.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.first = self.lookup(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.places = np.cumsum(self.sizes) - self.sizes

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.code, code)
        return np.where(self.code[at] == code, self.rank[at], NONE)

    def replay(self, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words laid end to end in ``flat``, and how many each word has."""
        n = len(flat)
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        token = self.byte[flat]
        place = np.arange(n, dtype=np.int32)
        after, before = place + np.int32(1), place - np.int32(1)
        ends = np.cumsum(lengths) - 1
        after[ends] = -1
        before[ends - lengths + 1] = -1
        rank = np.full(n, NONE, np.int32)
        if n > 1:
            inner = np.flatnonzero(after >= 0)
            rank[inner] = self.first[flat[inner], flat[inner + 1]]
        low = 0
        while low < self.top:
            high = low + self.BAND
            found = np.flatnonzero((rank >= low) & (rank < high))
            back = self._band(found, low, high, token, after, before, rank, word) if len(found) else None
            low = high if back is None else back // self.BAND * self.BAND
        live = token >= 0
        return token[live], np.bincount(word[live], minlength=len(lengths))

    def _band(self, found, low, high, token, after, before, rank, word) -> int | None:
        """All merges whose rank lies in [low, high). A lower one that arises ends the band: its rank is returned."""
        index: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def put(places: np.ndarray) -> None:
            ranks = rank[places]
            at = np.argsort(ranks, kind="stable")
            places, ranks = places[at], ranks[at]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(queue, r)
                index[r].append(part)

        put(found)
        while queue:
            r = heapq.heappop(queue)
            parts = index.pop(r)
            p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            p = p[rank[p] == r]
            if not len(p):
                continue
            new = self.result[r]
            if len(p) > 1:
                touch = after[p[:-1]] == p[1:]
                if touch.any():  # in a chain of overlapping pairs every second one, from the left
                    i = np.arange(len(p))
                    head = np.maximum.accumulate(np.where(np.append(True, ~touch), i, 0))
                    p = p[(i - head) % 2 == 0]
                again = np.append(False, word[p[1:]] == word[p[:-1]])
                if again.any():
                    # several in a word: if a merge may open a lower rank there, only the first of them now
                    left, right = before[p], after[after[p]]
                    least = np.minimum(np.where(left >= 0, self.lookup(token[left], new), NONE), np.where(right >= 0, self.lookup(np.full(len(p), new), token[right]), NONE))
                    least = np.minimum(least, self.lookup(np.array([new]), np.array([new]))[0])
                    wait = again & np.isin(word[p], word[p[least < r]])
                    if wait.any():
                        index[r] = [p[wait]]
                        heapq.heappush(queue, r)
                        p = p[~wait]
            gone = after[p]
            right = after[gone]
            token[p] = new
            token[gone] = -1
            rank[gone] = NONE
            after[p] = right
            has = right >= 0
            before[right[has]] = p[has]
            rank[p] = NONE
            rank[p[has]] = self.lookup(token[p[has]], token[right[has]])
            left = before[p]
            had = left >= 0
            rank[left[had]] = self.lookup(token[left[had]], token[p[had]])
            changed = np.concatenate([p, left[had]])
            fresh = rank[changed]
            if (lowest := int(fresh.min())) < low:
                return lowest
            near = changed[fresh < high]
            if len(near):
                put(near)
        return None

    def cuts(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First and last edges of the added tokens in the documents: leftmost, of those the longest."""
        if not self.added:
            return np.zeros(0, np.int64)
        raw, out = flat.tobytes(), []
        find = re.compile(b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))
        if find.search(raw):
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                out += [x for m in find.finditer(raw, a, b) for x in m.span()]
        return np.array(out, np.int64)

    def encode(self, flat: np.ndarray, lengths: np.ndarray, added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """As ``replay``; words that are tokens themselves are taken whole if ``whole`` is set, added ones if ``added`` is."""
        if not (self.whole or added) or not len(lengths):
            return self.replay(flat, lengths)
        ends = np.cumsum(lengths)
        raw = flat.tobytes()
        ids = (self.ids if self.whole else {}) | (self.added if added else {})
        known = np.fromiter((ids.get(raw[a:b], -1) for a, b in zip((ends - lengths).tolist(), ends.tolist())), np.int32, len(lengths))
        rest = np.flatnonzero(known < 0)
        got, counts = self.replay(flat[ragged((ends - lengths)[rest], lengths[rest])], lengths[rest])
        sizes = np.ones(len(lengths), np.int64)
        sizes[rest] = counts
        out = np.empty(int(sizes.sum()), np.int32)
        starts = np.cumsum(sizes) - sizes
        out[starts[known >= 0]] = known[known >= 0]
        out[ragged(starts[rest], counts)] = got
        return out, sizes

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the ids, laid end to end, and the length of each."""
        sizes = self.sizes[ids]
        return self.bytes[ragged(self.places[ids], sizes)], sizes


def encode_texts(column, merges: Merges):
    """Yields (first document, ids, ids per document) for blocks of a text column.

    Distinct words of the whole column are merged once, by one replay; then each block of documents
    is put together from them.
    """
    flat, offsets = utf8(column)
    plan, keys, texts, sizes, added = [], [], [], [], False
    for a, b in blocks(offsets, BLOCK_BYTES):
        part, edges = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        cuts = merges.cuts(part, edges)
        if len(cuts):  # what lies between added tokens is split on its own, and each of them is one word
            added = True
            starts, _ = split(part, np.sort(np.append(edges, cuts)))
            first, last = cuts[::2], cuts[1::2]
            inside = np.searchsorted(first, starts, "right") - 1
            starts = np.sort(np.append(starts[(inside < 0) | (starts >= last[inside])], first))
            counts = np.bincount(np.searchsorted(edges, starts, "right") - 1, minlength=b - a)
        else:
            starts, counts = split(part, edges)
        ends = np.append(starts[1:], len(part))[: len(starts)]
        key, at, back = np.unique(segment_hashes(part, starts, ends), return_index=True, return_inverse=True)
        plan.append((a, counts, back.astype(np.int32), len(key)))
        keys.append(key)
        sizes.append((ends - starts)[at])
        texts.append(part[ragged(starts[at], sizes[-1])])
    if not plan:
        return
    length = np.concatenate(sizes)
    place = np.cumsum(length) - length
    _, at, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    ids, counts = merges.encode(np.concatenate(texts)[ragged(place[at], length[at])], length[at], added)
    first = np.cumsum(counts) - counts
    done = 0
    for a, per_doc, inner, distinct in plan:
        word = back[done : done + distinct][inner]
        done += distinct
        ends = np.append(0, np.cumsum(counts[word]))
        edges = np.append(0, np.cumsum(per_doc))
        yield a, ids[ragged(first[word], counts[word])], np.diff(ends[edges])
