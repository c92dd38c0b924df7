"""Spans of personal data by aggregated weak labelers.

One pass over the text finds the base spans (four fixed patterns) and wider candidates next to them: digit
groups, address-like and key-like tokens. Labelers vote on each candidate (for, against, or no vote): the
pattern of its shape, a gazetteer of known names and prefixes, the words around it, a checksum or
range, its mix of signs, its length. Votes and shape are one small code, so all candidates of the corpus
aggregate to a table with at most ``5 * 3**6 * 16`` rows. On it expectation-maximisation estimates every
labeler's reliability without labels, and a logistic classifier is fitted to the resulting
probabilities. Codes that it accepts add spans; base spans always stay, and what overlaps one is not added.

Null text counts as empty. Repeated rows get equal results. Other columns are not read. Positions count code
points and ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import blocks, cut, free_name, utf8

KINDS = ("email", "ip", "card", "phone", "secret")
LABELERS = ("shape", "gazetteer", "context", "check", "mix", "length")
SHAPES = 16
BROADCAST_BYTES = 32 << 20
SPAN = "array<struct<start:long,kind:int,end:long>>"
CANDIDATE = "array<struct<start:long,kind:int,end:long,code:int>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no match can begin inside a run of digits, so these only look at its start
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# every match of a pattern, base or wider, holds one of these bytes
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(0x30, 0x3A), *b"@=[(:"]] = True

# wider candidates
_DIGITS = re.compile(r"(?<![0-9A-Za-z])\+?[0-9]+(?:[-.()/ ]{1,2}[0-9]+)*(?![0-9A-Za-z])")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|@) ?[A-Za-z0-9-]{1,63}(?:(?: ?(?:\[dot\]|\(dot\)) ?|\.)[A-Za-z0-9-]{1,63})+")
_SETTING = re.compile(r"(?<![A-Za-z_])([A-Za-z_]{3,}+) ?[=:] ?[\"']?([A-Za-z0-9+/_-]{8,}+)")
_TOKEN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])[A-Za-z0-9]{16,}+")

# fixed values: known names, prefixes and cue words
TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu ch at nl".split())
SECRET_NAMES = frozenset("password passwd pwd token secret key api_key apikey access_key auth credential".split())
SECRET_PREFIXES = ("AKIA", "ASIA", "ghp_", "sk_", "pk_", "xox")
CUES = {
    "email": ("mail", "contact", "write to", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "fax", "mobil"),
    "secret": ("password", "token", "secret", "key", "login", "passwd"),
}
AGAINST = ("version", "license", "cc by", "isbn", "page", "fig", "section", "http", "www")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from their @ signs in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) < 3 or len(short) == 3 and short <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four base patterns, by start, then kind."""
    spans = [(a, 0, b) for a, b in emails(text)]
    if not _GROUP.search(text):
        return sorted(spans)  # the other patterns have digits
    spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _candidates(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of wider candidates."""
    digits = _GROUP.search(text)
    for m in _AT.finditer(text) if "@" in text or "(at)" in text or "[at]" in text else ():
        yield 0, m.start(), m.end()
    for m in _DIGITS.finditer(text) if digits else ():
        groups = [g.span() for g in _GROUP.finditer(text, m.start(), m.end())]
        sizes = [b - a for a, b in groups]
        for (a, b), size in zip(groups, sizes):
            if 13 <= size <= 19:
                yield 2, a, b
        runs = 0  # shorter groups next to each other
        for i, size in enumerate([*sizes, 99]):
            if size > 12:
                if i - runs > 1 and 7 <= sum(sizes[runs:i]) <= 15:
                    dots = text[groups[runs][0] : groups[i - 1][1]].count(".") == 3 and i - runs == 4
                    yield (1 if dots else 3), (m.start() if runs == 0 else groups[runs][0]), groups[i - 1][1]
                runs = i + 1
    for m in _SETTING.finditer(text) if "=" in text or ":" in text else ():
        yield 4, m.start(2), m.end(2)
    for m in _TOKEN.finditer(text) if digits else ():
        yield 4, m.start(), m.end()


def _votes(text: str, kind: int, start: int, end: int) -> tuple[list[int], int]:
    """The labelers' votes and a number for the shape."""
    span, before = text[start:end], text[max(0, start - 24) : start].lower()
    digits = "".join(c for c in span if c in "0123456789")
    letters = sum(c.isalpha() for c in span)
    name = KINDS[kind]
    if kind == 0:
        shape, known, check = (1 if "@" in span else 0), (1 if re.split(r"[.\])]", span)[-1].strip().lower() in TOP_DOMAINS else -1), (1 if letters > 3 else -1)
        long = 1 if 6 <= len(span) <= 64 else -1
    elif kind == 1:
        shape, known, check, long = 1, (-1 if span.startswith(("0.", "127.")) else 0), (1 if all(map(_octet, span.split("."))) else -1), (1 if 7 <= len(span) <= 15 else -1)
    elif kind == 2:
        shape, known, check, long = (1 if 15 <= len(digits) <= 16 else 0), (1 if digits[:1] in "3456" else -1), (1 if luhn(digits) else -1), (1 if 14 <= len(digits) <= 19 else -1)
    elif kind == 3:
        shape, known, check = (1 if span.startswith("+") or "(" in span else -1), (1 if "555" in span or span.startswith(("+1", "+3", "+4")) else 0), (1 if 10 <= len(digits) <= 15 else -1)
        long = 1 if 9 <= len(span) <= 22 else -1
    else:
        setting = re.search(r"([a-z_]+) ?[=:] ?[\"']?$", before)
        shape = 1 if setting or re.fullmatch(r"[A-Z0-9]{16,24}|[0-9a-f]{16,64}", span) else 0
        known = 1 if span.startswith(SECRET_PREFIXES) or setting and setting[1].strip("_") in SECRET_NAMES else (-1 if setting else 0)
        check = 1 if digits and letters and len(set(span)) >= 8 else -1
        long = 1 if 12 <= len(span) <= 128 else -1
    context = 1 if any(c in before for c in CUES[name]) else (-1 if any(c in before for c in AGAINST) else 0)
    mixed = (1 if letters and len(digits) >= 3 else -1) if kind == 4 else (1 if kind == 0 or letters == 0 else -1)
    look = min(3, len(span) // 12) | (4 if span[:1].isdigit() else 0) | (8 if start == 0 or text[start - 1] in " \n\t\"'=:(" else 0)
    return [shape, known, context, check, mixed, long], look


def _code(kind: int, votes: list[int], look: int) -> int:
    code = kind
    for v in votes:
        code = code * 3 + v + 1
    return code * SHAPES + look


def _decode(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    look, rest = code % SHAPES, code // SHAPES
    votes = np.empty((len(code), len(LABELERS)), np.int64)
    for j in reversed(range(len(LABELERS))):
        votes[:, j] = rest % 3 - 1
        rest = rest // 3
    return rest, votes, look


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, found): base spans and coded candidates of every document."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.int64()),
        ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
        ("found", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("code", pa.int32())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = utf8(batch.column(2))
            for x, y in blocks(offsets):
                base: list[list] = [[] for _ in range(y - x)]
                found: list[list] = [[] for _ in range(y - x)]
                hits = np.flatnonzero(_TRIGGER[flat[offsets[x] : offsets[y]]]) + offsets[x]
                for i in np.flatnonzero(np.diff(np.searchsorted(hits, offsets[x : y + 1]))).tolist():
                    text = flat[offsets[x + i] : offsets[x + i + 1]].tobytes().decode()
                    spans = base_spans(text)
                    base[i] = [{"start": a, "kind": k, "end": b} for a, k, b in spans]
                    taken = set()
                    for kind, a, b in _candidates(text):
                        if (a, b) not in taken and not any(u < b and a < v for u, _, v in spans):
                            taken.add((a, b))
                            found[i].append({"start": a, "kind": kind, "end": b, "code": _code(kind, *_votes(text, kind, a, b))})
                own = [batch.column(0).slice(x, y - x), batch.column(1).slice(x, y - x)]
                yield pa.record_batch([*own, pa.array(base, schema.field(2).type), pa.array(found, schema.field(3).type)], schema=schema)
        pa.default_memory_pool().release_unused()

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id long, key long, base {SPAN}, found {CANDIDATE}")


def reliabilities(votes: np.ndarray, times: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: the probability of each, and P(vote | class) of each labeler."""
    chance = 1 / (1 + np.exp(-votes.sum(axis=1)))
    for _ in range(rounds):
        prior = float((chance * times).sum() + 1) / float(times.sum() + 2)
        table = np.empty((2, votes.shape[1], 3))
        for c, weight in enumerate(((1 - chance) * times, chance * times)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] = (weight[:, None] * (votes == v)).sum(axis=0) + 1
        table /= table.sum(axis=2, keepdims=True)
        # a labeler never counts for what it votes against
        bad = table[1, :, 2] * table[0, :, 0] < table[0, :, 2] * table[1, :, 0]
        table[:, bad] = table[:, bad].mean(axis=0, keepdims=True)
        at = np.arange(votes.shape[1])
        score = np.log(prior / (1 - prior)) + (np.log(table[1, at, votes + 1]) - np.log(table[0, at, votes + 1])).sum(axis=1)
        chance = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return chance, table, prior


def fit(codes: np.ndarray, times: np.ndarray, steps: int = 400) -> np.ndarray:
    """The classifier's probability for each code of candidates, from the counts of all codes."""
    if not len(codes):
        return np.zeros(0)
    kind, votes, look = _decode(codes)
    target = np.empty(len(codes))
    for k in range(len(KINDS)):
        own = kind == k
        if own.any():
            target[own] = reliabilities(votes[own], times[own])[0]
    signs = np.concatenate([votes == 1, votes == -1, np.eye(4)[look % 4], (look[:, None] >> np.arange(2, 4)) & 1], axis=1).astype(float)
    inputs = np.concatenate([np.eye(len(KINDS))[kind], *[(kind == k)[:, None] * signs for k in range(len(KINDS))]], axis=1)
    weight = np.log1p(times)
    weight = weight / weight.sum()
    w = np.zeros(inputs.shape[1])
    for _ in range(steps):  # damped Newton steps on the cross entropy with soft targets
        p = 1 / (1 + np.exp(-inputs @ w))
        grad = inputs.T @ (weight * (p - target)) + 1e-4 * w
        hess = (inputs * (weight * p * (1 - p))[:, None]).T @ inputs + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return 1 / (1 + np.exp(-inputs @ w))


def detect(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, key, base, spans): base spans, and all spans with those that the classifier adds, by start and kind."""
    found = cut(find(docs), "candidates")
    counts = found.select(F.explode("found.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("times")).orderBy("code").toPandas()
    codes = counts["code"].to_numpy(np.int64)
    accepted = codes[fit(codes, counts["times"].to_numpy(np.float64)) >= threshold].tolist()
    good = F.array(*[F.lit(int(c)) for c in accepted]).cast("array<int>")
    added = F.transform(F.filter("found", lambda x: F.array_contains(good, x["code"])), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return found.select("doc_id", "key", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def listed(spans: str):
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; n_chars, if there, counts anew."""
    id_, key_, spans_ = (free_name(docs, x) for x in ("span_id", "span_key", "spans"))
    side = detect(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias(id_), F.col("key").alias(key_), F.col("spans").alias(spans_))
    side = cut(side.dropDuplicates([id_, key_]), "spans")
    size = side.agg(F.sum(F.size(spans_) * 20 + 48)).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, lists = batch.column(at), batch.column(batch.num_columns - 1)
            if lists.null_count < len(lists):
                new = []
                for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    text, out, done = texts[i].as_py(), [], 0
                    for s in lists[i].as_py():
                        if s["start"] >= done:
                            out += [text[done : s["start"]], f"<{KINDS[s['kind']]}>"]
                        done = max(done, s["end"])
                    new.append("".join(out) + text[done:])
                batch = batch.set_column(at, batch.schema.field(at), pc.replace_with_mask(texts, lists.is_valid(), pa.array(new, texts.type)))
            yield batch.select(range(batch.num_columns - 1))
        pa.default_memory_pool().release_unused()

    joined = docs.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key_)), "left").drop(id_, key_)
    clean = joined.mapInArrow(run, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
