"""Web archives in ZIP packages: written by tasks, read back by ranges without extraction.

A package holds ``archive/data.warc.gz`` (one gzip member per record) and ``indexes/index.cdxj`` as stored ZIP
members, so any record is a range of the package. ``write`` turns page rows into packages in a shared
folder; names hold the attempt of the task, and the manifest lists what the attempt that counted wrote, so a
repeated or late attempt (whose rows may come in another order) neither replaces nor doubles a record.
``ranges`` reads the end of each package, its central directory (ZIP64 where sizes or offsets
need it), and the index; ``read`` fetches runs of records by range and checks each payload's digest.

Of records with equal payloads of at least ``least`` bytes the one with the smallest page id is a response, the
others are revisits that refer to it; rows that repeat that page id are responses too. A null page id is
never referred to; a null html is an empty payload. The folder may be any that pyarrow opens by its URI.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnlake.llm.common import cut, small_side
from churnlake.session import scratch_path

PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 200_000
READ_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def mark(pages: DataFrame, least: int = 100) -> DataFrame:
    """Page rows with payload, its digest, and the page that holds the same payload (null for responses)."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    same = rows.filter(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("ref"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = cut(same.select("digest", "ref"), "payloads")
    refers = F.when(F.col("page_id").eqNullSafe(F.col("ref")), None).otherwise(F.col("ref"))
    return rows.join(small_side(same, 400_000), "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _line(text: str) -> str:
    """Text as the value of a header: no control characters."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, compressed by itself."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n", 4, mtime=0)


def write(marked: DataFrame, folder: str) -> DataFrame:
    """Writes packages; returns their manifest (path, bytes, records) as a written table."""
    own = uuid.uuid4().hex[:12]  # names of another run into the same folder differ too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        rows = (row for batch in batches for at in range(0, batch.num_rows, 256) for row in batch.slice(at, 256).to_pylist())
        row, count = next(rows, None), 0
        while row is not None:
            name = f"part-{own}-{task.partitionId():06d}-{task.taskAttemptId():08d}-{count:04d}.zip"
            index: list[str] = []
            with store.open_output_stream(f"{root}/{name}") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as package:
                with package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True) as member:
                    offset = member.write(gzip.compress(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n", 4, mtime=0))
                    while row is not None and offset < PACKAGE_BYTES and len(index) < PACKAGE_RECORDS:
                        data = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                        member.write(data)
                        index.append(json.dumps({"id": row["page_id"], "offset": offset, "length": len(data)}))
                        offset += len(data)
                        row = next(rows, None)
                package.writestr(zipfile.ZipInfo(INDEX), "\n".join(index) + "\n")
            size = store.get_file_info(f"{root}/{name}").size
            yield pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([size], pa.int64()), pa.array([len(index)], pa.int64())], ["path", "bytes", "records"])
            count += 1

    return cut(marked.mapInArrow(run, "path string, bytes long, records long"), "manifest")


def directory(file, size: int) -> dict[str, tuple[int, int, int, int]]:
    """Members of a ZIP file by name: method, stored bytes, real bytes, place of the local header."""
    tail_at = max(0, size - 65_557)
    file.seek(tail_at)
    tail = file.read(size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    while end >= 0 and end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail):
        end = tail.rfind(b"PK\x05\x06", 0, end)  # the signature inside a comment
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, length, start = struct.unpack_from("<HLL", tail, end + 10)
    if 0xFFFF == count or 0xFFFFFFFF in (length, start):
        file.seek(tail_at + end - 20)
        sign, _, at, _ = struct.unpack("<4sLQL", file.read(20))
        if sign == b"PK\x06\x07":
            file.seek(at)
            end64 = file.read(56)
            if end64[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
    file.seek(start)
    entries, at, found = file.read(length), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", entries, at + 8)
        packed, real, name_len, extra_len, comment_len = struct.unpack_from("<LLHHH", entries, at + 20)
        place = struct.unpack_from("<L", entries, at + 42)[0]
        name = entries[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
        extra, i = entries[at + 46 + name_len : at + 46 + name_len + extra_len], 0
        while i + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, i)
            if kind == 1:  # only the fields that did not fit, in this order
                wide = iter(struct.unpack_from(f"<{long // 8}Q", extra, i + 4))
                real = next(wide) if real == 0xFFFFFFFF else real
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                place = next(wide) if place == 0xFFFFFFFF else place
            i += 4 + long
        found[name] = (method, packed, real, place)
        at += 46 + name_len + extra_len + comment_len
    return found


def data_start(file, place: int) -> int:
    """Where a member's bytes begin, from its local header."""
    file.seek(place)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("damaged local header")
    name_len, extra_len = struct.unpack_from("<HH", head, 26)
    return place + 30 + name_len + extra_len


def ranges(manifest: DataFrame, run_bytes: int = READ_BYTES) -> DataFrame:
    """Runs of neighbouring records: path, first byte in the package, bytes, ends of the records in the run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                store, name = _store(path)
                with store.open_input_file(name) as file:
                    members = directory(file, file.size())
                    if members[ARCHIVE][0] != zipfile.ZIP_STORED:
                        raise ValueError(f"{path}: the archive member is compressed, its records have no ranges")
                    method, packed, _, place = members[INDEX]
                    file.seek(data_start(file, place))
                    text = file.read(packed)
                    text = zlib.decompress(text, -15) if method == zipfile.ZIP_DEFLATED else text
                    base = data_start(file, members[ARCHIVE][3])
                rows: list[tuple] = []
                start, ends = 0, []
                for line in text.splitlines():
                    entry = json.loads(line)
                    if ends and (entry["offset"] != start + ends[-1] or ends[-1] >= run_bytes):
                        rows.append((path, base + start, ends[-1], ends))
                        ends = []
                    if not ends:
                        start = entry["offset"]
                    ends.append(entry["offset"] - start + entry["length"])
                if ends:
                    rows.append((path, base + start, ends[-1], ends))
                yield pd.DataFrame(rows, columns=["path", "first", "bytes", "ends"])

    return manifest.select("path").mapInPandas(run, "path string, first long, bytes long, ends array<long>")


def parse(data: bytes, with_payload: bool = True) -> tuple:
    """One decompressed record as a row of RECORD; a response's digest has to be that of its payload."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    page = fields["WARC-Record-ID"].removeprefix("<urn:page:").removesuffix(">")
    refers = fields.get("WARC-Refers-To")
    if refers is None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"page {page}: the payload is not the one that was written")
    return (
        int(page) if page else None, fields.get("WARC-Target-URI"), fields["WARC-Type"], payload if with_payload and refers is None else None,
        length, digest, None if refers is None else int(refers.removeprefix("<urn:page:").removesuffix(">")),
    )


def read(runs: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of these runs, one range read each; columns of RECORD. Runs are dealt evenly."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, name = _store(row["path"])
                with store.open_input_file(name) as file:
                    data = file.read_at(row["bytes"], row["first"])
                rows = [parse(gzip.decompress(data[a:b]), with_payload) for a, b in zip([0, *row["ends"]], row["ends"])]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    dealt = runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, folder: str | None = None, with_payload: bool = True) -> DataFrame:
    """Writes pages into packages in the shared folder and reads them back."""
    manifest = write(mark(pages), folder or scratch_path(pages.sparkSession, "warc"))
    return read(ranges(manifest), with_payload)
