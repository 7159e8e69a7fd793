"""WARC archives: a writer with one gzip member per record, and a splittable reader.

Writing: a payload that several pages share is stored once, with the largest page id; the
others become revisit records that refer to it. Every task writes its own file of the shared
folder and reports it; only reported files are read, so a task that is run again leaves
nothing in the result.

Reading: files are cut into byte ranges. A task scans its range for the gzip magic, validates
each candidate by decoding the start of the member as a WARC header, and owns the records
that start inside its range, the last of which it may finish beyond it.

Defined results: a null html is an empty payload, a null url gives no target header. Rows
with equal payload and equal id are all responses; rows with a null id revisit a payload that
any id has. Payloads shorter than `least` bytes are never revisits."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raglens.llm.common import materialise, scratch, text_slices

MAGIC = b"\x1f\x8b\x08"
#: Bytes of archive that a reading task owns, and most bytes of one file (about).
SPLIT, FILE_BYTES = 8 << 20, 256 << 20
READ, STEP = 1 << 18, 1 << 14
#: Most tasks that ranges are dealt to.
TASKS = 100_000
VERSION = b"WARC/1."
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, place: str = "") -> bytes:
    """One WARC record, not compressed. place: what tells it from others of its page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {url} {place}')}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse_record(data: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type,
    refers_to of a decoded record. A response's digest is computed from its payload and must
    be the header's."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    http, _, payload = rest[: int(h["content-length"])].partition(b"\r\n\r\n")
    kind = h["warc-type"]
    said = h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        payload, n, digest = None, int(re.search(rb"\r\nContent-Length: (\d+)", http)[1]), said
    else:
        n, digest = len(payload), base32_sha1(payload)
        if digest != said:
            raise ValueError(f"a record's payload differs from its digest {said}")
    ref = h.get("x-refers-to-page-id", "None")
    return {"page_id": int(h["x-page-id"]) if "x-page-id" in h else None, "url": h.get("warc-target-uri"), "payload": payload, "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": None if ref == "None" else int(ref)}


def write(pages: DataFrame, folder: str | None = None, html: str = "html", id_col: str = "page_id", url: str = "url", least: int = 0) -> DataFrame:
    """Writes the pages' archives into a folder that all executors reach (a URI; by default
    one of the shared folder) and returns their table: path, size, records."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").select("digest", "kept")
    # a payload of very many pages is one key here; adaptive execution splits its partition
    told = rows.join(shared, "digest", "left").withColumn("again", F.coalesce(~F.col("page_id").eqNullSafe(F.col("kept")), F.lit(False)) & F.col("kept").isNotNull())

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        out = path = name = None
        size = n = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "size", "records"])

        for b in text_slices(batches, "payload", READ * 16):
            for page_id, u, payload, again, kept in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "again", "kept"))):
                if out is None:
                    store.create_dir(root, recursive=True)
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    path, size, n = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = member(record(page_id, u, payload, "revisit" if again else "response", kept if again else None, f"{name} {n}"))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= FILE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialise(told.select("page_id", "url", "payload", "again", "kept").mapInArrow(archived, "path string, size long, records long"), "manifest")


class Damaged(ValueError):
    """A member of an archive that can't be read."""


class _Bytes:
    """A file's bytes from some place on, read piece by piece; what is behind `here` may be
    forgotten, as it can be read again."""

    def __init__(self, file, at: int) -> None:
        self.file = file
        self.seek(at)

    @property
    def here(self) -> int:
        return self.at + self.pos

    def seek(self, at: int) -> None:
        self.at, self.pos, self.data = at, 0, b""
        self.file.seek(at)

    def back(self, at: int) -> None:
        if at >= self.at:
            self.pos = at - self.at
        else:
            self.seek(at)

    def more(self) -> bool:
        new = self.file.read(READ)
        self.at, self.data, self.pos = self.at + self.pos, self.data[self.pos :] + new, 0
        return bool(new)

    def find(self, what: bytes) -> bool:
        """Goes to the next place of `what`, or to the end."""
        while (i := self.data.find(what, self.pos)) < 0:
            self.pos = max(self.pos, len(self.data) - len(what) + 1)
            if not self.more():
                self.pos = len(self.data)
                return False
        self.pos = i
        return True

    def ended(self) -> bool:
        return self.pos >= len(self.data) and not self.more()


def _decoded(src: _Bytes, all_of_it: bool = True) -> bytes | None:
    """The record that starts at src, which is then behind it; None if none starts there, and
    src stays. Raises Damaged for a record that begins well and breaks or ends early. With
    all_of_it False only its start is decoded, and src stays."""
    start = src.here
    z = zlib.decompressobj(31)
    out, n, checked = [], 0, False
    while not z.eof:
        try:
            if src.ended():
                raise zlib.error("the file ends inside of a member")
            piece = src.data[src.pos : src.pos + STEP]
            out.append(z.decompress(piece))
        except zlib.error as e:
            if checked:
                raise Damaged(f"member at byte {start}: {e}") from e
            break
        src.pos += len(piece) - len(z.unused_data)
        n += len(out[-1])
        if not checked and n >= len(VERSION):
            if not b"".join(out).startswith(VERSION):
                break
            checked = True
            if not all_of_it:
                break
    if not checked or not all_of_it:
        src.back(start)
    return b"".join(out) if checked else None


def records_of(file, start: int, end: int, damaged: bool = False) -> Iterator[dict]:
    """The records of an archive that start in [start, end). Behind a record the next one must
    start at once, which is tested beyond `end` too, so that each start is known to some range:
    what isn't a record there, or breaks inside, raises Damaged. With `damaged` it is given as
    {record_type: damaged, offset} instead, and the search goes on behind its first byte."""
    src = _Bytes(file, start)
    sure = start == 0
    while src.here < end:
        if not sure and not src.find(MAGIC):
            return
        if (sure and src.ended()) or src.here >= end:
            break
        at = src.here
        try:
            data = _decoded(src)
            if data is None and sure:
                raise Damaged(f"no record starts at byte {at}")
            if data is not None:
                try:
                    one = parse_record(data)
                except (ValueError, KeyError, TypeError) as e:
                    raise Damaged(f"record at byte {at}: {e}") from e
                yield one | {"offset": at}
        except Damaged:
            if not damaged:
                raise
            yield {"record_type": "damaged", "offset": at}
            data = None
        sure = data is not None
        if not sure:
            src.back(at + 1)
    if sure and src.here >= end and not src.ended() and _decoded(src, all_of_it=False) is None:
        if not damaged:
            raise Damaged(f"no record starts at byte {src.here}")
        yield {"record_type": "damaged", "offset": src.here}


def read(manifest: DataFrame, split: int = SPLIT, payload: bool = False, damaged: bool = False) -> DataFrame:
    """The records of the archives in a table of path and size. A damaged or cut member, one
    between others that isn't a record, and a payload that isn't its digest's end the job with
    the file and the byte; with `damaged` each is a row of record_type `damaged` instead, all
    rows have their path and offset, and the records behind it are found again. (A file that was
    cut between two records has a size other than the manifest's.)"""
    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start")
    # ranges are short rows that stand for much work: without a number adaptive execution joins them
    n = manifest.agg(F.sum(F.ceil(F.col("size") / max(split, SPLIT)))).first()[0] or 1
    ranges = manifest.where("size > 0").select("path", "size", cuts).repartition(min(int(n), TASKS), "path", "start")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payload]
    if damaged:
        names += ["path", "offset"]
    types = {"path": pa.string(), "offset": pa.int64(), "page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], types[c]) for c in names], names=names)

        for b in batches:
            for path, size, start in zip(*(b.column(c).to_pylist() for c in ("path", "size", "start"))):
                store, where = fs.FileSystem.from_uri(path)
                with store.open_input_file(where) as file:
                    rows: list[dict] = []
                    if file.size() != size and not damaged:
                        raise Damaged(f"{path} has {file.size()} bytes of {size}")
                    try:
                        for r in records_of(file, start, start + split, damaged):
                            rows.append(r | {"path": path})
                            if len(rows) >= 256:
                                yield batch(rows)
                                rows = []
                    except Damaged as e:
                        raise Damaged(f"{path}: {e}") from e
                    if rows:
                        yield batch(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload + ", path string, offset long" * damaged
    return ranges.select("path", "size", "start").mapInArrow(scanned, schema)
