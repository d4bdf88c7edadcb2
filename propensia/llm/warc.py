"""WARC archives: revisit-aware writer and a splittable reader.

Writer: each task writes gzip archives (one member per record) to the shared
folder under a name of its own attempt; only files named in the manifest that
the finished tasks return are ever read, so lost or repeated tasks leave no
record twice.

Reader: archives are cut into byte ranges.  A task scans its range for the gzip
magic, accepts a candidate only if it inflates to a WARC header and is followed
by another member or the end of the file, reads the record (also past the end
of its range) and goes on behind it.  A record belongs to the range in which
its member starts, so each is read once, whatever the range size.

Equal payloads: of the rows whose payload is equal (compared by SHA-256 and
length, not by the SHA-1 that WARC names) and at least ``min_revisit_bytes``
long, the largest page_id is the response, the others are revisits of it.

Defined cases: null html counts as an empty payload; a null url is left out of
the record; a null page_id loses against any other (a group of nulls only are
all responses); rows repeated with the winning page_id are all responses; line
breaks in a url are percent-encoded; a very long payload is one member like any
other; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_scratch
from .common import bytes_of, q, written

MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 16 << 20
ARCHIVE_BYTES = 1 << 30
CAPTURED = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_STEP = 16 << 10

RECORD_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
                 "refers_to long, payload binary, archive string, offset long")


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Hadoop-style uri (``file:/x``, ``/x``, ``hdfs://...``)."""
    local = re.match(r"(?:file:)?(?://)?(/.*)", uri)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(uri)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head of its full payload but not the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {CAPTURED}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[%\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}"
                                                 if m[0] != "%" else "%", url))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _deflate(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                 min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, url, html and ``refers_to`` (null: the row is a response).

    Groups are counted before the join (partial aggregation); only digests with
    copies are joined back, and a hot digest is split by the adaptive skew join.
    """
    rows = pages.select(q(id_col).cast("long").alias("page_id"), q(url_col).alias("url"),
                        F.coalesce(q(html_col), F.lit("")).alias("html"))
    size = F.octet_length("html").cast("long")
    keyed = rows.withColumn("_same", F.concat(F.sha2("html", 256), F.lit("-"), size.cast("string")))
    groups = keyed.where(size >= min_revisit_bytes).groupBy("_same").agg(
        F.max("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_same", "_first")
    revisit = F.col("_first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("_first")))
    return keyed.join(groups, "_same", "left").select(
        "page_id", "url", "html", F.when(revisit, F.col("_first")).alias("refers_to"))


def write_archives(planned: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``planned`` rows; returns the manifest (path, size, records) as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = filesystem(folder)
        system.create_dir(at, recursive=True)
        out, path, size, n, done = None, "", 0, 0, []
        for b in batches:
            ids, urls, refers = (b.column(k).to_pylist() for k in (0, 1, 3))
            for page_id, url, payload, to in zip(ids, urls, bytes_of(b.column(2).cast(pa.string())), refers):
                if out is None:
                    path = f"{at}/{uuid.uuid4().hex}.warc.gz"
                    out, size, n = system.open_output_stream(path, compression=None), 0, 0
                member = _deflate(record(page_id, url, payload, to, to is not None))
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= archive_bytes:
                    out.close()
                    done.append((path, size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, size, n))
        prefix = folder[: len(folder) - len(at)] if folder.endswith(at) else ""
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array([prefix + p for p, _, _ in done], pa.string()), pa.array([s for _, s, _ in done], pa.int64()),
                 pa.array([k for _, _, k in done], pa.int64())], names=["path", "size", "records"])

    order = planned.select("page_id", "url", "html", "refers_to")
    return written(order.mapInArrow(run, "path string, size long, records long"), "warc_manifest")


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parse(data: bytes) -> tuple:
    """page_id, url, type, payload bytes, digest, refers_to, payload of one inflated record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    f = _fields(head)
    block = rest[: int(f["content-length"])]
    if len(block) != int(f["content-length"]):
        raise ValueError("record block is shorter than its Content-Length")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, size = f["warc-payload-digest"].removeprefix("sha1:"), int(_fields(http)["content-length"])
    revisit = f["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"payload of {f['warc-record-id']} does not match its header")
    return (_page(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], size, digest,
            _page(f.get("warc-refers-to")), None if revisit else payload)


class _Window:
    """Bytes of one file from ``start`` on, read ahead as needed."""

    def __init__(self, file, start: int, size: int):
        self.file, self.start, self.size, self.data = file, start, size, b""

    def upto(self, end: int) -> None:
        end = min(end, self.size)
        have = self.start + len(self.data)
        if end > have:
            self.data += self.file.read_at(end - have, have)

    def cut(self, a: int, b: int) -> bytes:
        self.upto(b)
        return self.data[a - self.start: b - self.start]


def _member(w: _Window, at: int) -> tuple[bytes, int] | None:
    """The inflated record whose member starts at ``at`` and the offset behind it; None if it is no record."""
    z, parts, pos, checked = zlib.decompressobj(31), [], at, False
    step = _STEP
    while not z.eof:
        piece = w.cut(pos, pos + step)
        if not piece:
            return None
        try:
            parts.append(z.decompress(piece))
        except zlib.error:
            return None
        pos += len(piece)
        step = min(step * 2, 1 << 20)
        if not checked and sum(map(len, parts[:4])) >= 7:
            checked = True
            if not b"".join(parts)[:7] == b"WARC/1.":
                return None
    end = pos - len(z.unused_data)
    follows = w.cut(end, end + 3)
    data = b"".join(parts)
    if not data.startswith(b"WARC/1.") or (follows and follows != MAGIC[: len(follows)]):
        return None
    return data, end


def scan_range(file, size: int, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, inflated record) of every record whose member starts in [start, end)."""
    w = _Window(file, start, size)
    w.upto(end + len(MAGIC) - 1)
    at = start
    while True:
        hit = w.data.find(MAGIC, at - start)
        if hit < 0 or start + hit >= end:
            return
        got = _member(w, start + hit)
        if got is None:
            at = start + hit + 1
        else:
            yield start + hit, got[0]
            at = got[1]
            if at >= end:
                return


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Every record of the archives in ``manifest`` (path, size): RECORD_SCHEMA."""
    ranges = manifest.where("size > 0").select(
        "path", "size", F.explode(F.expr(f"sequence(0L, size - 1, {range_bytes}L)")).alias("start"))
    spread = ranges.repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                system, at = filesystem(path)
                with system.open_input_file(at) as file:
                    rows: list[tuple] = []
                    held = 0
                    for offset, data in scan_range(file, size, start, min(size, start + range_bytes)):
                        rows.append((*parse(data), path, offset))
                        held += len(data)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return spread.mapInArrow(run, RECORD_SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "archive", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def round_trip(pages: DataFrame, folder: str | None = None, range_bytes: int = RANGE_BYTES, **columns) -> DataFrame:
    """Write one record per page and read the archives back."""
    folder = folder or shared_scratch(pages.sparkSession, f"warc/{uuid.uuid4().hex}")
    return read_archives(write_archives(plan_records(pages, **columns), folder), range_bytes)
