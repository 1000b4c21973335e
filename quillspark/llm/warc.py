"""WARC records in ZIP packages: a writer, and a reader that range-reads records without extraction.

An archive is a ZIP file of stored members: `archive/data.warc.gz` (each record its own gzip member) and
`indexes/index.cdxj` (one line a record with its offset and length). The reader finds the end-of-directory
record from the file's tail, follows the ZIP64 locator where one stands, parses the central directory, and
then reads only byte ranges: the index, and the records that it is asked for.

Records with equal payloads of at least `min_revisit` bytes are stored once, as the response of the smallest
page_id; the others become revisit records that refer to it. Defined results: a null payload is empty; null
page ids sort last, and if a group has no other they are all responses; rows that repeat the smallest page_id
are all responses; very long payloads are records of their own size; empty tables give no archive and no record; other columns are not stored.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, ship, tidy, written

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Fixed values of the formats: signatures, and a plain instant so that reruns write the same bytes.
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
WARC_DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


# ----------------------------------------------------------------- writing

def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record, uncompressed; a revisit carries no payload."""
    revisit = payload is None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {WARC_DATE}",
        f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Payload-Length: {length}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []),
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


class Archive:
    """Writes one ZIP package to a stream that may not seek; only index lines stay in memory."""

    def __init__(self, sink: BinaryIO):
        self._zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._data = self._zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self._lines: list[str] = []
        self.size = 0

    def __len__(self) -> int:
        return len(self._lines)

    def add(self, page_id: int | None, raw: bytes) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self._data.write(packed)
        self._lines.append(json.dumps({"page_id": page_id, "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> None:
        self._data.close()
        self._zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self._lines))
        self._zip.close()


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def plan_records(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """(page_id, url, html binary or null for revisits, n_bytes, digest, refers_to) for each page."""
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha2("html", 256))
    # only groups of two and more; a written table, so that both sides of the join are plain shuffles that
    # adaptive execution can split where one payload is hot
    firsts = written(p.where(F.col("n_bytes") >= min_revisit).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND first IS NOT NULL").drop("n"), "firsts")
    joined = p.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", F.when(~revisit, F.col("html")).alias("html"), "n_bytes", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit: int = 100, max_records: int = 50_000, max_bytes: int = 1 << 30) -> DataFrame:
    """Write all of `pages` (page_id, url, html) as archives below `folder`; gives the manifest.

    Each task streams its records into files of its own name, so a task that runs again can't harm what
    another wrote; the manifest, a written table, lists the files of the tasks that ended well.
    """
    ship(pages.sparkSession)
    folder = folder or new_path(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = _file_system(folder)
        disk.create_dir(base, recursive=True)
        archive = sink = path = None

        def close():
            archive.close()
            sink.close()
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": [len(archive)], "n_bytes": [archive.size]})

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    path, sink = f"{folder}/{name}", disk.open_output_stream(f"{base}/{name}")
                    archive = Archive(sink)
                page_id, url, html, n, digest, refers_to = r
                archive.add(page_id, record(page_id, url, html, n, digest, refers_to))
                if len(archive) >= max_records or archive.size >= max_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    return written(plan_records(pages, min_revisit).mapInArrow(tidy(run), MANIFEST), "manifest")


# ----------------------------------------------------------------- reading

@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # offset of the local header


def _read(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def members(f) -> dict[str, Member]:
    """The central directory of an open ZIP file, ZIP64 fields included."""
    f.seek(0, 2)
    size = f.tell()
    tail_at = max(0, size - 22 - 65_535)
    tail = _read(f, tail_at, size - tail_at)
    at = tail.rfind(END)
    if at < 0:
        raise ValueError("not a ZIP file: no end of directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR64:
        where = struct.unpack_from("<Q", tail, at - 12)[0]
        end64 = _read(f, where, 56)
        if end64[:4] != END64:
            raise ValueError("ZIP64 locator points nowhere")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory = _read(f, start, length)
    out: dict[str, Member] = {}
    p = 0
    for _ in range(count):
        if directory[p : p + 4] != ENTRY:
            raise ValueError("broken central directory")
        method, packed, plain = struct.unpack_from("<H", directory, p + 10)[0], *struct.unpack_from("<II", directory, p + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, p + 28)
        header = struct.unpack_from("<I", directory, p + 42)[0]
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8")
        extra = directory[p + 46 + n_name : p + 46 + n_name + n_extra]
        q = 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:  # ZIP64: only the fields that are saturated stand here, in this order
                k = q + 4
                if plain == 0xFFFFFFFF:
                    plain, k = struct.unpack_from("<Q", extra, k)[0], k + 8
                if packed == 0xFFFFFFFF:
                    packed, k = struct.unpack_from("<Q", extra, k)[0], k + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", extra, k)[0]
            q += 4 + n
        out[name] = Member(name, method, packed, header)
        p += 46 + n_name + n_extra + n_note
    return out


def data_start(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method != zipfile.ZIP_STORED:
        raise ValueError(f"{m.name} is compressed; only stored members can be range-read")
    head = _read(f, m.header, 30)
    if head[:4] != LOCAL:
        raise ValueError(f"no local header for {m.name}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n_name + n_extra


def read_index(f) -> tuple[int, list[dict]]:
    """Where the WARC member begins, and the index lines."""
    listed = members(f)
    raw = _read(f, data_start(f, listed[INDEX]), listed[INDEX].size)
    return data_start(f, listed[DATA]), [json.loads(x) for x in raw.decode("utf-8").split("\n") if x]


def parse_record(raw: bytes) -> dict:
    """The fields of one uncompressed WARC record; the payload's digest is checked where it has one."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    urn = lambda x: int(n) if (n := x.removeprefix("<urn:page:").removesuffix(">")) else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    out = {"page_id": urn(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI", ""), "record_type": fields["WARC-Type"], "refers_to": None, "payload_bytes": int(fields["WARC-Payload-Length"]), "payload_digest": digest, "payload": None}
    if out["record_type"] == "revisit":
        return out | {"refers_to": urn(fields["WARC-Refers-To"])}
    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != out["payload_bytes"]:
        raise ValueError(f"record {out['page_id']} is damaged")
    return out | {"payload": payload}


def read_records(f, first: int = 0, last: int | None = None, span: int = 1 << 22) -> Iterator[dict]:
    """Records [first, last) of an open archive; neighbours are read in ranges of about `span` bytes."""
    start, index = read_index(f)
    lines = index[first:last]
    k = 0
    while k < len(lines):
        begin, j = lines[k]["offset"], k
        while j < len(lines) and lines[j]["offset"] + lines[j]["length"] - begin <= max(span, lines[k]["length"]):
            j += 1
        raw = _read(f, start + begin, lines[j - 1]["offset"] + lines[j - 1]["length"] - begin)
        for x in lines[k:j]:
            at = x["offset"] - begin
            yield parse_record(gzip.decompress(raw[at : at + x["length"]]))
        k = j


def read_archives(spark: SparkSession, manifest: DataFrame, payloads: bool = True, records_a_task: int = 10_000, bytes_a_task: int = 16 << 20) -> DataFrame:
    """The records of all archives of a manifest, a task for each slice of about `bytes_a_task`, or `records_a_task` if that is less."""
    ship(spark)
    step = F.greatest(F.lit(1), F.least(F.lit(records_a_task), F.floor(F.col("n_records") * bytes_a_task / F.greatest("n_bytes", F.lit(1))))).cast("long")
    parts = manifest.withColumn("step", step).select("path", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_records") - 1, F.lit(0)), F.col("step"))).alias("first"))
    n_tasks = max(1, parts.count())
    schema = RECORDS if payloads else RECORDS.replace(", payload binary", "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    types = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.strip().split(" ")[1]]) for n, x in zip(names, schema.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, step, first in zip(*(c.to_pylist() for c in batch.columns)):
                disk, name = _file_system(path)
                with disk.open_input_file(name) as f:
                    rows = []
                    for r in read_records(f, first, first + step):
                        rows.append({n: r[n] for n in names})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, types)

    # slices are dealt out by number, which adaptive execution leaves as it is however few bytes their rows have
    return parts.repartition(n_tasks).mapInArrow(tidy(run), schema)
