"""WARC archives, index first.

Writing gives one archive per task, a gzip member per record, and one index row per
record: file, offset, length, url, digest. Reading starts from the index: selected rows
are sorted by file and offset, neighbouring byte ranges are coalesced into single reads,
and records are cut out of them. The index is the truth: archives of failed task
attempts carry other names and are never referred to.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoform.llm.common import Scratch

GAP, MAX_READ, LEVEL = 64 << 10, 8 << 20, 1
#: Bytes of archives that a reading task is given.
READ_BYTES = 64 << 20
#: Payload groups fewer than this are broadcast (some 60 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 200_000
_INDEX = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
_INDEX_NAMES = [c.split()[0] for c in _INDEX.split(", ")]
_READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ_NAMES = [c.split()[0] for c in _READ.split(", ")]


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _clean(url: str) -> str:
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool) -> tuple[bytes, str]:
    """(gzip member, payload digest) of one record. A revisit keeps the HTTP header, with
    the full payload's length, and names the record it repeats."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {_clean(url)}"] if url else []), f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {_name(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush(), digest


def parse(member: bytes) -> tuple:
    """A row of ``_READ`` from one gzip member; a response's length and digest are taken
    from its payload, and a digest that differs from the header's is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        return _id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), None, size, digest, kind, _id(fields["WARC-Refers-To"])
    if base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
    return _id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), payload, len(payload), digest, kind, None


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files under ``root``; returns the index.

    Of records with equal payloads of at least ``min_bytes`` bytes, those with the
    smallest page_id are responses and the others revisit it. Null html is an empty
    payload; a null url leaves out the target; a null page_id can only be revisited if
    its whole group has none. Repeated pages keep a record each. Extra columns are
    ignored. The index is a table in the shared folder, written once."""
    scratch = Scratch(pages.sparkSession, "warc-index")
    data = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", data.alias("payload"), F.sha1(data).alias("k"))
    groups = (
        keyed.where(F.octet_length("payload") >= min_bytes).groupBy("k").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    )
    groups = scratch.write(groups)
    n = groups.count()
    marked = keyed.join(F.broadcast(groups) if n <= BROADCAST_ROWS else groups, "k", "left").select(
        "page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        file = f"{base}/archive-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        offset = 0
        with store.open_output_stream(file, compression=None, buffer_size=1 << 20) as out:
            for b in batches:
                for lo in range(0, b.num_rows, 1000):
                    rows = []
                    for page_id, url, payload, first, revisit in zip(*(c.to_pylist() for c in b.slice(lo, 1000).columns), strict=True):
                        member, digest = record(page_id, url, payload, first, revisit)
                        out.write(member)
                        rows.append((file, offset, len(member), page_id, url, digest, "revisit" if revisit else "response"))
                        offset += len(member)
                    yield _batch(rows, _INDEX_NAMES, _INDEX)

    out = scratch.write(marked.mapInArrow(run, _INDEX))
    scratch.drop(groups)
    return out


_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], names: list[str], ddl: str) -> pa.RecordBatch:
    kinds = [_TYPES[c.split()[1]] for c in ddl.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def coalesce(ranges: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Sorted (file, offset, length) -> (file, offset, length, first row, one past the last) reads."""
    out: list[list] = []
    for i, (f, o, n) in enumerate(ranges):
        last = out[-1] if out else None
        if last and last[0] == f and 0 <= o - (last[1] + last[2]) <= GAP and o + n - last[1] <= MAX_READ:
            last[2], last[4] = o + n - last[1], i + 1
        else:
            out.append([f, o, n, i, i + 1])
    return [tuple(x) for x in out]


def read_records(index: DataFrame, root: str, payload: bool = True) -> DataFrame:
    """Read the records that index rows point at: see ``_READ``; payload is null for
    revisits, and for all if ``payload`` is false. Records that have moved or been
    altered fail loudly. An empty index gives no rows. Tasks are as many as the records'
    bytes ask for, whatever the size of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(root)
        for b in batches:
            ranges = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            for file, at, size, lo, hi in coalesce(ranges):
                with store.open_input_file(file) as f:
                    blob = f.read_at(size, at)
                rows = [parse(blob[o - at : o - at + n]) for _, o, n in ranges[lo:hi]]
                yield _batch(rows if payload else [(*r[:2], None, *r[3:]) for r in rows], _READ_NAMES, _READ)

    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // READ_BYTES))
    return index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, _READ)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder, read every record back, and
    return (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    root = Scratch(pages.sparkSession, "warc").path("archives")
    index = write_archives(pages, root, min_bytes)
    return read_records(index, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
