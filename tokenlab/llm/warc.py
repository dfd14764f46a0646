"""WARC records in ZIP-packaged archives: a writer, and a reader that range-reads records without extraction."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import zipdir
from .shared import materialise, new_folder

#: An archive is closed when it has this many bytes.
ROLL_BYTES = 64 << 20
#: Tasks that read archives, at most; beyond that a task reads several.
MOST_TASKS = 100_000
DATE = "2000-01-01T00:00:00Z"
RECORDS, INDEX = "archive/records.warc.gz", "indexes/index.cdxj"
_ID = "urn:x-page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record, gzipped on its own. A revisit holds the HTTP head only, whose Content-Length stays the payload's."""
    uri = _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([] if refers_to is None else [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", mtime=0)


def parse(packed: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (None in a revisit) of one record."""
    data = gzip.decompress(packed)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(_ID)) else None
    out = {
        "page_id": number(fields["warc-record-id"]), "url": fields["warc-target-uri"], "payload_bytes": length, "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": fields["warc-type"], "refers_to": number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None, "payload": None,
    }
    if out["record_type"] == "response":
        if len(payload) != length or digest(payload) != out["payload_digest"]:
            raise ValueError(f"record of page {out['page_id']}: its payload doesn't have the length and digest it gives")
        out["payload"] = payload
    return out


def assign(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to: among equal payloads, the largest page_id of those, null in that itself.

    Payloads below least_bytes all stay responses. Payloads are told apart by 160 bits of SHA-1. The largest id of a
    payload is found by a sum that starts in the map tasks; the join back can be split where many pages have one
    payload. With null ids only, all are responses; beside another id, a null id revisits it. Rows that repeat the
    largest id are all responses, under one record id; a null payload is empty, an empty table gives no rows.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    own = own.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    heads = own.groupBy("sha").agg(F.max("page_id").alias("head"))
    both = own.join(heads, "sha")
    again = (F.octet_length("payload") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("head"))
    return both.select("page_id", "url", "payload", F.when(again, F.col("head")).alias("refers_to"))


def write_archives(assigned: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the rows of assign() into ZIP archives in a folder that all executors share; path, records of each.

    An archive holds its records, each gzipped on its own, as a stored member, and after it an index of their places
    as another. Every attempt of a task writes archives under names of its own, and the table returned lists those
    of the attempts that counted, so that lost executors and repeated attempts leave no record twice. Every row is a
    record of its own, whatever repeats; a null id is left out of the record id, a null url is empty. No rows, no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        zipped = body = None
        done = []

        def close():
            nonlocal zipped, body
            if zipped:
                body.close()
                with zipped.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
                    for line in index:
                        f.write(line)
                zipped.close()
                stream.close()
                done.append((f"{folder}/{name}", len(index)))
                zipped = None

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if zipped is None:
                    name, index, at = f"{uuid.uuid4().hex}.wacz", [], 0
                    stream = store.open_output_stream(f"{root}/{name}")
                    zipped = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    body = zipped.open(zipfile.ZipInfo(RECORDS), "w", force_zip64=True)
                packed = record(page_id, url, payload.encode(), refers_to)
                body.write(packed)
                index.append(f"{page_id} {DATE} {json.dumps({'offset': at, 'length': len(packed), 'filename': RECORDS})}\n".encode())
                at += len(packed)
                if at >= roll_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return materialise(assigned.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, records long"), "archives")


def stored_records(read: zipdir.Read, size: int) -> Iterator[bytes]:
    """The packed records of one archive. By its index where it has one, else by following the gzip members."""
    all_members = {m.name: m for m in zipdir.members(read, size)}
    bodies = {n: zipdir.content(read, m) for n, m in all_members.items() if n.startswith("archive/") and n.endswith((".warc.gz", ".warc"))}
    named = {n.rpartition("/")[2]: n for n in bodies}
    listed = set()
    for name in sorted(n for n in all_members if n.startswith("indexes/") and n.endswith((".cdx", ".cdxj"))):
        index, at, rest = zipdir.content(read, all_members[name]), 0, b""
        while at < all_members[name].size or rest:
            more = index(at, 1 << 20)
            at += len(more)
            lines = (rest + more).split(b"\n")
            rest = lines.pop() if more else b""
            for line in lines:
                if line.strip():
                    entry = json.loads(line[line.index(b"{") :])
                    own = entry["filename"] if entry["filename"] in bodies else named[entry["filename"].rpartition("/")[2]]
                    listed.add(own)
                    yield bodies[own](int(entry["offset"]), int(entry["length"]))
    for name in sorted(set(bodies) - listed):
        yield from follow(bodies[name], all_members[name].size)


def follow(read: zipdir.Read, size: int, window: int = 1 << 20) -> Iterator[bytes]:
    """Gzip members one after another, without an index."""
    at, buffer = 0, b""
    while at < size or buffer:
        unpacker, record_parts, used = zlib.decompressobj(31), [], False
        while not unpacker.eof:
            if not buffer:
                buffer = read(at, window)
                at += len(buffer)
                if not buffer:
                    if used:
                        raise ValueError("the last record ends early")
                    return
            unpacker.decompress(buffer)
            used = True
            rest = unpacker.unused_data
            record_parts.append(buffer[: len(buffer) - len(rest)])
            buffer = rest
        yield b"".join(record_parts)


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the archives listed in column path: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    An archive is read by one task: its directories, its index, then each record by its range. Archives are of
    bounded size, so tasks are. Payloads of responses are checked against their length and digest. Records come as they
    were written, repeats too.
    """
    batch_rows, batch_bytes = 2000, 32 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            arrays = [pa.array([r[k] for r in rows], t) for k, t in kinds.items()]
            return pa.RecordBatch.from_arrays(arrays, names=list(kinds))

        kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, own = fs.FileSystem.from_uri(path)
                with store.open_input_file(own) as f:
                    for packed in stored_records(lambda at, n, f=f: f.read_at(n, at), f.size()):
                        rows.append(parse(packed))
                        if not with_payload:
                            rows[-1]["payload"] = None
                        size += len(rows[-1]["payload"] or b"")
                        if len(rows) >= batch_rows or size >= batch_bytes:
                            yield out(rows)
                            rows, size = [], 0
        if rows:
            yield out(rows)

    # A stated number of partitions, or so few bytes of names would be put into one task.
    spread = archives.select("path").repartition(max(1, min(archives.count(), MOST_TASKS)), "path")
    return spread.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages into archives in the shared folder and read them back, without payloads: a row per row of pages."""
    folder = new_folder(pages.sparkSession, "warc")
    return read_archives(write_archives(assign(pages, least_bytes), folder), with_payload=False)
