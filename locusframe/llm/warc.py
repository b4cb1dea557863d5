"""WARC archives as seekable Zstandard bundles.

A worker writes its records into bundles of independent frames, and ends each bundle with a
seek table (the skippable frame of Zstandard's seekable format), so that any record is read
by decompressing one frame.  The index, a table in the shared folder, maps a record's
identifier to its bundle, frame and offset in the frame.

Payloads of at least ``least`` bytes that repeat are written once, with the largest page_id;
the others are revisit records, which name that page.  Where a payload's rows tie for the
largest page_id, all of these are responses; null page_ids are never the largest, unless
there is no other.

Bundles have a name for each attempt of a task and the index only that of the attempt that
was committed, so a task that runs again does no harm.  They are written through pyarrow's
file systems, and the shared folder's scheme must be one of them.

Null payloads are empty; a null url leaves the target out.  Repeated rows give a record
each.  A payload may be larger than a frame, which then holds it alone.  Other columns are
ignored.  An empty table gives an empty index.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, small_batches, table, work_folder

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, record_type string, refers_to long, bundle string, frame long, offset long, length long"
CRLF = b"\r\n"


def record_id(place: str) -> str:
    """Of the place where a record is written, which no other record has."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}"


def record(own_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has no payload in its block, but its digest and size in its header, and the page that has it."""
    http = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + CRLF
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<{own_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url)))
    block = http + payload
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", str(refers_to))]
        block = http
    fields.append(("Content-Length", str(len(block))))
    head = b"WARC/1.1" + CRLF + b"".join(f"{k}: {v}\r\n".encode("utf-8", "surrogatepass") for k, v in fields)
    return head + CRLF + block + CRLF + CRLF


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of the record at the beginning of the data."""
    head, _, rest = data.partition(CRLF + CRLF)
    version, *lines = head.split(CRLF)
    if version != b"WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.decode("utf-8", "surrogatepass").split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(CRLF + CRLF)[2]


def file_system(folder: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else os.path.abspath(folder))


class Bundle:
    """A file of frames while it is written."""

    def __init__(self, system, path: str, level: int = 3):
        import zstandard

        self.out, self.path = system.open_output_stream(path, compression=None), path
        self.zstd, self.frames, self.size = zstandard.ZstdCompressor(level=level), [], 0

    def add(self, frame: bytes) -> None:
        data = self.zstd.compress(frame)
        self.out.write(data)
        self.frames.append((len(data), len(frame)))
        self.size += len(data)

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.out.close()


class Reader:
    """Frames of a bundle, found by its seek table."""

    def __init__(self, system, path: str):
        import zstandard

        self.file, self.zstd = system.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        table = self.file.read_at(8 * n, size - 9 - 8 * n)
        self.places, at = [], 0
        for k in range(n):
            packed, whole = struct.unpack_from("<II", table, 8 * k)
            self.places.append((at, packed, whole))
            at += packed

    def frame(self, k: int) -> bytes:
        at, packed, whole = self.places[k]
        return self.zstd.decompress(self.file.read_at(packed, at), max_output_size=whole)


def with_types(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html and refers_to: the page that holds the same payload, null for a response."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    keys = own.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("top"), F.count("*").alias("n"))
    repeated = cut(keys.where("n > 1").select("digest", "size", "top"), "payloads")
    # A payload that a third of the pages share is one row on the right; adaptive execution parts its rows on the left.
    joined = own.join(repeated, ["digest", "size"], "left")
    revisit = F.col("top").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("top")))
    return joined.select("page_id", "url", "html", F.when(revisit, F.col("top")).alias("refers_to"))


def write(pages: DataFrame, folder: str, frame_bytes: int = 512_000, bundle_bytes: int = 256_000_000) -> DataFrame:
    """Writes the bundles (pages as of with_types) and returns the index, kept in the shared folder."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        stem, n, n_records = f"part-{context.partitionId():06d}-{context.taskAttemptId()}", 0, 0
        bundle, buffer, size, rows = None, [], 0, []

        def close_frame() -> None:
            nonlocal buffer, size
            if buffer:
                bundle.add(b"".join(buffer))
                buffer, size = [], 0

        def frame_of_rows() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["page_id", "record_id", "record_type", "refers_to", "bundle", "frame", "offset", "length"])
            for c in ("page_id", "refers_to"):
                out[c] = pd.array([None if pd.isna(x) else int(x) for x in out[c]], "Int64")
            rows.clear()
            return out

        for part in pieces(frames, "html", 4_000_000):
            ids = [None if missing else int(x) for x, missing in zip(part["page_id"], part["page_id"].isna())]
            tops = [None if missing else int(x) for x, missing in zip(part["refers_to"], part["refers_to"].isna())]
            for page, url, html, top in zip(ids, part["url"], part["html"], tops):
                if bundle is None:
                    name = f"{stem}-{n}.warc.zst"
                    bundle, n = Bundle(system, f"{path}/{name}"), n + 1
                own_id = record_id(f"{folder}/{name}/{len(bundle.frames)}/{size}/{n_records}")
                n_records += 1
                data = record(own_id, page, url, (html or "").encode("utf-8", "surrogatepass"), top)
                if size and size + len(data) > frame_bytes:
                    close_frame()
                rows.append((page, own_id, "response" if top is None else "revisit", top, name, len(bundle.frames), size, len(data)))
                buffer.append(data)
                size += len(data)
                if bundle.size > bundle_bytes:
                    close_frame()
                    bundle.close()
                    bundle = None
            if rows:
                yield frame_of_rows()
        if bundle is not None:
            close_frame()
            bundle.close()

    small_batches(pages.sparkSession)
    return cut(pages.mapInPandas(run, INDEX), "warc-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of an index, all from the archive: page_id, record_id, record_type, refers_to, url, payload, payload_bytes and payload_digest.

    A response's payload must have the digest its header says; a revisit's payload is null.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = file_system(folder)
        name, reader, at, data = None, None, -1, b""
        for part in frames:
            out = []
            for row in part.itertuples(index=False):
                if row.bundle != name:
                    name, reader, at = row.bundle, Reader(system, f"{path}/{row.bundle}"), -1
                if row.frame != at:
                    at, data = row.frame, reader.frame(row.frame)
                fields, payload = parse(data[row.offset : row.offset + row.length])
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if fields["WARC-Record-ID"] != f"<{row.record_id}>" or fields["WARC-Type"] != row.record_type:
                    raise ValueError(f"{name}: another record where {row.record_id} should be")
                if fields["WARC-Type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != size):
                    raise ValueError(f"{name}: the payload of {row.record_id} is damaged")
                page, top = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                out.append((None if page is None else int(page), row.record_id, None if top is None else int(top), fields["WARC-Type"], fields.get("WARC-Target-URI"), payload if fields["WARC-Type"] == "response" else None, size, digest))
            frame = pd.DataFrame(out, columns=["page_id", "record_id", "refers_to", "record_type", "url", "payload", "payload_bytes", "payload_digest"])
            for k, c in ((0, "page_id"), (2, "refers_to")):
                frame[c] = pd.array([r[k] for r in out], "Int64")
            yield frame

    schema = "page_id long, record_id string, refers_to long, record_type string, url string, payload binary, payload_bytes long, payload_digest string"
    small_batches(index.sparkSession)
    return index.mapInPandas(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    folder = work_folder(spark, "warc")
    index = write(with_types(table(spark, sf_dir, "pages")), folder)
    return read(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
top AS (SELECT digest, size, max(page_id) AS top FROM p WHERE size >= 1000 GROUP BY digest, size)
SELECT p.page_id, CAST(p.size AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
  CASE WHEN p.page_id < top.top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id < top.top THEN top.top END AS refers_to
FROM p LEFT JOIN top USING (digest, size)
"""
