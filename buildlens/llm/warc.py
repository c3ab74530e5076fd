"""WARC archives: pages written as records, one gzip member each, and read back.

Of records with equal payloads of at least LEAST_SHARED bytes, that with the largest
page_id is a response and the others are revisits that refer to it; smaller payloads
are always responses. Payloads are compared by SHA-1 and length in a narrow shuffle
without the pages' content; repeated payloads are then few and meet the pages by id.

The reader streams: it inflates one member at a time from a stream of chunks, frames
the block by Content-Length and verifies the block's and the payload's digests, so
memory does not grow with an archive. Files are named by attempt, and only those of
successful tasks are in the manifest, so a lost executor leaves no half-read archive.

Null html: an empty payload. Null url: a record without target. Null page_id: never
the one referred to; among null ids alone all are responses. Repeated rows of the
largest page_id are all responses.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limit_batches, shared_dir, table, written

LEAST_SHARED = 1000
#: An archive is closed beyond this many bytes.
ARCHIVE_BYTES = 256 << 20
LEVEL = 6
CHUNK = 1 << 16
LONGEST_HEADER = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(uri: str | None) -> int | None:
    digits = (uri or "")[len("<urn:x-page:") : -1]
    return int(digits) if digits else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC record as one gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if revisit:
        fields += [("WARC-Refers-To", _uri(refers_to)), ("WARC-Profile", PROFILE)]
    fields += [("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


class Member:
    """One gzip member of a stream, inflated as it is read."""

    def __init__(self, stream, rest: bytes):
        self.stream, self.input, self.out, self.inflate = stream, rest, b"", zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflates at most about CHUNK more bytes; False at the member's end."""
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail or self.input or self.stream.read(CHUNK)
        self.input = b""
        got = self.inflate.decompress(data, CHUNK)  # without new data, what is still held back
        if not (data or got or self.inflate.eof):
            raise ValueError("the archive ends within a record")
        self.out += got
        return True

    def header(self) -> bytes:
        """What lies before the next empty line."""
        while (at := self.out.find(b"\r\n\r\n")) < 0:
            if len(self.out) > LONGEST_HEADER or not self.more():
                raise ValueError("a record without the end of its header")
        head, self.out = self.out[:at], self.out[at + 4 :]
        return head

    def take(self, n: int):
        """The next n bytes, in pieces."""
        while n:
            if not self.out and not self.more():
                raise ValueError("a record shorter than its Content-Length")
            piece, self.out = self.out[:n], self.out[n:]
            n -= len(piece)
            yield piece

    def rest(self) -> bytes:
        """Ends the member; the input after it."""
        while self.more():
            pass
        if self.out != b"\r\n\r\n":
            raise ValueError("a record longer than its Content-Length")
        return self.inflate.unused_data


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n")[1:])}


def records(stream, content: bool):
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record."""
    rest = stream.read(CHUNK)
    while rest:
        member = Member(stream, rest)
        fields = _fields(member.header())
        length, block, head = int(fields["content-length"]), hashlib.sha1(), b""
        payload, size, kept = hashlib.sha1(), 0, []
        in_http = True
        for piece in member.take(length):
            block.update(piece)
            if in_http:
                head += piece
                if (at := head.find(b"\r\n\r\n")) < 0:
                    continue
                head, piece, in_http = head[:at], head[at + 4 :], False
            payload.update(piece)
            size += len(piece)
            if content:
                kept.append(piece)
        rest = member.rest() or stream.read(CHUNK)
        said = lambda name: base64.b32decode(fields[name].removeprefix("sha1:"))
        revisit = fields["warc-type"] == "revisit"
        if said("warc-block-digest") != block.digest() or not revisit and said("warc-payload-digest") != payload.digest():
            raise ValueError(f"digests differ in {fields['warc-record-id']}")
        full = int(_fields(head)["content-length"])
        if not revisit and full != size:
            raise ValueError(f"lengths differ in {fields['warc-record-id']}")
        yield _page(fields["warc-record-id"]), fields.get("warc-target-uri"), full, said("warc-payload-digest").hex(), fields["warc-type"], _page(fields.get("warc-refers-to")), b"".join(kept) if content and not revisit else None


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that are revisits."""
    data = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    narrow = pages.select("page_id", F.sha1(data).alias("digest"), F.octet_length(data).alias("bytes")).where(F.col("bytes") >= LEAST_SHARED)
    shared = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 AND refers_to IS NOT NULL").drop("n")
    return narrow.join(shared, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the pages (page_id, url, html) as archives below folder; (path, records) of each."""
    again = written(revisits(pages)).withColumnsRenamed({"page_id": "__id", "digest": "__digest"})
    data = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", data.alias("payload"))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.sha1("payload") == F.col("__digest")), "left")
    rows = rows.select("page_id", "url", "payload", "refers_to")
    limit_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, path, size, n, made = None, "", 0, 0, []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path, size, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                data = record(page_id, url, payload, refers_to, refers_to is not None, date)
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = made.append((path, n))
        if out is not None:
            out.close()
            made.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": [x for x, _ in made], "records": [x for _, x in made]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return written(rows.mapInArrow(run, "path string, records long"))


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, folder: str, content: bool = False) -> DataFrame:
    """One row for each record of the archives; with content, also a response's payload."""
    limit_batches(archives.sparkSession)
    apart = archives.select("path").repartition(max(1, archives.count()))

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        schema = pa.schema(list(zip(names, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()))))
        store, _ = fs.FileSystem.from_uri(folder)
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    for row in records(stream, content):
                        rows.append(row)
                        size += len(row[-1] or b"")
                        if len(rows) == 1000 or size > 1 << 23:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return apart.mapInArrow(run, RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(archives, folder).drop("url", "payload")


def oracle() -> str:
    return f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= {LEAST_SHARED} AND page_id < last THEN last END AS refers_to FROM m"""
