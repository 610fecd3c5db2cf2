"""Web archives: written with revisit records, read back record by record.

``write_archives`` turns a table of pages into gzipped WARC 1.1 files, one gzip
member per record.  Of records with equal payloads (SHA-1 and length) the one
with the smallest id is a ``response``; the others become ``revisit`` records
that hold the HTTP header only and refer to the response.  The smallest ids are
found by an aggregate over digests, and only digests that occur twice or more
are joined back, so a payload that a third of the rows hold is split by the
planner like any skewed join.  Files roll over at a size; each file is written
whole by one task under a name of its own attempt, and only files that the
stored manifest lists belong to the archive, so a task that is lost and run
again leaves at most an unlisted file.

``read_archives`` reads the files of a manifest, in tasks.  A file is read from
front to back in pieces of 64 KB: a decompressor is fed until its member ends,
the record's header is parsed, and the block is framed by its Content-Length.
Block and payload digests are computed as the bytes pass, so memory is bounded
by one piece, or by one payload where payloads are asked for.

Files are opened through ``pyarrow.fs`` by the scheme of the shared folder, without its own decompression.

Defined results: a null payload is empty; of repeated rows with the smallest id
all are responses; rows with a null id are never the smallest, and where all
rows of a payload have null ids, all are responses; a null url writes no target
header and is read as null; bytes of a url outside printable ASCII are
percent-encoded; an empty table makes an archive without files and an empty result; other
columns are not written.  A damaged or cut file raises ``ValueError`` with its
name; a record whose digests don't match is returned with ``valid`` false.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.llm.common import shared_dir, stored

PIECE = 1 << 16
ROLL_BYTES = 256 << 20
HEAD_BYTES = 1 << 20  # a header beyond this is damage
RECORD_ID = "<urn:tracelake:page:%s>"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages have no time of capture
PLAIN_URL = "".join(map(chr, range(33, 127)))
MANIFEST = "path string, records long, bytes long"
RECORD = "id string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, valid boolean"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def record(kind: str, page: str, url: str | None, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record, not compressed. A revisit keeps the HTTP header, whose Content-Length is that of the payload it leaves out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {RECORD_ID % page}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=PLAIN_URL)}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {RECORD_ID % refers_to}"]
    lines += [
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base32(hashlib.sha1(payload).digest())}",
        f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 16 + zlib.MAX_WBITS)
    return z.compress(data) + z.flush()


class _Member:
    """The bytes of one gzip member, decompressed as they are asked for."""

    def __init__(self, pieces: Iterator[bytes], start: bytes, name: str):
        self.pieces, self.name, self.z = pieces, name, zlib.decompressobj(16 + zlib.MAX_WBITS)
        self.feed, self.ready = start, b""

    def more(self) -> bool:
        """At most a piece more of plain bytes; False at the member's end."""
        while not self.z.eof:
            data = self.feed or next(self.pieces, b"")
            if not data:
                raise ValueError(f"{self.name}: ends inside a record")
            try:
                got = self.z.decompress(data, PIECE)
            except zlib.error as e:
                raise ValueError(f"{self.name}: {e}") from None
            self.feed = self.z.unconsumed_tail
            if got:
                self.ready += got
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        """All up to and with the mark."""
        seen = 0
        while (at := self.ready.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.ready)
            if seen > HEAD_BYTES or not self.more():
                raise ValueError(f"{self.name}: a header without an end")
        out, self.ready = self.ready[: at + len(mark)], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next n bytes, piece by piece."""
        while n:
            if not self.ready and not self.more():
                raise ValueError(f"{self.name}: a block shorter than its Content-Length")
            out, self.ready = self.ready[:n], self.ready[n:]
            n -= len(out)
            yield out

    def end(self) -> bytes:
        """Checks that only the record's closing line ends are left; what was read beyond the member."""
        tail = self.ready
        self.ready = b""
        while self.more():
            tail += self.ready
            self.ready = b""
            if len(tail) > 4:
                break
        if tail != b"\r\n\r\n":
            raise ValueError(f"{self.name}: a record longer than its Content-Length")
        return self.z.unused_data


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def _urn(value: str | None) -> str | None:
    return value and value.removeprefix(RECORD_ID.partition("%")[0]).removesuffix(">")


def read_records(pieces: Iterator[bytes], name: str, with_payload: bool = False) -> Iterator[dict]:
    """The records of one archive in order, from pieces of its bytes."""
    pieces = iter(pieces)
    left = next(pieces, b"")
    while left:
        m = _Member(pieces, left, name)
        head = m.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/1."):
            raise ValueError(f"{name}: no WARC record")
        f = _fields(head)
        if not re.fullmatch(r"\d{1,18}", f.get("content-length", "")):
            raise ValueError(f"{name}: a record without Content-Length")
        n, kind = int(f["content-length"]), f.get("warc-type")
        block, payload, n_payload, kept, http, in_head = hashlib.sha1(), hashlib.sha1(), 0, [], b"", True
        for data in m.take(n):
            block.update(data)
            if in_head:
                http += data
                at = http.find(b"\r\n\r\n")
                if at < 0 and len(http) <= HEAD_BYTES:
                    continue
                in_head = False
                http, data = (http[: at + 4], http[at + 4 :]) if at >= 0 else (b"", http)
            payload.update(data)
            n_payload += len(data)
            if with_payload:
                kept.append(data)
        left = m.end() or next(pieces, b"")
        stated = f.get("warc-payload-digest", "").removeprefix("sha1:")
        valid = f.get("warc-block-digest", "").removeprefix("sha1:") in ("", base32(block.digest()))
        if kind == "revisit":  # its payload is elsewhere
            digest, n_payload = stated, int(_fields(http).get("content-length", 0))
        else:
            digest = base32(payload.digest())
            valid = valid and stated in ("", digest)
        out = {"id": _urn(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": kind, "refers_to": _urn(f.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": n_payload, "valid": valid}
        if with_payload:
            out["payload"] = None if kind == "revisit" else b"".join(kept)
        yield out


def judged(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """``(id, url, payload, refers_to)``: refers_to is null for a response, else the smallest id with that payload.

    Payloads under ``min_bytes`` are all responses.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("n", F.octet_length("payload"))
    same = rows.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times"))
    same = stored(same.where("times > 1 AND first IS NOT NULL").select("digest", "n", "first"), "equal-payloads")
    refers = F.when(F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first"))
    return rows.join(same, ["digest", "n"], "left").select("id", "url", "payload", refers.alias("refers_to"))


def write_archives(rows: DataFrame, folder: str | None = None, roll_bytes: int = ROLL_BYTES, level: int = 6) -> DataFrame:
    """Writes rows of ``judged`` as archives below ``folder`` (default: the shared one); their manifest ``(path, records, bytes)``."""
    folder = folder or f"{shared_dir(rows.sparkSession)}/warc-{uuid.uuid4().hex}"
    narrow = rows.select(F.col("id").cast("string").alias("id"), "url", "payload", F.col("refers_to").cast("string").alias("refers_to"))

    def write(batches):
        store, at = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        store.create_dir(at, recursive=True)
        task = TaskContext.get()
        stem, out, done = f"{at}/part-{task.partitionId():06d}-{task.taskAttemptId()}", None, []
        for batch in batches:
            ids, urls, payloads, refers = batch.columns
            for i in range(batch.num_rows):  # a payload at a time, so that no copy of a batch is made
                page, first = ids[i].as_py() or "", refers[i].as_py()
                data = member(record("response" if first is None else "revisit", page, urls[i].as_py(), payloads[i].as_py(), first), level)
                if out is None:
                    done.append([f"{stem}-{len(done):04d}.warc.gz", 0, 0])
                    out = store.open_output_stream(done[-1][0], compression=None)
                out.write(data)
                done[-1][1] += 1
                done[-1][2] += len(data)
                if done[-1][2] >= roll_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "records", "bytes"])

    out = stored(narrow.mapInArrow(write, MANIFEST), "warc-manifest")
    out.archive_folder = folder
    return out


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's files. Each file is read by one task; files of one manifest are dealt out evenly."""
    schema = RECORD + (", payload binary" if with_payload else "")
    types = [(k, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for k, t in (x.split() for x in schema.split(", "))]

    def read(batches):
        store = pafs.FileSystem.from_uri(folder)[0] if "://" in folder or folder.startswith("file:") else pafs.LocalFileSystem()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                found, held = [], 0
                with store.open_input_stream(path, compression=None) as f:
                    for r in read_records(iter(lambda f=f: f.read(PIECE), b""), path, with_payload):
                        found.append(r)
                        held += len(r.get("payload") or b"") + 400
                        if held >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(found, schema=pa.schema(types))
                            found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=pa.schema(types))

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(read, schema)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    kind = pages.schema["page_id"].dataType
    manifest = write_archives(judged(pages))
    records = read_archives(manifest, manifest.archive_folder)
    return records.select(
        F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"), "valid"
    )


#: Base 32 from the 40 hex digits of SHA-1: five of them are 20 bits, or four letters.
OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST((CAST('0x' || substr(h, CAST(5 * (k // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, true AS valid
FROM q
"""
