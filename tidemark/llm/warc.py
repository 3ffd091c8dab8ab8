"""WARC archives: a writer, and a sequential reader of one gzip member per record.

`write_archives` writes pages as response and revisit records, an archive per task, to a folder that
driver and executors share; `read_archives` streams archives record by record: zlib decompresses a
member as its bytes arrive, the header says how long the block is, and block and payload digests are
fed chunk by chunk and verified. Memory is bounded by one record's payload. Archives are written under a name of their own attempt and
listed in a manifest table once the task's output is committed, so a lost or repeated task leaves no
half archive in a result.

Of records with equal payloads (SHA-1 and length) of at least `min_revisit_bytes` the one with the
smallest page_id is the response, others revisit it by the identical-payload-digest profile.

The reader takes archives of any writer: records of every type come out (payload: the body of an HTTP block, else the
block), ids other than this writer's URNs have a null page_id, digests may be missing, or of several algorithms
in base32 or hexadecimal, and a chunked body whose digest is of its content is given as its content.

Defined results. Very long payloads are written and read whole, up to the 2 GB that a Spark value can hold. Null html: empty payload. Null url: the record's own URN is its target. Null
page_id: a response that nothing refers to, or a revisit of the smallest id. Repeated rows of that
smallest id: each a response. Empty table: no archive, empty result. Control characters and spaces
in urls are percent-encoded. Other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
URN = "urn:page:"
CHUNK, BATCH_BYTES = 1 << 16, 8 << 20
SAFE = "".join(chr(c) for c in range(33, 127))
#: Bytes of a header at most, and the digest algorithms that are checked.
MOST_HEADER, KNOWN_DIGESTS = 1 << 20, ("md5", "sha1", "sha256", "sha512")
RECORDS = "archive string, byte_offset long, record_id string, page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long, refers_to_id string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()  # noqa: S324  the format's own digest


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, first_id: int | None, first_url: str | None, revisit: bool) -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = f"{URN}{'' if page_id is None else page_id}"
    head = {"WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{name}>", "WARC-Date": DATE, "WARC-Target-URI": quote(url, safe=SAFE) if url else name}
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<{URN}{first_id}>", "WARC-Refers-To-Target-URI": quote(first_url, safe=SAFE) if first_url else f"{URN}{first_id}", "WARC-Refers-To-Date": DATE}
    head |= {"WARC-Payload-Digest": f"sha1:{payload_digest}", "WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode()) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


class Counted:
    """A byte source that knows how much was read; streams need not be seekable."""

    def __init__(self, source: BinaryIO) -> None:
        self.source, self.n = source, 0

    def read(self, size: int) -> bytes:
        got = self.source.read(size)
        self.n += len(got)
        return got


class Member:
    """One gzip member, inflated as it is read."""

    def __init__(self, source: Counted, rest: bytes) -> None:
        self.source, self.raw, self.z, self.out = source, rest, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.z.eof:
            return False
        if not self.raw:
            self.raw = self.source.read(CHUNK)
            if not self.raw:
                raise ValueError("the archive ends within a gzip member")
        try:
            self.out += self.z.decompress(self.raw, CHUNK)
        except zlib.error as e:
            raise ValueError(f"not a gzip member: {e}") from e
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (at := self.out.find(mark, seen)) < 0:
            seen = max(0, len(self.out) - len(mark) + 1)
            if len(self.out) > MOST_HEADER or not self._more():
                raise ValueError("the header does not end")
        got = bytes(self.out[: at + len(mark)])
        del self.out[: at + len(mark)]
        return got

    def block(self, n: int) -> Iterator[bytes]:
        """The next n bytes, as they are inflated."""
        while n:
            if not self.out and not self._more():
                raise ValueError("the block is shorter than its Content-Length")
            got = bytes(self.out[:n])
            del self.out[:n]
            n -= len(got)
            if got:
                yield got

    def close(self) -> bytes:
        """Inflate what is left, which must be the record's end; the bytes after the member."""
        while self._more():
            if len(self.out) > 4:
                break
        if bytes(self.out) != b"\r\n\r\n":
            raise ValueError("the block is longer than its Content-Length")
        return self.raw


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a header block, names in lower case; a line that begins with white space continues the last."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out.setdefault(last, value.strip())
    return out


class Labelled:
    """A digest field, `algorithm:value`, checked against bytes as they pass. Values are base32 or hexadecimal;
    what names no algorithm known here is not checked."""

    def __init__(self, field: str | None) -> None:
        name, _, self.value = (field or "").strip().partition(":")
        name = name.lower().replace("-", "")
        self.hash = hashlib.new(name) if self.value and name in KNOWN_DIGESTS else None

    def update(self, data: bytes) -> None:
        if self.hash is not None:
            self.hash.update(data)

    def fits(self) -> bool:
        if self.hash is None:
            return True
        got = self.hash.digest()
        return self.value.lower() == got.hex() or self.value.upper().rstrip("=") == base64.b32encode(got).decode().rstrip("=")


def _unchunked(data: bytes) -> bytes | None:
    """The content of an HTTP/1.1 chunked body; None if it is not one."""
    out, at = bytearray(), 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            n = int(data[at:end].partition(b";")[0], 16)
        except ValueError:
            return None
        if n == 0:
            return bytes(out)
        if n < 0 or end + 2 + n > len(data):
            return None
        out += data[end + 2 : end + 2 + n]
        at = end + 4 + n
    return None


def _own_id(field: str | None) -> int | None:
    """The page id in one of this writer's URNs; other ids, and none, are null."""
    name = (field or "").strip().strip("<>")
    number = name.removeprefix(URN)
    return int(number) if name != number and number.lstrip("-").isdecimal() and number.isascii() else None


def _block(m: Member, f: dict[str, str], name: str) -> tuple[bytes, int, Labelled]:
    """(payload, its length by the block's own framing, the payload's digest field) of the block that m holds.
    Digests are fed as the bytes arrive; the payload, which is the result, is all that is kept of the block."""
    whole, part = Labelled(f.get("warc-block-digest")), Labelled(f.get("warc-payload-digest"))
    http = f.get("content-type", "").partition(";")[0].strip().lower() == "application/http"
    head, payload = bytearray(), bytearray()
    inside = not http
    for data in m.block(int(f["content-length"])):
        whole.update(data)
        if not inside:
            seen = max(0, len(head) - 3)
            head += data
            at = head.find(b"\r\n\r\n", seen)
            if at < 0:
                continue
            inside, data = True, bytes(head[at + 4 :])
            del head[at + 4 :]
        part.update(data)
        payload += data
    if not whole.fits():
        raise ValueError(f"{name}: the block's digest is another")
    said = _fields(bytes(head)) if http else {}
    if f["warc-type"] == "revisit":  # its block holds no payload: neither length nor digest is of these bytes
        n = said.get("content-length", "")
        return b"", int(n) if n.isdecimal() else len(payload), part
    if not part.fits():
        chunked = _unchunked(bytes(payload)) if said.get("transfer-encoding", "").lower() == "chunked" else None
        again = Labelled(f.get("warc-payload-digest"))
        again.update(chunked or b"")
        if chunked is None or not again.fits():
            raise ValueError(f"{name}: the payload's digest is another")
        payload = bytearray(chunked)
    return bytes(payload), len(payload), part


def read_records(source: BinaryIO) -> Iterator[tuple]:
    """(byte offset, record id, page_id, url, type, payload or None, payload bytes, payload digest, refers_to,
    refers_to_id) of each record in order, of any type and writer. Raises ValueError at a broken frame or digest."""
    counted = Counted(source)
    rest = counted.read(CHUNK)
    while rest:
        begin = counted.n - len(rest)
        m = Member(counted, rest)
        head = m.until(b"\r\n\r\n")
        if not head.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        f = _fields(head)
        name, kind, size = f.get("warc-record-id", ""), f.get("warc-type", ""), f.get("content-length", "")
        if not kind or not size.isdecimal():
            raise ValueError(f"{name or begin}: a record without type or length")
        payload, n, want = _block(m, f, name)
        rest = m.close() or counted.read(CHUNK)
        refers = f.get("warc-refers-to")
        url = f.get("warc-target-uri")
        yield begin, name.strip("<>") or None, _own_id(name), url.strip("<>") if url else None, kind, None if kind == "revisit" else payload, n, want.value or None, _own_id(refers), refers.strip("<>") if refers else None


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        name = f"{folder}/part-{ctx.partitionId():05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        system, path = open_fs(name)
        out, n, size = None, 0, 0
        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    out = system.open_output_stream(path, compression=None)  # members are compressed here, one a record
                data = record(r["page_id"], r["url"], r["payload"], base64.b32encode(bytes.fromhex(r["sha1"])).decode(), r["first_id"], r["first_url"], r["revisit"])
                out.write(data)
                n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "records": pa.array([n], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write pages(page_id, url, html); the manifest (archive, records, bytes)."""
    spark = pages.sparkSession
    C.ship(spark)
    system, path = open_fs(folder)
    system.create_dir(path, recursive=True)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    p = p.withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long")})
    # ids and digests only: the payloads are not needed to tell which copies there are
    slim = p.where(F.col("n") >= min_revisit_bytes).select("page_id", "url", "sha1", "n")
    copies = slim.groupBy("sha1", "n").agg(F.count("*").alias("rows"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
    copies = C.materialize(copies.where("rows > 1 and first is not null").select("sha1", "n", "first"), f"{folder}/copies")
    p = p.join(copies, ["sha1", "n"], "left").withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    p = p.select("page_id", "url", "payload", "sha1", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), "revisit")
    return C.materialize(p.mapInArrow(_writer(folder), "archive string, records long, bytes long"), f"{folder}/manifest")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in RECORDS.split(", ")]
    for b in batches:
        for archive in b.column(0).to_pylist():
            system, path = open_fs(archive)
            rows, held = [], 0
            with system.open_input_stream(path, compression=None) as f:
                for x in read_records(f):
                    rows.append((archive, *x))
                    held += len(x[5] or b"")
                    if held >= BATCH_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records (see RECORDS) of the archives named in the column archive, one task for a few archives."""
    C.ship(archives.sparkSession)
    names = archives.select("archive")
    return names.repartition(max(1, archives.count()), "archive").mapInArrow(_reader, RECORDS)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.workspace(spark, "warc")
    records = read_archives(write_archives(C.read(spark, sf_dir, "pages"), folder))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h)::BIGINT AS n, sha1(h) AS s FROM p),
f AS (SELECT s, n, min(page_id) AS first FROM d GROUP BY s, n),
hexa AS (SELECT page_id, n, first, s, list_transform(range(0, 160), lambda i: ((instr('0123456789abcdef', s[(i // 4 + 1)::INT]) - 1) >> (3 - i % 4)::INT) & 1) AS bits FROM d JOIN f USING (s, n))
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(1 + 16 * bits[(5 * k + 1)::INT] + 8 * bits[(5 * k + 2)::INT] + 4 * bits[(5 * k + 3)::INT] + 2 * bits[(5 * k + 4)::INT] + bits[(5 * k + 5)::INT])::INT]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM hexa
"""
