"""WARC archives: a writer with revisit records and a sequential reader.

One gzip member per record. The writer puts every partition's records into
files of its own, begun anew beyond a size; the names that a task returns are
those of its finished files, and only files named in the written list are read,
so that what a lost or repeated task left behind does no harm. The reader takes
whole files, one after another, decompresses member by member as bytes arrive,
frames blocks by Content-Length and verifies the digests.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayframe.llm.common import meet, new_path, written

#: Field for a url that has to be quoted to be a URI.
RAW_URL = "X-Unquoted-URL"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES, READ_BYTES, LEVEL = 64_000_000, 1 << 16, 4
#: All records of one run carry this time: the pages have none of their own.
DATE = "2024-01-01T00:00:00Z"


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``page_id, url, payload, digest, refers_to`` for every page; refers_to is null for responses.

    Of pages with equal payloads of at least ``min_bytes`` that with the largest page_id
    is the response. Rows that repeat its page_id are responses too, and rows without
    a page_id refer to it; where no page of a payload has an id, all are responses.
    Null html is an empty payload.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    narrow = own.filter(F.octet_length("payload") >= min_bytes).select("page_id", "digest")
    heads = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1")
    revisits = meet(narrow, written(heads, "payloads"), "digest", "n").filter("not (page_id <=> refers_to)")
    revisits = revisits.select(F.col("page_id").alias("of_id"), F.col("digest").alias("of_digest"), "refers_to").distinct()
    same = own["page_id"].eqNullSafe(revisits["of_id"]) & (own["digest"] == revisits["of_digest"])
    return own.join(revisits, same, "left").select("page_id", "url", "payload", "digest", "refers_to")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has the response's HTTP header and no payload.

    The record's id is the page's, so rows that repeat a page_id have records of equal ids. A url that isn't a
    valid URI is quoted, and is given as it is in a field of its own.
    """
    head = HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    safe = quote(url or "", safe=":/?#[]@!$&'()*+,;=~%", encoding="utf-8", errors="surrogatepass")
    b32 = lambda h: "sha1:" + base64.b32encode(h).decode()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", safe)] if url else []),
        *([(RAW_URL, base64.b64encode(url.encode("utf-8", "surrogatepass")).decode())] if url and safe != url else []),
        ("WARC-Payload-Digest", b32(bytes.fromhex(digest))),
        ("WARC-Block-Digest", b32(hashlib.sha1(block).digest())),
        *([("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", REVISIT_PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the rows of ``with_revisits`` below ``folder``, a shared place that pyarrow's file systems reach.

    Returns the written list of finished files: ``path, records, bytes``. An empty table gives no files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part, out, files = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None or files[-1][2] >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.warc.gz"
                    files.append([f"{folder}/{name}", 0, 0])
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = pack.compress(record(*row)) + pack.flush()
                out.write(member)
                files[-1][1] += 1
                files[-1][2] += len(member)
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64()), pa.array([f[2] for f in files], pa.int64())], names=["path", "records", "bytes"])

    return written(records.mapInArrow(run, "path string, records long, bytes long"), "archives")


class _Members:
    """The decompressed bytes of a file of gzip members, read bit by bit; a member ends with its record."""

    def __init__(self, stream):
        self.stream, self.unpack, self.rest, self.ready = stream, None, b"", b""

    def _more(self) -> bool:
        """Decompresses another piece; False at the end of the member."""
        while True:
            if self.unpack is None or self.unpack.eof:
                return False
            if not self.rest and not (chunk := self.stream.read(READ_BYTES)):
                raise ValueError("the archive ends within a record")
            self.rest = self.rest or chunk
            got = self.unpack.decompress(self.rest, READ_BYTES)
            self.rest = self.unpack.unused_data or self.unpack.unconsumed_tail
            if got:
                self.ready += got
                return True

    def next(self) -> bool:
        """Begins the next member; False at the end of the file."""
        if not self.rest:
            self.rest = self.stream.read(READ_BYTES)
        self.unpack, self.ready = zlib.decompressobj(31), b""
        return bool(self.rest)

    def until(self, mark: bytes) -> bytes:
        while mark not in self.ready:
            if not self._more():
                raise ValueError("a header isn't ended")
        head, _, self.ready = self.ready.partition(mark)
        return head

    def exactly(self, n: int) -> Iterator[bytes]:
        while n > 0:
            if not self.ready and not self._more():
                raise ValueError("a block is shorter than its Content-Length")
            piece, self.ready = self.ready[:n], self.ready[n:]
            n -= len(piece)
            yield piece

    def end(self) -> None:
        while self._more():
            pass
        if self.ready != b"\r\n\r\n":
            raise ValueError("a record doesn't end with its block")


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def read_file(stream) -> Iterator[dict]:
    """The records of one archive, in order: header fields, HTTP header fields, payload; digests verified."""
    members = _Members(stream)
    while members.next():
        fields = _fields(members.until(b"\r\n\r\n"))
        block_digest, pieces = hashlib.sha1(), []
        for piece in members.exactly(int(fields["Content-Length"])):
            block_digest.update(piece)
            pieces.append(piece)
        members.end()
        head, _, payload = b"".join(pieces).partition(b"\r\n\r\n")
        told = lambda k: base64.b32decode(fields[k].removeprefix("sha1:")).hex()
        if block_digest.hexdigest() != told("WARC-Block-Digest"):
            raise ValueError(f"{fields['WARC-Record-ID']}: the block isn't what its digest says")
        if fields["WARC-Type"] == "response" and hashlib.sha1(payload).hexdigest() != told("WARC-Payload-Digest"):
            raise ValueError(f"{fields['WARC-Record-ID']}: the payload isn't what its digest says")
        yield {"fields": fields, "http": _fields(head), "payload": payload, "payload_digest": told("WARC-Payload-Digest")}


def _page(urn: str | None) -> int | None:
    name = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read(files: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the listed archives. A revisit's payload is null, its size and digest are those it refers to.

    A file is read by one task as a stream, a record at a time. A damaged record is an error.
    """

    def rows(path: str) -> Iterator[tuple]:
        fs, place = pafs.FileSystem.from_uri(path)
        with fs.open_input_stream(place, compression=None) as stream:
            for r in read_file(stream):
                f = r["fields"]
                payload = r["payload"] if with_payload and f["WARC-Type"] == "response" else None
                url = base64.b64decode(f[RAW_URL]).decode("utf-8", "surrogatepass") if RAW_URL in f else f.get("WARC-Target-URI")
                yield _page(f["WARC-Record-ID"]), url, payload, int(r["http"]["Content-Length"]), r["payload_digest"], f["WARC-Type"], _page(f.get("WARC-Refers-To"))

    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                some, size = [], 0
                for row in rows(path):
                    some.append(row)
                    size += len(row[2] or b"")
                    if len(some) >= 2000 or size > 8_000_000:
                        yield batch_of(some)
                        some, size = [], 0
                if some:
                    yield batch_of(some)

    spark = files.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return files.select("path").repartition(tasks, "path").mapInArrow(run, SCHEMA)


def archive(pages: DataFrame, min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes all pages and returns the list of archives."""
    return write(with_revisits(pages, min_bytes), folder or new_path(pages.sparkSession, "warc"))
