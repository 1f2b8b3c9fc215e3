"""WARC writer and sequential reader.

One gzip member per record. The writer makes one archive per task in the
shared folder; the reader takes an archive as a stream: members are inflated
piece by piece, a record's end comes from its Content-Length, and block and
payload digests are verified while the bytes pass, so memory stays bounded by
one chunk and one header, whatever the payload's length.

Payloads of ``MIN_REVISIT`` bytes or more are stored once: the row with the
smallest page_id is the response, rows with an equal payload revisit it by its
record id and digest. Only digests that occur under more than one page meet in
that decision; it is a pre-aggregated minimum per digest and a join.

Defined cases: a null payload is empty; null page_ids order after all others
and stay null; rows that repeat the smallest page_id with the same payload are
responses too; a null or odd URL is written as ``urn:page:<page_id>`` or
percent-encoded; an empty table gives no archive and no rows; more columns are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import AtomicFile, materialize, new_dir, partition_id, resolve

MIN_REVISIT = 100
CHUNK = 1 << 16
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long"
RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "payload binary"
)


def plan_records(pages: DataFrame, payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to: which rows are stored and which revisit a stored one."""
    rows = pages.select("page_id", "url", F.coalesce(payload, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n", F.octet_length("payload"))
    shared = (
        rows.filter((F.col("n") >= min_revisit) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    )
    nulls = rows.filter((F.col("n") >= min_revisit) & F.col("page_id").isNull()).groupBy("digest").agg(F.count("*").alias("nulls"))
    shared = shared.join(nulls, "digest", "left").filter(F.col("copies") + F.coalesce("nulls", F.lit(0)) > 1)
    rows = rows.join(shared.select("digest", "first_id"), "digest", "left")
    is_copy = F.col("first_id").isNotNull() & (F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "payload", "digest", F.when(is_copy, F.col("first_id")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def _safe(url: str | None, page_id) -> str:
    if not url or not url.strip():
        return f"urn:page:{page_id}"
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in url)


def make_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record: WARC head, HTTP head, and the payload unless another record holds it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_safe(url, page_id)}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(planned: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Write the planned records, one archive per task; return the manifest (file, records, bytes)."""

    def write(batches):
        uri, n, out = f"{folder}/part-{partition_id():06d}.warc.gz", 0, None
        try:
            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    out = out or AtomicFile(uri)
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(packer.compress(make_record(*row)) + packer.flush())
                    n += 1
        except BaseException as e:
            if out:
                out.__exit__(type(e), e, None)
            raise
        if out:
            out.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"file": [uri], "records": [n], "bytes": [out.size]})

    return materialize(planned.mapInArrow(write, MANIFEST), "warc-manifest")


class _Stream:
    """The inflated bytes of one gzip member after another."""

    def __init__(self, raw):
        self.raw, self.rest, self.buf, self.z = raw, b"", bytearray(), None

    def begin(self) -> bool:
        """Start the next member; False at the end of the file."""
        self.rest = self.rest or self.raw.read(CHUNK)
        if not self.rest:
            return False
        self.z, self.buf = zlib.decompressobj(31), bytearray()
        return True

    def more(self) -> bool:
        if self.z.eof:
            return False
        data = self.rest or self.raw.read(CHUNK)
        if not data:
            raise ValueError("archive ends within a member")
        self.buf += self.z.decompress(data, CHUNK)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        start = 0
        while (at := self.buf.find(mark, start)) < 0:
            start = max(0, len(self.buf) - len(mark))
            if not self.more():
                raise ValueError("record head without an end")
        head = bytes(self.buf[:at])
        del self.buf[: at + len(mark)]
        return head

    def take(self, n: int):
        """Exactly n bytes, in pieces."""
        while n:
            if not self.buf and not self.more():
                raise ValueError("record shorter than its Content-Length")
            part = bytes(self.buf[:n])
            del self.buf[: len(part)]
            n -= len(part)
            if part:
                yield part

    def end(self) -> None:
        while self.more():
            pass
        if bytes(self.buf) != b"\r\n\r\n":
            raise ValueError("record not framed by its Content-Length")


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}


def read_records(raw, keep_payload: bool = True):
    """Yield (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of an open archive."""
    stream = _Stream(raw)
    while stream.begin():
        version, *lines = stream.until(b"\r\n\r\n").split(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"not a WARC record: {version[:20]!r}")
        head = _fields(lines)
        block, payload, body, kept, http, have = hashlib.sha256(), hashlib.sha256(), 0, [], b"", False
        for part in stream.take(int(head["content-length"])):
            block.update(part)
            if not have:
                http += part
                if (at := http.find(b"\r\n\r\n")) < 0:
                    continue
                part, http, have = http[at + 4 :], http[:at], True
            payload.update(part)
            body += len(part)
            if keep_payload:
                kept.append(part)
        stream.end()
        length = int(_fields(http.split(b"\r\n")[1:])["content-length"])
        digest = head["warc-payload-digest"].removeprefix("sha256:")
        if f"sha256:{block.hexdigest()}" != head["warc-block-digest"]:
            raise ValueError("block digest differs")
        if head["warc-type"] == "response" and (payload.hexdigest() != digest or body != length):
            raise ValueError("payload digest differs")
        page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
        yield (
            None if page is None else int(page), head["warc-target-uri"], length, digest, head["warc-type"],
            None if refers is None else int(refers), b"".join(kept) if keep_payload and head["warc-type"] == "response" else None,
        )


def read_archives(manifest: DataFrame, keep_payload: bool = True) -> DataFrame:
    """One row per record of the archives that the manifest names; archives are spread over the tasks."""

    def read(batches):
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        schema = pa.schema(list(zip(names, types, strict=True)))
        for batch in batches:
            for uri in batch.column("file").to_pylist():
                fs, path = resolve(uri)
                with fs.open_input_stream(path, compression=None) as raw:
                    rows, held = [], 0
                    for row in read_records(raw, keep_payload):
                        rows.append(row)
                        held += len(row[6] or b"") + 200
                        if held > 8 << 20:
                            yield _batch(rows, schema)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, schema)

    files = manifest.select("file")
    return files.repartition(max(1, files.count())).mapInArrow(read, RECORDS)


def _batch(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in a new shared folder and return the manifest."""
    return write_archives(plan_records(pages), new_dir(pages.sparkSession, "warc"))
