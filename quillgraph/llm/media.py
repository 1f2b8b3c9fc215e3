"""Media columns: content-addressed payloads in tar shards.

A text becomes a payload (UTF-8, padded with spaces to a positive multiple of
192 bytes) and the payload a greyscale PNG, 192 samples of 8 bits a row. Each
writing task packs its distinct images into tar shards of at most
``SHARD_BYTES``, named by the payload's SHA-256, and gives every row (digest,
shard, offset, length). Within a task an equal payload is stored once; copies
in other tasks point to their own task's shard, so the texts are never
shuffled. The metadata columns (width, height, bit depth, colour type) come from
range reads of the image's first 33 bytes; features from a range read of the
whole image, decoded and verified against that header and its address. Reading
tasks take some ``READ_BYTES`` of images each, so a large shard is read by
several.

Defined cases: a null text is empty (its payload is 192 spaces); a repeated
row points to the same bytes; texts of any length are stored whole; an empty
table gives no shard and no rows; more columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import AtomicFile, drop_table, materialize, new_dir, partition_id, resolve

WIDTH = 192
SHARD_BYTES = 128 << 20
READ_BYTES = 32 << 20
HEADER_BYTES = 33
SIGNATURE = b"\x89PNG\r\n\x1a\n"
REFS = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
PLACE = "shard string, offset long, length long, digest string"
META = f"{PLACE}, width int, height int, bit_depth int, color_type int"
STORED = (
    f"{META}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string"
)


def to_payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b" ")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # a filter byte of 0 leads each row
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw, level)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int, int]:
    """width, height, bit depth and colour type from an image's first 33 bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR" or zlib.crc32(first[12:29]) != struct.unpack(">I", first[29:33])[0]:
        raise ValueError("not the head of a PNG")
    return struct.unpack(">IIBB", first[16:26])


def decode_png(image: bytes) -> bytes:
    width, height, depth, color = png_header(image[:HEADER_BYTES])
    if (depth, color) != (8, 0):
        raise ValueError("not 8-bit greyscale")
    at, packed = HEADER_BYTES, []
    while at < len(image):
        n, kind = struct.unpack(">I4s", image[at : at + 8])
        if kind == b"IDAT":
            packed.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean sample, distinct values and an 8-bin histogram in permille, all whole numbers."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    bins = counts.reshape(8, 32).sum(axis=1) * 1000 // len(x)
    return f"h{len(x) // WIDTH}.m{int(x.sum(dtype=np.int64)) // len(x)}.d{int((counts > 0).sum())}." + "-".join(map(str, bins))


def store_media(docs: DataFrame, folder: str, level: int = 6, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every text's image; return a reference per row: doc_id, n_bytes, digest, shard, offset, length."""

    def write(batches):
        part, known, out, number = partition_id(), {}, None, 0
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    n, payload = to_payload(text)
                    address = hashlib.sha256(payload)
                    if (place := known.get(address.digest())) is None:
                        image = encode_png(payload, level)
                        if out and out.size + len(image) > shard_bytes:
                            out.write(bytes(1024))
                            out.__exit__(None, None, None)
                            out, number = None, number + 1
                        out = out or AtomicFile(f"{folder}/{part:06d}-{number:04d}.tar")
                        info = tarfile.TarInfo(f"{address.hexdigest()}.png")
                        info.size = len(image)
                        out.write(info.tobuf(tarfile.USTAR_FORMAT))
                        place = known[address.digest()] = (number, out.size, len(image))
                        out.write(image + bytes(-len(image) % 512))
                    rows.append((doc_id, n, address.hexdigest(), f"{folder}/{part:06d}-{place[0]:04d}.tar", place[1], place[2]))
                if rows:
                    yield _rows(rows, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), REFS)
        except BaseException as e:
            if out:
                out.__exit__(type(e), e, None)
            raise
        if out:
            out.write(bytes(1024))
            out.__exit__(None, None, None)

    return materialize(docs.select("doc_id", "text").mapInArrow(write, REFS), "media-refs")


def _rows(rows, types, ddl):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=_names(ddl))


def _names(ddl: str) -> list[str]:
    return [c.split()[0] for c in ddl.split(", ")]


def stored_images(refs: DataFrame) -> DataFrame:
    """The distinct stored images: shard, offset, length, digest."""
    return refs.select("shard", "offset", "length", "digest").distinct()


def _each_stored(images: DataFrame, read, types, ddl: str) -> DataFrame:
    """Run ``read(file, row)`` over images (PLACE first); what lies together in a shard is read in one task and in order."""
    total = images.agg(F.sum("length")).first()[0] or 0
    near = F.floor(F.col("offset") / READ_BYTES)
    places = images.repartition(total // READ_BYTES + 1, "shard", near).sortWithinPartitions("shard", "offset")

    def scan(batches):
        shard, raw = None, None
        for batch in batches:
            rows = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != shard:
                    if raw:
                        raw.close()
                    fs, path = resolve(row[0])
                    shard, raw = row[0], fs.open_input_file(path)
                rows.append((*row, *read(raw, row)))
            if rows:
                yield _rows(rows, types, ddl)
        if raw:
            raw.close()

    return places.mapInArrow(scan, ddl)


_PLACE_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string())
_META_TYPES = (*_PLACE_TYPES, *[pa.int32()] * 4)


def probe_media(images: DataFrame) -> DataFrame:
    """The images with their metadata columns, from range reads of the headers only."""

    def head(raw, row):
        return png_header(raw.read_at(min(HEADER_BYTES, row[2]), row[1]))

    return _each_stored(images.select(_names(PLACE)), head, _META_TYPES, META)


def read_media(probed: DataFrame) -> DataFrame:
    """Decode each image once, verify it against its metadata and address, and compute digests and features."""

    def whole(raw, row):
        _, offset, length, digest, width, height, depth, color = row
        image = raw.read_at(length, offset)
        payload = decode_png(image)
        sha = hashlib.sha256(payload).hexdigest()
        if sha != digest or len(payload) != width * height or (depth, color) != (8, 0):
            raise ValueError(f"the image at {row[0]}:{offset} is not what its address or header says")
        return len(payload), sha, zlib.crc32(payload[-16:]), length, hashlib.sha256(image).hexdigest(), feature_of(payload)

    types = (*_META_TYPES, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    return _each_stored(probed.select(_names(META)), whole, types, STORED)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store all texts and return per row its reference, its image's metadata, and what reading the stored bytes back gives."""
    refs = store_media(docs, new_dir(docs.sparkSession, "media"))
    images = materialize(stored_images(refs), "media-images")
    probed = materialize(probe_media(images), "media-probed")
    drop_table(images)
    found = materialize(read_media(probed), "media-read")
    drop_table(probed)
    return refs.join(found.drop("length", "digest"), ["shard", "offset"])
