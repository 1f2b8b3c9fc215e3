"""Token-id files: flat unsigned integers, 64-bit document offsets, memory-mapped.

The documents are range-partitioned by doc_id (nulls first, ties by text), and
each task writes flat little-endian files, a new set whenever one holds
``FILE_BYTES`` of ids, so that reading one back takes bounded memory: ``.bin``
(ids, 16 bits where the vocabulary allows, else 32), ``.idx`` (document offsets
in ids, int64, one more than documents) and ``.doc`` (doc_id, int64; null is the
smallest int64). A file's base in the whole stream is the prefix sum of the
manifest's counts, one row per file.

Where the tokenizer's own description says that it drops white space and cuts
lower-cased texts as ``CUT`` does (``cuts_by_word``), each distinct piece is
encoded once per worker and kept in a table of at most MEMO_PIECES (some 150 MB); the tests
compare with encoding whole texts, which any other tokenizer gets, and
``memo=False`` asks for.

Defined cases: a null text is empty and gets its end id alone; repeated rows
are separate documents; an empty table gives no files and no rows; more
columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import AtomicFile, materialize, new_dir, partition_id, process_cache, resolve

END_ID = 2
NULL_ID = -(1 << 63)
MEMO_PIECES = 1_000_000
WORDS_AT_ONCE = 200
FILE_BYTES = 256 << 20
MANIFEST = "part int, piece int, prefix string, docs long, ids long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Fixed: the pre-tokenizer's pattern for lower-cased texts without RARE characters, which no normaliser changes.
CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
RARE = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
#: Fixed: what a tokenizer's description must hold for CUT and the end of a word to be its own.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZER = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def cuts_by_word(path: str) -> bool:
    """Whether a tokenizer encodes a text as its pieces by CUT, one after another."""
    with open(path, encoding="utf-8") as raw:
        told = json.load(raw)
    model, parts = told["model"], [(told.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    plain = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")
    return plain and parts == [NORMALIZER, PRE_TOKENIZER] and all(t["content"].startswith("<|") for t in told["added_tokens"])


def load_tokenizer(path: str):
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    return process_cache(f"tokenizer_{path}", make)


def encode_texts(tokenizer, texts: list[str], width: int = 2, memo: dict[str, bytes] | None = None) -> list[bytes]:
    """The ids of each text, as ``width``-byte little-endian integers.

    With a ``memo``, a text of common characters is cut as the tokenizer's own
    pre-tokenizer cuts it (``CUT``), and each distinct piece is encoded once;
    any other text is encoded whole.
    """
    out: list = [None] * len(texts)
    pack = lambda ids: np.array(ids, f"<u{width}").tobytes()
    cut = {i: CUT.findall(t.lower()) for i, t in enumerate(texts) if memo is not None and "<|" not in t and not RARE.search(t)}
    whole = [i for i in range(len(texts)) if i not in cut]
    for i, e in zip(whole, tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False), strict=True):
        out[i] = pack(e.ids)
    if cut:
        new = list(set().union(*cut.values()).difference(memo))
        got = dict(zip(new, _encode_pieces(tokenizer, new, width), strict=True))
        if len(memo) < MEMO_PIECES:
            memo.update(got)
            got = {}
        held = memo.get
        for i, pieces in cut.items():  # once the table is full, rare pieces are kept for this call only
            out[i] = b"".join([held(p) or got[p] for p in pieces] if got else map(memo.__getitem__, pieces))
    return out


def _encode_pieces(tokenizer, pieces: list[str], width: int) -> list[bytes]:
    """WORDS_AT_ONCE words are encoded as one text, cut again after each word's last token; the other pieces one by one."""
    ends = process_cache(f"ends_{id(tokenizer)}", lambda: {i for t, i in tokenizer.get_vocab(False).items() if t.endswith("</w>")})
    words = [p for p in pieces if p.isalpha()]
    found: dict[str, bytes] = {}
    groups = [words[k : k + WORDS_AT_ONCE] for k in range(0, len(words), WORDS_AT_ONCE)]
    for group, told in zip(groups, tokenizer.encode_batch(list(map(" ".join, groups)), add_special_tokens=False), strict=True):
        flat = told.ids
        stops = [width * (k + 1) for k, i in enumerate(flat) if i in ends]
        if len(stops) == len(group):
            packed = np.array(flat, f"<u{width}").tobytes()
            found |= {w: packed[a:b] for w, a, b in zip(group, [0, *stops], stops, strict=False)}
    rest = [p for p in pieces if p not in found]
    for p, told in zip(rest, tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
        found[p] = np.array(told.ids, f"<u{width}").tobytes()
    return [found[p] for p in pieces]


def write_token_files(
    docs: DataFrame, vocab_file: str, folder: str, end_id: int = END_ID, width: int | None = None, memo: bool | None = None,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Encode all texts in ascending doc_id order into flat files; return the manifest with bases.

    ``memo`` asks for (or forbids) encoding by piece; a tokenizer that does not cut by word is never so encoded.
    """
    memo = memo is not False and cuts_by_word(vocab_file)
    if width is None:
        width = 2 if max(load_tokenizer(vocab_file).get_vocab_size(True) - 1, end_id) < 1 << 16 else 4
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )

    def write(batches):
        tokenizer, part = load_tokenizer(vocab_file), partition_id()
        known = process_cache(f"memo_{vocab_file}_{width}", dict) if memo else None
        last = np.array([end_id], f"<u{width}").tobytes()
        piece, files, offsets, keys = 0, None, [0], []

        def close():
            nonlocal piece, files, offsets, keys
            prefix = f"{folder}/{part:06d}-{piece:06d}"
            with AtomicFile(prefix + ".idx") as idx:
                idx.write(np.array(offsets, "<i8").tobytes())
            with AtomicFile(prefix + ".doc") as doc:
                doc.write(np.array([NULL_ID if k is None else k for k in keys], "<i8").tobytes())
            files.__exit__(None, None, None)
            columns = [[part], [piece], [prefix], [len(keys)], [offsets[-1]], [width]]
            types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
            piece, files, offsets, keys = piece + 1, None, [0], []
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "piece", "prefix", "docs", "ids", "width"]
            )

        try:
            for batch in batches:
                names, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for k in range(0, len(texts), 64):
                    for name, got in zip(names[k : k + 64], encode_texts(tokenizer, texts[k : k + 64], width, known), strict=False):
                        files = files or AtomicFile(f"{folder}/{part:06d}-{piece:06d}.bin")
                        files.write(got + last)
                        keys.append(name)
                        offsets.append(offsets[-1] + len(got) // width + 1)
                        if files.size >= file_bytes:
                            yield close()
            if files:
                yield close()
        except BaseException as e:
            if files:
                files.__exit__(type(e), e, None)
            raise

    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    parts = sorted(manifest.collect(), key=lambda r: (r.part, r.piece))  # one row per file
    bases = np.concatenate([[0], np.cumsum([r.ids for r in parts])]).tolist()
    rows = [(*r, int(b)) for r, b in zip(parts, bases, strict=False)]
    return docs.sparkSession.createDataFrame(rows, MANIFEST + ", base long")


def map_file(uri: str, dtype: str) -> np.ndarray:
    """A flat file as an array: memory-mapped where it is local, read through its store elsewhere."""
    fs, path = resolve(uri)
    if not fs.get_file_info(path).size:
        return np.zeros(0, dtype)
    if fs.type_name == "local":
        return np.memmap(path, dtype, mode="r")
    with fs.open_input_file(path) as raw:
        return np.frombuffer(raw.read(), dtype)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start (ids before it), n_tokens, ids_crc32 (of 32-bit little-endian ids)."""

    def read(batches):
        for batch in batches:
            for prefix, width, base in zip(*(batch.column(c).to_pylist() for c in ("prefix", "width", "base")), strict=True):
                ids, offsets, keys = map_file(prefix + ".bin", f"<u{width}"), map_file(prefix + ".idx", "<i8"), map_file(prefix + ".doc", "<i8")
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.asarray(keys), pa.int64(), mask=np.asarray(keys) == NULL_ID),
                        pa.array(base + np.asarray(offsets[:-1]), pa.int64()),
                        pa.array(np.diff(offsets), pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return manifest.repartition(max(1, manifest.count())).mapInArrow(read, READ)


def tokenize(docs: DataFrame, vocab_file: str, **options) -> DataFrame:
    """Write ``docs`` to token files in a new shared folder and return the manifest."""
    return write_token_files(docs, vocab_file, new_dir(docs.sparkSession, "tokens"), **options)
