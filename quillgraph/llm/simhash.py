"""SimHash near-dedup by covering locality-sensitive hashing.

A fingerprint's 64 bits come from the XXH64 of the 3-word shingles. Every bit
position has a code from 1 to 15, and mask v of the 15 masks keeps the
positions whose code has odd parity with v. Three differing positions span at
most three of the codes' four dimensions, so some v is even with all of them:
its mask drops all three, and the pair has the same key in that table. Every
pair within the radius thus meets, without exception. Each table keeps some
34 bits as its key.

Distinct fingerprints are dealt out by (table, key). Within a bucket the
members differ in the dropped bits only; a bucket's links are emitted as a
spanning forest, found by breadth-first search, and a bucket of over
``SEARCH`` members is first dealt out again by the same covering of its free
bits, which halves them each time. No bucket is capped and no pairs of a
bucket are listed.

``near_duplicates(similarity=...)``, the pipeline's form, links texts of at least
that Jaccard similarity of 5-word shingles too. Such texts differ in more bits
than a fingerprint can cover with selective keys, so they are met by MinHash:
``BANDS`` bands of ``ROWS`` minima, which two texts of similarity 0.8 all miss
with probability 2e-4, of 0.9 with 1e-7. Each bucket is searched by the exact
Jaccard similarity of whole shingle sets. The first ``FIRST`` bands come first;
of the others only buckets that are not yet in one component are searched.

Defined cases: a null text is empty; documents without words have fingerprint
zero and are linked; repeated rows share a component; a null doc_id never
names a component (a component of nulls only has id null); very long texts
are hashed whole; a text of fewer words than a shingle is one shingle; an empty table gives no rows; more columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.components import connected_components
from quillgraph.llm.storage import materialize

RADIUS = 3
SEED = 42
SHINGLE = 3
SEARCH = 16384
STEP = 1 << 16
SIMILAR_SHINGLE = 5
BANDS = 16
ROWS = 4
FIRST = 4
SMALL = 500_000
BITS = np.array([[v >> i & 1 for i in range(8)] for v in range(256)], np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit SimHash of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros((8, 8), np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for at in range(0, n, STEP):
        part = words[at : at + STEP + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle)), strict=False) if n > 1 or len(words) == shingle else [words]
        h = np.array([digest(join(r), SEED) for r in rows], np.uint64).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[byte] += np.bincount(h[:, byte], minlength=256) @ BITS
    set_bits = (ones.reshape(64) * 2 > n).astype(np.uint64)
    return int((set_bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def shingle_set(text: str | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    rows = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    return np.unique(np.fromiter((digest(join(r), SEED) for r in rows), np.uint64))


def _salts(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, (n, 1), np.uint64)


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key of each band's minima; none of an empty set."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    salts, least = _salts(bands * rows), np.full(bands * rows, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), 4096):
        x = (shingles[at : at + 4096] ^ salts) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
        least = np.minimum(least, x.min(axis=1))
    cells = least.reshape(bands, rows)
    return np.array([xxhash.xxh64_intdigest(c.tobytes(), b) for b, c in enumerate(cells)], np.uint64).view(np.int64)


def shingles_column(text: Column, shingle: int = SIMILAR_SHINGLE) -> Column:
    @F.pandas_udf("array<long>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, shingle).view(np.int64) for t in texts])

    return sets(text)


def bands_column(text: Column, shingle: int = SIMILAR_SHINGLE) -> Column:
    @F.pandas_udf("array<long>")
    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([band_keys(shingle_set(t, shingle)) for t in texts])

    return keys(text)


def fingerprint_column(text: Column) -> Column:
    """The fingerprint's bits as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))

    return fp(text)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row."""
    return docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp"))


def covering_masks(free: int = (1 << 64) - 1) -> list[int]:
    """15 masks over the positions in ``free``: any 3 positions are all outside at least one of them."""
    places = [i for i in range(64) if free >> i & 1]
    code = {p: 1 + (7 * k) % 15 for k, p in enumerate(places)}
    return [sum(1 << p for p in places if (code[p] & v).bit_count() & 1) for v in range(1, 16)]


def _search(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search."""
    edges, left = [], np.arange(len(fps))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]) <= RADIUS
            if near.any():
                found = left[near]
                edges += [(at, x) for x in found.tolist()]
                queue += found.tolist()
                left = left[~near]
    return edges


def forest(fps: np.ndarray, free: int, search: int = SEARCH) -> list[tuple[int, int]]:
    """Index pairs that connect what links connect among fingerprints that differ in the bits of ``free`` only."""
    if len(fps) <= search or free.bit_count() <= 8:
        return _search(fps)
    edges = []
    for mask in covering_masks(free):
        keys = fps & np.uint64(mask)
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        for group in np.split(order, cuts):
            if len(group) > 1:
                edges += [(int(group[a]), int(group[b])) for a, b in forest(fps[group], free & ~mask, search)]
    return _prune(edges, len(fps))


def _prune(edges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """The edges that first join two components."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in edges:
        if (ra := find(a)) != (rb := find(b)):
            root[ra] = rb
            kept.append((a, b))
    return kept


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): a forest in each bucket that connects all fingerprints within the radius of each other."""
    masks = covering_masks()
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    rows = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in signed))).alias("tab", "key"))
    rows = rows.repartition("tab", "key").sortWithinPartitions("tab", "key")

    def bucket(tab: int, fps: np.ndarray):
        free = ~masks[tab] & ((1 << 64) - 1)
        return [(fps[a], fps[b]) for a, b in forest(fps, free)]

    def pair_up(batches):
        def whole(t: np.ndarray, k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            starts = np.concatenate([[0], np.flatnonzero((np.diff(k) != 0) | (np.diff(t) != 0)) + 1])
            sizes = np.diff(np.append(starts, len(k)))
            two = starts[sizes == 2]
            a, b = f[two], f[two + 1]
            near = np.bitwise_count(a ^ b) <= RADIUS
            found = [(a[near], b[near])]
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if got := bucket(int(t[s]), f[s : s + n]):
                    found.append(tuple(np.array(x, np.uint64) for x in zip(*got, strict=True)))
            a, b = (np.concatenate([x[i] for x in found]).view(np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def columns(batch):
            return batch.column("tab").to_numpy(), batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)

        for pieces in whole_buckets(map(columns, batches), 2):
            yield whole(*map(np.concatenate, zip(*pieces, strict=True)))

    return rows.mapInArrow(pair_up, "a long, b long")


def whole_buckets(batches, keys: int):
    """Lists of consecutive pieces (tuples of arrays, sorted by the first ``keys`` of them) that end where a bucket ends; each row is copied once."""
    held = []
    for piece in batches:
        if not len(piece[0]):
            continue
        differs = np.zeros(len(piece[0]), bool)
        for k in piece[:keys]:
            differs[1:] |= k[1:] != k[:-1]
        differs[0] = bool(held) and any(old[-1] != new[0] for old, new in zip(held[-1][:keys], piece[:keys], strict=True))
        starts = np.flatnonzero(differs)
        if len(starts):  # the last bucket may go on in the next batch
            at = int(starts[-1])
            if at:
                held.append(tuple(c[:at] for c in piece))
            yield held
            held, piece = [], tuple(c[at:] for c in piece)
        held.append(piece)
    if held:
        yield held


def similar_forest(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of at least this Jaccard similarity, by breadth-first search."""
    size = np.array([len(x) for x in sets])
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    parts = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(int(flat.max()) + 1, np.int64)
    edges, left, starts = [], np.arange(len(sets)), np.concatenate([[0], np.cumsum(size)[:-1]])

    def keep(those: np.ndarray):
        if not those.any():
            return left[those], flat[:0], starts[:0]
        n = size[left]
        return left[those], flat[np.repeat(those, n)], np.concatenate([[0], np.cumsum(n[those])[:-1]])

    while len(left) > 1:
        queue = [int(left[0])]
        left, flat, starts = keep(np.arange(len(left)) > 0)
        while queue and len(left):
            at = queue.pop()
            mark[parts[at]] = 1
            common = np.add.reduceat(mark[flat], starts)
            mark[parts[at]] = 0
            near = common >= similarity * (size[at] + size[left] - common) - 1e-9
            if near.any():
                found = left[near].tolist()
                edges += [(at, x) for x in found]
                queue += found
                left, flat, starts = keep(~near)
    return edges


def similar_links(members: DataFrame, similarity: float) -> DataFrame:
    """(a, b), by fp: a forest in each bucket (key) of the members (fp, shingles) that connects all similar ones."""
    rows = members.select("key", "fp", "shingles").repartition("key").sortWithinPartitions("key")

    def pair_up(batches):
        def whole(key: np.ndarray, fp: np.ndarray, sets: list[np.ndarray]) -> pa.RecordBatch:
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            found = [(s + a, s + b) for s, e in zip(cuts, cuts[1:], strict=False) if e - s > 1 for a, b in similar_forest(sets[s:e], similarity)]
            ends = np.array(found, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fp[ends[:, i]]) for i in (0, 1)], names=["a", "b"])

        def columns(batch):
            column = batch.column("shingles")
            values, at = column.values.to_numpy(), column.offsets.to_numpy()
            sets = [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            return batch.column("key").to_numpy(), batch.column("fp").to_numpy(), sets

        for pieces in whole_buckets(map(columns, batches), 1):
            key, fp, sets = zip(*pieces, strict=True)
            yield whole(np.concatenate(key), np.concatenate(fp), [x for part in sets for x in part])

    return rows.mapInArrow(pair_up, "a long, b long")


def _hint(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def _split_buckets(cells: DataFrame) -> DataFrame:
    """The cells (key, root, ...) whose key occurs with several roots."""
    split = cells.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    return cells.join(_hint(materialize(split, "simhash-split")), "key")


def similar_roots(docs: DataFrame, prints: DataFrame, near: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(node, root) of the links ``near`` and those of similar texts together."""
    texts = prints.filter(F.size("keys") > 0).dropDuplicates(["text_hash"]).select("text_hash", "fp", F.posexplode("keys").alias("band", "key"))
    cells = materialize(_split_buckets(texts.withColumn("root", F.col("fp"))).drop("root"), "simhash-cells")
    wanted = materialize(cells.select("text_hash").distinct(), "simhash-wanted")
    held = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(_hint(wanted), "text_hash", "left_semi")
    held = held.groupBy("text_hash").agg(F.max("text").alias("text"))
    held = materialize(held.select("text_hash", shingles_column(F.col("text"), shingle).alias("shingles")), "simhash-sets")
    first = similar_links(cells.filter(F.col("band") < FIRST).join(held, "text_hash"), similarity)
    roots = connected_components(near.union(first))
    rest = cells.filter(F.col("band") >= FIRST).join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    more = materialize(similar_links(_split_buckets(rest).join(held, "text_hash"), similarity), "simhash-more")
    return roots if more.isEmpty() else connected_components(roots.toDF("a", "b").union(more))


def near_duplicates(docs: DataFrame, similarity: float | None = None, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """doc_id, fp, component_id, root of every row; components are those of the links, smallest doc_id first.

    ``root`` is the component's smallest fingerprint, which tells components apart where doc_ids repeat.

    With ``similarity``, texts of at least that Jaccard similarity of shingles are linked as well.
    """
    prints = fingerprints(docs)
    if similarity is not None:
        prints = docs.select("doc_id", fingerprint_column(F.col("text")).alias("fp"), F.xxhash64("text").alias("text_hash"), bands_column(F.col("text"), shingle).alias("keys"))
    prints = materialize(prints, "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    near = links(distinct)
    roots = connected_components(near) if similarity is None else similar_roots(docs, prints, near, similarity, shingle)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    named = named.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(named.join(names, "root").select("fp", "component_id", "root"), "simhash-classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "root")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, similarity: float | None = None, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """One row of each component: the one with the component's id.

    Rows whose doc_id is null or repeated are told apart by a number within
    their component; there are none in a well-formed table.
    """
    found = materialize(near_duplicates(docs, similarity, shingle), "simhash-found")
    repeated = found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id")
    drop = found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id").union(repeated).distinct()
    kept = docs.filter("doc_id IS NOT NULL").join(drop, "doc_id", "left_anti").select(docs.columns)
    if repeated.isEmpty():
        return kept
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row")["doc_id"].alias("id"), F.col("row")["text"].alias("text"))
    odd = rows.join(F.broadcast(repeated) if repeated.count() < 10000 else repeated, rows["id"].eqNullSafe(repeated["doc_id"]), "left_semi")
    odd = odd.withColumn("fp", fingerprint_column(F.col("text")))
    classes = found.select("fp", "root", F.col("component_id").alias("component")).distinct()
    first = Window.partitionBy("root").orderBy("text")
    odd = odd.join(classes, "fp").filter(F.col("id").eqNullSafe(F.col("component"))).withColumn("n", F.row_number().over(first)).filter("n = 1")
    return kept.union(odd.select(*(F.col("row")[c].alias(c) for c in docs.columns)))
