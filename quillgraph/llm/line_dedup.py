"""Fuzzy line dedup by MinHash, in DataFrame functions only.

A line's set is its 8-character shingles (of UTF-16 units). Shingles are
exploded below a hash aggregate on the line's 64-bit hash, which merges
repeated lines before its shuffle; neither a shingle nor a text moves. The last
four bits of a shingle's hash put it into one of 16 parts, and the least hash
of each part is a minimum (MinHash by one permutation). An empty part takes
that of the next in its group of four that has one. The 16 minima are laid
out as the points of the affine plane over four elements, and each of its 20
lines of four points is a band. Whichever minima agree, six or fewer that
differ leave a band whole, so 16 minima give lines of Jaccard similarity 0.8
a common bucket with probability 0.995 (400 shingles) to 1 (under 12), by
simulation; a group without shingles in both lines agrees.

A bucket of two is its pair. In a larger one each member is compared with the
bucket's hub, the member whose buckets are largest, and the links found are
joined into components. Where a bucket's other members still lie in several
components, those of different ones are compared by a join that has the exact
Jaccard similarity as its condition: rows come out for links only, in blocks of
``BLOCK`` members, and a pair is compared in the first bucket it shares. So a
pair of a bucket is either compared exactly or already connected; nothing is
estimated or capped. Work grows with the members that no link connects, not
with groups of copies.

Lines of under eight units have no shingle; equal ones are one line, as equal
lines of any length are. Of each component the first occurrence (by doc_id,
nulls last, then the text's hash and the line's number) is kept and all others
go. Empty lines have no content and stay.

Joins by line or bucket broadcast the at most ``HOT`` keys that hold the
``HOT``-th part of the rows each, and shuffle the others; a table counted to
hold at most ``SMALL`` rows is broadcast whole.

Defined cases: a null text is one empty line; identical rows (doc_id and text)
keep the same lines; very long lines are shingled whole; an empty table gives
no rows; more columns, whatever their names, stay with ``dedupe_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.components import connected_components
from quillgraph.llm.storage import drop_table, materialize, spread_join

SHINGLE = 8
SIDE = 4
MINIMA = SIDE * SIDE
SIMILARITY = 0.8
BLOCK = 1024
WORDS = 32
LAST = (1 << 63) - 1


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no, line, h: one row per line of every text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line"))
    return rows.withColumn("h", F.xxhash64("line"))


def _units(line: Column) -> Column:
    return F.encode(line, "UTF-16BE")


def _times(a: int, b: int) -> int:
    """The product in the field of four elements (polynomials over bits, modulo x^2 + x + 1)."""
    out = (a if b & 1 else 0) ^ (a << 1 if b & 2 else 0)
    return out ^ 0b111 if out & 4 else out


def bands() -> list[list[int]]:
    """The lines of the plane of SIDE x SIDE points: all of one x, and y = s x + c of each slope s."""
    upright = [[x * SIDE + y for y in range(SIDE)] for x in range(SIDE)]
    return upright + [[x * SIDE + (_times(s, x) ^ c) for x in range(SIDE)] for s in range(SIDE) for c in range(SIDE)]


def signatures(lines: DataFrame) -> DataFrame:
    """h and its minima (m0, ..., their upper halves), one row per distinct line with a shingle."""
    cells = lines.select("h", _units(F.col("line")).alias("units")).filter(F.octet_length("units") >= 2 * SHINGLE)
    cells = cells.select("h", "units", F.explode(F.sequence(F.lit(0), (F.octet_length("units") / 2 - SHINGLE).cast("int"))).alias("i"))
    cells = cells.select("h", F.xxhash64(F.substring("units", F.col("i") * 2 + 1, F.lit(2 * SHINGLE))).alias("v"))
    # by FILTER a shingle updates the one minimum of its part
    mins = cells.groupBy("h").agg(*(F.expr(f"min(v) FILTER (WHERE (v & {MINIMA - 1}) = {j})").alias(f"m{j}") for j in range(MINIMA)))
    for near in (1, 2):
        mins = mins.select("h", *(F.coalesce(f"m{j}", f"m{j ^ near}").alias(f"m{j}") for j in range(MINIMA)))
    return mins.select("h", *(F.shiftright(f"m{j}", 32).cast("int").alias(f"m{j}") for j in range(MINIMA)))


def bucket_keys(signed: DataFrame) -> DataFrame:
    """h, key: one row per bucket of a line; a band of one empty group is none."""
    keys = [F.xxhash64(F.lit(b), *(f"m{j}" for j in band)) for b, band in enumerate(bands())]
    keys[:SIDE] = [F.when(F.col(f"m{x * SIDE}").isNotNull(), key) for x, key in enumerate(keys[:SIDE])]
    return signed.select("h", F.explode(F.array(*keys)).alias("key")).filter("key IS NOT NULL")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def buckets(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): (a, b) of the buckets of two lines; key, n, h of all larger ones."""
    cells = bucket_keys(signed)
    shared = cells.groupBy("key").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high")).filter("n > 1")
    shared = materialize(shared, "lines-buckets")
    members = spread_join(cells, shared.filter("n > 2").select("key", "n", F.col("n").alias("size")), "key", "size")
    return shared.filter("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")), materialize(members, "lines-members")


def hub_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, others): (a, b) of each member of a bucket with the member that meets most lines in all its buckets; the members but these."""
    mass = materialize(members.groupBy("h").agg(F.sum("n").alias("mass"), F.count("*").alias("times")), "lines-mass")
    weighed = spread_join(members, mass, "h", "times")
    hubs = materialize(weighed.groupBy("key").agg(F.max_by("h", "mass").alias("hub"), F.count("*").alias("size")), "lines-hubs")
    others = spread_join(members, hubs, "key", "size").filter("h <> hub")
    return others.select(*_pair(F.col("h"), F.col("hub"))), others.drop("hub")


def _shingles(line: Column) -> Column:
    """The hashes, repeats included; the outer transform binds the units, which a lambda would else make anew for each shingle."""
    spots = lambda u: F.sequence(F.lit(1), F.octet_length(u) - (2 * SHINGLE - 1), F.lit(2))
    hashes = F.transform(F.array(_units(line)), lambda u: F.transform(spots(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(2 * SHINGLE)))))
    return F.get(hashes, F.lit(0))


def _similar(n: Column, m: Column, a: Column, b: Column, similarity: float) -> Column:
    """Whether lines a and b, of n and m distinct shingles, have at least this exact Jaccard similarity.

    Counts that rule it out are met first. Each line's hashes are named once, as
    a condition makes them anew at every place of use.
    """
    common = F.size(F.array_intersect(_shingles(a), _shingles(b)))
    sizes = F.least(n, m) >= similarity * F.greatest(n, m) - F.lit(1e-9)
    return F.when(sizes, common * (1 + similarity) >= similarity * (n + m) - F.lit(1e-9)).otherwise(False)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose lines have at least this exact Jaccard similarity of shingles."""
    left, right = (texts.withColumnsRenamed({"h": c, "line": f"l{c}", "shingles": f"n{c}"}) for c in "ab")
    both = pairs.join(left, "a").join(right, "b")
    return both.filter(_similar(F.col("na"), F.col("nb"), F.col("la"), F.col("lb"), similarity)).select("a", "b")


def split_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, n, h, root, main, own of the buckets whose members (but the hubs) lie in different components.

    ``main`` tells the bucket's largest component; ``own`` lists the line's split
    buckets that come before this one (larger first). A bucket all of whose
    members share an earlier one has no pair of its own and is left out.
    """
    known = members.join(roots.select(F.col("node").alias("h"), "root"), "h", "left")
    known = materialize(known.select("key", "n", "h", F.coalesce("root", "h").alias("root")), "lines-known")
    parts = known.groupBy("key", "root").agg(F.count("*").alias("size")).groupBy("key")
    split = parts.agg(F.max_by("root", "size").alias("most"), F.count("*").alias("parts"), F.sum("size").alias("size")).filter("parts > 1")
    split = materialize(split.select("key", "most", "size", F.col("size").alias("left")), "lines-split")
    rows = spread_join(known, split, "key", "size")
    place = F.struct((-F.col("n")).alias("n"), "key")
    before = rows.groupBy("h").agg(F.collect_list(place).alias("places"))
    earlier = F.transform(F.filter("places", lambda p: p < place), lambda p: p["key"])
    rows = materialize(rows.join(before, "h").select("key", "n", "left", "h", "root", (F.col("root") == F.col("most")).alias("main"), earlier.alias("own")), "lines-split")
    within = rows.select("key", "left", F.explode("own").alias("k")).groupBy("key", "k").agg(F.count("*").alias("c"), F.max("left").alias("left")).filter("c = left")
    return rows.join(within.select("key").distinct(), "key", "left_anti")


def bitmaps(texts: DataFrame) -> DataFrame:
    """h and 64 * WORDS bits (w0, ...) of which each distinct shingle sets one."""
    cells = texts.select("h", _units(F.col("line")).alias("units"))
    cells = cells.select("h", "units", F.explode(F.sequence(F.lit(1), F.octet_length("units") - (2 * SHINGLE - 1), F.lit(2))).alias("i"))
    cells = cells.select("h", F.xxhash64(F.substring("units", F.col("i"), F.lit(2 * SHINGLE))).alias("v"))
    bits = "bit_or(shiftleft(1L, cast(v & 63 AS int))) FILTER (WHERE (shiftrightunsigned(v, 6) & {}) = {})"
    return cells.groupBy("h").agg(*(F.coalesce(F.expr(bits.format(WORDS - 1, w)), F.lit(0)).alias(f"w{w}") for w in range(WORDS)))


def other_links(split: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): the similar lines of different components that share a bucket.

    The members outside of a bucket's largest component are compared with all
    others. Bits that only one line has are at most as many as the shingles
    that only one has, so a pair with too many of them cannot be similar; the
    shingles of the others are made and compared within the join.
    """
    texts = texts.join(split.select("h").distinct(), "h", "left_semi")
    rows = split.join(materialize(texts.join(bitmaps(texts), "h"), "lines-bits"), "h").withColumn("blocks", F.ceil(F.col("left") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # 0 is of the largest component, 1 looks for others in this block, 2 in another block
    role = F.when(F.col("main"), 0).when(F.pmod("h", "blocks") == F.col("block"), 1).otherwise(2)
    words = [f"w{w}" for w in range(WORDS)]
    columns = ["h", "root", "role", "own", "shingles", "line", *words]
    # both sides use the same columns, so that they read one shuffle
    left = rows.withColumn("role", role).select("key", "block", *columns).repartition("key", "block")
    right = left.toDF("key", "block", *(f"{c}_b" for c in columns))
    apart = (F.col("role") == 1) & (F.col("root") != F.col("root_b")) & ((F.col("role_b") == 0) | (F.col("h") < F.col("h_b")))
    odd = F.lit(0)
    for w in words:
        odd = odd + F.bit_count(F.col(w).bitwiseXOR(F.col(f"{w}_b")))
    near = odd <= (F.col("shingles") + F.col("shingles_b")) * ((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    exact = _similar(F.col("shingles"), F.col("shingles_b"), F.col("line"), F.col("line_b"), similarity)
    found = F.when(apart & near, F.when(~F.arrays_overlap("own", "own_b"), exact).otherwise(False)).otherwise(False)
    both = left.hint("merge").join(right, (left["key"] == right["key"]) & (left["block"] == right["block"]) & found)
    return both.select(*_pair(F.col("h"), F.col("h_b")))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, line and shingles (how many distinct ones) of every line of ``wanted`` (h, unique); UTF-8, as units take twice the space."""
    lines = line_table(docs).select("h", "line")
    lines = spread_join(lines, materialize(wanted, "lines-wanted").withColumn("times", F.lit(1)), "h", "times")
    texts = lines.groupBy("h").agg(F.max("line").alias("line"))
    return materialize(texts.withColumn("shingles", F.size(F.array_distinct(_shingles(F.col("line"))))), "lines-texts")


def links(docs: DataFrame, signed: DataFrame) -> DataFrame:
    """(a, b): similar lines, by hash; they connect all similar lines that share a bucket. ``signed`` is a table that goes with its use."""
    twos, members = buckets(signed)
    drop_table(signed)
    pairs, others = hub_pairs(members)
    pairs = materialize(twos.unionByName(pairs).distinct(), "lines-pairs")
    texts = _texts(docs, pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct())
    near = materialize(verified(pairs, texts), "lines-near")
    split = materialize(split_members(others, connected_components(near)), "lines-split")
    return near if split.isEmpty() else near.unionByName(other_links(split, texts))


def line_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(occurrences, roots): every line's doc_id, text_hash, line_no, h, and h -> smallest h of its component."""
    seen = materialize(line_table(docs).withColumn("blank", F.col("line") == "").drop("line"), "lines-seen")
    signed = materialize(signatures(line_table(docs)), "lines-signed")
    roots = connected_components(links(docs, signed))
    return seen, roots.select(F.col("node").alias("h"), "root")


def dropped_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, line_no of every line that an earlier one stands for."""
    seen, roots = line_classes(docs)
    seen = seen.filter("NOT blank").drop("blank")
    times = seen.groupBy("h").agg(F.count("*").alias("times"))
    kinds = materialize(times.join(roots, "h", "left").withColumn("root", F.coalesce("root", "h")), "lines-kinds")
    many = kinds.groupBy("root").agg(F.sum("times").alias("n"), F.count("*").alias("size")).filter("n > 1")
    many = materialize(many.select("root", "size"), "lines-many")
    repeated = materialize(spread_join(kinds, many, "root", "size").select("h", "root", "times"), "lines-repeated")
    rows = spread_join(seen, repeated, "h", "times").drop("h")
    rows = materialize(rows.withColumn("d", F.coalesce("doc_id", F.lit(LAST))), "lines-rows")
    place = ["d", "text_hash", "line_no"]
    first = rows.groupBy("root").agg(F.min(F.struct(*place)).alias("first")).select("first.*")
    return rows.join(first, place, "left_anti").select("doc_id", "text_hash", "line_no").distinct()


def _gone(docs: DataFrame) -> DataFrame:
    """d, t, gone: the numbers of a text's dropped lines."""
    return dropped_lines(docs).groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def summary(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, dropped (line numbers) of every document row."""
    text, lists = F.coalesce("text", F.lit("")), _gone(docs)
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.size(F.split(text, "\n", -1)).cast("long").alias("n_lines"))
    rows = rows.join(lists, rows["doc_id"].eqNullSafe(lists["d"]) & (rows["text_hash"] == lists["t"]), "left")
    dropped = F.coalesce("gone", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size(dropped)).alias("n_kept"), dropped.alias("dropped"))


def dedupe_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the dropped lines; a document that keeps no line has an empty text."""
    lists, text = _gone(docs), F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64(text).alias("text_hash"))
    rows = rows.join(lists, rows["id"].eqNullSafe(lists["d"]) & (rows["text_hash"] == lists["t"]), "left")
    lines = F.filter(F.split(F.col("row")["text"], "\n", -1), lambda _, i: ~F.array_contains("gone", i))
    kept = F.when(F.col("gone").isNull(), F.col("row")["text"]).otherwise(F.array_join(lines, "\n"))
    return rows.select(*(kept.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
