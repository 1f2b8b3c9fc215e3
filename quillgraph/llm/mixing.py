"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target of words (weights share a budget; no target goes
above ``max_repeats`` times its source, the excess is shared again). A
document's expected copies are ``lambda = min(max_repeats, c * x)`` with its
importance x and the c at which a source's expected words are its target; the
query's importance is the number of binary digits of the document's size, so
longer documents are likelier. ``floor(lambda)`` copies are certain. For one
more copy, with inclusion probability p the fraction left, documents of a
source are ranked by ``(u / (1 - u)) / (p / (1 - p))``, u being a hash of the
seed and doc_id, and the sample of fixed size, in words, is the prefix of that
ranking that fits what the target leaves. What the prefix falls short by is
made up further down the ranking: up to ``FILLS - 1`` times the next document
that still fits, and at last the one that brings the sum nearest to the target,
the earliest of equally near ones.

The prefix is found without ranking a source in one task: the ranks fall into
buckets in proportion to the source's rows, buckets are summed, and only the
one that holds the cut is ordered. c is found from sums by importance, of which
there are at most ``LEVELS`` a source: an importance is rounded to the nearest
of as many steps of an eighth of a power of two (whole numbers up to 16 are
kept as they are).

Defined cases: a null text has size 0; null is a source of its own, after all
others; a null doc_id hashes as ``null``; rows of one source with the same
doc_id and rank are taken or left together; a source without words has target 0 and
copies 0; an importance that is null or not above 0 counts as the least; an empty
table gives no rows; more columns stay with ``mixed_rows``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.storage import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
BUCKET_ROWS = 5000
FILLS = 8
LEVELS = 257
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """52 bits of an MD5 as a number in (0, 1)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def digits(size: Column) -> Column:
    """The number of binary digits of a size: the query's importance."""
    return F.length(F.bin(size))


def level(importance: Column) -> Column:
    """An importance as one of ``LEVELS`` values, from 2^-16 to 2^16."""
    steps = F.round(F.log2(importance) * 8)
    rounded = F.pow(F.lit(2.0), F.least(F.greatest(steps, F.lit(-128.0)), F.lit(128.0)) / 8)
    whole = (importance == F.floor(importance)) & importance.between(1, 16)
    return F.when(whole, importance).when(importance > 0, rounded).otherwise(F.lit(2.0**-16)).cast("double")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, rows, target, c: one row per source; the windows see at most LEVELS rows of a source."""
    levels = sizes.groupBy("source", "x").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    levels = materialize(levels, "mix-levels")
    per = levels.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("rows").alias("rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * max_repeats)
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(everything)).withColumn("all_w", F.sum("w").over(everything))
    share = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0))
    )
    per = per.withColumn("capped", F.col("cap") <= F.col("w") * share)
    free = F.try_divide(
        F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0)),
        F.col("all_w") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("w"))).over(everything), F.lit(0)),
    )
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * free)
    per = per.select("source", "source_size", "rows", target.alias("target"))
    return _join(per, _rates(_join(levels.drop("rows"), per.select("source", "target")), max_repeats))


def _rates(levels: DataFrame, max_repeats: int) -> DataFrame:
    """source, c: the most important levels are taken max_repeats times while the rest's share would exceed that."""
    above = Window.partitionBy("source").orderBy(F.col("x").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy(F.col("x").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.col("target") - max_repeats * F.coalesce(F.sum("words").over(above), F.lit(0))
    own = F.try_divide(left, F.sum(F.col("words") * F.col("x")).over(below))
    rows = levels.withColumn("rate", own).withColumn("open", F.col("x") * F.col("rate") < max_repeats)
    # the first open level's rate holds for it and all below; where none is open, everything is taken max_repeats times
    return rows.groupBy("source").agg(F.max_by("rate", F.when(F.col("open"), F.col("x"))).alias("c"))


def _join(left: DataFrame, per_source: DataFrame, how: str = "inner") -> DataFrame:
    """Join on the source, null with null."""
    right = per_source.withColumnRenamed("source", "_source")
    return left.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _ranked(sizes: DataFrame, per_source: DataFrame, max_repeats: int) -> DataFrame:
    most = F.lit(float(max_repeats))
    rate = F.when(F.col("source_size") > 0, F.coalesce(F.least(most, F.col("c") * F.col("x")), most)).otherwise(0.0)
    rows = _join(sizes, per_source).withColumn("rate", rate).withColumn("sure", F.floor("rate"))
    p = F.col("rate") - F.col("sure")
    odds = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    return rows.withColumn("rank", F.when((p > 0) & (F.col("size") > 0), odds)).withColumn(
        "bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * (F.floor(F.col("rows") / BUCKET_ROWS) + 1))
    )


def cuts(sizes: DataFrame, per_source: DataFrame, max_repeats: int = MAX_REPEATS, fills: int = FILLS) -> DataFrame:
    """Per source its target and where its sample ends: last rank and doc_id taken, and the documents that fill the rest."""
    rows = _ranked(sizes, per_source, max_repeats)
    ranked = rows.filter(F.col("rank").isNotNull())
    sure = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("sure")).alias("sure_words"))
    room = _join(per_source, sure).withColumn("room", F.col("target") - F.col("sure_words"))
    room = room.select("source", "source_size", "rows", "c", "target", "room")
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("upto", F.sum("words").over(by_bucket))
    sums = _join(sums, room.select("source", "room"))
    # the cut lies in the first bucket that goes beyond the room; where none does, everything is taken
    cut = sums.filter(F.col("upto") > F.col("room")).groupBy("source").agg(
        F.min("bucket").alias("cut_bucket"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("below")
    )
    room = materialize(_join(room, cut, "left"), "mix-room")
    edge = _join(ranked.select("source", "bucket", "rank", "doc_id", "size"), room.select("source", "room", "cut_bucket", "below"))
    edge = edge.filter(F.col("bucket") == F.col("cut_bucket"))
    order = Window.partitionBy("source").orderBy("rank", F.col("doc_id").asc_nulls_first())
    edge = edge.withColumn("upto", F.col("below") + F.sum("size").over(order)).filter(F.col("upto") <= F.col("room"))
    last = edge.groupBy("source").agg(
        F.max(F.struct("rank", "doc_id")).alias("last"), F.max("upto").alias("reached")
    )
    state = _join(room, last, "left").withColumn("gap", F.col("room") - F.coalesce("reached", "below"))
    state = state.withColumn("filled", F.array().cast("array<struct<rank:double,doc_id:bigint>>"))
    state = materialize(state, "mix-cuts")
    # what the fills choose from: the documents after the prefix that are no larger than twice the gap
    spare = _join(ranked.select("source", "bucket", "rank", "doc_id", "size"), state.select("source", "cut_bucket", "last", "gap"))
    spare = spare.filter(F.col("cut_bucket").isNotNull() & ~_in_prefix() & (F.col("size") < 2 * F.col("gap")))
    spare = materialize(spare.select("source", "rank", "doc_id", "size"), "mix-spare")
    for left in reversed(range(fills)):
        here = F.struct("rank", "doc_id")
        rows = _join(spare, state.select("source", "gap", F.get("filled", F.size("filled") - 1).alias("at")))
        rows = rows.filter(F.col("at").isNull() | (here > F.col("at")))
        rows = rows.filter(F.col("size") <= F.col("gap") if left else F.abs(F.col("size") - F.col("gap")) < F.col("gap"))
        off = F.lit(0) if left else F.abs(F.col("size") - F.col("gap"))
        best = rows.groupBy("source").agg(F.min(F.struct(off.alias("off"), "rank", "doc_id", "size")).alias("best"))
        state = _join(state, best, "left")
        picked = F.array_append("filled", F.struct("best.rank", "best.doc_id"))
        state = state.withColumn("filled", F.when(F.col("best").isNull(), F.col("filled")).otherwise(picked))
        state = materialize(state.withColumn("gap", F.col("gap") - F.coalesce("best.size", F.lit(0))).drop("best"), "mix-cuts")
    return state


def _in_prefix() -> Column:
    here = F.struct("rank", "doc_id")
    return F.col("cut_bucket").isNull() | (F.col("bucket") < F.col("cut_bucket")) | (
        (F.col("bucket") == F.col("cut_bucket")) & F.coalesce(here <= F.col("last"), F.lit(False))
    )


def _in_fill() -> Column:
    return F.exists("filled", lambda f: (f["rank"] == F.col("rank")) & f["doc_id"].eqNullSafe(F.col("doc_id")))


def mix(docs: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS, seed=17, importance: Column | None = None, keep_rows: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (how often the mix takes the row) of every row.

    ``importance`` is a column of ``docs``, the digits of the size where none is given.

    All decisions are made on a narrow table. With ``keep_rows`` the texts are
    read once more and each whole row comes along as the struct ``_row``.
    """
    size = word_count(F.col("text"))
    x = level((importance if importance is not None else digits(size)).cast("double"))
    sizing = [size.alias("size"), x.alias("x"), uniform(F.col("doc_id"), seed).alias("u")]
    sizes = materialize(docs.select("doc_id", "source", *sizing), "mix-sizes")
    per_source = materialize(targets(sizes, weights, max_repeats), "mix-targets")
    state = cuts(sizes, per_source, max_repeats)
    own = state.select("source", "source_size", "rows", "c", "target", "cut_bucket", "last", "filled")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "source", *sizing) if keep_rows else sizes
    rows = _ranked(rows, own, max_repeats)
    more = F.col("rank").isNotNull() & (_in_prefix() | _in_fill())
    rows = rows.withColumn("copies", F.col("sure") + F.when(more, 1).otherwise(0))
    return rows.select(*(["_row"] if keep_rows else []), "doc_id", "source", "size", "source_size", "target", "copies")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    rows = mix(docs, keep_rows=True, **options)
    return rows.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
