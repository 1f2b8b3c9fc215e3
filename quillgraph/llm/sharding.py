"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows with equal texts form a group, and a group stays together unless it holds
more bytes, tokens or rows than one shard's share: only then it is cut, by
doc_id, into as few slices as fit a shard each, so that a group of a third of
all rows spreads. A group with more than ``1 / (shards * LARGE)`` of all bytes,
tokens or rows is packed on its own; there are at most ``3 * shards * LARGE`` of
those. All other groups are hashed into ``BUNDLES`` bundles. So the packer sees
a number of items that depends on the parameters, never on the table. Items go,
largest first, to the shard where the dot product of the item with the shard's
residual capacity is highest, and a bounded number of exchanges evens the rest;
that is all that runs on the driver.

Defined cases: a null text is its own group of size 1 byte (no bytes, plus 1)
and no tokens; rows that repeat a doc_id and a text share a slice; a text
longer than a shard's share is one item; an empty table gives no rows; more
columns stay with ``assign``, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.mixing import word_count
from quillgraph.llm.storage import materialize

SHARDS = 8
LARGE = 256
BUNDLES = 8192
SLOT_ROWS = 20000
POLISH = 200
#: What a deviation in bytes, tokens and rows counts when items are exchanged; the law is ``bytes``.
WEIGHTS = np.array([4.0, 1.0, 1.0])


def measures() -> dict[str, Column]:
    """What a row weighs: bytes (and 1), tokens, and the group it belongs to."""
    text = F.coalesce("text", F.lit(""))
    return {
        "size": (F.octet_length(text) + 1).cast("long"),
        "tokens": word_count(F.col("text")),
        "group_key": F.unhex(F.md5(F.concat(F.when(F.col("text").isNull(), F.lit("n")).otherwise(F.lit("t")), text))),
    }


def greedy(items: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard of each item, items as shares of a shard, loads): largest first, by dot product with residual capacity."""
    total = items.sum(axis=0, dtype=np.float64)
    share = items / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-share.max(axis=1), kind="stable"):
        best = out[i] = int(np.argmax(residual @ share[i]))
        residual[best] -= share[i]
    return out, share, 1 - residual


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of bytes, tokens, rows): the greedy placement, evened out by exchanges."""
    out, share, loads = greedy(items, shards)
    return _polish(share, out, loads)


def _polish(share: np.ndarray, out: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """Exchange items between the fullest and the emptiest shard, in bytes, while all measures together get more even."""
    order = np.argsort(share[:, 0], kind="stable")
    for _ in range(POLISH):
        high, low = int(np.argmax(loads[:, 0])), int(np.argmin(loads[:, 0]))
        mine, theirs = order[out[order] == high], order[out[order] == low]
        if high == low or not len(mine):
            break
        wanted = share[mine, 0] - (loads[high, 0] - loads[low, 0]) / 2
        pair = np.searchsorted(share[theirs, 0], wanted)
        other = np.concatenate([np.full(len(mine), -1), *(np.clip(pair + k, -1, len(theirs) - 1) for k in (-1, 0))])
        mine = np.tile(mine, 3)
        moved = share[mine] - np.where((other >= 0)[:, None], share[theirs[np.maximum(other, 0)]] if len(theirs) else 0.0, 0.0)
        before = ((loads[[high, low]] - 1) ** 2 * WEIGHTS).sum()
        after = ((loads[high] - moved - 1) ** 2 * WEIGHTS).sum(axis=1) + ((loads[low] + moved - 1) ** 2 * WEIGHTS).sum(axis=1)
        best = int(np.argmin(after))
        if after[best] >= before - 1e-12:
            break
        out[mine[best]] = low
        if other[best] >= 0:
            out[theirs[other[best]]] = high
        loads[high] -= moved[best]
        loads[low] += moved[best]
    return out


def plan(rows: DataFrame, shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """(large groups: group_key, first_unit, slices), (units: unit, shard); both of bounded size.

    ``rows`` has doc_id, size, tokens, group_key.
    """
    spark = rows.sparkSession
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    caps = [max(1, v or 0) / shards for v in total]
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n"))
    share = F.greatest(*(F.col(c) / F.lit(float(cap)) for c, cap in zip("btn", caps, strict=True)))
    heavy = groups.withColumn("share", share).filter((F.col("share") > 1 / LARGE) & (F.col("n") > 1) | (F.col("share") > 4 / LARGE))
    heavy = heavy.select("group_key", F.least("n", F.ceil(F.col("share"))).alias("slices")).collect()  # at most 3 * shards * LARGE
    first, units = [], BUNDLES
    for key, slices in sorted(heavy):
        first.append((bytes(key), units, int(slices)))
        units += int(slices)
    large = spark.createDataFrame(first, "group_key binary, first_unit long, slices long")
    sums = units_of(rows, large).groupBy("unit").agg(F.sum("size"), F.sum("tokens"), F.count("*"))
    got = sorted(map(tuple, sums.collect()))  # one row per unit: the same bound
    placed = pack(np.array([r[1:] for r in got], np.float64).reshape(-1, 3), shards)
    return large, spark.createDataFrame([(r[0], int(s)) for r, s in zip(got, placed, strict=True)], "unit long, shard int")


def units_of(rows: DataFrame, large: DataFrame) -> DataFrame:
    rows = rows.join(F.broadcast(large), "group_key", "left")
    salt = F.xxhash64(F.col("doc_id"), F.lit("slice"))
    bundle = F.pmod(F.xxhash64("group_key"), F.lit(BUNDLES))
    unit = F.when(F.col("slices").isNull(), bundle).otherwise(F.col("first_unit") + F.pmod(salt, F.coalesce("slices", F.lit(1))))
    return rows.withColumn("unit", unit).drop("first_unit", "slices")


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with ``shard`` (one that they had is replaced), without a shuffle of the texts."""
    weights = [c.alias(n) for n, c in measures().items()]
    narrow = materialize(docs.select("doc_id", *weights), "shard-sizes")
    large, units = plan(narrow, shards)
    kept = [c for c in docs.columns if c != "shard"]
    rows = docs.select(F.struct(*kept).alias("_row"), "doc_id", *weights)
    return units_of(rows, large).join(F.broadcast(units), "unit").select("_row.*", "shard")


def number_slots(rows: DataFrame) -> DataFrame:
    """Gapless slots from 0 in each shard: hashed buckets are counted, and rows numbered within a bucket only."""
    n = rows.count()
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(n // SLOT_ROWS + 1))
    rows = rows.withColumn("bucket", bucket)
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")) - 1
    return rows.withColumn("inside", inside).join(counts.drop("n"), ["shard", "bucket"]).withColumn(
        "slot", (F.col("base") + F.col("inside")).cast("long")
    ).drop("bucket", "inside", "base")


def shard_table(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; decided and numbered on a narrow table."""
    columns = measures() | {"text_crc32": F.crc32(F.coalesce("text", F.lit("")).cast("binary"))}
    narrow = materialize(docs.select("doc_id", *(c.alias(n) for n, c in columns.items())), "shard-sizes")
    large, units = plan(narrow, shards)
    placed = units_of(narrow, large).join(F.broadcast(units), "unit")
    return number_slots(materialize(placed.select("doc_id", "size", "text_crc32", "shard"), "shard-rows"))
