"""The live event feed: positions, audiences, retention and resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.errors import Invalid, TooOld
from quillgraph.model import ADMIN, PUBLIC, Requester
from quillgraph.sources.session import keep


def node_audience() -> Column:
    """Who hears of a node: NULL is everyone, else its owner (and admins)."""
    return F.when(F.col("visibility") == PUBLIC, F.lit(None).cast("string")).otherwise(F.col("owner"))


def edge_audience(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with ``audience``: everyone only where both ends are public, else the edge's owner."""
    ends = nodes.filter(F.col("visibility") == PUBLIC).select(F.col("address").alias("_a"))
    out = edges
    for end in ("from", "to"):
        public = ends.withColumnRenamed("_a", f"_{end}")
        out = out.join(public, out[end] == public[f"_{end}"], "left")
    both = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    return out.withColumn("audience", F.when(~both, F.col("owner"))).drop("_from", "_to")


def inject_seq(payload: Column, seq: Column) -> Column:
    """JSON objects get a ``seq`` member; other payloads stay as they are."""
    members = F.try_variant_get(F.try_parse_json(payload), "$", "map<string,variant>")
    kept = F.map_filter(members, lambda k, _: k != "seq")
    whole = F.map_concat(kept, F.map_from_arrays(F.array(F.lit("seq")), F.array(seq.cast("variant"))))
    is_object = F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT")
    return F.when(is_object, F.to_json(whole)).otherwise(payload)


def publish(payload: str, who: Requester) -> tuple[str, str | None]:
    """An application's event: (payload, audience); admins reach everyone, others themselves."""
    if len(payload.encode()) > model.MAX_PAYLOAD_BYTES:
        raise Invalid(f"a payload has at most {model.MAX_PAYLOAD_BYTES} bytes")
    return payload, None if who.admin else who.owner


def heard(events: DataFrame, who: Requester = ADMIN) -> DataFrame:
    return events if who.admin else events.filter(F.col("audience").isNull() | (F.col("audience") == who.owner))


def retained(events: DataFrame, ring: int = model.EVENT_RING) -> DataFrame:
    """The last ``ring`` events, by position: a top-k, no full sort."""
    return events.orderBy(F.col("seq").desc()).limit(ring)


def resume(events: DataFrame, after: int | None, who: Requester = ADMIN, ring: int = model.EVENT_RING) -> DataFrame:
    """What a subscriber that saw ``after`` still gets (None: nothing yet, the live edge)."""
    if after is None:
        return heard(events, who).limit(0)
    held = retained(events, ring)
    first, rows, total = held.agg(F.min("seq"), F.count("*")).first() + (events.count(),)
    earliest = first - 1 if rows and total > rows else 0
    if after < earliest:
        raise TooOld(after, earliest)
    return heard(held.filter(F.col("seq") > after), who).orderBy("seq")


def numbered(events: DataFrame, *order: str, buckets: int = 64) -> DataFrame:
    """Events with a gapless ``seq`` in the given order: a range partitioning, counts per partition, and offsets.

    The partitioned rows are written once: both the counts and the numbers see
    the same partitions, whatever a lost task computes anew.
    """
    spread = events.repartitionByRange(buckets, *order).withColumn("_part", F.spark_partition_id())
    spread = keep(spread)
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    counts = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return spread.join(F.broadcast(counts), "_part").withColumn("seq", (F.col("_base") + inside).cast("long")).drop("_part", "_n", "_base")
