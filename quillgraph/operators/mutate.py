"""Batch mutations as functions from one immutable snapshot to the next.

Every write archives the whole previous node. A batch is resolved, checked as
a whole (deferred, on its net effect) and only then becomes a snapshot, so it
holds entirely or not at all; publishing a snapshot is swapping a directory
(see ``sources.store``).
"""

from __future__ import annotations

import json
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.errors import Conflict, Invalid, Precondition
from quillgraph.functions import jsonval as J
from quillgraph.model import ADMIN, NODE_COLUMNS, Requester
from quillgraph.operators import graph
from quillgraph.operators.integrity import delete_closure
from quillgraph.operators.query import matching
from quillgraph.operators.snapshot import Snapshot
from quillgraph.operators.transaction import expectation, transaction
from quillgraph.plans import expr as E

__all__ = ["Snapshot", "transaction"]


def _archive(s: Snapshot, touched: DataFrame) -> DataFrame:
    """History with the current state of each touched address appended as its next version."""
    old = s.nodes.join(touched.select("address").distinct(), "address", "left_semi").select(NODE_COLUMNS)
    last = s.history.join(touched.select("address").distinct(), "address", "left_semi").groupBy("address").agg(F.max("version").alias("_last"))
    new = old.join(last, "address", "left").select(
        "address", F.lit(s.now).cast("long").alias("archived_at_unix"), F.struct(*NODE_COLUMNS).alias("node"),
        (F.coalesce("_last", F.lit(0)) + 1).alias("version"),
    )
    return s.history.unionByName(new)


def upsert(s: Snapshot, batch: DataFrame, check: bool = True, order: str | None = None, distinct: bool = True) -> Snapshot:
    """Insert or replace whole nodes by address; what was there is archived.

    ``order`` names a column of ``batch`` by whose greatest value an address
    that occurs more than once is settled; without it such a batch is refused.
    """
    if order is not None:
        last = F.max_by(F.struct(*NODE_COLUMNS), F.col(order)).alias("node")
        batch = batch.groupBy("address").agg(last).select("node.*")
    elif distinct and not batch.groupBy("address").count().filter("count > 1").isEmpty():
        raise Invalid("a batch names an address twice")
    rows = batch.select(NODE_COLUMNS)
    nodes = s.nodes.join(rows.select("address"), "address", "left_anti").select(NODE_COLUMNS).unionByName(rows)
    out = replace(s, nodes=nodes, history=_archive(s, rows))
    if check:
        s.catalog.check(nodes, rows)
    return out


def insert_with_edges(s: Snapshot, node: DataFrame, edges: DataFrame, who: Requester = ADMIN, if_absent: bool = False) -> Snapshot:
    """One node and its edges, together; an existing node of another owner is not replaced."""
    there = s.nodes.join(node.select("address"), "address", "left_semi")
    if if_absent and not there.isEmpty():
        raise Conflict("the node exists")
    if not who.admin and not there.filter(F.col("owner") != who.owner).isEmpty():
        raise Conflict("the node belongs to another owner")
    out = upsert(s, node)
    return replace(out, edges=graph.put_edges(out.edges, edges, out.nodes, who, take_over=True))


def update(s: Snapshot, address: str, data: str, who: Requester = ADMIN, visibility: str | None = None) -> Snapshot:
    row = s.nodes.filter((F.col("address") == address) & who.can_write())
    if row.isEmpty():
        raise Precondition("no such node, or not yours")
    row = row.withColumn("data", F.lit(data))
    return upsert(s, row if visibility is None else row.withColumn("visibility", F.lit(visibility)))


def delete(s: Snapshot, addresses: DataFrame, checkpoint=None) -> Snapshot:
    """Delete nodes and what their references cascade to; absent targets are no error, edges stay."""
    closure = delete_closure(s.nodes, list(s.catalog.references.values()), addresses, checkpoint)
    touched = closure.deleted
    nodes = s.nodes
    for name, rows in closure.nulled.items():
        ref = s.catalog.references[name]
        touched = touched.union(rows)
        hit = nodes.join(rows.distinct(), "address", "left_semi").withColumn("data", set_field(F.col("data"), ref.field, None))
        nodes = nodes.join(rows.distinct(), "address", "left_anti").select(NODE_COLUMNS).unionByName(hit.select(NODE_COLUMNS))
    nodes = nodes.join(closure.deleted, "address", "left_anti").select(NODE_COLUMNS)
    return replace(s, nodes=nodes, history=_archive(s, touched))


def delete_where(s: Snapshot, kind: str, where: E.Expr | None = None, who: Requester = ADMIN, most: int | None = model.MAX_ROWS_HELD) -> tuple[Snapshot, DataFrame]:
    """Delete a kind's rows that the caller may write and the predicate takes; a failing predicate aborts all."""
    mine = s.nodes.withColumn("_w", who.can_write())
    rows = matching(mine.filter("_w"), ADMIN, kind, None, where).select("address")
    if most is not None and rows.limit(most + 1).count() > most:
        raise Invalid(f"more than {most} rows to delete")
    return delete(s, rows), rows


def claim(s: Snapshot, address: str, who: Requester) -> Snapshot:
    row = model.visible(s.nodes.filter(F.col("address") == address), who)
    if row.isEmpty():
        raise Precondition("no such node")
    free = row.filter(F.col("claimed_by").isNull())
    if free.isEmpty():
        raise Conflict("already claimed")
    return upsert(s, free.withColumn("claimed_by", F.lit(who.owner)))


def claim_all(s: Snapshot, rows: DataFrame, claimant: Column) -> Snapshot:
    """Claim every unclaimed node among ``rows`` (addresses) for the owner that ``claimant`` gives."""
    free = s.nodes.filter(F.col("claimed_by").isNull()).join(rows.select("address"), "address", "left_semi")
    return upsert(s, free.withColumn("claimed_by", claimant), check=False, distinct=False)


def set_field(data: Column, name: str, value) -> Column:
    """The JSON object with one member replaced or added, other members as they were."""
    whole = F.try_variant_get(F.try_parse_json(data), "$", "map<string,variant>")
    kept = F.map_filter(F.coalesce(whole, F.create_map().cast("map<string,variant>")), lambda k, _: k != name)
    added = F.map_from_arrays(F.array(F.lit(name)), F.array(F.parse_json(F.lit(json.dumps(value)))))
    return F.to_json(F.map_concat(kept, added))


def _compare(expect: dict) -> Column:
    """The test of one compare-and-set request: expect_le, expect_eq (exact JSON) or expect_absent."""
    test = expectation(expect)
    raw, v = J.variant_field(F.col("data"), expect["field"]), J.field(expect["field"])
    if test == "expect_absent":
        return v.rank.isin(J.NULL, J.ABSENT)
    if test == "expect_le":
        return (v.rank == J.NUMBER) & (v.num <= float(expect["expect_le"]))
    want = expect["expect_eq"]
    if isinstance(want, int) and not isinstance(want, bool):
        # compared as whole numbers: a double holds no more than 53 bits
        whole = F.try_variant_get(raw, "$", "decimal(38,0)") if -(10**38) < want < 10**38 else F.lit(None)
        return J.is_int(raw) & F.coalesce(whole == F.lit(Decimal(want)).cast("decimal(38,0)"), F.lit(False))
    typed = ~J.is_int(raw) if isinstance(want, float) else F.lit(True)
    return typed & E.equal(v, J.literal(want))


def set_if(s: Snapshot, address: str, expect: dict, changes: dict, who: Requester = ADMIN) -> Snapshot:
    """Merge ``changes`` into a node's data if the test on one of its fields holds."""
    row = s.nodes.filter((F.col("address") == address) & who.can_write())
    hit = row.filter(_compare(expect))
    if hit.isEmpty():
        raise Precondition("no such node, or the test failed")
    return upsert(s, merged(hit, changes))


def set_if_rows(nodes: DataFrame, expect: dict, changes: dict) -> DataFrame:
    """The set-based form: the rows whose test holds, with ``changes`` merged into their data."""
    return merged(nodes.filter(_compare(expect)), changes)


def merged(rows: DataFrame, changes: dict) -> DataFrame:
    data = F.col("data")
    for name, value in changes.items():
        data = set_field(data, name, value)
    return rows.withColumn("data", data)


def next_block(s: Snapshot, name: str, count: int, who: Requester) -> tuple[Snapshot, int]:
    """Allocate ``count`` numbers of a sequence; the first block starts at 1."""
    if not name or len(name) > model.MAX_SEQUENCE_NAME or ":" in name or not 1 <= count <= model.MAX_SEQUENCE_BLOCK:
        raise Invalid("bad sequence name or block")
    address = f"__sequence:{name}"
    row = s.nodes.filter(F.col("address") == address).select("owner", "data").first()
    if row and not who.admin and row.owner != who.owner:
        raise Conflict("the sequence belongs to another owner")
    first = json.loads(row.data)["next"] if row else 1
    owner = row.owner if row else who.owner
    new = s.nodes.sparkSession.createDataFrame(
        [(address, (0, 0, 0, 0), 0, "__sequence", json.dumps({"next": first + count}), owner, None, model.PRIVATE)], model.NODE
    )
    return upsert(s, new, check=False), first


def blocks(requests: DataFrame, name: str = "name", order: str = "request_id", count: str = "count") -> DataFrame:
    """All blocks of many requests at once: per sequence, contiguous in order of request."""
    before = Window.partitionBy(name).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum(count).over(before), F.lit(0)) + 1
    return requests.withColumn("first", first).withColumn("end", first + F.col(count))
