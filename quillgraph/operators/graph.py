"""Adjacency, edge lookup and one-hop expansion over edges (from, to, kind, owner)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.errors import Conflict
from quillgraph.model import ADMIN, Requester, visible

KEY = ["from", "to", "kind"]


def _adjacent(edges: DataFrame, here: str, there: str, address: str) -> DataFrame:
    """Edge kinds order by their byte length first, then bytes."""
    return edges.filter(F.col(here) == address).orderBy(F.octet_length("kind"), "kind", there)


def out_edges(edges: DataFrame, address: str) -> DataFrame:
    return _adjacent(edges, "from", "to", address)


def in_edges(edges: DataFrame, address: str) -> DataFrame:
    return _adjacent(edges, "to", "from", address)


def find_edge(edges: DataFrame, source: str, target: str, kind: str) -> DataFrame:
    return edges.filter((F.col("from") == source) & (F.col("to") == target) & (F.col("kind") == kind))


def expand(edges: DataFrame, nodes: DataFrame, address: str, who: Requester = ADMIN, reverse: bool = False) -> DataFrame:
    """The edges of a node with the readable node at their other end; ends that are gone are left out."""
    here, there = ("to", "from") if reverse else ("from", "to")
    near = edges.filter(F.col(here) == address).select(F.col("kind").alias("edge_kind"), F.col(there).alias("address"))
    return near.join(visible(nodes, who), "address").orderBy(F.octet_length("edge_kind"), "edge_kind", "address")


def degrees(edges: DataFrame, end: str = "from") -> DataFrame:
    """Edges per node and kind, pre-aggregated before the shuffle."""
    return edges.groupBy(F.col(end).alias("address"), "kind").agg(F.count("*").alias("degree"))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which an end does not exist: deleting a node leaves its edges."""
    there = nodes.select("address")
    lost = [edges.join(there, edges[end] == there["address"], "left_anti") for end in ("from", "to")]
    return lost[0].unionByName(lost[1]).dropDuplicates(KEY)


def put_edges(edges: DataFrame, batch: DataFrame, nodes: DataFrame, who: Requester = ADMIN, take_over: bool = False) -> DataFrame:
    """Upsert edges by (from, to, kind). Both ends must exist; another owner's edge is not replaced."""
    if not dangling(batch, nodes).isEmpty():
        raise Conflict("an edge's end does not exist")
    if not (who.admin or take_over):
        theirs = edges.filter(F.col("owner") != who.owner).join(batch.select(KEY), KEY, "left_semi")
        if not theirs.isEmpty():
            raise Conflict("an edge belongs to another owner")
    return edges.join(batch.select(KEY), KEY, "left_anti").select(edges.columns).unionByName(batch.select(edges.columns))


def drop_edges(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Delete edges by key; every key must exist."""
    if not keys.join(edges.select(KEY), KEY, "left_anti").isEmpty():
        raise Conflict("no such edge")
    return edges.join(keys.select(KEY), KEY, "left_anti").select(edges.columns)
