"""Connected components of an edge table, in DataFrame functions only.

Large-star and small-star rounds alternate until nothing changes; then every
node points to the smallest node of its component. A node's neighbourhood is
never gathered: its minimum is a pre-aggregated ``min`` that is joined back by
``spread_join``, so a hub's edges stay spread over the tasks they lie in. Each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.storage import drop_table, materialize, spread_join


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect each node's larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
    return spread_join(both.filter("v > u"), least, "u", "n", total).select(F.col("v").alias("hi"), F.col("m").alias("lo"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect each node's smaller neighbours, and the node, to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n"))
    moved = spread_join(edges, least, "hi", "n", total).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo")
    return moved.union(least.select("hi", F.col("m").alias("lo"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge but the roots themselves; root is its component's smallest node.

    Edges with a null end and loops are left out; repeated edges count once.
    """
    pairs = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = materialize(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "components")
    state = _state(now)
    while state[0]:
        # a large star never adds an edge, so 2 x state bounds the tables that a round joins
        after = materialize(_small_star(_large_star(now, 2 * state[0]), 2 * state[0]), "components")
        drop_table(now)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
