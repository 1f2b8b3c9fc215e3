"""The test tables as stored snapshots: written once a session in the shared folder, then read by the queries.

Nodes lie by kind and, within a kind, in order of address, with a typed key
column for each indexed field; edges lie by kind in order of either end. So a
lookup by address or end, an equality, prefix or range test on an indexed
field and a keyset page all become filters that reach the Parquet scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators.text import postings
from quillgraph.sources import catalog
from quillgraph.sources.session import shared_folder
from quillgraph.sources.store import read_nodes, write_edges, write_nodes

INDEXED = (
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate", "c_custkey", "c_nationkey", "n_nationkey", "n_regionkey",
    "r_regionkey", "p_name", "p_brand", "p_type",
)

_WRITTEN: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """The folder of a stored table, which ``write`` fills at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark)}/stored-{name}-{uuid.uuid4().hex}"
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _nodes(spark: SparkSession, sf_dir: str, name: str, make, *indexed: str, order: str = "address") -> DataFrame:
    return read_nodes(spark, once(spark, sf_dir, name, lambda path: write_nodes(make(spark, sf_dir), path, indexed, order)))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, "nodes", catalog.nodes, *INDEXED)


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of one kind: one folder of the snapshot."""
    return nodes(spark, sf_dir).filter("kind = 'Order'")


def mixed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In order of the field that pages go by."""
    return _nodes(spark, sf_dir, "mixed", catalog.mixed_nodes, "m", order="key_m")


def sparse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, "sparse", catalog.sparse_nodes, "g", "t")


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, "docs", catalog.doc_nodes)


def edges(spark: SparkSession, sf_dir: str, end: str = "from") -> DataFrame:
    """All edges, in order of the given end."""
    return spark.read.parquet(once(spark, sf_dir, f"edges-{end}", lambda path: write_edges(catalog.edges(spark, sf_dir), path, end)))


def doc_postings(spark: SparkSession, sf_dir: str, folded: bool) -> DataFrame:
    """The documents' text index, in order of gram."""

    def write(path: str) -> None:
        index = postings(doc_nodes(spark, sf_dir), "Doc", "body", folded)
        index.repartitionByRange("gram").sortWithinPartitions("gram", "address").write.parquet(path)

    return spark.read.parquet(once(spark, sf_dir, f"postings-{folded}", write))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's records in segments by sequence, as they were committed."""

    def write(path: str) -> None:
        catalog.log(spark, sf_dir).repartitionByRange("sequence").sortWithinPartitions("sequence").write.parquet(path)

    return spark.read.parquet(once(spark, sf_dir, "log", write))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archived states in order of address and version."""

    def write(path: str) -> None:
        catalog.history(spark, sf_dir).repartitionByRange("address", "version").sortWithinPartitions("address", "version").write.parquet(path)

    return spark.read.parquet(once(spark, sf_dir, "history", write))


def user_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark, sf_dir, "users", catalog.user_nodes)
