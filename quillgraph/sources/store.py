"""Parquet snapshots: nodes partitioned by kind, published by swapping a pointer.

A snapshot is a directory of its own; ``CURRENT`` names the published one and
is replaced by a rename, so readers see the old state or the new one. Nodes are
in order of address (or of a key), edges in order of an end, so that the files'
own minima and maxima prune them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.errors import Conflict, Invalid
from quillgraph.functions import jsonval as J
from quillgraph.model import EDGE, HISTORY, NODE
from quillgraph.operators.snapshot import Snapshot

TABLES = ("nodes", "edges", "history")


def _fs(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def write_nodes(nodes: DataFrame, path: str, declared: tuple[str, ...] = (), order: str = "address") -> None:
    """Nodes by kind and, within a kind, in order, with a typed key column for each declared field."""
    if order in nodes.columns:  # the keys are parsed after the shuffle, which reads its input once more to find its ranges
        rows = J.declare(nodes.repartitionByRange("kind", order), *declared)
    else:
        rows = J.declare(nodes, *declared).repartitionByRange("kind", order, "address")  # equal keys may fill many files
    rows.sortWithinPartitions("kind", order, "address").write.partitionBy("kind").parquet(path)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes as written; a kind is a text, whatever it looks like."""
    found = spark.read.parquet(path).schema
    fields = [T.StructField("kind", T.StringType()) if f.name == "kind" else f for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(path)


def write_edges(edges: DataFrame, path: str, end: str = "from") -> None:
    """Edges in order of one end, for adjacency from there."""
    edges.repartitionByRange(end).sortWithinPartitions(end, F.octet_length("kind"), "kind").write.parquet(path)


def write_snapshot(s: Snapshot, root: str, version: int, declared: tuple[str, ...] = ()) -> str:
    """Write a snapshot's tables; ``declared`` fields get typed key columns. Refuses to overwrite one."""
    path = f"{root}/v{version:08d}"
    spark = s.nodes.sparkSession
    fs, hadoop = _fs(spark, path)
    if fs.exists(hadoop):
        raise Conflict(f"{path} exists")
    write_nodes(s.nodes, f"{path}/nodes", declared)
    write_edges(s.edges, f"{path}/edges")
    s.history.write.parquet(f"{path}/history")
    return path


def publish(spark: SparkSession, root: str, version: int) -> None:
    fs, pointer = _fs(spark, f"{root}/CURRENT")
    _, fresh = _fs(spark, f"{root}/CURRENT.{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(str(version).encode()))
    out.close()
    fs.delete(pointer, False)
    if not fs.rename(fresh, pointer):
        raise Conflict("the snapshot pointer could not be replaced")


def current(spark: SparkSession, root: str) -> int | None:
    fs, pointer = _fs(spark, f"{root}/CURRENT")
    if not fs.exists(pointer):
        return None
    return int(spark.read.text(f"{root}/CURRENT").first()[0])


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The published snapshot, or a given one."""
    version = current(spark, root) if version is None else version
    if version is None:
        raise Invalid("nothing has been published")
    edges, history = (spark.read.parquet(f"{root}/v{version:08d}/{t}") for t in TABLES[1:])
    return Snapshot(read_nodes(spark, f"{root}/v{version:08d}/nodes"), edges, history)


def backup(s: Snapshot, path: str) -> None:
    """A copy of a snapshot's plain tables that never overwrites."""
    for name, df, schema in zip(TABLES, (s.nodes, s.edges, s.history), (NODE, EDGE, HISTORY), strict=True):
        df.select(schema.fieldNames()).write.mode("errorifexists").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, root: str, declared: tuple[str, ...] = ()) -> int:
    """Publish a backup as the store's next version; what was published stays readable by its number."""
    if not all(_fs(spark, f"{path}/{t}")[0].exists(_fs(spark, f"{path}/{t}")[1]) for t in TABLES):
        raise Invalid(f"{path} is no backup")
    version = (current(spark, root) or 0) + 1
    nodes, edges, history = (spark.read.schema(x).parquet(f"{path}/{t}") for t, x in zip(TABLES, (NODE, EDGE, HISTORY), strict=True))
    write_snapshot(Snapshot(nodes, edges, history), root, version, declared)
    publish(spark, root, version)
    return version
