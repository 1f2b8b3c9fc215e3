"""Shared storage: tables that cut lineage, and files that executors write and read.

Everything goes below ``spark.checkpoint.dir``, the one folder that the driver
and all executors share, through Spark's own writers or through
``pyarrow.fs`` by the folder's URI. Files are written under a temporary name
and moved when whole; their final names and bytes depend on the task's input
only, so a task that runs again leaves the same file.
"""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; a local session without one gets a temporary folder."""
    uri = spark.conf.get("spark.checkpoint.dir", None)
    if not uri:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        uri = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="quillgraph-"))
    return (uri if "://" in uri or uri.startswith("file:") else "file://" + uri).rstrip("/")


_MADE: list[list[str]] = []


def new_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextmanager
def scratch():
    """The list of the folders that are named meanwhile, to be deleted when nothing reads them any more."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield made
    finally:
        _MADE.remove(made)


def delete(spark: SparkSession, folders: list[str]) -> None:
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there."""
    spark = df.sparkSession
    path = new_dir(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL = 200_000
HOT = 1000


def spread_join(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """``rows`` joined with ``table`` (one row a key; ``weight`` is how many of ``rows`` have that key), without it.

    A table of at most ``SMALL`` rows, counted here unless ``total`` (the sum of
    weights, or a bound on it) says so, is broadcast. Otherwise the keys of at
    least the ``HOT``-th part of all weights, of which there are at most ``HOT``,
    are broadcast, and the rest is an ordinary join: no task gets a hot key's rows.
    The table is read up to three times, so it should be a written one.
    """
    if total is None:
        total = SMALL if table.limit(SMALL + 1).count() <= SMALL else table.agg(F.sum(weight)).first()[0]
    if total <= SMALL:
        return rows.join(F.broadcast(table.drop(weight)), key)
    hot = F.broadcast(table.filter(F.col(weight) * HOT >= total).drop(weight))
    cold = table.filter(F.col(weight) * HOT < total).drop(weight)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def drop_table(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    delete(df.sparkSession, sorted({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


class AtomicFile:
    """An output stream that appears under its final name only once it is closed well."""

    def __init__(self, uri: str):
        self.fs, self.path = resolve(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        ctx = TaskContext.get()
        self.tmp = f"{self.path}.{ctx.taskAttemptId() if ctx else uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.tmp, compression=None)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        self.out.close()
        if kind is not None:
            self.fs.delete_file(self.tmp)
            return
        try:
            self.fs.move(self.tmp, self.path)
        except OSError:  # an earlier attempt left the same file
            if self.fs.get_file_info(self.path).size != self.size:
                raise
            self.fs.delete_file(self.tmp)


def partition_id() -> int:
    ctx = TaskContext.get()
    return ctx.partitionId() if ctx else 0


def process_cache(name: str, make):
    """One value per Python worker process; workers serve many tasks."""
    holder = sys.modules.setdefault("_quillgraph_worker_cache", types.ModuleType("_quillgraph_worker_cache"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
