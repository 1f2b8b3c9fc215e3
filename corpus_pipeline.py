"""The corpus pipeline: five operators in a row, each stage written as Parquet and read again.

Every stage works on all that the one before it kept. A mixed row may occur
up to three times; the last stage adds ``shard`` to the columns of documents.
``run`` deletes a stage's own tables, and its input, once its result is written.

Defined cases: rows with a null or empty text, a null doc_id or a repeated one
pass through each stage as its operator's docstring says, of equal or similar
texts one row stays; more columns, whatever their names, stay (``shard`` is
replaced); an empty table, or labels or a benchmark without rows, gives no
rejection and, in the end, a table of the same columns and ``shard``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, mixing, quality, sharding, simhash, storage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedupe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by fingerprint or 0.8 similar in 5-word shingles, stays."""
    return simhash.keep_one(docs, similarity=0.8)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_rows(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the shard that each goes to."""
    return sharding.assign(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", dedupe),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: The stages hash shingles, fit a model and pack greedily: SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with storage.scratch() as made:
            docs = storage.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        storage.delete(spark, before + made[:-1])
        before = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
