"""Counts, latency percentiles and traffic per coordinate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.model import ADMIN, Requester, visible

# Callers see the bounds of these buckets.
SUB_BITS = 3
BUCKETS = 512


def kind_tally(nodes: DataFrame, who: Requester = ADMIN) -> DataFrame:
    """Nodes per kind that the caller may read."""
    return visible(nodes, who).groupBy("kind").agg(F.count("*").alias("nodes")).orderBy("kind")


def owners(nodes: DataFrame, who: Requester = ADMIN) -> DataFrame:
    """The owners of readable nodes, with how many and of how many kinds."""
    return visible(nodes, who).groupBy("owner").agg(F.count("*").alias("nodes"), F.count_distinct("kind").alias("kinds")).orderBy("owner")


def counters(nodes: DataFrame, edges: DataFrame, history: DataFrame) -> DataFrame:
    """One row of totals."""
    one = [df.agg(F.count("*").alias(n)) for n, df in (("nodes", nodes), ("edges", edges), ("history", history))]
    return one[0].join(F.broadcast(one[1])).join(F.broadcast(one[2]))


def bucket_of(micros: Column) -> Column:
    """The log-linear bucket of a latency: eight steps to each power of two."""
    us = micros.cast("long")
    msb = F.floor(F.log2(us.cast("double"))).cast("int")
    msb = msb + F.when(F.shiftrightunsigned(us, 0) < F.pow(F.lit(2.0), msb), -1).when(us >= F.pow(F.lit(2.0), msb + 1), 1).otherwise(0)
    sub = F.floor(us / F.pow(F.lit(2.0), msb - SUB_BITS)).cast("long") % (1 << SUB_BITS)
    return F.when(us < 1 << SUB_BITS, us).otherwise(F.least((msb - SUB_BITS + 1) * (1 << SUB_BITS) + sub, F.lit(BUCKETS - 1).cast("long"))).cast("int")


def bucket_upper(bucket: Column) -> Column:
    """The largest latency of a bucket."""
    msb = F.floor(bucket / (1 << SUB_BITS)) + SUB_BITS - 1
    width = F.pow(F.lit(2.0), msb - SUB_BITS).cast("long")
    base = ((1 << SUB_BITS) + bucket % (1 << SUB_BITS)) * width
    return F.when(bucket < 1 << SUB_BITS, bucket.cast("long")).otherwise(base + width - 1)


def latency(samples: DataFrame, micros: Column, *by: str) -> DataFrame:
    """count, p50_us, p99_us and max_us per group, each a bucket's upper bound; at most 512 buckets a group are shuffled."""
    counts = samples.groupBy(*by, bucket_of(micros).alias("_b")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    counts = counts.withColumn("_seen", F.sum("_n").over(group.orderBy("_b"))).withColumn("_all", F.sum("_n").over(group))

    def quantile(q: float) -> Column:
        rank = F.greatest(F.ceil(F.col("_all") * F.lit(q)), F.lit(1))
        return bucket_upper(F.min(F.when(F.col("_seen") >= rank, F.col("_b"))))

    return counts.groupBy(*by).agg(
        F.sum("_n").alias("count"), quantile(0.5).alias("p50_us"), quantile(0.99).alias("p99_us"), bucket_upper(F.max("_b")).alias("max_us")
    )


def cell_traffic(traffic: DataFrame, slots: int = 256) -> DataFrame:
    """reads, writes and bytes per coordinate; cells beyond the first ``slots`` (by coordinate) share a row with NULL."""
    per = traffic.groupBy("coordinate").agg(F.sum("reads").alias("reads"), F.sum("writes").alias("writes"), F.sum("bytes").alias("bytes"))
    kept = per.orderBy("coordinate").limit(slots).select("coordinate", F.lit(True).alias("_kept"))
    named = per.join(F.broadcast(kept), "coordinate", "left").withColumn("coordinate", F.when(F.col("_kept"), F.col("coordinate")))
    return named.groupBy("coordinate").agg(*(F.sum(c).alias(c) for c in ("reads", "writes", "bytes")))
