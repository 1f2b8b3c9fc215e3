"""The committed change feed as a stream.

Each micro-batch is put together with the records of units that were still
open, settled units are turned into changes by the batch operator, and the
rest waits for the next one. What waits is written under the batch's id, so a
batch that runs again reads the same past and writes the same result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.operators import changes as C


def _settled(rows: DataFrame) -> DataFrame:
    return C.units(rows).filter(F.col("op").isin("Commit", "Abort") | (F.col("transaction_id") == 0)).select("unit").distinct()


def process_batch(batch: DataFrame, batch_id: int, state: str, out: str, retain: int | None = None) -> None:
    spark = batch.sparkSession
    rows = batch.select(model.LOG.fieldNames())
    if batch_id > 0:
        rows = rows.unionByName(spark.read.schema(model.LOG).parquet(f"{state}/{batch_id - 1}"))
    done = _settled(rows)
    with_unit = C.units(rows)
    C.committed_changes(rows).join(done, "unit", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    open_units = with_unit.join(done, "unit", "left_anti")
    if retain is not None:
        # a unit whose records all lie before the horizon can never commit: the log no longer holds its beginning
        last = rows.agg(F.max("sequence")).first()[0]
        alive = open_units.groupBy("unit").agg(F.max("sequence").alias("_end")).filter(F.col("_end") > F.lit((last or 0) - retain))
        open_units = open_units.join(alive, "unit", "left_semi")
    open_units.select(model.LOG.fieldNames()).write.mode("overwrite").parquet(f"{state}/{batch_id}")


def stream_changes(spark: SparkSession, log_dir: str, work_dir: str, files_per_batch: int = 1, retain: int | None = None) -> DataFrame:
    """Run the feed over the log files that are there, to the end, and return all changes.

    ``retain`` is how many sequence numbers the log keeps: what waits for a
    commit for longer is dropped from the state, as it is from the log.
    """
    state, out = f"{work_dir}/state", f"{work_dir}/changes"
    source = spark.readStream.schema(model.LOG).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
    query = (
        source.writeStream.trigger(availableNow=True)
        .option("checkpointLocation", f"{work_dir}/checkpoint")
        .foreachBatch(lambda df, i: process_batch(df, i, state, out, retain))
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).drop("batch")


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "1 day") -> DataFrame:
    """An extension: events per type and tumbling window, with a watermark; for streams and tables alike."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
