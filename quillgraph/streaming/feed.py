"""The live event feed on Structured Streaming.

A subscription is a streaming read of the event files, filtered by audience
and start. Its position is the stream's checkpoint: a subscriber that comes
back with the same one gets what it has not seen, each event once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.model import ADMIN, Requester
from quillgraph.operators.feed import heard


def live(spark: SparkSession, events_dir: str, schema: T.StructType, who: Requester = ADMIN, after: int | None = None) -> DataFrame:
    """A stream of the events (``seq``, ``audience`` and more) that the subscriber hears, past ``after``."""
    rows = heard(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(events_dir), who)
    return rows if after is None else rows.filter(F.col("seq") > after)


def deliver(stream: DataFrame, out: str, position: str) -> None:
    """Write all that is there by now and not yet delivered; ``position`` is the folder that keeps the place."""
    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", position).format("parquet").start(out)
    query.awaitTermination()
