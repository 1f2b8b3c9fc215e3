"""Schemas of the graph-document model, limits, and who asks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COORDINATE = T.StructType([T.StructField(c, T.ShortType()) for c in "xyzq"])
NODE = T.StructType(
    [
        T.StructField("address", T.StringType(), False),
        T.StructField("coordinate", COORDINATE),
        T.StructField("value", T.LongType()),
        T.StructField("kind", T.StringType(), False),
        T.StructField("data", T.StringType()),
        T.StructField("owner", T.StringType(), False),
        T.StructField("claimed_by", T.StringType()),
        T.StructField("visibility", T.StringType()),
    ]
)
EDGE = T.StructType([T.StructField(c, T.StringType(), False) for c in ("from", "to", "kind", "owner")])
HISTORY = T.StructType(
    [
        T.StructField("address", T.StringType(), False),
        T.StructField("archived_at_unix", T.LongType()),
        T.StructField("node", NODE),
        T.StructField("version", T.LongType()),
    ]
)
LOG = T.StructType(
    [
        T.StructField("sequence", T.LongType(), False),
        T.StructField("transaction_id", T.LongType(), False),
        T.StructField("op", T.StringType(), False),
        T.StructField("address", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("owner", T.StringType()),
        T.StructField("visibility", T.StringType()),
    ]
)
NODE_COLUMNS = NODE.fieldNames()

PUBLIC, PRIVATE = "Public", "Private"

# Bounds that callers see as errors.
MAX_DEPTH = 64
MAX_EXPR_NODES = 256
MAX_CONCAT_BYTES = 65536
MAX_IN_SET = 1000
MAX_MULTI_GET = 1000
MAX_GROUP_VALUES = 1000
MAX_ROWS_HELD = 100_000
MAX_OFFSET = 10_000
DEFAULT_LIMIT = 50
MAX_LIMIT = 500
MAX_CURSOR_BYTES = 4096
MAX_MUTATIONS = 50_000
MAX_SEQUENCE_NAME = 128
MAX_SEQUENCE_BLOCK = 100_000
MAX_PAYLOAD_BYTES = 65536
CHANGE_PAGE_DEFAULT = 500
CHANGE_PAGE_MAX = 2000
EVENT_RING = 1024


@dataclass(frozen=True)
class Requester:
    """Who asks; an admin sees and may write everything."""

    owner: str = ""
    admin: bool = False

    def can_read(self) -> Column:
        if self.admin:
            return F.lit(True)
        return (F.col("visibility") == PUBLIC) | (F.col("owner") == self.owner)

    def can_write(self) -> Column:
        return F.lit(True) if self.admin else F.col("owner") == self.owner


ADMIN = Requester(admin=True)


def visible(nodes: DataFrame, who: Requester) -> DataFrame:
    return nodes if who.admin else nodes.filter(who.can_read())


def coordinate(x: Column, y: Column, z: Column, q: Column) -> Column:
    """A coordinate whose parts must lie in 0..255."""
    parts = [
        F.when(c.between(0, 255), c.cast("short")).otherwise(F.raise_error(F.lit("a coordinate lies in 0..255")).cast("short")).alias(n)
        for n, c in zip("xyzq", (x, y, z, q), strict=True)
    ]
    return F.struct(*parts)
