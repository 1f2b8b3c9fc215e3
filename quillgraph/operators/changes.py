"""The committed change feed, as a batch query over the log.

A durable unit is the records of one transaction, or one record outside any
(transaction 0). Only units with a Commit count; a unit at the end of the log
that has neither Commit nor Abort is still in flight, and nothing follows it.
Within a unit an Archive of the same address makes an Insert an update and a
Delete attributable; a Delete without one is not a change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.errors import Invalid, TooOld
from quillgraph.model import ADMIN, PUBLIC, Requester

CHANGE = ["seq", "change", "address", "kind", "owner", "visibility", "unit"]


def units(log: DataFrame) -> DataFrame:
    """The log with ``unit``: the transaction's id, or a key of the record's own."""
    standalone = F.col("transaction_id") == 0
    return log.withColumn("unit", F.when(standalone, -F.col("sequence")).otherwise(F.col("transaction_id")))


def committed_records(log: DataFrame) -> DataFrame:
    """The records of committed units; one pre-aggregate per unit and a semi join, no window over the log."""
    rows = units(log)
    done = rows.filter((F.col("op") == "Commit") | (F.col("unit") <= 0)).select("unit").distinct()
    return rows.join(done, "unit", "left_semi")


def committed_changes(log: DataFrame) -> DataFrame:
    """seq, change (created, updated, deleted), address, kind, owner, visibility, unit of every committed change."""
    rows = committed_records(log).filter(F.col("op").isin("Archive", "Insert", "Delete"))
    before = Window.partitionBy("unit", "address").orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("Archive", "Delete"), F.struct("op", "kind", "owner", "visibility")), ignorenulls=True).over(before)
    rows = rows.withColumn("_last", last).withColumn("_had", F.coalesce(F.col("_last.op") == "Archive", F.lit(False)))
    rows = rows.filter((F.col("op") == "Insert") | ((F.col("op") == "Delete") & F.col("_had")))
    gone = F.col("op") == "Delete"
    change = F.when(gone, "deleted").when(F.col("_had"), "updated").otherwise("created")
    pick = [F.when(gone, F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) for c in ("kind", "owner", "visibility")]
    return rows.select(F.col("sequence").alias("seq"), change.alias("change"), "address", *pick, "unit")


def admitted(changes: DataFrame, who: Requester) -> DataFrame:
    """The changes that the caller may learn of: public ones, their own, or all for an admin."""
    return changes if who.admin else changes.filter((F.col("visibility") == PUBLIC) | (F.col("owner") == who.owner))


@dataclass
class ChangePage:
    changes: DataFrame
    next: int
    complete: bool


def horizon(log: DataFrame) -> int:
    """The position below which records are no longer retained."""
    first = log.agg(F.min("sequence")).first()[0]
    return 0 if first is None else max(0, first - 1)


def page(log: DataFrame, after: int = 0, limit: int = model.CHANGE_PAGE_DEFAULT, who: Requester = ADMIN) -> ChangePage:
    """Changes past ``after``; units are never split, so a page may run over ``limit``."""
    if not 1 <= limit <= model.CHANGE_PAGE_MAX:
        raise Invalid(f"a page holds 1 to {model.CHANGE_PAGE_MAX} changes")
    if after < (earliest := horizon(log)):
        raise TooOld(after, earliest)
    fresh = admitted(committed_changes(log), who).filter(F.col("seq") > after)
    # the page ends with the unit of its limit-th change: a top-k by position, then one filter
    first = fresh.orderBy("seq").limit(limit).agg(F.count("*"), F.max_by("unit", "seq"), F.max("seq")).first()
    if not first[0]:
        return ChangePage(fresh.limit(0), after, True)
    end = fresh.filter(F.col("unit") == first[1]).agg(F.max("seq")).first()[0]
    rest = units(log).filter((F.col("sequence") > end) & (F.col("unit") != first[1]))
    return ChangePage(fresh.filter(F.col("seq") <= end), end, first[0] < limit or rest.isEmpty())


def latest_state(log: DataFrame) -> DataFrame:
    """The nodes that the committed log leaves: each address's last change, unless it is a delete."""
    changes = committed_changes(log)
    last = changes.groupBy("address").agg(F.max_by(F.struct("change", "kind", "owner", "visibility", "seq"), "seq").alias("s"))
    return last.filter("s.change <> 'deleted'").select("address", "s.kind", "s.owner", "s.visibility", "s.seq")
