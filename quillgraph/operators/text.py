"""Substring search with trigram candidates.

A postings table (gram, address) is built once per (kind, field), from the
ASCII-folded text or, in ``folded`` mode, from the lower-cased one. A search
intersects the postings of the needles' grams (those of the rarest come
first, at most ``MAX_GRAMS``) and rechecks the exact predicate on the
candidates, so postings only ever save work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import jsonval as J
from quillgraph.functions.lower import simple_lower
from quillgraph.model import ADMIN, Requester
from quillgraph.operators.query import matching
from quillgraph.plans import expr as E

MAX_GRAMS = 16
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def fold_ascii(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none under three characters.

    Four bytes a character make each cut a known place; the outer transform
    binds the bytes, which an inner one would else copy for each gram.
    """
    spots = lambda u: F.when(F.octet_length(u) >= 12, F.sequence(F.lit(1), F.octet_length(u) - 11, F.lit(4)))
    cuts = lambda u: F.transform(spots(u), lambda i: F.decode(F.substring(u, i, F.lit(12)), "UTF-32"))
    return F.array_distinct(F.flatten(F.transform(F.array(F.encode(text, "UTF-32")), cuts)))


def indexed_text(nodes: DataFrame, field: str, folded: bool = False) -> Column:
    """What an index stores of a field, NULL where it is no text."""
    v = J.field(field, nodes.columns)
    return F.when(v.rank == J.STRING, simple_lower(v.txt) if folded else fold_ascii(v.txt))


def postings(nodes: DataFrame, kind: str, field: str, folded: bool = False) -> DataFrame:
    """(gram, address) of a kind's string field; addresses are unique, so each row's grams are made distinct in place."""
    rows = nodes.filter(F.col("kind") == kind)
    return rows.select(F.explode(grams(indexed_text(rows, field, folded))).alias("gram"), "address")


def needle_grams(needles: list[str], folded: bool) -> list[str]:
    out: set[str] = set()
    for needle in needles:
        low = needle if folded else "".join(c.lower() if c in _UPPER else c for c in needle)
        out |= {low[i : i + 3] for i in range(len(low) - 2)}
    return sorted(out)


def candidates(index: DataFrame, needles: list[str], folded: bool = False) -> DataFrame | None:
    """Addresses that hold all grams of all needles; None where no needle has three characters."""
    wanted = needle_grams(needles, folded)
    if not wanted:
        return None
    hits = index.filter(F.col("gram").isin(*wanted))
    if len(wanted) > MAX_GRAMS:  # fewer grams still admit every match; the recheck is exact
        rare = hits.groupBy("gram").count().orderBy("count", "gram").limit(MAX_GRAMS)
        kept = [r.gram for r in rare.select("gram").collect()]
        if len(kept) < min(MAX_GRAMS, len(wanted)):
            return index.select("address").limit(0)
        wanted, hits = kept, index.filter(F.col("gram").isin(*kept))
    return hits.groupBy("address").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(wanted)).select("address")


def search(
    nodes: DataFrame, where: E.Expr, kind: str, indexes: dict[tuple[str, bool], DataFrame], who: Requester = ADMIN, owner: str | None = None
) -> DataFrame:
    """Rows that match ``where``, through the first usable index {(field, folded): postings}, else by a scan."""
    for (field, folded), index in indexes.items():
        needles = [v for f, test, v, low in E.leading_tests(where) if f == field and test != "==" and low == folded]
        found = candidates(index, needles, folded) if needles else None
        if found is not None:
            nodes = nodes.join(found, "address", "left_semi")
            break
    return matching(nodes, who, kind, owner, where)
