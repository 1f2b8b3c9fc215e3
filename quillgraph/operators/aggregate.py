"""count, sum, avg, min and max, for all rows or per value of a field.

Values are parsed once per row into typed columns and folded by ordinary
partial and final hash aggregates. Sums of integers are exact (DECIMAL) until
they outgrow 64 bits; one non-integer makes a sum a double. A value that is
neither a number nor missing fails sum and avg. min and max follow the total
order and keep the value of the smallest address among equals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.errors import Invalid
from quillgraph.functions import jsonval as J
from quillgraph.model import ADMIN, Requester
from quillgraph.operators.query import matching
from quillgraph.plans import expr as E

FUNCTIONS = ("count", "sum", "avg", "min", "max")
RESULT = ("result_rank", "result_int", "result_num", "result_txt")


def check(func: str, field: str | None) -> None:
    if func not in FUNCTIONS:
        raise Invalid(f"unknown function {func!r}: one of {', '.join(FUNCTIONS)}")
    if func == "count" and field is not None:
        raise Invalid("count takes no field")
    if func != "count" and not field:
        raise Invalid(f"{func} needs a field")


def _inputs(rows: DataFrame, *fields: str | None) -> DataFrame:
    """``rows`` with the named fields' values as ``_g``, ``_v`` and ``_int``: a declared field as it is stored, others from one parse."""
    group, field = fields
    named = [f for f in (group, field) if f is not None]
    rows = J.declare(rows, *dict.fromkeys(named))
    out = [F.col("address")] if field is not None else []
    out += [F.col(f"`{J.key_column(group)}`").alias("_g")] if group is not None else []
    if field is not None:
        out += [F.col(f"`{J.key_column(field)}`").alias("_v"), F.col(f"`{J.int_column(field)}`").alias("_int")]
    return rows.select(*out)


def _number() -> Column:
    rank = F.col("_v.rank")
    return F.when(rank == J.NUMBER, F.col("_v.num")).when(
        ~rank.isin(J.NULL, J.ABSENT), F.raise_error(F.lit("cannot add up a value that is not a number")).cast("double")
    )


def _folds(func: str) -> list[Column]:
    if func == "count":
        return [F.count("*").alias("_n")]
    if func in ("sum", "avg"):
        n = _number()
        return [
            F.count(n).alias("_n"),
            F.sum(n).alias("_sum"),
            F.sum(F.col("_int").cast("decimal(38,0)")).alias("_exact"),
            F.count("_int").alias("_ints"),
        ]
    has = ~F.col("_v.rank").isin(J.NULL, J.ABSENT)
    pick = F.struct("_v", "address", "_int")
    if func == "min":
        return [F.min(F.when(has, pick)).alias("_best")]
    # of equal maxima the smallest address counts: compare the value first, then take the least address at it
    return [F.max_by(F.struct("_v", "address", "_int"), F.when(has, F.col("_v"))).alias("_best")]


def _finish(func: str) -> list[Column]:
    """rank, exact integer (if it is one), double and text of the result."""
    if func == "count":
        n = F.coalesce("_n", F.lit(0))
        return [F.lit(J.NUMBER), n.cast("bigint"), n.cast("double"), F.lit("")]
    if func == "sum":
        whole = F.coalesce(F.col("_n") == F.col("_ints"), F.lit(True))
        exact = F.coalesce("_exact", F.lit(0).cast("decimal(38,0)"))
        fits = whole & exact.between(F.lit("-9223372036854775808").cast("decimal(38,0)"), F.lit("9223372036854775807").cast("decimal(38,0)"))
        return [
            F.lit(J.NUMBER),
            F.when(fits, exact).cast("bigint"),
            F.when(whole, exact.cast("double")).otherwise(F.coalesce("_sum", F.lit(0.0))),
            F.lit(""),
        ]
    if func == "avg":
        total = F.when(F.col("_n") == F.col("_ints"), F.col("_exact").cast("double")).otherwise(F.col("_sum"))
        some = F.coalesce(F.col("_n") > 0, F.lit(False))
        return [F.when(some, J.NUMBER).otherwise(J.NULL), F.lit(None).cast("bigint"), F.when(some, total / F.nullif("_n", F.lit(0))), F.lit("")]
    best = F.col("_best")
    return [
        F.coalesce(best["_v"]["rank"], F.lit(J.NULL)),
        best["_int"],
        F.when(best["_v"]["rank"].isin(J.NUMBER, J.BOOL), best["_v"]["num"]),
        F.coalesce(best["_v"]["txt"], F.lit("")),
    ]


def _result(func: str) -> list[Column]:
    return [c.alias(n) for n, c in zip(RESULT, _finish(func), strict=True)]


def aggregate(
    nodes: DataFrame, func: str, field: str | None = None, who: Requester = ADMIN, kind: str | None = None,
    owner: str | None = None, where: E.Expr | None = None,
) -> DataFrame:
    """One row: the result's rank, exact integer, double and text. Nothing matched: sum 0, count 0, else null."""
    check(func, field)
    rows = _inputs(matching(nodes, who, kind, owner, where), None, field)
    if func == "max":
        rows = _least_address(rows, [])
    return rows.agg(*_folds(func)).select(*_result(func))


def _least_address(rows: DataFrame, keys: list) -> DataFrame:
    """One row per (group, value): that of the smallest address; a pre-aggregate, no sort."""
    slim = rows.groupBy(*keys, "_v").agg(F.min(F.struct("address", "_int")).alias("_first"), F.count("*").alias("_rows"))
    return slim.select(*[k for k in keys], "_v", F.col("_first.address").alias("address"), F.col("_first._int").alias("_int"))


def aggregate_by(
    nodes: DataFrame, group_by: str, func: str = "count", field: str | None = None, values: list | None = None,
    who: Requester = ADMIN, kind: str | None = None, owner: str | None = None, where: E.Expr | None = None, most: int | None = model.MAX_ROWS_HELD,
) -> DataFrame:
    """A row per value of ``group_by``: its rank, num, txt, and the result; named values get a row even if empty.

    ``most`` bounds the number of groups: more are an error when the rows are read (None: no bound). Absent and null are two groups.
    """
    check(func, field)
    if not group_by:
        raise Invalid("group_by names a field")
    rows = _inputs(matching(nodes, who, kind, owner, where), group_by, field)
    named = None
    if values is not None:
        if len(values) > model.MAX_GROUP_VALUES:
            raise Invalid(f"at most {model.MAX_GROUP_VALUES} values")
        one = rows.sparkSession.range(1)
        wanted = F.explode(F.array(*(J.literal(v).key() for v in values))) if values else None
        empty = one.select(J.absent().key().alias("_g")).limit(0)
        named = empty if wanted is None else one.select(wanted.alias("_g")).distinct()
        rows = rows.join(F.broadcast(named), "_g", "left_semi")
    if func == "max":
        rows = _least_address(rows, ["_g"])
    groups = rows.groupBy("_g").agg(*_folds(func))
    if named is not None:
        groups = named.join(groups, "_g", "left")
    if most is not None and named is None:  # at most ``most`` + 1 rows, so one task may count them
        held = groups.limit(most + 1).withColumn("_all", F.count("*").over(Window.partitionBy()))
        refused = F.raise_error(F.lit(f"more than {most} groups")).cast("boolean")
        groups = held.filter(F.when(F.col("_all") > most, refused).otherwise(True))
    shown = [F.col("_g.rank").alias("value_rank"), F.col("_g.num").alias("value_num"), F.col("_g.txt").alias("value_txt")]
    return groups.select(*shown, *_result(func)).orderBy("value_rank", "value_num", "value_txt")


def count_by(nodes: DataFrame, field: str, values: list | None = None, **scope) -> DataFrame:
    return aggregate_by(nodes, field, "count", values=values, **scope)
