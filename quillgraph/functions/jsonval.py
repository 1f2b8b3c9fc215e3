"""JSON values as three plain columns with one total order.

A value is (rank, num, txt): absent 6, null 1, bool 2, number 3, string 4,
array or object 5. Comparing the three in turn is the total order; equality of
all three is group identity. Nothing of it needs Python or a VARIANT compare,
so it sorts, groups, joins and pushes down like any columns. A field that was
stored as a declared key column (``key_<field>``) is read from there.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL, BOOL, NUMBER, STRING, COMPOSITE, ABSENT = 1, 2, 3, 4, 5, 6


@dataclass
class Val:
    """A value as columns; none of the three is ever SQL NULL."""

    rank: Column
    num: Column
    txt: Column
    whole: Column | None = None

    def key(self) -> Column:
        if self.whole is not None:
            return self.whole
        return F.struct(self.rank.cast("int").alias("rank"), self.num.cast("double").alias("num"), self.txt.alias("txt"))


def parts(value) -> tuple[int, float, str]:
    """A Python JSON value's (rank, num, txt)."""
    if value is None:
        return NULL, 0.0, ""
    if isinstance(value, bool):
        return BOOL, float(value), ""
    if isinstance(value, (int, float)):
        return NUMBER, float(value), ""
    if isinstance(value, str):
        return STRING, 0.0, value
    return COMPOSITE, 0.0, json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def literal(value) -> Val:
    return Val(*map(F.lit, parts(value)))


def absent() -> Val:
    return Val(F.lit(ABSENT), F.lit(0.0), F.lit(""))


def key_column(field: str) -> str:
    return f"key_{field}"


def int_column(field: str) -> str:
    """Beside a declared key: the value where it is a whole number of 64 bits, which a double may not hold."""
    return f"int_{field}"


def member(parsed: Column, field: str) -> Column:
    """A parsed object's member as VARIANT: SQL NULL where absent, a variant null where null."""
    if not field or any(c in field for c in "\"'[]\\"):  # a path cannot name these
        return F.get(F.map_values(F.map_filter(F.try_variant_get(parsed, "$", "map<string,variant>"), lambda k, _: k == field)), 0)
    return F.variant_get(parsed, f'$["{field}"]', "variant")


def variant_field(data: Column, field: str) -> Column:
    """A field of a JSON text as VARIANT; absent where the text is no JSON object."""
    return member(F.try_parse_json(data), field)


def json_type(v: Column) -> Column:
    """VOID, BOOLEAN, BIGINT, DECIMAL(..), DOUBLE, STRING, ARRAY<..> or OBJECT<..>; NULL where absent."""
    return F.schema_of_variant(v)


def rank_of(kind: Column) -> Column:
    return (
        F.when(kind.isNull(), ABSENT)
        .when(kind == "VOID", NULL)
        .when(kind == "BOOLEAN", BOOL)
        .when((kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL"), NUMBER)
        .when(kind == "STRING", STRING)
        .otherwise(COMPOSITE)
    )


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: the optimizer would else copy its expression to each place of use."""
    return F.get(F.transform(F.array(value), body), 0)


def of_variant(v: Column) -> Val:
    """A VARIANT's parts; parsed, and its type taken, once a row."""
    k = let(v, lambda x: let(json_type(x), lambda kind: _key(x, kind)))
    return Val(k["rank"], k["num"], k["txt"], k)


def _key(v: Column, kind: Column) -> Column:
    rank = rank_of(kind)
    num = F.when(rank == NUMBER, F.try_variant_get(v, "$", "double")).when(
        rank == BOOL, F.try_variant_get(v, "$", "boolean").cast("int").cast("double")
    )
    txt = F.when(rank == STRING, F.try_variant_get(v, "$", "string")).when(rank == COMPOSITE, F.to_json(v))
    return Val(rank, F.coalesce(num, F.lit(0.0)), F.coalesce(txt, F.lit(""))).key()


def field(name: str, columns: list[str] = (), data: str = "data") -> Val:
    """A top-level field of the JSON text in ``data``."""
    if key_column(name) in columns:
        k = F.col(f"`{key_column(name)}`")
        return Val(k["rank"], k["num"], k["txt"], k)
    return of_variant(variant_field(F.col(data), name))


def okey(name: str, columns: list[str] = ()) -> Column:
    """The field's order key: a struct to sort and group by."""
    return field(name, columns).key()


def is_int(v: Column) -> Column:
    """Whether a VARIANT is a whole number of at most 64 bits, with or without sign; a longer one reads as a double."""
    kind = json_type(v)
    wide = F.try_variant_get(v, "$", "decimal(38,0)") <= F.lit(Decimal(2**64 - 1)).cast("decimal(38,0)")
    return F.coalesce((kind == "BIGINT") | (kind.isin("DECIMAL(19,0)", "DECIMAL(20,0)") & wide), F.lit(False))


def double_text(x: Column) -> Column:
    """A double's JSON text: its shortest digits, plain from 1e-5 up to 1e16."""
    size, text = F.abs(x), x.cast("string")
    trimmed = lambda scale: F.regexp_replace(x.cast(f"decimal(38,{scale})").cast("string"), r"(\.\d+?)0+$", "$1")
    return (
        F.when(size.between(1e-5, 1e-3), trimmed(30))
        .when((size >= 1e7) & (size < 1e16), trimmed(10))
        .otherwise(F.regexp_replace(text, r"(\.0)?E", "e"))
    )


def whole(v: Column) -> Column:
    """A VARIANT's value as BIGINT where it is a whole number, else NULL."""
    return F.when(is_int(v), F.try_variant_get(v, "$", "bigint"))


def declare(nodes: DataFrame, *fields: str) -> DataFrame:
    """Add a key column per field (and its whole number): parsed once a row, stored typed, usable for pruning and push-down."""
    new = [f for f in fields if key_column(f) not in nodes.columns]
    if not new:
        return nodes

    def parts_of(parsed: Column) -> Column:
        found = [let(member(parsed, f), lambda v: F.struct(of_variant(v).key().alias("key"), whole(v).alias("int"))) for f in new]
        return F.struct(*(c.alias(f"f{i}") for i, c in enumerate(found)))

    rows = nodes.withColumn("_keys", let(F.try_parse_json(F.col("data")), parts_of))
    columns = [F.col(f"_keys.f{i}.{part}").alias(name(f)) for i, f in enumerate(new) for part, name in (("key", key_column), ("int", int_column))]
    return rows.select(*nodes.columns, *columns)


def to_python(rank: int, num: float, txt: str):
    """A key's parts as a Python JSON value (None for null and absent)."""
    if rank == BOOL:
        return bool(num)
    if rank == NUMBER:
        return int(num) if num == int(num) and abs(num) < 1 << 53 else num
    if rank == STRING:
        return txt
    return json.loads(txt) if rank == COMPOSITE else None
