"""Declared indexes and references: uniqueness, referential checks and cascades.

Checks are set-based: duplicates by a pre-aggregated count, orphans by an anti
join, closures by a loop of joins that only carries newly found addresses.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.errors import Conflict, Invalid, ScanLimit
from quillgraph.functions import jsonval as J
from quillgraph.operators.text import indexed_text
from quillgraph.sources.session import keep

MODES = ("ordered", "text", "folded")
ACTIONS = ("cascade", "restrict", "set_null")
MAX_NAME = 64
MAX_VALUE_BYTES = 512
MAX_TEXT_BYTES = 16384


@dataclass(frozen=True)
class Index:
    name: str
    kind: str
    field: str
    unique: bool = False
    mode: str = "ordered"


@dataclass(frozen=True)
class Reference:
    """A child field that names its parent's address, or the value of a unique parent field."""

    name: str
    kind: str
    field: str
    parent_kind: str
    parent_field: str | None = None
    on_delete: str = "restrict"


@dataclass
class Catalog:
    """Declared indexes and references, by name."""

    indexes: dict[str, Index] = field(default_factory=dict)
    references: dict[str, Reference] = field(default_factory=dict)

    def listing(self) -> list[Index]:
        return [self.indexes[n] for n in sorted(self.indexes)]

    def reference_listing(self) -> list[Reference]:
        return [self.references[n] for n in sorted(self.references)]

    def create_index(self, index: Index, nodes: DataFrame) -> Catalog:
        """A new catalog with the index; the same declaration again is fine, existing data must admit it."""
        if not index.name or len(index.name.encode()) > MAX_NAME or index.mode not in MODES or (index.unique and index.mode != "ordered"):
            raise Invalid("bad index name or mode")
        if self.indexes.get(index.name) == index:
            return self
        clash = [i for i in self.indexes.values() if i.name == index.name or (i.kind, i.field, i.mode) == (index.kind, index.field, index.mode)]
        if clash:
            raise Conflict(f"index {clash[0].name} is declared differently")
        rows = nodes.filter(F.col("kind") == index.kind)
        if not rows.filter(too_long(rows, index)).isEmpty():
            raise Conflict("a value is too long for an index")
        if index.unique and not unique_violations(nodes, index.kind, index.field).isEmpty():
            raise Conflict("existing rows are not unique")
        return replace(self, indexes={**self.indexes, index.name: index})

    def drop_index(self, name: str) -> Catalog:
        if name not in self.indexes:
            raise Invalid(f"no index {name}")
        rest = {n: i for n, i in self.indexes.items() if n != name}
        if any(not _served(r, rest) for r in self.references.values()):
            raise Conflict("a reference depends on this index")
        return replace(self, indexes=rest)

    def create_reference(self, ref: Reference, nodes: DataFrame) -> Catalog:
        """A new catalog with the reference, which needs its indexes and data without orphans."""
        if ref.on_delete not in ACTIONS:
            raise Invalid(f"on_delete is one of {', '.join(ACTIONS)}")
        if self.references.get(ref.name) == ref:
            return self
        if ref.name in self.references:
            raise Conflict(f"reference {ref.name} is declared differently")
        if not _served(ref, self.indexes):
            raise Invalid("a reference needs an index on its field and a unique one on the parent's field")
        if not reference_violations(nodes, ref).isEmpty():
            raise Conflict("existing rows name parents that do not exist")
        return replace(self, references={**self.references, ref.name: ref})

    def drop_reference(self, name: str) -> Catalog:
        if name not in self.references:
            raise Invalid(f"no reference {name}")
        return replace(self, references={n: r for n, r in self.references.items() if n != name})

    def check(self, nodes: DataFrame, touched: DataFrame | None = None) -> None:
        """Refuse a state that breaks a constraint; ``touched`` addresses bound the work to what a batch changed."""
        for i in self.indexes.values():
            written = nodes.filter(F.col("kind") == i.kind)
            if touched is not None:
                written = written.join(touched.select("address"), "address", "left_semi")
            if not written.filter(too_long(written, i)).isEmpty():
                raise Conflict(f"a value is too long for index {i.name}")
            if i.unique:
                rows = nodes.filter(F.col("kind") == i.kind).withColumn("_k", J.okey(i.field, nodes.columns))
                if touched is not None:
                    rows = rows.join(rows.join(touched.select("address"), "address", "left_semi").select("_k").distinct(), "_k", "left_semi")
                if not rows.groupBy("_k").count().filter("count > 1").isEmpty():
                    raise Conflict(f"index {i.name} is unique")
        for r in self.references.values():
            if not reference_violations(nodes, r, touched).isEmpty():
                raise Conflict(f"reference {r.name}: no such parent")


def _served(ref: Reference, indexes: dict[str, Index]) -> bool:
    ordered = [i for i in indexes.values() if i.mode == "ordered"]
    child = any((i.kind, i.field) == (ref.kind, ref.field) for i in ordered)
    parent = ref.parent_field is None or any(i.unique and (i.kind, i.field) == (ref.parent_kind, ref.parent_field) for i in ordered)
    return child and parent


def too_long(rows: DataFrame, index: Index) -> Column:
    """Whether a row's value exceeds what its index may store; a folded index stores the lowered text."""
    if index.mode == "ordered":
        return F.octet_length(J.field(index.field, rows.columns).txt) > MAX_VALUE_BYTES
    return F.coalesce(F.octet_length(indexed_text(rows, index.field, index.mode == "folded")) > MAX_TEXT_BYTES, F.lit(False))


def entries(nodes: DataFrame, index: Index) -> DataFrame:
    """The distinct values that an index holds."""
    return nodes.filter(F.col("kind") == index.kind).select(J.okey(index.field, nodes.columns).alias("k")).distinct()


def bound_rows(nodes: DataFrame, ref: Reference) -> DataFrame:
    """Addresses of the rows that name a parent."""
    return _children(nodes, ref).select("address")


def unique_violations(nodes: DataFrame, kind: str, field: str) -> DataFrame:
    """Values that more than one row of a kind has (absent and null are values): rank, num, txt, rows."""
    rows = nodes.filter(F.col("kind") == kind).select(J.okey(field, nodes.columns).alias("k"))
    return rows.groupBy("k").agg(F.count("*").alias("rows")).filter("rows > 1").select("k.rank", "k.num", "k.txt", "rows")


def _parents(nodes: DataFrame, ref: Reference) -> DataFrame:
    rows = nodes.filter(F.col("kind") == ref.parent_kind)
    key = J.Val(F.lit(J.STRING), F.lit(0.0), F.col("address")).key() if ref.parent_field is None else J.okey(ref.parent_field, nodes.columns)
    return rows.select(key.alias("_p"), F.col("address").alias("_parent"))


def _children(nodes: DataFrame, ref: Reference) -> DataFrame:
    """Rows that name a parent; null and absent name none."""
    rows = nodes.filter(F.col("kind") == ref.kind).withColumn("_p", J.okey(ref.field, nodes.columns))
    return rows.filter(~F.col("_p.rank").isin(J.NULL, J.ABSENT))


def reference_violations(nodes: DataFrame, ref: Reference, touched: DataFrame | None = None) -> DataFrame:
    """Addresses of children whose parent does not exist."""
    children = _children(nodes, ref)
    if touched is not None:
        children = children.join(touched.select("address"), "address", "left_semi")
    return children.join(_parents(nodes, ref), "_p", "left_anti").select("address")


def children_of(nodes: DataFrame, ref: Reference, gone: DataFrame) -> DataFrame:
    """Addresses of the rows that name a row of ``gone`` (addresses) as parent."""
    parents = _parents(nodes, ref).join(gone.select(F.col("address").alias("_parent")), "_parent", "left_semi")
    return _children(nodes, ref).join(parents.select("_p").distinct(), "_p", "left_semi").select("address")


def children_with_parent(nodes: DataFrame, ref: Reference, parents: DataFrame) -> DataFrame:
    """The rows that name a parent of a request-sized list (_parent, and its value as _rank, _num, _txt), with ``_parent``."""
    keys = parents.select("_parent", J.Val(F.col("_rank"), F.col("_num"), F.col("_txt")).key().alias("_p"))
    return _children(nodes, ref).join(F.broadcast(keys), "_p").drop("_p")


@dataclass
class Closure:
    deleted: DataFrame
    nulled: dict[str, DataFrame]


def _with_names(rows: DataFrame, references: list[Reference]) -> DataFrame:
    """address, kind and, per reference, the value by which children name the row (NULL where it is no parent)."""
    names = []
    for i, ref in enumerate(references):
        own = J.Val(F.lit(J.STRING), F.lit(0.0), F.col("address")).key() if ref.parent_field is None else J.okey(ref.parent_field, rows.columns)
        names.append(F.when(F.col("kind") == ref.parent_kind, own).alias(f"n{i}"))
    return rows.select("address", "kind", *names)


def _naming(nodes: DataFrame, ref: Reference, gone: DataFrame, place: int) -> DataFrame:
    """The rows whose reference names a row of ``gone``; only the child's kind is read."""
    keys = gone.filter(F.col(f"n{place}").isNotNull()).select(F.col(f"n{place}").alias("_p")).distinct()
    return _children(nodes, ref).join(keys, "_p", "left_semi")


def delete_closure(nodes: DataFrame, references: list[Reference], targets: DataFrame, checkpoint=None, most: int | None = None) -> Closure:
    """All that goes when ``targets`` (addresses) go, and per reference the rows whose field becomes null.

    Breadth first; each round joins only what the last one added, reads only
    kinds that can name it, and is written to a table of its own, so cycles end
    and nothing is computed or rewritten twice. ``checkpoint`` (a function of a
    DataFrame) does the writing. A restricted child that does not go itself
    refuses the whole.
    """
    cut = checkpoint or keep
    start = nodes.join(targets.select("address").distinct(), "address", "left_semi")
    rounds = [cut(_with_names(start, references))]
    while True:
        kinds = {r.kind: r["count"] for r in rounds[-1].groupBy("kind").count().collect()}  # one row a kind
        if most is not None and (most := most - sum(kinds.values())) < 0:
            raise ScanLimit("a delete would reach more rows than it may")
        found = [_with_names(_naming(nodes, r, rounds[-1], i), references) for i, r in enumerate(references) if r.on_delete == "cascade" and r.parent_kind in kinds]
        if not found:
            break
        fresh = found[0]
        for more in found[1:]:
            fresh = fresh.unionByName(more)
        fresh = fresh.dropDuplicates(["address"]) if len(found) > 1 else fresh
        for done in rounds:
            fresh = fresh.join(done.select("address"), "address", "left_anti")
        rounds.append(cut(fresh))
    gone = rounds[0]
    for more in rounds[1:]:
        gone = gone.unionByName(more)
    nulled = {}
    for i, r in enumerate(references):
        if r.on_delete == "cascade":
            continue
        left = _naming(nodes, r, gone, i).select("address").join(gone.select("address"), "address", "left_anti")
        if r.on_delete == "restrict" and not left.isEmpty():
            raise Conflict(f"reference {r.name} restricts the delete")
        if r.on_delete == "set_null":
            nulled[r.name] = left
    return Closure(gone.select("address"), nulled)


def restrict_blockers(nodes: DataFrame, ref: Reference, targets: DataFrame) -> DataFrame:
    """The children that keep ``targets`` from being deleted."""
    return children_of(nodes, ref, targets).join(targets.select("address"), "address", "left_anti")
