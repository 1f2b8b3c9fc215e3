"""Transactions: operations resolved one by one, each against what the earlier ones left.

The staged view is the snapshot overlaid with the batch's own writes. What a
batch names is read at once; what a bulk delete or a cascade reaches is read by
one join a level, over the stored rows that the batch has not touched. All of
it is held on the driver, which the bound on a batch's mutations keeps small.
Constraints are checked on the net effect; restricted deletes are refused where
they stand. Only then is the overlay laid over the snapshot, in one pass.
"""

from __future__ import annotations

import json
import math
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.errors import Conflict, Invalid, Precondition
from quillgraph.functions import jsonval as J
from quillgraph.model import ADMIN, NODE_COLUMNS, Requester
from quillgraph.operators.graph import KEY
from quillgraph.operators.integrity import Reference, children_with_parent
from quillgraph.operators.query import matching
from quillgraph.operators.snapshot import Snapshot
from quillgraph.plans import expr as E

_BLANK = {"coordinate": {c: 0 for c in "xyzq"}, "value": 0, "data": "{}", "claimed_by": None, "visibility": model.PRIVATE}


def body_of(data: str | None) -> dict:
    """A node's data as an object; empty text and null are an empty one."""
    if not (data or "").strip():
        return {}
    try:
        body = json.loads(data)
    except ValueError as e:
        raise Invalid("the node's data is not JSON") from e
    if body is None:
        return {}
    if not isinstance(body, dict):
        raise Invalid("the node's data is not a JSON object")
    return body


def same_json(a, b) -> bool:
    """Equality of JSON values: 1, 1.0 and true are three."""
    if type(a) is not type(b):
        return False
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same_json(a[k], b[k]) for k in a)
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same_json, a, b))
    return a == b


def expectation(expect: dict) -> str:
    """Which of the three tests a compare-and-set request makes."""
    tests = [k for k in ("expect_le", "expect_eq", "expect_absent") if k in expect]
    if len(tests) != 1 or not expect.get("field"):
        raise Invalid("set_if takes one of expect_le, expect_eq, expect_absent, and a field")
    return tests[0]


def holds(body: dict, expect: dict) -> bool:
    test, name = expectation(expect), expect["field"]
    have = body.get(name)
    if test == "expect_absent":
        return have is None
    if test == "expect_le":
        return isinstance(have, (int, float)) and not isinstance(have, bool) and math.isfinite(have) and float(have) <= float(expect[test])
    return name in body and same_json(have, expect[test])


class Staged:
    """A snapshot overlaid with a batch's writes: nodes by address, edges by key; None is removed."""

    def __init__(self, s: Snapshot, ops: list[dict], who: Requester):
        self.s, self.who = s, who
        self.spark = s.nodes.sparkSession
        self.nodes: dict[str, dict | None] = {}
        self.edges: dict[tuple, dict | None] = {}
        self.archived: list[dict] = []
        self.written: set[str] = set()
        self.mutations = 0
        keys = {(o["from"], o["to"], o["kind"]) for o in ops if o.get("op") in ("insert_edge", "delete_edge")}
        named = {o["address"] for o in ops if "address" in o} | {o["node"]["address"] for o in ops if "node" in o} | {a for k in keys for a in k[:2]}
        found = s.nodes.join(F.broadcast(self._addresses(named)), "address", "left_semi")
        self.stored = {r.address: r.asDict(recursive=True) for r in found.select(NODE_COLUMNS).collect()} if named else {}
        self.stored_edges = {}
        if keys:
            wanted = self.spark.createDataFrame(sorted(keys), "`from` string, `to` string, kind string")
            rows = s.edges.join(F.broadcast(wanted), KEY, "left_semi").select("from", "to", "kind", "owner").collect()
            self.stored_edges = {(r["from"], r["to"], r["kind"]): r.asDict() for r in rows}

    def _addresses(self, addresses) -> DataFrame:
        return self.spark.createDataFrame([(a,) for a in sorted(addresses)], "address string")

    def node(self, address: str) -> dict | None:
        return self.nodes[address] if address in self.nodes else self.stored.get(address)

    def edge(self, key: tuple) -> dict | None:
        return self.edges[key] if key in self.edges else self.stored_edges.get(key)

    def _count(self, n: int) -> None:
        self.mutations += n
        if self.mutations > model.MAX_MUTATIONS:
            raise Invalid(f"the batch resolves to more than {model.MAX_MUTATIONS} mutations")

    def put(self, node: dict) -> None:
        if (old := self.node(node["address"])) is not None:
            self.archived.append(old)
        self.nodes[node["address"]] = node
        self.written.add(node["address"])
        self._count(1 + (old is not None))

    def remove(self, node: dict) -> None:
        self.archived.append(node)
        self.nodes[node["address"]] = None
        self._count(2)

    def owned(self, address: str, node: dict) -> dict:
        if not self.who.admin and node["owner"] != self.who.owner:
            raise Conflict(f"{address} belongs to another owner")
        return node

    # -- operations

    def insert_node(self, o: dict) -> None:
        given = o["node"]
        owner = given.get("owner", self.who.owner) if self.who.admin else self.who.owner
        old = self.node(given["address"])
        if old is not None and old["owner"] != owner:
            raise Conflict(f"{given['address']} belongs to another owner")
        self.put({**_BLANK, **given, "owner": owner})

    def update_node(self, o: dict) -> None:
        if (old := self.node(o["address"])) is None:
            raise Precondition(f"no node {o['address']}")
        self.put({**self.owned(o["address"], old), "data": o["data"]})

    def set_if(self, o: dict) -> None:
        if (old := self.node(o["address"])) is None:
            raise Precondition(f"no node {o['address']}")
        body = body_of(self.owned(o["address"], old)["data"])
        if not holds(body, o["expect"]):
            raise Precondition("the test failed")
        self.put({**old, "data": json.dumps({**body, **o["set"]}, ensure_ascii=False)})

    def delete_node(self, o: dict) -> None:
        address = o["address"]
        if address in self.nodes and self.nodes[address] is None:
            return  # an earlier operation removed it
        if (old := self.node(address)) is None:
            raise Precondition(f"no node {address}")
        self.delete([self.owned(address, old)])

    def clear_kind(self, o: dict) -> None:
        where = E.Expr.of(o["where"]) if o.get("where") else None
        view = self._untouched()
        if mine := [tuple(n[c] for c in NODE_COLUMNS) for n in self.nodes.values() if n is not None]:
            view = view.unionByName(self.spark.createDataFrame(mine, model.NODE))
        rows = matching(view.filter(self.who.can_write()), ADMIN, o["kind"], None, where)
        found = rows.limit(model.MAX_MUTATIONS + 1).collect()
        self.delete(sorted((r.asDict(recursive=True) for r in found), key=lambda n: n["address"]))

    def insert_edge(self, o: dict) -> None:
        for end in ("from", "to"):
            if self.node(o[end]) is None:
                raise Conflict(f"an edge's end does not exist: {o[end]}")
        self.edges[o["from"], o["to"], o["kind"]] = {"from": o["from"], "to": o["to"], "kind": o["kind"], "owner": self.who.owner}
        self._count(1)

    def delete_edge(self, o: dict) -> None:
        key = (o["from"], o["to"], o["kind"])
        if key in self.edges and self.edges[key] is None:
            return
        if (old := self.edge(key)) is None:
            raise Conflict("no such edge")
        self.owned("the edge", old)
        self.edges[key] = None
        self._count(1)

    # -- deletes and what follows from them

    def _untouched(self) -> DataFrame:
        rows = self.s.nodes.select(NODE_COLUMNS)
        return rows.join(F.broadcast(self._addresses(self.nodes)), "address", "left_anti") if self.nodes else rows

    def _stored_children(self, level: list[dict]) -> dict[tuple, list[dict]]:
        """By (reference, parent's address): the stored rows that name a node of the level and that the batch has not touched."""
        out: dict[tuple, list[dict]] = {}
        for ref in self.s.catalog.references.values():
            parents = [(n["address"], *key) for n in level if n["kind"] == ref.parent_kind and (key := _named(n, ref)) is not None]
            if parents:
                wanted = self.spark.createDataFrame(parents, "_parent string, _rank int, _num double, _txt string")
                rows = children_with_parent(self._untouched(), ref, wanted).limit(model.MAX_MUTATIONS + 1).collect()
                for r in sorted(rows, key=lambda r: r.address):
                    d = r.asDict(recursive=True)
                    out.setdefault((ref.name, d.pop("_parent")), []).append(d)
                    self.stored.setdefault(r.address, d)
        return out

    def _children(self, ref: Reference, parent: dict, stored: dict[tuple, list[dict]]) -> list[dict]:
        """The nodes that name ``parent`` by now, the batch's own among them."""
        key = _named(parent, ref)
        if key is None:
            return []
        found = {n["address"]: n for n in stored.get((ref.name, parent["address"]), []) if n["address"] not in self.nodes}
        found |= {a: n for a, n in self.nodes.items() if n is not None and n["kind"] == ref.kind and _value(n, ref.field) == key}
        return [found[a] for a in sorted(found)]

    def delete(self, seeds: list[dict]) -> None:
        """Remove the nodes and, breadth first, what their references entail."""
        level, removed = seeds, set()
        while level:
            stored, following = self._stored_children(level), deque()
            for node in level:
                if node["address"] in removed:
                    continue
                removed.add(node["address"])
                self.remove(node)
                for ref in self.s.catalog.references.values():
                    if ref.parent_kind != node["kind"]:
                        continue
                    children = [c for c in self._children(ref, node, stored) if c["address"] not in removed]
                    if children and ref.on_delete == "restrict":
                        raise Conflict(f"reference {ref.name} restricts the delete: {children[0]['address']} names {node['address']}")
                    if ref.on_delete == "cascade":
                        following.extend(children)
                    elif ref.on_delete == "set_null":
                        for c in children:
                            self.put({**c, "data": json.dumps({**body_of(c["data"]), ref.field: None}, ensure_ascii=False)})
            # a later set_null may have rewritten what an earlier node's cascade found
            level = [self.node(c["address"]) or c for c in following]

    # -- the result

    def result(self) -> Snapshot:
        s, schema = self.s, model.NODE
        puts = [n for a, n in self.nodes.items() if n is not None and a in self.written]
        nodes = self._untouched()
        if puts:
            nodes = nodes.unionByName(self.spark.createDataFrame([tuple(n[c] for c in NODE_COLUMNS) for n in puts], schema))
        s.catalog.check(nodes, self._addresses(n["address"] for n in puts))
        history = s.history
        if self.archived:
            touched = {n["address"] for n in self.archived}
            last = s.history.join(F.broadcast(self._addresses(touched)), "address", "left_semi").groupBy("address").agg(F.max("version").alias("v"))
            version = {r.address: r.v for r in last.collect()}
            rows = []
            for n in self.archived:
                version[n["address"]] = version.get(n["address"], 0) + 1
                rows.append((n["address"], s.now, tuple(n[c] for c in NODE_COLUMNS), version[n["address"]]))
            history = history.unionByName(self.spark.createDataFrame(rows, model.HISTORY).select(history.columns))
        edges = s.edges
        if self.edges:
            keys = self.spark.createDataFrame(sorted(self.edges), "`from` string, `to` string, kind string")
            edges = edges.join(F.broadcast(keys), KEY, "left_anti").select(s.edges.columns)
            if kept := [tuple(e[c] for c in model.EDGE.fieldNames()) for e in self.edges.values() if e is not None]:
                edges = edges.unionByName(self.spark.createDataFrame(kept, model.EDGE).select(s.edges.columns))
        return Snapshot(nodes, edges, history, s.catalog, s.now)


def _value(node: dict, field: str) -> tuple | None:
    """The key of a field, None where it names no parent (null, absent, data that is no object)."""
    try:
        body = json.loads(node["data"] or "")
    except ValueError:
        return None
    if not isinstance(body, dict) or body.get(field) is None:
        return None
    return J.parts(body[field])


def _named(parent: dict, ref: Reference) -> tuple | None:
    """The value by which children name this node."""
    return J.parts(parent["address"]) if ref.parent_field is None else _value(parent, ref.parent_field)


OPERATIONS = ("insert_node", "update_node", "delete_node", "set_if", "clear_kind", "insert_edge", "delete_edge")


def transaction(s: Snapshot, ops: list[dict], who: Requester = ADMIN) -> Snapshot:
    """Resolve operations in order against what earlier ones staged; all hold or none does.

    insert_node (replaces a node of the same owner), update_node, delete_node,
    set_if, clear_kind (with an optional where), insert_edge, delete_edge. Who
    asks owns what they insert; an admin may name another owner of a node.
    """
    if len(ops) > model.MAX_MUTATIONS:
        raise Invalid(f"at most {model.MAX_MUTATIONS} mutations in a batch")
    for o in ops:
        if o.get("op") not in OPERATIONS:
            raise Invalid(f"unknown operation {o.get('op')!r}")
    view = Staged(s, ops, who)
    for o in ops:
        getattr(view, o["op"])(o)
    return view.result()
