"""Order, errors, pages, aggregates, text and constraints on small hand-made nodes."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.errors import Conflict, Invalid, Precondition, ScanLimit, TooOld
from quillgraph.functions import jsonval as J
from quillgraph.functions.lower import simple_lower
from quillgraph.model import Requester
from quillgraph.operators import aggregate as A
from quillgraph.operators import changes as C
from quillgraph.operators import feed, graph, integrity, mutate, stats
from quillgraph.operators import query as Q
from quillgraph.operators import text as X
from quillgraph.plans import expr as E
from quillgraph.sources import store
from quillgraph.sources.session import cut

ZERO = (0, 0, 0, 0)


def make(spark, rows, kind="K"):
    """Nodes from (address, data) or (address, data, kind, owner, visibility)."""
    full = []
    for r in rows:
        address, data, *rest = r
        k, owner, sight = (*rest, *(kind, "app", "Public")[len(rest) :])
        full.append((address, ZERO, 0, k, data if isinstance(data, str) or data is None else json.dumps(data, ensure_ascii=False), owner, None, sight))
    return spark.createDataFrame(full, model.NODE)


def addresses(df):
    return [r.address for r in df.collect()]


#: JSON values from least to greatest; a row without the field comes last.
ASCENDING = ["null", "false", "true", "-7.25e12", "-40", "-3.75", "0", "0.125", "6", "18", "45.5", "3e18", '""', '"delta"', '"delta-2"', '"epsilon"', '"z\\t"', "[7]", '{"k":1}']


@pytest.mark.parametrize("desc", [False, True])
def test_total_order_of_mixed_values(spark, desc):
    rows = [(f"a{i:02d}", f'{{"f":{v}}}') for i, v in enumerate(ASCENDING)] + [(f"a{len(ASCENDING):02d}", "{}")]
    nodes = make(spark, rows[::-1])
    got = addresses(Q.ordered(nodes, Q.Query(order="f", desc=desc)))
    assert got == sorted((r[0] for r in rows), reverse=desc)


def test_pages_reach_null_and_absent_rows(spark):
    nodes = cut(make(spark, [(f"n{i}", d) for i, d in enumerate(['{"s":1}', '{"s":1}', '{"s":null}', '{"s":null}', "{}", "{}", "not json", '{"s":2}'])]))
    for desc in (False, True):
        whole = addresses(Q.ordered(nodes, Q.Query(order="s", desc=desc)))
        for stored, ahead in ((nodes, 1), (nodes, 3), (J.declare(nodes, "s"), 1), (J.declare(nodes, "s"), 100)):
            got = list(Q.pages(stored, Q.Query(order="s", limit=1, desc=desc), ahead=ahead))
            assert [r.address for p in got for r in p.rows] == whole and len(whole) == len(got) == 8 and not got[-1].next
            assert [r.address for p in Q.pages(stored, Q.Query(order="s", limit=3, desc=desc), ahead=ahead, most=2) for r in p.rows] == whole[:6]
    assert list(Q.pages(nodes.limit(0), Q.Query())) == [Q.Page()]


def test_walk_holds_no_rows_on_the_driver(spark, tmp_path, monkeypatch):
    values = ['"b"', "true", "null", "-1.5", "7", '"a"', "[1]"]
    nodes = make(spark, [(f"n{i}", "{}" if i % 9 == 8 else f'{{"s":{values[i % 7]}}}', "Item") for i in range(150)])
    store.write_nodes(nodes.repartition(5), str(tmp_path / "nodes"), ("s",), order="key_s")
    stored = store.read_nodes(spark, str(tmp_path / "nodes"))
    for rows, change in ((nodes, {}), (stored, {}), (stored, {"desc": True}), (stored, {"order": "id"}), (stored, {"offset": 40}), (stored, {"where": E.op(E.get("s"), "!=", None)})):
        q = Q.Query(**{"order": "s", "limit": 4, **change})
        want = [r.address for p in Q.pages(rows, q, ahead=5) for r in p.rows]
        with monkeypatch.context() as patch:  # what makes up a walk is written where it is found
            patch.setattr(Q, "_cut", None)
            got = Q.walk(rows, q, ahead=5).orderBy("place").collect()
        assert [r.address for r in got] == want and [r.place for r in got] == list(range(1, len(want) + 1)) and len(want) > 100
    # fences that lie anywhere change what a step reads, never what a walk finds
    monkeypatch.setattr(Q, "_fences", lambda *_: [((1, 0.0, "", "n3"), 9), ((1, 0.0, "", "n4"), 99), ((4, 0.0, "a", "zz"), 9), ((4, 0.0, "b", "n1"), 9), ((4, 0.0, "b", "n2"), 99)])
    got = Q.walk(stored, Q.Query(order="s", limit=7)).orderBy("place").collect()
    assert [r.address for r in got] == addresses(Q.ordered(nodes, Q.Query(order="s"))) and len(got) == 150
    assert not Q.walk(nodes.limit(0), Q.Query()).count() and not Q.walk(nodes, Q.Query(limit=0)).count()


def test_equal_keys_fill_many_files(spark, tmp_path):
    nodes = make(spark, [(f"n{i:05d}", "{}") for i in range(2000)])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_nodes(nodes, str(tmp_path / "nodes"), ("s",), order="key_s")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = store.read_nodes(spark, str(tmp_path / "nodes")).groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 1500


def test_cursor_and_bounds(spark):
    nodes = make(spark, [("a", "{}")])
    for bad in ("!!", "e30", "x" * 5000):
        with pytest.raises(Invalid):
            Q.ordered(nodes, Q.Query(cursor=bad))
    with pytest.raises(Invalid):
        Q.ordered(nodes, Q.Query(offset=10_001))
    with pytest.raises(Invalid):
        Q.multi_get(nodes, ["a"] * 1001)
    assert Q.run(nodes, Q.Query(limit=0)) == Q.Page([], "")


def test_errors_follow_evaluation(spark):
    nodes = make(spark, [("a", {"n": 1}), ("b", {"n": "x"}), ("c", {})])
    with pytest.raises(Exception, match="needs numbers"):
        Q.matching(nodes, where=E.op(E.get("n"), "<", 5)).collect()
    guarded = E.op(E.un("!", E.op(E.get("n"), "in", E.lit(["x", None]))), "&&", E.op(E.get("n"), "<", 5))
    assert addresses(Q.matching(nodes, where=guarded)) == ["a"]
    other = make(spark, [("a", {"n": 1}), ("z", {"n": "x"}, "Other")])
    assert addresses(Q.matching(other, kind="K", where=E.op(E.get("n"), "<", 5))) == ["a"]
    hidden = make(spark, [("a", {"n": 1}), ("z", {"n": "x"}, "K", "ana", "Private")])
    assert addresses(Q.matching(hidden, Requester("bo"), where=E.op(E.get("n"), "<", 5))) == ["a"]
    with pytest.raises(Exception, match="division by zero"):
        Q.matching(make(spark, [("a", {"n": 0})]), where=E.op(E.op(1, "/", E.get("n")), ">", 0)).collect()
    assert addresses(Q.matching(nodes, where=E.lit(5))) == []


@pytest.mark.parametrize(
    "bad",
    [
        E.Expr("filter"), E.Expr("ref", name="item"), E.get("x", "other"), E.Expr("call", name="upper", args=[E.lit("a")]),
        E.Expr("call", name="lower"), E.op(1, "~", 2), E.un("+", E.lit(1)), E.op(E.get("x"), "in", 3), E.op(E.get("x"), "in", E.lit(list(range(1001)))),
    ],
)
def test_refused_predicates(spark, bad):
    with pytest.raises(Invalid):
        Q.matching(make(spark, [("a", "{}")]), where=bad)


def test_shape_bounds(spark):
    deep = E.lit(True)
    for _ in range(64):
        deep = E.un("!", deep)
    with pytest.raises(Invalid):
        E.validate(deep)
    with pytest.raises(Invalid):
        E.validate(E.Expr("call", name="lower", args=[E.lit(1)] * 256))


def test_field_array_membership_and_arithmetic(spark):
    nodes = make(spark, [("a", {"t": ["x", 1], "v": "x"}), ("b", {"t": [2], "v": 2.0}), ("c", {"t": [], "v": None})])
    assert addresses(Q.matching(nodes, where=E.op(E.get("v"), "in", E.get("t")))) == ["a", "b"]
    big = make(spark, [("a", {"n": 1e308})])
    assert addresses(Q.matching(big, where=E.op(E.op(E.get("n"), "*", 10), "==", None))) == ["a"]


def test_literals_by_declared_type():
    assert E.literal_value(E.Expr("lit", vtype="int", val=2.9)) == 2 and E.literal_value(E.Expr("lit", vtype="int", val="2")) is None
    assert E.literal_value(E.Expr("lit", vtype="text", val=2)) == "2" and E.literal_value(E.Expr("lit", vtype="bool", val=1)) is False


def test_lower(spark):
    texts = ["İZMİR Lights", "\u212b", "ΣΊΣΥΦΟΣ", "ÜNAL"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(simple_lower(F.col("t")).alias("l"))
    assert [r.l for r in df.collect()] == ["izmir lights", "å", "σίσυφοσ", "ünal"]


@pytest.mark.parametrize(
    "number, text",
    [
        ("5", "5"), ("1.0", "1.0"), ("12345678.25", "12345678.25"), ("-0.5", "-0.5"), ("9007199254740993", "9007199254740993"), ("1e7", "10000000.0"),
        ("1.5e15", "1500000000000000.0"), ("1e16", "1e16"), ("2.5e-3", "0.0025"), ("1e-4", "0.0001"), ("1e-6", "1e-6"), ("18446744073709551615", "18446744073709551615"),
        ("null", ""), ("true", "true"), ('"ÄB"', "äb"), ('[1,"X"]', '[1,"x"]'),
    ],
)
def test_lower_reads_the_json_text(spark, number, text):
    nodes = make(spark, [("a", f'{{"v":{number}}}')])
    assert addresses(Q.matching(nodes, where=E.op(E.lower(E.get("v")), "==", text))) == ["a"]


@pytest.mark.parametrize("name", ["a]b", "it's", 'say "x"', "back\\slash", "[0]", "dot.ted", "$", "ключ"])
def test_any_field_name_is_read(spark, name):
    nodes = make(spark, [("a", {name: 7, "other": 1}), ("b", {"other": 7})])
    assert addresses(Q.matching(nodes, where=E.op(E.get(name), "==", 7))) == ["a"]
    assert [(r.value_rank, r.result_int) for r in A.count_by(nodes, name).collect()] == [(J.NUMBER, 1), (J.ABSENT, 1)]


TICKETS = [
    ("Ticket:a", {"desk": "north", "minutes": 15, "grade": 2.5}), ("Ticket:b", {"desk": "north", "minutes": 45, "grade": 7.5}),
    ("Ticket:c", {"desk": "south", "minutes": 20, "grade": 1.25}), ("Ticket:d", {"desk": "south", "minutes": 5, "grade": 6.0}),
    ("Ticket:e", {"desk": "south", "grade": 3.0}), ("Ticket:f", {"desk": "west", "minutes": 60, "grade": 9.5}), ("Draft:1", {"desk": "west", "minutes": "n/a"}, "Draft"),
]


def test_aggregates(spark):
    nodes = make(spark, [(*r, "Ticket")[:3] for r in TICKETS])
    one = lambda *a, **k: A.aggregate(nodes, *a, kind="Ticket", **k).first()
    south = E.op(E.get("desk"), "==", "south")
    assert one("sum", "minutes", where=south).result_int == 25 and one("count", where=south).result_int == 3
    assert one("sum", "minutes").result_int == 145 and one("sum", "grade").result_int is None
    assert one("avg", "minutes", where=south).result_num == pytest.approx(12.5)
    assert (one("min", "minutes").result_int, one("max", "minutes").result_int) == (5, 60)
    assert (one("min", "desk").result_txt, one("max", "desk").result_txt) == ("north", "west")
    with pytest.raises(Exception, match="not a number"):
        A.aggregate(nodes, "sum", "minutes", kind="Draft").collect()
    for bad in (("sum", None), ("count", "minutes"), ("median", "minutes")):
        with pytest.raises(Invalid):
            A.aggregate(nodes, *bad)
    big = make(spark, [("a", '{"n":9223372036854775807}'), ("b", '{"n":1}')])
    r = A.aggregate(big, "sum", "n").first()
    assert r.result_int is None and r.result_num == pytest.approx(2.0**63)


def test_groups(spark):
    votes = make(spark, [(f"v{i}", {"poll": p}) for i, p in enumerate([8, 8, 5, 8, 5, 2, 2, 2, 2])])
    named = {r.value_num: r.result_int for r in A.count_by(votes, "poll", [2, 8, 70, 8.0]).collect()}
    assert named == {2.0: 4, 8.0: 3, 70.0: 0}
    assert [r.result_int for r in A.count_by(votes, "nothing").collect()] == [9]
    assert A.count_by(votes, "poll", []).count() == 0
    with pytest.raises(Invalid):
        A.count_by(votes, "poll", list(range(1001)))
    with pytest.raises(Exception, match="more than 2 groups"):
        A.aggregate_by(votes, "poll", most=2).collect()
    assert A.aggregate_by(votes, "poll", most=3).count() == 3 and A.count_by(votes, "poll", [2, 5, 8], most=2).count() == 3
    mixed = make(spark, [("a", "{}"), ("b", '{"g":null}'), ("c", '{"g":1}'), ("d", '{"g":1.0}')])
    assert [(r.value_rank, r.result_int) for r in A.count_by(mixed, "g").collect()] == [(1, 1), (3, 2), (6, 1)]


#: Both cases of plain, accented and oddly mapped letters, a row shorter than a gram, an empty one and one that is no text.
BODIES = ["Green Valley", "GREEN VALLEY", "Ünal Çelik", "ünal çelik", "İZMİR", "\u212bngström", "ΣΊΣΥΦΟΣ", "mnopqrmn", "", "xy", 7]


@pytest.mark.parametrize("folded", [False, True])
def test_index_changes_no_answer(spark, folded):
    nodes = cut(make(spark, [(f"t{i:02d}", {"body": b}) for i, b in enumerate(BODIES)]))
    body = E.lower(E.get("body")) if folded else E.get("body")
    index = {("body", folded): cut(X.postings(nodes, "K", "body", folded))}
    for test, needle in (
        ("contains", "green"), ("contains", "çelik"), ("contains", "σίσυφοσ"), ("starts_with", "ünal"), ("ends_with", "qrmn"), ("contains", ""),
        ("contains", "a needle that is longer than any row"),
    ):
        where = E.op(body, test, needle)
        assert sorted(addresses(X.search(nodes, where, "K", index))) == sorted(addresses(Q.matching(nodes, kind="K", where=where))), (test, needle)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=20), st.text(max_size=6), st.text(max_size=20))
def test_needle_grams_are_in_the_haystack(a, needle, b):
    assert set(X.needle_grams([needle], True)) <= set(X.needle_grams([a + needle + b], True))


def test_declared_keys_give_the_same_answers(spark):
    nodes = make(spark, [(f"a{i}", {"s": s}) for i, s in enumerate(["x", "xy", "y", None, 3])])
    keyed = J.declare(nodes, "s")
    for where in (E.op(E.get("s"), "==", "x"), E.op(E.get("s"), "starts_with", "x"), E.op(E.get("s"), "!=", 3)):
        assert addresses(Q.ordered(keyed, Q.Query(where=where, order="s"))) == addresses(Q.ordered(nodes, Q.Query(where=where, order="s")))


#: Two sites with racks, and racks with disks.
TREE = [("Site:n", {}, "Site"), ("Site:s", {}, "Site")]
TREE += [(f"Rack:{i}", {"site": f"Site:{'nns'[i - 1]}"}, "Rack") for i in (1, 2, 3)] + [(f"Disk:{i}", {"rack": f"Rack:{(1, 1, 2, 3)[i - 1]}"}, "Disk") for i in (1, 2, 3, 4)]


def _catalog(nodes, action):
    c = integrity.Catalog()
    for kind, field, parent in (("Rack", "site", "Site"), ("Disk", "rack", "Rack")):
        c = c.create_index(integrity.Index(f"{kind}_i", kind, field), nodes)
        c = c.create_reference(integrity.Reference(f"{kind}_r", kind, field, parent, on_delete=action), nodes)
    return c


def _snapshot(spark, nodes, catalog=None):
    return mutate.Snapshot(nodes, spark.createDataFrame([], model.EDGE), spark.createDataFrame([], model.HISTORY), catalog or integrity.Catalog(), 7)


def test_referential_actions(spark):
    nodes = cut(make(spark, TREE))
    target = spark.createDataFrame([("Site:n",)], "address string")
    after = mutate.delete(_snapshot(spark, nodes, _catalog(nodes, "cascade")), target, cut)
    assert sorted(addresses(after.nodes)) == ["Disk:4", "Rack:3", "Site:s"] and after.history.count() == 6
    with pytest.raises(Conflict):
        mutate.delete(_snapshot(spark, nodes, _catalog(nodes, "restrict")), target, cut)
    nulled = mutate.delete(_snapshot(spark, nodes, _catalog(nodes, "set_null")), target, cut)
    got = {r.address: json.loads(r.data) for r in nulled.nodes.filter("kind = 'Rack'").collect()}
    assert got == {"Rack:1": {"site": None}, "Rack:2": {"site": None}, "Rack:3": {"site": "Site:s"}}
    with pytest.raises(ScanLimit):
        integrity.delete_closure(nodes, list(_catalog(nodes, "cascade").references.values()), target, cut, most=5)
    loop = cut(make(spark, [("N:1", {"up": "N:2"}, "N"), ("N:2", {"up": "N:1"}, "N")]))
    ref = integrity.Reference("r", "N", "up", "N", on_delete="cascade")
    assert integrity.delete_closure(loop, [ref], spark.createDataFrame([("N:1",)], "address string"), cut).deleted.count() == 2


def test_catalog_rules(spark):
    nodes = make(spark, [("a", {"h": "x"}), ("b", {"h": "x"}), ("c", {})])
    c = integrity.Catalog()
    with pytest.raises(Conflict):
        c.create_index(integrity.Index("u", "K", "h", True), nodes)
    with pytest.raises(Conflict):  # two rows without the field conflict as well
        c.create_index(integrity.Index("u", "K", "other", True), nodes)
    c = c.create_index(integrity.Index("i", "K", "h"), nodes)
    assert c.create_index(integrity.Index("i", "K", "h"), nodes) is c
    with pytest.raises(Conflict):
        c.create_index(integrity.Index("j", "K", "h", True), nodes)
    with pytest.raises(Invalid):
        c.create_reference(integrity.Reference("r", "K", "h", "P", "name"), nodes)
    with pytest.raises(Conflict):
        c.create_reference(integrity.Reference("r", "K", "h", "P"), nodes)


def test_unique_on_write(spark):
    nodes = make(spark, [("a", {"h": "x"}), ("b", {"h": "y"})])
    s = _snapshot(spark, nodes, integrity.Catalog().create_index(integrity.Index("u", "K", "h", True), nodes))
    with pytest.raises(Conflict):
        mutate.upsert(s, make(spark, [("c", {"h": "x"})]))
    moved = mutate.upsert(s, make(spark, [("a", {"h": "y"}), ("b", {"h": "x"})]))
    assert moved.history.count() == 2 and mutate.upsert(s, make(spark, [("a", {"h": "x", "more": 1})])).nodes.count() == 2


def test_transactions_hold_entirely_or_not(spark):
    s = _snapshot(spark, make(spark, [("a", {"n": 1}, "K", "ana"), ("b", {"n": 2}, "K", "bo")]))
    ana = Requester("ana")
    out = mutate.transaction(s, [{"op": "set_if", "address": "a", "expect": {"field": "n", "expect_le": 1}, "set": {"n": 5}}, {"op": "update_node", "address": "a", "data": '{"n":6}'}], ana)
    assert json.loads(out.nodes.filter("address = 'a'").first().data) == {"n": 6}
    for ops, error in (
        ([{"op": "set_if", "address": "a", "expect": {"field": "n", "expect_eq": 1.0}, "set": {}}], Precondition),
        ([{"op": "insert_node", "node": {"address": "b", "kind": "K"}}], Conflict),
        ([{"op": "insert_edge", "from": "a", "to": "nobody", "kind": "k"}], Conflict),
        ([{"op": "fly"}], Invalid),
    ):
        with pytest.raises(error):
            mutate.transaction(s, ops, ana)
    cleared = mutate.transaction(s, [{"op": "clear_kind", "kind": "K"}], ana)
    assert addresses(cleared.nodes) == ["b"]


ANA, BO = Requester("ana"), Requester("bo")


def _insert(address, kind="K", data="{}"):
    return {"op": "insert_node", "node": {"address": address, "kind": kind, "data": data}}


def _edge(op, a, b, kind="k"):
    return {"op": op, "from": a, "to": b, "kind": kind}


def _state(s):
    edges = sorted((r["from"], r["to"], r["kind"], r["owner"]) for r in s.edges.collect())
    return {r.address: json.loads(r.data) for r in s.nodes.collect()}, edges, sorted((r.address, r.version) for r in s.history.collect())


@pytest.fixture(scope="module")
def staged(spark):
    nodes = cut(make(spark, [("a", {"n": 1}, "K", "ana"), ("b", {"n": 2}, "K", "bo"), ("c", {"n": 3}, "L", "ana")]))
    edges = cut(spark.createDataFrame([("a", "c", "k", "ana"), ("b", "c", "k", "bo")], model.EDGE))
    return mutate.Snapshot(nodes, edges, spark.createDataFrame([], model.HISTORY), integrity.Catalog(), 7)


def test_transactions_resolve_in_order(staged):
    clear, n = {"op": "clear_kind", "kind": "K"}, {"b": {"n": 2}, "c": {"n": 3}}
    kept = [("a", "c", "k", "ana"), ("b", "c", "k", "bo")]
    run = lambda *ops, who=ANA: _state(mutate.transaction(staged, list(ops), who))
    # a node inserted after a clear stays, one inserted before it goes
    assert run(clear, _insert("d")) == ({**n, "d": {}}, kept, [("a", 1)])
    assert run(_insert("d"), clear) == (n, kept, [("a", 1), ("d", 1)])
    # a clear reads what the batch wrote, its predicate too
    where = {"op": "clear_kind", "kind": "K", "where": {"kind": "bin", "op": "==", "l": {"kind": "get", "obj": {"kind": "ref", "name": "item"}, "field": "n"}, "r": {"kind": "lit", "val": 9}}}
    assert run({"op": "update_node", "address": "a", "data": '{"n":9}'}, where)[0] == n
    assert run(where)[0] == {"a": {"n": 1}, **n}
    # each state that a node had is archived
    twice = [{"op": "update_node", "address": "a", "data": f'{{"n":{i}}}'} for i in (5, 6)]
    assert run(*twice)[2] == [("a", 1), ("a", 2)] and run(*twice)[0]["a"] == {"n": 6}
    # removing what an earlier operation removed is nothing more to do
    gone = {"op": "delete_node", "address": "a"}
    assert run(gone, gone, clear)[0] == n and run(gone, _insert("a"))[0] == {"a": {}, **n}
    # edges: put and cut in order, cut twice, an end that comes earlier, the asker's own
    assert run(_edge("insert_edge", "a", "c"), _edge("delete_edge", "a", "c"))[1] == kept[1:]
    assert run(_edge("delete_edge", "a", "c"), _edge("delete_edge", "a", "c"))[1] == kept[1:]
    assert run(_edge("delete_edge", "a", "c"), _edge("insert_edge", "a", "c"))[1] == kept
    assert run(_insert("d"), {**_edge("insert_edge", "a", "d"), "owner": "bo"})[1] == [kept[0], ("a", "d", "k", "ana"), kept[1]]
    assert run(_edge("delete_edge", "b", "c"), who=Requester("root", admin=True))[1] == kept[:1]


@pytest.mark.parametrize(
    "ops, error",
    [
        ([{"op": "clear_kind", "kind": "K"}, {"op": "update_node", "address": "a", "data": "{}"}], Precondition),
        ([{"op": "delete_node", "address": "a"}, {"op": "set_if", "address": "a", "expect": {"field": "n", "expect_le": 9}, "set": {}}], Precondition),
        ([{"op": "delete_node", "address": "nobody"}], Precondition),
        ([{"op": "delete_node", "address": "b"}], Conflict),
        ([_insert("b")], Conflict),
        ([_edge("delete_edge", "b", "c")], Conflict),
        ([_edge("delete_edge", "a", "b")], Conflict),
        ([_edge("insert_edge", "a", "d"), _insert("d")], Conflict),
        ([{"op": "delete_node", "address": "c"}, _edge("insert_edge", "a", "c")], Conflict),
        ([{"op": "set_if", "address": "a", "expect": {"field": "n"}, "set": {}}], Invalid),
        ([_insert("e", data="[1]"), {"op": "set_if", "address": "e", "expect": {"field": "n", "expect_absent": True}, "set": {}}], Invalid),
    ],
)
def test_transactions_refuse(staged, ops, error):
    with pytest.raises(error):
        mutate.transaction(staged, ops, ANA)


def test_transactions_follow_references(spark, monkeypatch):
    nodes = cut(make(spark, TREE))
    run = lambda action, *ops: _state(mutate.transaction(_snapshot(spark, nodes, _catalog(nodes, action)), list(ops)))
    site, rack = {"op": "delete_node", "address": "Site:n"}, {"op": "delete_node", "address": "Rack:3"}
    got, _, archived = run("cascade", site)
    assert sorted(got) == ["Disk:4", "Rack:3", "Site:s"] and len(archived) == 6
    # a child that the batch wrote goes too, one that it moved away stays
    moved = {"op": "update_node", "address": "Rack:2", "data": '{"site":"Site:s"}'}
    added = _insert("Rack:9", "Rack", '{"site":"Site:n"}')
    assert sorted(run("cascade", moved, added, site)[0]) == ["Disk:3", "Disk:4", "Rack:2", "Rack:3", "Site:s"]
    # restricted where it stands, whatever follows in the batch
    for after in ({"op": "delete_node", "address": "Disk:4"}, _insert("Rack:3", "Rack", '{"site":"Site:s"}')):
        with pytest.raises(Conflict):
            run("restrict", rack, after)
    assert "Rack:3" not in run("restrict", {"op": "delete_node", "address": "Disk:4"}, rack)[0]
    got, _, archived = run("set_null", site)
    assert got["Rack:1"] == got["Rack:2"] == {"site": None} and archived == [("Rack:1", 1), ("Rack:2", 1), ("Site:n", 1)]
    # constraints hold for the batch as a whole
    assert "Rack:8" in run("restrict", _insert("Rack:8", "Rack", '{"site":"Site:x"}'), _insert("Site:x", "Site"))[0]
    with pytest.raises(Conflict):
        run("restrict", _insert("Rack:8", "Rack", '{"site":"Site:x"}'))
    # the bound counts what the operations become
    monkeypatch.setattr(model, "MAX_MUTATIONS", 11)
    with pytest.raises(Invalid):
        run("cascade", site)


def test_a_batch_settles_repeated_addresses(spark):
    s = _snapshot(spark, make(spark, [("a", {"n": 1})]))
    batch = make(spark, [("b", {"n": 2}), ("b", {"n": 3}), ("b", {"n": 1})])
    with pytest.raises(Invalid):
        mutate.upsert(s, batch)
    after = mutate.upsert(s, batch.withColumn("at", J.field("n").num), order="at")
    assert {r.address: json.loads(r.data) for r in after.nodes.collect()} == {"a": {"n": 1}, "b": {"n": 3}}


def test_compare_and_set_compares_whole_numbers_exactly(spark):
    s = _snapshot(spark, make(spark, [("a", '{"n":9007199254740993,"u":18446744073709551615,"f":1.0}')]))
    for name, want in (("n", 9007199254740993), ("u", 18446744073709551615), ("f", 1.0)):
        expect = {"field": name, "expect_eq": want}
        assert json.loads(mutate.set_if(s, "a", expect, {"ok": 1}).nodes.first().data)["ok"] == 1
        mutate.transaction(s, [{"op": "set_if", "address": "a", "expect": expect, "set": {}}])
    for name, want in (("n", 9007199254740992), ("u", 18446744073709551614), ("f", 1), ("n", 9007199254740993.0)):
        expect = {"field": name, "expect_eq": want}
        with pytest.raises(Precondition):
            mutate.set_if(s, "a", expect, {})
        with pytest.raises(Precondition):
            mutate.transaction(s, [{"op": "set_if", "address": "a", "expect": expect, "set": {}}])


def test_set_if_claim_and_sequences(spark):
    s = _snapshot(spark, make(spark, [("a", {"n": 1, "k": [1]}, "K", "ana")]))
    out = mutate.set_if(s, "a", {"field": "m", "expect_absent": True}, {"m": "x"})
    assert json.loads(out.nodes.first().data) == {"n": 1, "k": [1], "m": "x"}
    for expect in ({"field": "n", "expect_eq": 1.0}, {"field": "n", "expect_le": 0}, {"field": "n", "expect_absent": True}):
        with pytest.raises(Precondition):
            mutate.set_if(s, "a", expect, {})
    claimed = mutate.claim(s, "a", Requester("bo"))
    with pytest.raises(Conflict):
        mutate.claim(claimed, "a", Requester("eve"))
    one, first = mutate.next_block(s, "n", 10, Requester("ana"))
    two, second = mutate.next_block(one, "n", 5, Requester("ana"))
    assert (first, second) == (1, 11)
    with pytest.raises(Conflict):
        mutate.next_block(two, "n", 1, Requester("bo"))
    with pytest.raises(Invalid):
        mutate.next_block(s, "a:b", 1, Requester("ana"))


def test_edges(spark):
    nodes = make(spark, [("a", {}), ("b", {}), ("c", {})])
    edges = spark.createDataFrame([("a", "b", "zz", "ana"), ("a", "c", "y", "ana"), ("a", "gone", "y", "ana")], model.EDGE)
    assert [(r.kind, r.to) for r in graph.out_edges(edges, "a").collect()] == [("y", "c"), ("y", "gone"), ("zz", "b")]
    assert addresses(graph.expand(edges, nodes, "a")) == ["c", "b"]
    with pytest.raises(Conflict):
        graph.put_edges(edges, spark.createDataFrame([("a", "b", "zz", "bo")], model.EDGE), nodes, Requester("bo"))
    with pytest.raises(Conflict):
        graph.drop_edges(edges, spark.createDataFrame([("x", "y", "z")], "`from` string, `to` string, kind string"))


def _log(spark, rows):
    return spark.createDataFrame([(s, t, op, a, "K", "ana", "Public") for s, t, op, a in rows], model.LOG)


def test_change_units(spark):
    log = _log(spark, [
        (1, 0, "Insert", "a"), (2, 5, "Begin", None), (3, 5, "Archive", "a"), (4, 5, "Delete", "a"), (5, 5, "Insert", "a"), (6, 5, "Delete", "zz"), (7, 5, "Commit", None),
        (8, 6, "Insert", "lost"), (9, 0, "Archive", "b"), (10, 7, "Archive", "a"), (11, 7, "Insert", "a"), (12, 7, "Commit", None), (13, 8, "Insert", "late"),
    ])
    got = [(r.seq, r.change) for r in C.committed_changes(log).orderBy("seq").collect()]
    assert got == [(1, "created"), (4, "deleted"), (5, "created"), (11, "updated")]
    page = C.page(log, after=0, limit=2)
    assert [r.seq for r in page.changes.orderBy("seq").collect()] == [1, 4, 5] and page.next == 5 and not page.complete
    assert C.page(log, after=5, limit=2).complete
    with pytest.raises(TooOld):
        C.page(log.filter("sequence > 5"), after=2)
    with pytest.raises(Invalid):
        C.page(log, limit=0)


def test_feed(spark):
    events = spark.range(1, 21).select(F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, "ana").alias("audience"))
    assert feed.resume(events, 15, Requester("bo"), ring=10).count() == 2
    with pytest.raises(TooOld):
        feed.resume(events, 5, ring=10)
    assert feed.resume(events, None).count() == 0
    df = spark.createDataFrame([('{"a":1,"seq":9}',), ("[1]",), ("text",)], "p string").select(feed.inject_seq(F.col("p"), F.lit(3).cast("long")).alias("p"))
    assert [r.p for r in df.collect()] == ['{"a":1,"seq":3}', "[1]", "text"]


def test_snapshots_are_published_by_a_pointer(spark, tmp_path):
    s = _snapshot(spark, make(spark, [("a", {"n": 1})]))
    root = f"file://{tmp_path}"
    store.write_snapshot(s, root, 1, ("n",))
    assert store.current(spark, root) is None
    store.publish(spark, root, 1)
    assert addresses(Q.matching(store.read_snapshot(spark, root).nodes, kind="K", where=E.op(E.get("n"), "==", 1))) == ["a"]
    with pytest.raises(Conflict):
        store.write_snapshot(s, root, 1)
    store.write_snapshot(mutate.upsert(s, make(spark, [("b", {})])), root, 2)
    store.publish(spark, root, 2)
    assert store.read_snapshot(spark, root).nodes.count() == 2 and store.read_snapshot(spark, root, 1).nodes.count() == 1


def test_backup_and_restore(spark, tmp_path):
    root, copy = f"file://{tmp_path}/store", f"file://{tmp_path}/copy"
    s = mutate.upsert(_snapshot(spark, make(spark, [("a", {"n": 1}), ("b", {"n": 2}, "7")])), make(spark, [("a", {"n": 3})]))
    store.backup(s, copy)
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        store.backup(s, copy)
    assert store.restore(spark, copy, root, ("n",)) == 1 and store.restore(spark, copy, root) == 2
    back = store.read_snapshot(spark, root, 1)
    assert {(r.address, r.kind, r.data) for r in back.nodes.collect()} == {("a", "K", '{"n": 3}'), ("b", "7", '{"n": 2}')}
    assert [(r.address, r.version, json.loads(r.node.data)) for r in back.history.collect()] == [("a", 1, {"n": 1})]
    with pytest.raises(Invalid):
        store.restore(spark, f"file://{tmp_path}/nothing", root)


def test_catalog_is_taken_apart(spark):
    nodes = cut(make(spark, TREE))
    c = _catalog(nodes, "cascade")
    assert [r.name for r in c.reference_listing()] == ["Disk_r", "Rack_r"] and [i.name for i in c.listing()] == ["Disk_i", "Rack_i"]
    with pytest.raises(Conflict):
        c.drop_index("Rack_i")
    for name in ("Rack_r", "Disk_r"):
        c = c.drop_reference(name)
    assert not c.drop_index("Rack_i").drop_index("Disk_i").listing()
    for drop in (c.drop_index, c.drop_reference):
        with pytest.raises(Invalid):
            drop("nothing")


def test_text_indexes_refuse_long_texts(spark):
    long = "x" * (integrity.MAX_TEXT_BYTES + 1)
    for mode in ("text", "folded"):
        index = integrity.Index("t", "K", "body", mode=mode)
        with pytest.raises(Conflict):
            integrity.Catalog().create_index(index, make(spark, [("a", {"body": long})]))
        nodes = make(spark, [("a", {"body": long[:-1]})])
        s = _snapshot(spark, nodes, integrity.Catalog().create_index(index, nodes))
        with pytest.raises(Conflict):
            mutate.upsert(s, make(spark, [("b", {"body": long})]))
        assert mutate.upsert(s, make(spark, [("b", {"body": 5}), ("c", {"body": long}, "Other")])).nodes.count() == 3


def test_inserts_with_edges_and_updates(spark):
    s = _snapshot(spark, make(spark, [("a", {"n": 1}, "K", "ana"), ("b", {}, "K", "bo")]))
    node, edge = make(spark, [("c", {}, "K", "ana")]), lambda *ends: spark.createDataFrame([(*ends, "k", "ana")], model.EDGE)
    out = mutate.insert_with_edges(s, node, edge("c", "a"), ANA)
    assert _state(out)[1] == [("c", "a", "k", "ana")] and out.nodes.count() == 3
    for bad, options in ((edge("c", "nobody"), {}), (edge("b", "a"), {"node": make(spark, [("b", {}, "K", "ana")])}), (edge("a", "b"), {"node": make(spark, [("a", {}, "K", "ana")]), "if_absent": True})):
        with pytest.raises(Conflict):
            mutate.insert_with_edges(s, options.pop("node", node), bad, ANA, **options)
    changed = mutate.update(s, "a", '{"n":2}', ANA, visibility="Private")
    row = changed.nodes.filter("address = 'a'").first()
    assert (json.loads(row.data), row.visibility, changed.history.count()) == ({"n": 2}, "Private", 1)
    for address, who in (("nobody", ANA), ("b", ANA)):
        with pytest.raises(Precondition):
            mutate.update(s, address, "{}", who)


def test_publishing_and_rendering(spark):
    assert feed.publish('{"a":1}', ANA) == ('{"a":1}', "ana") and feed.publish("x", model.ADMIN) == ("x", None)
    with pytest.raises(Invalid):
        feed.publish("x" * (model.MAX_PAYLOAD_BYTES + 1), ANA)
    rows = make(spark, [("a", {"n": 1}, "K", "ana", "Private"), ("b", {})])
    assert [json.loads(r.json)["address"] for r in Q.to_json_rows(rows).collect()] == ["a", "b"]
    assert [r.h for r in rows.select(feed.node_audience().alias("h")).collect()] == ["ana", None]
    assert {r.kind: r.nodes for r in stats.kind_tally(rows, BO).collect()} == {"K": 1}
    spot = spark.range(1).select(model.coordinate(*(F.lit(v) for v in (0, 255, 7, 1))).alias("c"))
    assert tuple(spot.first().c) == (0, 255, 7, 1)
    with pytest.raises(Exception, match="0..255"):
        spark.range(1).select(model.coordinate(*(F.lit(v) for v in (0, 256, 7, 1))).alias("c")).collect()


def test_traffic_beyond_the_slots_shares_a_row(spark):
    rows = spark.range(10).select(F.struct(F.col("id").alias("x")).alias("coordinate"), F.lit(1).alias("reads"), F.lit(2).alias("writes"), F.lit(3).alias("bytes"))
    got = {r.coordinate.x if r.coordinate else None: (r.reads, r.writes, r.bytes) for r in stats.cell_traffic(rows, slots=4).collect()}
    assert got == {None: (6, 12, 18), **{i: (1, 2, 3) for i in range(4)}}


def test_the_stream_forgets_what_can_never_commit(spark, tmp_path):
    from quillgraph.streaming.changes import stream_changes

    for i in range(3):  # transaction 9 stays open
        rows = [(100 * i + 1, 9 if i == 0 else 0, "Insert", f"a{i}"), (100 * i + 2, 0, "Insert", f"b{i}")]
        _log(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    got = stream_changes(spark, f"{tmp_path}/log", f"{tmp_path}/kept", retain=150)
    assert sorted(r.address for r in got.collect()) == ["a1", "a2", "b0", "b1", "b2"]
    left = lambda work, batch: spark.read.schema(model.LOG).parquet(f"{tmp_path}/{work}/state/{batch}").count()
    assert (left("kept", 1), left("kept", 2)) == (1, 0)
    stream_changes(spark, f"{tmp_path}/log", f"{tmp_path}/all")
    assert left("all", 2) == 1


def _pushed(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    text = df._jdf.queryExecution().executedPlan().toString()
    return text[text.index("PushedFilters") :]


def test_tests_on_stored_keys_reach_the_scan(spark, tmp_path):
    store.write_nodes(make(spark, [(f"a{i:03d}", {"s": f"t{i}", "n": i}) for i in range(50)]), f"{tmp_path}/n", ("s", "n"))
    nodes = spark.read.parquet(f"{tmp_path}/n")
    for where, parts in (
        (E.op(E.get("s"), "==", "t7"), ("EqualTo(key_s.txt,t7)",)),
        (E.op(E.get("s"), "starts_with", "t1"), ("StringStartsWith(key_s.txt,t1)",)),
        (E.all_of(E.op(E.get("n"), ">", 4), E.op(E.get("n"), "<=", 9)), ("GreaterThan(key_n.num,4.0)", "LessThanOrEqual(key_n.num,9.0)", "Not(EqualTo(key_n.rank,3))")),
    ):
        rows = Q.matching(nodes, kind="K", where=where).select("address")
        assert all(p in _pushed(rows) for p in parts), _pushed(rows)
        assert sorted(addresses(rows)) == sorted(addresses(Q.matching(nodes.drop("key_s", "key_n"), kind="K", where=where)))
        assert "data" not in _pushed(rows).split("ReadSchema")[1]
    assert "EqualTo(address,a007)" in _pushed(Q.point_get(nodes, "a007"))
    page = Q.run(nodes, Q.Query(order="n", limit=10))
    assert "GreaterThanOrEqual(key_n.num,9.0)" in _pushed(Q.page_frame(nodes, Q.Query(order="n", cursor=page.next)))
    # a row on which a comparison fails is not filtered away
    odd = make(spark, [("a", {"n": 1, "s": "x"}), ("b", {"n": "text", "s": "y"})])
    store.write_nodes(odd, f"{tmp_path}/odd", ("s", "n"))
    for where in (E.op(E.get("n"), ">", 5), E.all_of(E.op(E.get("n"), ">", 0), E.op(E.get("s"), "==", "x"))):
        with pytest.raises(Exception, match="needs numbers"):
            Q.matching(spark.read.parquet(f"{tmp_path}/odd"), where=where).collect()


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    from quillgraph.sources import catalog

    plan = Q.matching(catalog.nodes(spark, sf_dir), kind="Order", where=E.op(E.get("o_custkey"), "==", 3)).select("address")
    text = plan._jdf.queryExecution().toString()
    assert "customer.parquet" not in text and "Python" not in text and "l_orderkey" not in text.split("Physical Plan")[1]
