"""One query per operator over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions import jsonval as J
from quillgraph.model import MAX_LIMIT, Requester
from quillgraph.operators import aggregate as A
from quillgraph.operators import changes as C
from quillgraph.operators import feed, graph, integrity, mutate, stats
from quillgraph.operators import query as Q
from quillgraph.operators import text as X
from quillgraph.plans import expr as E
from quillgraph.sources import catalog as src
from quillgraph.sources import stored as db
from quillgraph.sources.session import cut, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORD = """o AS (SELECT 'Order:' || o_orderkey AS address, 'cust:' || o_custkey AS owner,
  CASE WHEN o_orderstatus <> 'P' THEN 'Public' ELSE 'Private' END AS visibility, orders.*,
  strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders)"""
MIX = """x AS (SELECT 'Mixed:' || o_orderkey AS address,
  [6, 1, 4, 3, 3, 2][(o_orderkey % 6 + 1)::INT] AS r,
  CASE o_orderkey % 6 WHEN 3 THEN o_totalprice WHEN 4 THEN o_orderkey % 100 WHEN 5 THEN (o_orderkey % 4 = 1)::INT ELSE 0 END::DOUBLE AS n,
  CASE WHEN o_orderkey % 6 = 2 THEN o_orderpriority ELSE '' END AS s, o_orderkey FROM orders)"""
SPARSE = """p AS (SELECT 'Sparse:' || o_orderkey AS address, CASE o_orderkey % 5 WHEN 0 THEN 6 WHEN 1 THEN 1 ELSE 4 END AS r,
  CASE WHEN o_orderkey % 5 > 1 THEN o_orderstatus ELSE '' END AS s, CASE WHEN o_orderkey % 5 > 1 THEN o_custkey END AS t,
  CASE WHEN o_orderstatus <> 'P' THEN 'Public' ELSE 'Private' END AS visibility, 'cust:' || o_custkey AS owner FROM orders)"""
LOG = """e AS (SELECT event_id, user_id, event_type, 'User:' || user_id AS address, 'u:' || user_id % 10 AS owner, event_id // 10 + 1 AS unit,
    lag(event_id) OVER w AS prev_id, lag(event_type) OVER w AS prev_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
h AS (SELECT *, prev_id IS NOT NULL AND prev_type <> 'error' AS had FROM e),
ch AS (SELECT event_id * 4 + 2 AS seq, CASE WHEN event_type = 'error' THEN 'deleted' WHEN had THEN 'updated' ELSE 'created' END AS change,
    address, owner, CASE WHEN (CASE WHEN event_type = 'error' THEN prev_id ELSE event_id END) % 4 = 0 THEN 'Private' ELSE 'Public' END AS visibility, unit
  FROM h WHERE unit % 7 <> 0 AND (event_type <> 'error' OR had))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def ranked(rows: DataFrame, *order, keep: tuple = ("address",)) -> DataFrame:
    """A bounded page with its place as ``rn``, for results where order is the point."""
    return rows.withColumn("rn", F.row_number().over(Window.orderBy(*order))).select("rn", *keep)


def as_read(rows: DataFrame) -> DataFrame:
    """A bounded result with the place at which each row comes as ``rn``, where the operator's own order is the point."""
    got = [(i + 1, *r) for i, r in enumerate(rows.collect())]
    return rows.sparkSession.createDataFrame(got, T.StructType([T.StructField("rn", T.LongType()), *rows.schema.fields]))


def result(rows: DataFrame, round_to: int = 2) -> DataFrame:
    return rows.withColumn("result_num", F.round("result_num", round_to))


def where_query(name: str, expr: E.Expr, sql: str, table: str = "order", kind: str = "Order") -> None:
    """A predicate over a whole kind: the addresses that it takes."""
    make = {"order": db.order_nodes, "mixed": db.mixed_nodes, "all": db.nodes, "doc": db.doc_nodes}[table]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Q.matching(make(spark, sf_dir), kind=kind, where=expr).select("address")

    run.__name__ = name
    query(sql)(run)


# -- scans ---------------------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY a) AS rn, a AS address FROM (SELECT 'Customer:' || c_custkey AS a FROM customer ORDER BY 1 LIMIT 50)")
def list_kind_page(spark, sf_dir):
    return ranked(Q.page_frame(db.nodes(spark, sf_dir), Q.Query(kind="Customer")), "address")


@query(f"WITH {ORD} SELECT address FROM o WHERE owner = 'cust:7' UNION ALL SELECT 'Customer:7'")
def list_owner_page(spark, sf_dir):
    return Q.page_frame(db.nodes(spark, sf_dir), Q.Query(owner="cust:7", limit=500)).select("address")


@query(f"WITH {ORD} SELECT address, 'Order' AS kind, owner, visibility, o_orderpriority AS priority FROM o WHERE o_orderkey = 10")
def point_get(spark, sf_dir):
    found = Q.point_get(db.nodes(spark, sf_dir), "Order:10")
    return found.select("address", "kind", "owner", "visibility", J.field("o_orderpriority").txt.alias("priority"))


@query("""SELECT pos, address, kind FROM (VALUES (0, 'Order:12'), (1, 'Customer:3'), (2, 'Nobody:1'), (3, 'Order:12'), (4, 'Region:0')) t(pos, address)
 JOIN (SELECT 'Order:' || o_orderkey AS address, 'Order' AS kind FROM orders UNION ALL SELECT 'Customer:' || c_custkey, 'Customer' FROM customer
  UNION ALL SELECT 'Region:' || r_regionkey, 'Region' FROM region) USING (address)""")
def multi_get_ordered(spark, sf_dir):
    wanted = ["Order:12", "Customer:3", "Nobody:1", "Order:12", "Region:0"]
    return Q.multi_get(db.nodes(spark, sf_dir), wanted).select("pos", "address", "kind")


@query(f"WITH {ORD} SELECT address FROM o WHERE o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 10) UNION ALL SELECT 'Customer:' || o_custkey FROM orders WHERE o_orderkey = 10")
def owned_by_subject(spark, sf_dir):
    return Q.owned_by_subject(db.nodes(spark, sf_dir), "Order:10").select("address")


@query("SELECT * FROM (VALUES ('Customer'), ('Nation'), ('Order'), ('Part'), ('Region'), ('Supplier')) t(kind) JOIN (SELECT 'Order' AS kind, count(*) AS nodes FROM orders UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region) USING (kind)")
def kind_tally(spark, sf_dir):
    return stats.kind_tally(db.nodes(spark, sf_dir))


@query(f"""WITH {ORD} SELECT 'Order' AS kind, count(*) AS nodes FROM o WHERE visibility = 'Public' OR owner = 'cust:7' UNION ALL SELECT 'Customer', count(*) FROM customer
 UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Nation', count(*) FROM nation
 UNION ALL SELECT 'Region', count(*) FROM region""")
def kind_tally_visible(spark, sf_dir):
    return stats.kind_tally(db.nodes(spark, sf_dir), Requester("cust:7"))


@query("""SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier)
  + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS nodes,
 (SELECT count(*) FROM orders) + (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)) + (SELECT count(*) FROM nation)
  + (SELECT count(*) FROM customer) AS edges,
 (SELECT count(*) - count(DISTINCT user_id) FROM events) AS history""")
def stats_counts(spark, sf_dir):
    return stats.counters(db.nodes(spark, sf_dir), db.edges(spark, sf_dir), db.history(spark, sf_dir))


@query("SELECT user_id AS u, version, archived_at_unix FROM (SELECT user_id, row_number() OVER w AS version, lead(event_id) OVER w AS archived_at_unix FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE archived_at_unix IS NOT NULL AND user_id = 8")
def history_of(spark, sf_dir):
    rows = Q.history_of(db.history(spark, sf_dir), db.user_nodes(spark, sf_dir), "User:8")
    return rows.select(F.lit(8).cast("long").alias("u"), "version", "archived_at_unix")


@query("SELECT 'User:' || user_id AS address, count(*) - 1 AS versions FROM events GROUP BY 1 HAVING count(*) > 1")
def history_counts(spark, sf_dir):
    return db.history(spark, sf_dir).groupBy("address").agg(F.count("*").alias("versions"))


# -- predicates ----------------------------------------------------------------------------------------------------

where_query("pred_eq", E.op(E.get("o_orderpriority"), "==", "1-URGENT"), f"WITH {ORD} SELECT address FROM o WHERE o_orderpriority = '1-URGENT'")
where_query("pred_ne_absent", E.op(E.get("m"), "!=", None), f"WITH {MIX} SELECT address FROM x WHERE r NOT IN (1, 6)", "mixed", "Mixed")
where_query("pred_range", E.all_of(E.op(E.get("o_totalprice"), ">", 1000), E.op(E.get("o_totalprice"), "<=", 50000)), f"WITH {ORD} SELECT address FROM o WHERE o_totalprice > 1000 AND o_totalprice <= 50000")
where_query("pred_arith", E.op(E.op(E.op(E.op(E.get("o_totalprice"), "*", 2), "-", 100), "/", 4), ">", 30000), f"WITH {ORD} SELECT address FROM o WHERE (o_totalprice * 2 - 100) / 4 > 30000")
where_query("pred_mod", E.op(E.op(E.un("-", E.get("o_orderkey")), "%", 7), "==", -3), f"WITH {ORD} SELECT address FROM o WHERE o_orderkey % 7 = 3")
where_query("pred_not_or", E.un("!", E.op(E.op(E.get("o_orderstatus"), "==", "F"), "||", E.op(E.get("o_orderpriority"), "==", "5-LOW"))), f"WITH {ORD} SELECT address FROM o WHERE NOT (o_orderstatus = 'F' OR o_orderpriority = '5-LOW')")
where_query("pred_truthy", E.un("!", E.get("m")), f"WITH {MIX} SELECT address FROM x WHERE r IN (1, 6) OR r = 2 AND n = 0", "mixed", "Mixed")
where_query("pred_concat", E.op(E.op(E.get("o_orderstatus"), "+", E.get("o_orderpriority")), "==", "F1-URGENT"), f"WITH {ORD} SELECT address FROM o WHERE o_orderstatus || o_orderpriority = 'F1-URGENT'")
where_query("pred_in", E.op(E.get("m"), "in", E.lit([1, 4.0, "5-LOW", None, True])), f"WITH {MIX} SELECT address FROM x WHERE r = 3 AND n IN (1, 4) OR r = 4 AND s = '5-LOW' OR r IN (1, 6) OR r = 2 AND n = 1", "mixed", "Mixed")
where_query("pred_not_in", E.op(E.get("o_orderpriority"), "not in", E.lit(["1-URGENT", "2-HIGH", 3])), f"WITH {ORD} SELECT address FROM o WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
where_query("pred_starts_with", E.op(E.get("p_name"), "starts_with", "red"), "SELECT 'Part:' || p_partkey AS address FROM part WHERE starts_with(p_name, 'red')", "all", "Part")
where_query("pred_ends_with", E.op(E.get("p_name"), "ends_with", "ring"), "SELECT 'Part:' || p_partkey AS address FROM part WHERE suffix(p_name, 'ring')", "all", "Part")
where_query("pred_contains", E.op(E.get("p_brand"), "contains", "#1"), "SELECT 'Part:' || p_partkey AS address FROM part WHERE contains(p_brand, '#1')", "all", "Part")
where_query("pred_lower_contains", E.op(E.lower(E.get("p_type")), "contains", "econ"), "SELECT 'Part:' || p_partkey AS address FROM part WHERE contains(lower(p_type), 'econ')", "all", "Part")
where_query("pred_short_circuit", E.all_of(E.op(E.get("m"), "!=", None), E.un("!", E.op(E.get("m"), "==", True)), E.un("!", E.op(E.get("m"), "==", False)), E.un("!", E.op(E.get("m"), "contains", "-")), E.op(E.get("m"), ">", 50)), f"WITH {MIX} SELECT address FROM x WHERE r = 3 AND n > 50", "mixed", "Mixed")


# -- order and pages -----------------------------------------------------------------------------------------------


@query(f"WITH {ORD} SELECT row_number() OVER (ORDER BY o_totalprice, address) AS rn, address FROM o QUALIFY rn <= 50")
def order_field_asc(spark, sf_dir):
    return ranked(Q.page_frame(db.order_nodes(spark, sf_dir), Q.Query(order="o_totalprice")), "okey", "address")


@query(f"WITH {ORD} SELECT row_number() OVER (ORDER BY day DESC, address DESC) AS rn, address FROM o QUALIFY rn <= 50")
def order_field_desc(spark, sf_dir):
    return ranked(Q.page_frame(db.order_nodes(spark, sf_dir), Q.Query(order="o_orderdate", desc=True)), F.desc("okey"), F.desc("address"))


@query(f"WITH {MIX} SELECT row_number() OVER (ORDER BY r, n, s, address) AS rn, address FROM x")
def order_mixed_types(spark, sf_dir):
    rows = Q.ordered(db.mixed_nodes(spark, sf_dir), Q.Query(order="m"))
    # the whole order, checked by place: numbered per range partition, not in one task
    return feed.numbered(rows.select("okey", "address"), "okey", "address", buckets=8).select(F.col("seq").alias("rn"), "address")


@query(f"WITH {MIX} SELECT row_number() OVER (ORDER BY r DESC, n DESC, s DESC, address DESC) AS rn, address FROM x QUALIFY rn <= 500")
def order_mixed_types_desc(spark, sf_dir):
    return ranked(Q.page_frame(db.mixed_nodes(spark, sf_dir), Q.Query(order="m", desc=True, limit=500)), F.desc("okey"), F.desc("address"))


@query(f"WITH {ORD} SELECT row_number() OVER (ORDER BY o_orderpriority, address) - 50 AS rn, address FROM o QUALIFY rn BETWEEN 1 AND 50")
def keyset_page_2(spark, sf_dir):
    orders = db.order_nodes(spark, sf_dir)
    first = Q.run(orders, Q.Query(order="o_orderpriority"))
    return ranked(Q.page_frame(orders, Q.Query(order="o_orderpriority", cursor=first.next)), "okey", "address")


@query(f"WITH {MIX} SELECT row_number() OVER (ORDER BY r, n, s, address) AS rn, address FROM x")
def keyset_all_pages(spark, sf_dir):
    """Every page of a whole table, by cursor, to the last."""
    nodes = db.mixed_nodes(spark, sf_dir).select("address", "kind", "owner", "visibility", "key_m")
    return Q.walk(nodes, Q.Query(order="m", limit=MAX_LIMIT), ahead=100).select(F.col("place").cast("int").alias("rn"), "address")


@query(f"WITH {ORD} SELECT row_number() OVER (ORDER BY address) - 100 AS rn, address FROM o QUALIFY rn BETWEEN 1 AND 20")
def offset_page(spark, sf_dir):
    return ranked(Q.page_frame(db.order_nodes(spark, sf_dir), Q.Query(kind="Order", order="id", limit=20, offset=100)), "address")


# -- aggregates ----------------------------------------------------------------------------------------------------

_R = "{} AS result_rank, {} AS result_int, {} AS result_num, {} AS result_txt"


@query(f"WITH {ORD} SELECT {_R.format(3, 'count(*)', 'count(*)::DOUBLE', chr(39) * 2)} FROM o WHERE o_orderpriority = '2-HIGH'")
def agg_count(spark, sf_dir):
    return A.aggregate(db.order_nodes(spark, sf_dir), "count", kind="Order", where=E.op(E.get("o_orderpriority"), "==", "2-HIGH"))


@query(f"SELECT {_R.format(3, 'sum(o_custkey)::BIGINT', 'sum(o_custkey)::DOUBLE', chr(39) * 2)} FROM orders")
def agg_sum_int(spark, sf_dir):
    return A.aggregate(db.order_nodes(spark, sf_dir), "sum", "o_custkey")


@query(f"SELECT {_R.format(3, 'NULL::BIGINT', 'round(sum(o_totalprice), 2)', chr(39) * 2)} FROM orders")
def agg_sum_float(spark, sf_dir):
    return result(A.aggregate(db.order_nodes(spark, sf_dir), "sum", "o_totalprice"))


@query(f"WITH {SPARSE} SELECT {_R.format(3, 'NULL::BIGINT', 'round(avg(t), 4)', chr(39) * 2)} FROM p")
def agg_avg_missing(spark, sf_dir):
    return result(A.aggregate(db.sparse_nodes(spark, sf_dir), "avg", "t"), 4)


@query(f"SELECT {_R.format(4, 'NULL::BIGINT', 'NULL::DOUBLE', 'min(o_orderpriority)')} FROM orders")
def agg_min_text(spark, sf_dir):
    return A.aggregate(db.order_nodes(spark, sf_dir), "min", "o_orderpriority")


@query(f"WITH {MIX} SELECT {_R.format(4, 'NULL::BIGINT', 'NULL::DOUBLE', 'max(s)')} FROM x")
def agg_max_mixed(spark, sf_dir):
    return A.aggregate(db.mixed_nodes(spark, sf_dir), "max", "m")


@query("""WITH n AS (SELECT * FROM orders WHERE o_orderstatus = 'no such')
SELECT 'sum' AS func, 3 AS result_rank, coalesce(sum(o_custkey), 0)::BIGINT AS result_int, coalesce(sum(o_custkey), 0)::DOUBLE AS result_num FROM n
UNION ALL SELECT 'avg', CASE WHEN count(*) = 0 THEN 1 ELSE 3 END, NULL, avg(o_custkey) FROM n
UNION ALL SELECT 'min', CASE WHEN count(*) = 0 THEN 1 ELSE 3 END, min(o_custkey), min(o_custkey)::DOUBLE FROM n
UNION ALL SELECT 'count', 3, count(*), count(*)::DOUBLE FROM n""")
def agg_empty(spark, sf_dir):
    nodes, none = db.order_nodes(spark, sf_dir), E.op(E.get("o_orderstatus"), "==", "no such")
    out = None
    for f in ("sum", "avg", "min", "count"):
        row = A.aggregate(nodes, f, None if f == "count" else "o_custkey", where=none).select(F.lit(f).alias("func"), "result_rank", "result_int", "result_num")
        out = row if out is None else out.union(row)
    return out


@query(f"WITH {ORD} SELECT o_orderstatus AS value_txt, count(*) AS result_int FROM o GROUP BY 1")
def count_by(spark, sf_dir):
    return A.count_by(db.order_nodes(spark, sf_dir), "o_orderstatus").select("value_txt", "result_int")


@query(f"WITH {SPARSE} SELECT r AS value_rank, s AS value_txt, count(*) AS result_int FROM p GROUP BY ALL")
def count_by_null_absent(spark, sf_dir):
    return A.count_by(db.sparse_nodes(spark, sf_dir), "g").select("value_rank", "value_txt", "result_int")


@query(f"WITH {SPARSE}, g AS (SELECT r, s, count(*) AS n FROM p GROUP BY r, s) SELECT row_number() OVER (ORDER BY r, s) AS rn, r AS value_rank, s AS value_txt, n AS result_int FROM g")
def group_order(spark, sf_dir):
    """Groups come in the order of their values: null first, absent last."""
    return as_read(A.count_by(db.sparse_nodes(spark, sf_dir), "g").select("value_rank", "value_txt", "result_int"))


def _by(name: str, func: str, field: str, sql: str, columns: tuple[str, ...], round_to: int = 2) -> None:
    def run(spark, sf_dir):
        return result(A.aggregate_by(db.order_nodes(spark, sf_dir), "o_orderpriority", func, field), round_to).select("value_txt", *columns)

    run.__name__ = name
    query(f"SELECT o_orderpriority AS value_txt, {sql} FROM orders GROUP BY 1")(run)


_by("sum_by", "sum", "o_totalprice", "round(sum(o_totalprice), 2) AS result_num", ("result_num",))
_by("avg_by", "avg", "o_custkey", "round(avg(o_custkey), 4) AS result_num", ("result_num",), 4)
_by("min_by_group", "min", "o_orderdate", "min(strftime(o_orderdate, '%Y-%m-%d')) AS result_txt", ("result_txt",))
_by("max_by_group", "max", "o_orderkey", "max(o_orderkey) AS result_int", ("result_int",))


@query("""SELECT v AS value_txt, coalesce(n, 0) AS result_int, coalesce(s, 0) AS total FROM (VALUES ('F'), ('O'), ('X')) t(v)
 LEFT JOIN (SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS s FROM orders GROUP BY 1) ON v = o_orderstatus""")
def agg_by_named_values(spark, sf_dir):
    nodes, values = db.order_nodes(spark, sf_dir), ["F", "O", "X", "F"]
    n = A.count_by(nodes, "o_orderstatus", values).select("value_txt", "result_int")
    s = A.aggregate_by(nodes, "o_orderstatus", "sum", "o_custkey", values).select("value_txt", F.col("result_int").alias("total"))
    return n.join(s, "value_txt")


@query(f"WITH {ORD} SELECT count(*) AS result_int FROM o WHERE visibility = 'Public' OR owner = 'cust:7'")
def visibility_count(spark, sf_dir):
    return A.aggregate(db.order_nodes(spark, sf_dir), "count", who=Requester("cust:7")).select("result_int")


@query(f"WITH {SPARSE} SELECT r AS value_rank, s AS value_txt, count(*) AS result_int FROM p WHERE visibility = 'Public' OR owner = 'cust:7' GROUP BY ALL")
def visibility_groups(spark, sf_dir):
    return A.count_by(db.sparse_nodes(spark, sf_dir), "g", who=Requester("cust:7")).select("value_rank", "value_txt", "result_int")


# -- graph ---------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT 'FROM' AS kind, 'Nation:' || c_nationkey AS "to" FROM customer WHERE c_custkey = 7 UNION ALL SELECT 'PLACED', 'Order:' || o_orderkey FROM orders WHERE o_custkey = 7)
SELECT row_number() OVER (ORDER BY strlen(kind), kind, "to") AS rn, kind, "to" FROM e""")
def edges_out(spark, sf_dir):
    return as_read(graph.out_edges(db.edges(spark, sf_dir), "Customer:7").select("kind", "to"))


@query("""WITH e AS (SELECT DISTINCT 'CONTAINS' AS kind, 'Order:' || l_orderkey AS "from" FROM lineitem WHERE l_partkey = 5)
SELECT row_number() OVER (ORDER BY strlen(kind), kind, "from") AS rn, kind, "from" FROM e""")
def edges_in(spark, sf_dir):
    return as_read(graph.in_edges(db.edges(spark, sf_dir, "to"), "Part:5").select("kind", "from"))


@query("SELECT 'Nation:' || n_nationkey AS \"from\", 'Region:' || n_regionkey AS \"to\", 'IN' AS kind, 'app' AS owner FROM nation WHERE n_nationkey = 3")
def edge_lookup(spark, sf_dir):
    region = src.table(spark, sf_dir, "nation").filter("n_nationkey = 3").first()["n_regionkey"]
    return graph.find_edge(db.edges(spark, sf_dir), "Nation:3", f"Region:{region}", "IN")


@query(f"WITH {ORD} SELECT 'PLACED' AS edge_kind, address, visibility FROM o WHERE o_custkey = 7 AND (visibility = 'Public' OR owner = 'cust:3') UNION ALL SELECT 'FROM', 'Nation:' || c_nationkey, 'Public' FROM customer WHERE c_custkey = 7")
def expand_one_hop(spark, sf_dir):
    found = graph.expand(db.edges(spark, sf_dir), db.nodes(spark, sf_dir), "Customer:7", Requester("cust:3"))
    return found.select("edge_kind", "address", "visibility")


@query("SELECT 'Customer:' || o_custkey AS address, 'PLACED' AS kind, count(*) AS degree FROM orders GROUP BY 1 UNION ALL SELECT 'Order:' || l_orderkey, 'CONTAINS', count(DISTINCT l_partkey) FROM lineitem GROUP BY 1 UNION ALL SELECT 'Nation:' || n_nationkey, 'IN', 1 FROM nation UNION ALL SELECT 'Customer:' || c_custkey, 'FROM', 1 FROM customer")
def out_degree(spark, sf_dir):
    return graph.degrees(db.edges(spark, sf_dir))


@query("SELECT 'Customer:' || o_custkey AS \"from\", 'Order:' || o_orderkey AS \"to\", 'PLACED' AS kind FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT DISTINCT 'Order:' || l_orderkey, 'Part:' || l_partkey, 'CONTAINS' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW'")
def edges_dangling(spark, sf_dir):
    low = E.op(E.get("o_orderpriority"), "==", "5-LOW")
    nodes = db.nodes(spark, sf_dir)
    gone = Q.matching(nodes, kind="Order", where=low).select("address")
    return graph.dangling(db.edges(spark, sf_dir), nodes.join(gone, "address", "left_anti")).select("from", "to", "kind")


# -- text ----------------------------------------------------------------------------------------------------------


def _text(name: str, needle: str, folded: bool, sql: str) -> None:
    def run(spark, sf_dir):
        nodes = db.doc_nodes(spark, sf_dir)
        body = E.lower(E.get("body")) if folded else E.get("body")
        index = db.doc_postings(spark, sf_dir, folded)
        return X.search(nodes, E.op(body, "contains", needle), "Doc", {("body", folded): index}).select("address")

    run.__name__ = name
    query(sql)(run)


_text("text_candidates_exact", "thing the", False, "SELECT 'Doc:' || doc_id AS address FROM documents WHERE contains(text, 'thing the')")
_text("text_folded_exact", "éau", True, "SELECT 'Doc:' || doc_id AS address FROM documents WHERE contains(lower(text), 'éau')")
where_query("text_scan_short_needle", E.op(E.get("body"), "contains", "ß"), "SELECT 'Doc:' || doc_id AS address FROM documents WHERE contains(text, 'ß')", "doc", "Doc")


# -- constraints ---------------------------------------------------------------------------------------------------

CUSTOMER_OF = integrity.Reference("order_customer", "Order", "o_custkey", "Customer", "c_custkey", "cascade")
NATION_OF = integrity.Reference("customer_nation", "Customer", "c_nationkey", "Nation", "n_nationkey", "cascade")
REGION_OF = integrity.Reference("nation_region", "Nation", "n_regionkey", "Region", "r_regionkey", "cascade")


@query("SELECT c_nationkey::DOUBLE AS num, count(*) AS rows FROM customer GROUP BY 1 HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return integrity.unique_violations(db.nodes(spark, sf_dir), "Customer", "c_nationkey").select("num", "rows")


@query("SELECT 'Order:' || o_orderkey AS address FROM orders WHERE o_custkey % 10 = 0")
def reference_violations(spark, sf_dir):
    nodes = db.nodes(spark, sf_dir)
    nodes = nodes.filter((F.col("kind") != "Customer") | (F.substring_index("address", ":", -1).cast("long") % 10 != 0))
    return integrity.reference_violations(nodes, CUSTOMER_OF)


@query("""WITH RECURSIVE links AS (SELECT 'Nation:' || n_nationkey AS child, 'Region:' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM customer
  UNION ALL SELECT 'Order:' || o_orderkey, 'Customer:' || o_custkey FROM orders),
 gone AS (SELECT 'Region:1' AS address UNION SELECT child FROM links JOIN gone ON parent = address) SELECT address FROM gone""")
def cascade_closure(spark, sf_dir):
    target = spark.createDataFrame([("Region:1",)], "address string")
    return integrity.delete_closure(db.nodes(spark, sf_dir), [CUSTOMER_OF, NATION_OF, REGION_OF], target).deleted


@query("SELECT 'Order:' || o_orderkey AS address, 1 AS rank, o_orderpriority AS priority FROM orders WHERE o_custkey IN (1, 4)")
def set_null_result(spark, sf_dir):
    nodes = db.nodes(spark, sf_dir)
    ref = integrity.Reference("order_customer", "Order", "o_custkey", "Customer", "c_custkey", "set_null")
    s = mutate.Snapshot(nodes, db.edges(spark, sf_dir), db.history(spark, sf_dir).limit(0), integrity.Catalog(references={ref.name: ref}))
    after = mutate.delete(s, spark.createDataFrame([("Customer:1",), ("Customer:4",)], "address string"))
    hit = after.nodes.join(after.history.filter("node.kind = 'Order'").select("address"), "address", "left_semi")
    return hit.select("address", J.field("o_custkey").rank.alias("rank"), J.field("o_orderpriority").txt.alias("priority"))


@query("SELECT 'Order:' || o_orderkey AS address FROM orders WHERE o_custkey IN (1, 4)")
def restrict_blockers(spark, sf_dir):
    targets = spark.createDataFrame([("Customer:1",), ("Customer:4",)], "address string")
    return integrity.restrict_blockers(db.nodes(spark, sf_dir), CUSTOMER_OF, targets)


# -- mutations -----------------------------------------------------------------------------------------------------


def _snapshot(spark, sf_dir) -> mutate.Snapshot:
    nodes = db.order_nodes(spark, sf_dir)
    return mutate.Snapshot(nodes, db.edges(spark, sf_dir), db.history(spark, sf_dir).limit(0), now=1)


@query("""SELECT 'Order:' || o_orderkey AS address, CASE WHEN o_orderkey % 10 = 0 THEN 'Z' ELSE o_orderstatus END AS status,
 (o_orderkey % 10 = 0)::INT AS versions FROM orders UNION ALL SELECT 'Order:new' , 'N', 0""")
def upsert_state(spark, sf_dir):
    s = _snapshot(spark, sf_dir)
    batch = s.nodes.filter(F.substring_index("address", ":", -1).cast("long") % 10 == 0).withColumn("data", F.lit('{"o_orderstatus":"Z"}'))
    new = s.nodes.limit(1).withColumn("address", F.lit("Order:new")).withColumn("data", F.lit('{"o_orderstatus":"N"}'))
    after = mutate.upsert(s, batch.unionByName(new))
    versions = after.history.groupBy("address").agg(F.max("version").alias("v"))
    rows = after.nodes.select("address", J.field("o_orderstatus").txt.alias("status")).join(versions, "address", "left")
    return rows.select("address", "status", F.coalesce("v", F.lit(0)).cast("int").alias("versions"))


@query(f"WITH {ORD} SELECT (SELECT count(*) FROM o WHERE NOT (o_orderpriority = '5-LOW' AND owner = 'cust:7')) AS nodes, (SELECT count(*) FROM o WHERE o_orderpriority = '5-LOW' AND owner = 'cust:7') AS archived")
def delete_where_state(spark, sf_dir):
    after, _ = mutate.delete_where(_snapshot(spark, sf_dir), "Order", E.op(E.get("o_orderpriority"), "==", "5-LOW"), Requester("cust:7"))
    return after.nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(after.history.agg(F.count("*").alias("archived"))))


@query("SELECT 'Order:' || o_orderkey AS address, 'held' AS mark, o_orderstatus AS status FROM orders WHERE o_totalprice <= 20000")
def set_if_winners(spark, sf_dir):
    won = mutate.set_if_rows(db.order_nodes(spark, sf_dir), {"field": "o_totalprice", "expect_le": 20000}, {"mark": "held"})
    return won.select("address", J.field("mark").txt.alias("mark"), J.field("o_orderstatus").txt.alias("status"))


@query("SELECT 'Order:' || o_orderkey AS address, 'worker:' || o_orderkey % 3 AS claimed_by FROM orders WHERE o_orderstatus = 'O'")
def claim_state(spark, sf_dir):
    s = _snapshot(spark, sf_dir)
    open_rows = Q.matching(s.nodes, where=E.op(E.get("o_orderstatus"), "==", "O")).select("address")
    worker = F.concat(F.lit("worker:"), (F.substring_index("address", ":", -1).cast("long") % 3).cast("string"))
    after = mutate.claim_all(s, open_rows, worker)
    return after.nodes.filter("claimed_by IS NOT NULL").select("address", "claimed_by")


@query("SELECT o_orderpriority AS name, o_orderkey AS request_id, 1 + coalesce(sum(o_custkey % 5 + 1) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first FROM orders")
def sequence_blocks(spark, sf_dir):
    wanted = src.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("request_id"), (F.col("o_custkey") % 5 + 1).alias("count")
    )
    return mutate.blocks(wanted).select("name", "request_id", "first")


def _insert(address: str, data: str) -> dict:
    return {"op": "insert_node", "node": {"address": address, "kind": "Order", "data": data}}


@query(f"""WITH {ORD} SELECT address, owner <> 'cust:7' AS present, (owner = 'cust:7')::INT AS archived FROM o
UNION ALL SELECT * FROM (VALUES ('Order:early', false, 1), ('Order:late', true, 2)) t(address, present, archived)""")
def transaction_order(spark, sf_dir):
    """A clear takes what was inserted before it and leaves what came after."""
    ops = [
        _insert("Order:early", "{}"), {"op": "clear_kind", "kind": "Order"}, _insert("Order:late", '{"n":1}'),
        {"op": "set_if", "address": "Order:late", "expect": {"field": "n", "expect_le": 1}, "set": {"n": 2}},
        {"op": "update_node", "address": "Order:late", "data": '{"n":3}'},
    ]
    after = mutate.transaction(_snapshot(spark, sf_dir), ops, Requester("cust:7"))
    versions = after.history.groupBy("address").agg(F.max("version").cast("int").alias("v"))
    both = after.nodes.select("address", F.lit(True).alias("here")).join(versions, "address", "full")
    return both.select("address", F.coalesce("here", F.lit(False)).alias("present"), F.coalesce("v", F.lit(0)).alias("archived"))


@query("""SELECT 'Customer:' || o_custkey AS "from", 'Order:' || o_orderkey AS "to", 'PLACED' AS kind FROM orders WHERE o_orderkey <> 10
UNION ALL SELECT 'Order:10', 'Order:11', 'NEXT' UNION ALL SELECT 'Order:11', 'Order:new', 'NEXT'""")
def transaction_edges(spark, sf_dir):
    """Edges put and cut in order, to a node that the batch inserts first."""
    s = _snapshot(spark, sf_dir)
    placed = s.edges.filter("kind = 'PLACED' AND `to` = 'Order:10'").first()
    edge = lambda op, a, b, kind="NEXT": {"op": op, "from": a, "to": b, "kind": kind}
    ops = [
        edge("delete_edge", placed["from"], "Order:10", "PLACED"), edge("delete_edge", placed["from"], "Order:10", "PLACED"),
        edge("insert_edge", "Order:10", "Order:11"), edge("delete_edge", "Order:10", "Order:11"), edge("insert_edge", "Order:10", "Order:11"),
        edge("insert_edge", "Order:10", "Order:12"), edge("delete_edge", "Order:10", "Order:12"), _insert("Order:new", "{}"), edge("insert_edge", "Order:11", "Order:new"),
    ]
    after = mutate.transaction(s, ops, Requester("root", admin=True))
    return after.edges.filter("kind IN ('PLACED', 'NEXT')").select("from", "to", "kind")


@query(f"""WITH {ORD} SELECT address, 'name' AS test FROM o WHERE o_custkey % 7 > 2 UNION ALL SELECT address, 'cas' FROM o WHERE o_orderkey % 2 = 1
UNION ALL SELECT address, 'text' FROM o WHERE o_orderkey % 3 = 1""")
def json_odd_values(spark, sf_dir):
    """Names that no path can hold, whole numbers beyond a double's 53 bits, and numbers read as text."""
    k = F.col("o_orderkey")
    number = F.when(k % 3 == 0, F.lit("1")).when(k % 3 == 1, F.lit("1.0")).otherwise(F.lit("12345678.25"))
    big = (k % 2 + (1 << 53)).cast("string")
    data = F.concat(F.lit('{"a]b\\"c":'), (F.col("o_custkey") % 7).cast("string"), F.lit(',"big":'), big, F.lit(',"v":'), number, F.lit("}"))
    nodes = src.table(spark, sf_dir, "orders").select(*src.node("Order", k, data, F.lit("app")))
    tests = {
        "name": Q.matching(nodes, where=E.op(E.get('a]b"c'), ">", 2)),
        "cas": mutate.set_if_rows(nodes, {"field": "big", "expect_eq": (1 << 53) + 1}, {"mark": True}),
        "text": Q.matching(nodes, where=E.op(E.lower(E.get("v")), "==", "1.0")),
    }
    out = [rows.select("address", F.lit(name).alias("test")) for name, rows in tests.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


# -- changes -------------------------------------------------------------------------------------------------------

_CHANGE = "seq, change, address, owner, visibility"


@query(f"WITH {LOG} SELECT {_CHANGE} FROM ch")
def changes_committed(spark, sf_dir):
    return C.committed_changes(db.log(spark, sf_dir)).select(*_CHANGE.split(", "))


@query(f"WITH {LOG}, f AS (SELECT * FROM ch WHERE seq > 400 ORDER BY seq LIMIT 25) SELECT {_CHANGE} FROM ch WHERE seq > 400 AND unit <= (SELECT max(unit) FROM f)")
def changes_page(spark, sf_dir):
    return C.page(db.log(spark, sf_dir), after=400, limit=25).changes.select(*_CHANGE.split(", "))


@query(f"WITH {LOG} SELECT {_CHANGE} FROM ch WHERE visibility = 'Public' OR owner = 'u:3'")
def changes_visible_to_owner(spark, sf_dir):
    return C.admitted(C.committed_changes(db.log(spark, sf_dir)), Requester("u:3")).select(*_CHANGE.split(", "))


@query(f"WITH {LOG} SELECT address, max(seq) AS seq FROM ch GROUP BY 1 HAVING arg_max(change, seq) <> 'deleted'")
def latest_state_from_log(spark, sf_dir):
    return C.latest_state(db.log(spark, sf_dir)).select("address", "seq")


@query(f"WITH {LOG} SELECT {_CHANGE} FROM ch")
def stream_changes(spark, sf_dir):
    from quillgraph.streaming.changes import stream_changes as run

    cut(spark.range(1))
    work = f"{spark.sparkContext.getCheckpointDir() or ''}/stream-{spark.sql('SELECT uuid()').first()[0]}"
    logs = db.log(spark, sf_dir)
    part = F.floor(F.col("sequence") * 3 / logs.agg(F.max("sequence")).first()[0])
    for i in range(4):  # a log grows in order: file after file
        logs.filter(part == i).coalesce(1).write.mode("append").parquet(f"{work}/log")
    return run(spark, f"{work}/log", work).select(*_CHANGE.split(", "))


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id > (SELECT max(event_id) FROM events) - 300 AND (event_id % 4 <> 0 OR user_id % 10 = 3)")
def audience_feed(spark, sf_dir):
    events = src.table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq")
    private = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("u:"), (F.col("user_id") % 10).cast("string")))
    last = events.agg(F.max("seq")).first()[0]
    return feed.resume(events.withColumn("audience", private), last - 300, Requester("u:3")).select("seq", "event_type")


@query("SELECT event_id AS seq, event_type FROM events WHERE event_id > 50 AND (event_id % 4 <> 0 OR user_id % 10 = 3)")
def stream_feed(spark, sf_dir):
    """A live subscription that breaks off, misses events and resumes from its own position."""
    from quillgraph.streaming import feed as live

    work = f"{shared_folder(spark)}/feed-{spark.sql('SELECT uuid()').first()[0]}"
    private = F.when(F.col("seq") % 4 == 0, F.concat(F.lit("u:"), (F.col("user_id") % 10).cast("string")))
    events = src.table(spark, sf_dir, "events").withColumnRenamed("event_id", "seq").withColumn("audience", private).select("seq", "event_type", "audience")
    for part in range(3):  # events are published, the subscriber connects and is gone again
        events.filter(F.col("seq") % 3 == part).coalesce(1).write.mode("append").parquet(f"{work}/events")
        stream = live.live(spark, f"{work}/events", events.schema, Requester("u:3"), after=50)
        live.deliver(stream, f"{work}/out", f"{work}/position")
    return spark.read.parquet(f"{work}/out").select("seq", "event_type")


@query("SELECT event_id AS seq, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def feed_payloads(spark, sf_dir):
    rows = src.table(spark, sf_dir, "events").select(feed.inject_seq(F.col("props"), F.col("event_id")).alias("data"))
    return rows.select(*(F.try_variant_get(J.variant_field(F.col("data"), f), "$", "bigint").alias(f) for f in ("seq", "k")))


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS seq, event_id FROM events")
def feed_numbering(spark, sf_dir):
    return feed.numbered(src.table(spark, sf_dir, "events").select("ts", "event_id"), "ts", "event_id", buckets=8).select("seq", "event_id")


@query(f"""WITH {ORD}, seen AS (SELECT o_orderkey, CASE WHEN visibility = 'Private' THEN 'app' END AS audience, o_custkey FROM o)
SELECT 'PLACED' AS kind, 'Customer:' || o_custkey AS "from", 'Order:' || o_orderkey AS "to", audience FROM seen
UNION ALL SELECT DISTINCT 'CONTAINS', 'Order:' || l_orderkey, 'Part:' || l_partkey, audience FROM lineitem JOIN seen ON l_orderkey = o_orderkey
UNION ALL SELECT 'IN', 'Nation:' || n_nationkey, 'Region:' || n_regionkey, NULL FROM nation
UNION ALL SELECT 'FROM', 'Customer:' || c_custkey, 'Nation:' || c_nationkey, NULL FROM customer""")
def edge_audience(spark, sf_dir):
    return feed.edge_audience(db.edges(spark, sf_dir), db.nodes(spark, sf_dir)).select("kind", "from", "to", "audience")


@query(f"WITH {ORD} SELECT address, CASE WHEN visibility = 'Private' THEN owner END AS audience FROM o")
def node_audience(spark, sf_dir):
    return db.order_nodes(spark, sf_dir).select("address", feed.node_audience().alias("audience"))


# -- statistics ----------------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT event_type, floor(value * 1000)::BIGINT AS us FROM events),
m AS (SELECT *, CASE WHEN us < 8 THEN 0 ELSE length(bin(us)) - 1 END AS msb FROM s),
b AS (SELECT *, CASE WHEN us < 8 THEN us ELSE ((us >> (msb - 3)::INT) << (msb - 3)::INT) + (1::BIGINT << (msb - 3)::INT) - 1 END AS upper FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY upper) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM b)
SELECT event_type, max(n) AS count, min(upper) FILTER (rn >= greatest(ceil(n * 0.5), 1)) AS p50_us,
 min(upper) FILTER (rn >= greatest(ceil(n * 0.99), 1)) AS p99_us, max(upper) AS max_us FROM r GROUP BY 1""")
def latency_percentiles(spark, sf_dir):
    events = src.table(spark, sf_dir, "events")
    return stats.latency(events, F.floor(F.col("value") * 1000), "event_type")


@query("SELECT o_orderkey % 4 AS x, o_custkey % 3 AS y, count(*) AS reads, sum(o_custkey % 2)::BIGINT AS writes, sum(floor(o_totalprice))::BIGINT AS bytes FROM orders GROUP BY ALL")
def cell_traffic(spark, sf_dir):
    traffic = db.order_nodes(spark, sf_dir).select(
        "coordinate", F.lit(1).cast("long").alias("reads"), (J.field("o_custkey").num.cast("long") % 2).alias("writes"), F.floor(J.field("o_totalprice").num).alias("bytes")
    )
    return stats.cell_traffic(traffic).select(F.col("coordinate.x").cast("long").alias("x"), F.col("coordinate.y").cast("long").alias("y"), "reads", "writes", "bytes")


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS events, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def windowed_events(spark, sf_dir):
    from quillgraph.streaming.changes import windowed_counts

    rows = windowed_counts(src.table(spark, sf_dir, "events"))
    return rows.select(F.col("w.start").alias("day"), "event_type", "events", F.round("total", 2).alias("total"))


# -- catalog -------------------------------------------------------------------------------------------------------


@query("""SELECT 'index' AS what, 'by_date' AS name, 'ordered' AS how, count(DISTINCT strftime(o_orderdate, '%Y-%m-%d')) AS entries FROM orders
UNION ALL SELECT 'index', 'by_key', 'unique', count(DISTINCT o_orderkey) FROM orders UNION ALL SELECT 'index', 'by_priority', 'text', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'index', 'customer_key', 'unique', count(DISTINCT c_custkey) FROM customer UNION ALL SELECT 'index', 'order_customer', 'ordered', count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'reference', 'order_customer', 'cascade', count(*) FROM orders""")
def catalog_listing(spark, sf_dir):
    """The declared indexes with their distinct entries, and the references with the rows that they bind."""
    nodes, c = db.nodes(spark, sf_dir), integrity.Catalog()
    for i in (
        integrity.Index("by_key", "Order", "o_orderkey", True), integrity.Index("by_priority", "Order", "o_orderpriority", mode="text"), integrity.Index("by_date", "Order", "o_orderdate"),
        integrity.Index("order_customer", "Order", "o_custkey"), integrity.Index("customer_key", "Customer", "c_custkey", True),
    ):
        c = c.create_index(i, nodes)
    c = c.create_reference(CUSTOMER_OF, nodes)
    rows = [("index", i.name, "unique" if i.unique else i.mode, integrity.entries(nodes, i).count()) for i in c.listing()]
    rows += [("reference", r.name, r.on_delete, integrity.bound_rows(nodes, r).count()) for r in c.reference_listing()]
    return spark.createDataFrame(rows, "what string, name string, how string, entries long")


@query(f"""WITH {ORD} SELECT owner, count(*) AS nodes, count(DISTINCT kind) AS kinds FROM (SELECT owner, 'Order' AS kind FROM o WHERE visibility = 'Public'
 UNION ALL SELECT 'cust:' || c_custkey, 'Customer' FROM customer UNION ALL SELECT 'app', 'Part' FROM part UNION ALL SELECT 'app', 'Supplier' FROM supplier
 UNION ALL SELECT 'app', 'Nation' FROM nation UNION ALL SELECT 'app', 'Region' FROM region) GROUP BY 1""")
def owner_listing(spark, sf_dir):
    return stats.owners(db.nodes(spark, sf_dir), Requester("nobody"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent public orders above a price, newest first, twenty of them."""
    where = E.all_of(E.op(E.get("o_orderpriority"), "==", "1-URGENT"), E.op(E.get("o_totalprice"), ">", 50000))
    rows = Q.page_frame(db.nodes(spark, sf_dir), Q.Query(kind="Order", where=where, order="o_orderdate", desc=True, limit=20), Requester("nobody"))
    price = J.field("o_totalprice").num
    return rows.select("address", F.col("okey.txt").alias("day"), price.alias("price"))
