"""The relational test tables as nodes, edges and a log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.model import NODE_COLUMNS, PRIVATE, PUBLIC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: Column, data: Column, owner: Column, visibility: Column | None = None, x: Column | None = None, y: Column | None = None) -> list[Column]:
    small = lambda c: (F.lit(0) if c is None else c).cast("short")
    return [
        F.concat(F.lit(f"{kind}:"), key.cast("string")).alias("address"),
        F.struct(small(x).alias("x"), small(y).alias("y"), small(None).alias("z"), small(None).alias("q")).alias("coordinate"),
        F.lit(0).cast("long").alias("value"),
        F.lit(kind).alias("kind"),
        data.alias("data"),
        owner.alias("owner"),
        F.lit(None).cast("string").alias("claimed_by"),
        (F.lit(PUBLIC) if visibility is None else visibility).alias("visibility"),
    ]


def _json(*columns) -> Column:
    return F.to_json(F.struct(*columns))


def _order_cells() -> dict:
    return {
        "owner": F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")),
        "visibility": F.when(F.col("o_orderstatus") != "P", PUBLIC).otherwise(PRIVATE),
        "x": F.col("o_orderkey") % 4,
        "y": F.col("o_custkey") % 3,
    }


def order_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate")
    data = _json("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority", day)
    return table(spark, sf_dir, "orders").select(*node("Order", F.col("o_orderkey"), data, **_order_cells()))


def mixed_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a field ``m`` of changing type, and ``g``/``t`` that are at times null or absent."""
    k = F.col("o_orderkey")
    m = (
        F.when(k % 6 == 0, F.lit("{}")).when(k % 6 == 1, F.lit('{"m":null}'))
        .when(k % 6 == 2, F.concat(F.lit('{"m":"'), F.col("o_orderpriority"), F.lit('"}')))
        .when(k % 6 == 3, F.concat(F.lit('{"m":'), F.col("o_totalprice").cast("string"), F.lit("}")))
        .when(k % 6 == 4, F.concat(F.lit('{"m":'), (k % 100).cast("string"), F.lit("}")))
        .otherwise(F.concat(F.lit('{"m":'), F.when(k % 4 == 1, "true").otherwise("false"), F.lit("}")))
    )
    return table(spark, sf_dir, "orders").select(*node("Mixed", k, m, **_order_cells()))


def sparse_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose ``g`` (status) and ``t`` (a number) are absent or null in every fifth row each."""
    k = F.col("o_orderkey")
    full = F.concat(F.lit('{"g":"'), F.col("o_orderstatus"), F.lit('","t":'), F.col("o_custkey").cast("string"), F.lit("}"))
    data = F.when(k % 5 == 0, F.lit("{}")).when(k % 5 == 1, F.lit('{"g":null,"t":null}')).otherwise(full)
    return table(spark, sf_dir, "orders").select(*node("Sparse", k, data, **_order_cells()))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    app = F.lit("app")
    parts = [
        order_nodes(spark, sf_dir),
        t("customer").select(*node("Customer", F.col("c_custkey"), _json("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")))),
        t("part").select(*node("Part", F.col("p_partkey"), _json("p_partkey", "p_name", "p_brand", "p_type", "p_size"), app)),
        t("supplier").select(*node("Supplier", F.col("s_suppkey"), _json("s_suppkey", "s_name", "s_nationkey"), app)),
        t("nation").select(*node("Nation", F.col("n_nationkey"), _json("n_nationkey", "n_name", "n_regionkey"), app)),
        t("region").select(*node("Region", F.col("r_regionkey"), _json("r_regionkey", "r_name"), app)),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(NODE_COLUMNS)


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _json(F.col("text").alias("body"), "lang", "source")
    return table(spark, sf_dir, "documents").select(*node("Doc", F.col("doc_id"), data, F.lit("app")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)

    def edge(df: DataFrame, kind: str, source: tuple[str, str], target: tuple[str, str]) -> DataFrame:
        ends = [F.concat(F.lit(f"{k}:"), F.col(c).cast("string")) for k, c in (source, target)]
        return df.select(ends[0].alias("from"), ends[1].alias("to"), F.lit(kind).alias("kind"), F.lit("app").alias("owner"))

    contains = t("lineitem").select("l_orderkey", "l_partkey").distinct()
    return (
        edge(t("orders"), "PLACED", ("Customer", "o_custkey"), ("Order", "o_orderkey"))
        .unionByName(edge(contains, "CONTAINS", ("Order", "l_orderkey"), ("Part", "l_partkey")))
        .unionByName(edge(t("nation"), "IN", ("Nation", "n_nationkey"), ("Region", "n_regionkey")))
        .unionByName(edge(t("customer"), "FROM", ("Customer", "c_custkey"), ("Nation", "c_nationkey")))
    )


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: each is an upsert of its user (an ``error`` a delete), ten to a transaction, each seventh not committed."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    seen = F.lag(F.struct("event_id", "event_type")).over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = events.withColumn("prev", seen).withColumn("transaction_id", F.floor(F.col("event_id") / 10) + 1)
    address = F.concat(F.lit("User:"), F.col("user_id").cast("string"))
    owner = F.concat(F.lit("u:"), (F.col("user_id") % 10).cast("string"))
    sight = lambda e: F.when(e % 4 == 0, PRIVATE).otherwise(PUBLIC)
    had = F.col("prev").isNotNull() & (F.col("prev.event_type") != "error")

    def record(df: DataFrame, place: int, op: Column, when: Column) -> DataFrame:
        return df.select(
            (F.col("event_id") * 4 + place).alias("sequence"), "transaction_id", op.alias("op"), address.alias("address"),
            F.lit("User").alias("kind"), owner.alias("owner"), sight(when).alias("visibility"),
        )

    archives = record(rows.filter(had), 1, F.lit("Archive"), F.col("prev.event_id"))
    writes = record(rows, 2, F.when(F.col("event_type") == "error", "Delete").otherwise("Insert"), F.col("event_id"))
    none = F.lit(None).cast("string")
    ends = rows.groupBy("transaction_id").agg((F.max("event_id") * 4 + 3).alias("sequence")).filter("transaction_id % 7 <> 0")
    ends = ends.select("sequence", "transaction_id", F.lit("Commit").alias("op"), none.alias("address"), none.alias("kind"), none.alias("owner"), none.alias("visibility"))
    return archives.unionByName(writes).unionByName(ends)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a user but the last as an archived state, versions from 1."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = events.withColumn("version", F.row_number().over(order).cast("long")).withColumn("next", F.lead("event_id").over(order))
    state = node("User", F.col("user_id"), _json("event_id", "event_type", "value"), F.concat(F.lit("u:"), (F.col("user_id") % 10).cast("string")))
    rows = rows.filter("next IS NOT NULL").select(F.struct(*state).alias("node"), "version", F.col("next").alias("archived_at_unix"))
    return rows.select("node.address", "archived_at_unix", "node", "version")


def user_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of each user."""
    last = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("e"))
    rows = last.select("user_id", "e.*")
    return rows.select(*node("User", F.col("user_id"), _json("event_id", "event_type", "value"), F.concat(F.lit("u:"), (F.col("user_id") % 10).cast("string"))))
