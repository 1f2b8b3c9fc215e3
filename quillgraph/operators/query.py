"""Filtered, ordered, keyset-paginated reads."""

from __future__ import annotations

import base64
import binascii
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.errors import Invalid
from quillgraph.functions import jsonval as J
from quillgraph.model import ADMIN, Requester
from quillgraph.plans import expr as E
from quillgraph.sources.session import shared_folder


@dataclass
class Query:
    """What to read. ``order`` is a field, ``id`` or None (both: by address)."""

    kind: str | None = None
    owner: str | None = None
    where: E.Expr | None = None
    order: str | None = None
    desc: bool = False
    limit: int = model.DEFAULT_LIMIT
    offset: int = 0
    cursor: str = ""
    item: str = "item"

    @staticmethod
    def of(request: dict) -> Query:
        known = {k: request[k] for k in ("kind", "owner", "order", "desc", "limit", "offset", "cursor") if request.get(k) is not None}
        where = request.get("where")
        return Query(**known, where=None if where is None else E.Expr.of(where))


@dataclass
class Page:
    """One page: its rows, in order, and the cursor of the next one ("" at the end)."""

    rows: list = field(default_factory=list)
    next: str = ""


def base_filter(nodes: DataFrame, who: Requester, kind: str | None, owner: str | None) -> Column:
    keep = who.can_read()
    for name, value in (("owner", owner), ("kind", kind)):
        if value is not None:
            keep = (F.col(name) == value) & keep
    return keep


def matching(nodes: DataFrame, who: Requester = ADMIN, kind: str | None = None, owner: str | None = None, where: E.Expr | None = None, item: str = "item") -> DataFrame:
    """The rows that pass kind, owner, visibility and predicate; one that these rule out never fails the predicate."""
    base = base_filter(nodes, who, kind, owner)
    out = nodes.filter(base)
    if where is None:
        return out
    E.validate(where)
    for test in pushed_tests(nodes.columns, where, item):
        out = out.filter(test)
    condition = E.Compiler(nodes.columns, item).condition(where)
    return out.filter(F.when(base, condition).otherwise(False))


def pushed_tests(columns: list[str], where: E.Expr, item: str = "item") -> list[Column]:
    """Plain filters on declared keys that the predicate implies wherever it can be evaluated; they reach the scan."""
    out: list[Column] = []
    failing: Column | None = None  # where an earlier comparison fails, the row must stay to fail the query
    for name, test, value, lowered in E.leading_tests(where, item):
        if lowered:
            continue
        if J.key_column(name) not in columns:
            if test in E.RANGE_TESTS:
                break
            continue
        key = F.col(f"`{J.key_column(name)}`")
        if test in E.RANGE_TESTS:
            odd = key["rank"] != J.NUMBER
            failing = odd if failing is None else failing | odd
            passes = {"<": key["num"] < value, "<=": key["num"] <= value, ">": key["num"] > value, ">=": key["num"] >= value}[test]
        elif test == "==":
            rank, num, txt = J.parts(value)
            # null equals absent, so it is no place in the order
            passes = key["rank"].isin(J.NULL, J.ABSENT) if rank == J.NULL else (key["rank"] == rank) & (key["num"] == num) & (key["txt"] == txt)
        else:
            passes = {"starts_with": key["txt"].startswith, "ends_with": key["txt"].endswith, "contains": key["txt"].contains}[test](value)
            passes = (key["rank"] == J.STRING) & passes
        out.append(passes if failing is None else failing | passes)
    return out


def encode_cursor(rank: int, num: float, txt: str, address: str) -> str:
    """base64url of compact JSON: the order value, its rank (null and absent differ), and the address."""
    body = {"o": J.to_python(rank, num, txt), "r": rank, "a": address}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":"), ensure_ascii=False).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[J.Val, str]:
    if len(cursor.encode()) > model.MAX_CURSOR_BYTES:
        raise Invalid("cursor too long")
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        address = body["a"]
        value = J.absent() if body.get("r", J.ABSENT) == J.ABSENT and body.get("o") is None else J.literal(body.get("o"))
        if not isinstance(address, str):
            raise ValueError
    except (binascii.Error, ValueError, KeyError, TypeError, AttributeError) as e:
        raise Invalid("bad cursor") from e
    return value, address


def int_of(rank: Column) -> Column:
    return rank.cast("int")


def _order_key(nodes: DataFrame, q: Query) -> Column | None:
    return None if q.order in (None, "id") else J.okey(q.order, nodes.columns)


def _from_cursor(nodes: DataFrame, q: Query, cursor: str, after: bool = True) -> Column:
    """Whether a row (with ``okey``) comes after the cursor's, or else up to it and that row included, in the query's order."""
    value, address = decode_cursor(cursor)
    up = after != q.desc  # towards larger values
    if _order_key(nodes, q) is None:
        here, there = F.col("address"), F.lit(address)
    else:
        here, there = F.struct("okey", "address"), F.struct(value.key().alias("okey"), F.lit(address).alias("address"))
    keep = (here > there if up else here < there) if after else (here >= there if up else here <= there)
    if q.order is not None and J.key_column(q.order) in nodes.columns:  # implied by the struct's order, and within the scan's reach
        stored = F.col(f"`{J.key_column(q.order)}`")
        near = F.col("address") >= address if up else F.col("address") <= address
        for part, at in ((stored["txt"], value.txt), (stored["num"], value.num), (stored["rank"], int_of(value.rank))):
            near = (part > at if up else part < at) | (part == at) & near
        keep = near & keep
    return keep


def ordered(nodes: DataFrame, q: Query, who: Requester = ADMIN, until: str = "") -> DataFrame:
    """The matching rows past the cursor, and up to ``until`` (a cursor too), with ``okey`` (constant where ordered by address), in order, unlimited."""
    if q.limit < 0 or q.offset < 0:
        raise Invalid("limit and offset are not negative")
    if q.offset > model.MAX_OFFSET and not q.cursor:
        raise Invalid(f"offset goes up to {model.MAX_OFFSET}; use a cursor")
    key = _order_key(nodes, q)
    rows = matching(nodes, who, q.kind, q.owner, q.where, q.item)
    rows = rows.withColumn("okey", J.absent().key() if key is None else key)
    if q.cursor:
        rows = rows.filter(_from_cursor(nodes, q, q.cursor))
    if until:
        rows = rows.filter(_from_cursor(nodes, q, until, after=False))
    columns = ["address"] if key is None else ["okey", "address"]
    return rows.orderBy(*(F.col(c).desc() if q.desc else F.col(c).asc() for c in columns))


def page_frame(nodes: DataFrame, q: Query, who: Requester = ADMIN, extra: int = 0) -> DataFrame:
    """The page's rows as a DataFrame (a top-k plan, never a full sort)."""
    rows = ordered(nodes, q, who)
    limit = min(q.limit, model.MAX_LIMIT)
    if q.offset and not q.cursor:
        rows = rows.offset(q.offset)
    return rows.limit(limit + (extra if limit else 0))


def run(nodes: DataFrame, q: Query, who: Requester = ADMIN) -> Page:
    """One page and the next cursor, which is empty when no further row matches."""
    limit = min(q.limit, model.MAX_LIMIT)
    got = page_frame(nodes, q, who, extra=1).collect() if limit else []
    return next(_cut(got, limit, False), Page())


def _cut(got: list, limit: int, more: bool):
    """Pages of ``limit`` rows from consecutive ones; ``more``: rows follow the last of them."""
    for at in range(0, len(got), max(1, limit)):
        rows = got[at : at + limit]
        yield Page(rows, encode_cursor(*rows[-1].okey, rows[-1].address) if more or at + limit < len(got) else "")


def pages(nodes: DataFrame, q: Query, who: Requester = ADMIN, most: int | None = None, ahead: int = 1):
    """Page after page, at most ``most`` of them.

    ``ahead`` pages, of at most ``MAX_ROWS_HELD`` rows together, are read by one
    top-k; the next one begins at the last page's cursor.
    """
    limit = min(q.limit, model.MAX_LIMIT)
    if not limit:
        yield Page()
        return
    chunk = limit * max(1, min(ahead, model.MAX_ROWS_HELD // limit))
    while True:
        rows = ordered(nodes, q, who)
        got = (rows.offset(q.offset) if q.offset and not q.cursor else rows).limit(chunk + 1).collect()
        page = Page()
        for page in _cut(got[:chunk], limit, len(got) > chunk):
            if most is not None and most <= 0:
                return
            most = None if most is None else most - 1
            yield page
        if not got:
            yield page
        if not page.next:
            return
        q = Query(**{**q.__dict__, "cursor": page.next})


def walk(nodes: DataFrame, q: Query, who: Requester = ADMIN, ahead: int = 1) -> DataFrame:
    """place (from 1), okey and address of every row of all pages, in a table of its own: the rows that ``pages`` yields, none of them on the driver.

    Each step reads ``ahead`` pages past the cursor by one top-k, which is written
    where it is found; only the cursor of its last row comes back. A step reads up to
    a fence, the cursor of a file's last row, behind which as many rows lie as it
    asks for: of a table in order, that is a few files. A step that finds fewer goes
    on without a fence, so the rows do not depend on where fences stand.
    """
    limit = min(q.limit, model.MAX_LIMIT)
    folder, spark = f"{shared_folder(nodes.sparkSession)}/walk-{uuid.uuid4().hex}", nodes.sparkSession
    chunk = limit * max(1, min(ahead, model.MAX_ROWS_HELD // max(1, limit)))
    fences = _fences(nodes, q, who) if limit else []
    way = [F.col(c).desc() if q.desc else F.col(c).asc() for c in ("okey", "address")]
    done, step, until = 0, 0, ""
    while True:
        skip = q.offset if not q.cursor else 0
        until = "" if skip else until
        rows = ordered(nodes, q, who, until)
        rows = (rows.offset(skip) if skip else rows).limit(chunk).select("okey", "address")
        rows = rows.select((F.row_number().over(Window.orderBy(*way)) + F.lit(done).cast("long")).alias("place"), "okey", "address")
        seen, last = Observation(), [F.max_by(c, "place").alias(c.split(".")[-1]) for c in ("okey.rank", "okey.num", "okey.txt", "address")]
        rows.observe(seen, F.count(F.lit(1)).alias("n"), *last).write.parquet(f"{folder}/{step:08d}")
        got = seen.get
        done, step = done + got["n"], step + 1
        if got["n"] < chunk and not until or not limit:
            return spark.read.schema(rows.schema).parquet(f"{folder}/*")
        if got["n"]:
            q = Query(**{**q.__dict__, "cursor": encode_cursor(got["rank"], got["num"], got["txt"], got["address"])})
        until = _fence(fences, _place(q.cursor), chunk, q.desc) if got["n"] == chunk else ""


def _place(cursor: str) -> tuple:
    body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    return (J.ABSENT, 0.0, "", body["a"]) if body["r"] == J.ABSENT else (*J.parts(body["o"]), body["a"])


def _fences(nodes: DataFrame, q: Query, who: Requester) -> list[tuple]:
    """(place of the last row, rows) of each file that the rows come from, in the query's order."""
    key = _order_key(nodes, q)
    rows = matching(nodes, who, q.kind, q.owner, q.where, q.item)
    here = F.struct((J.absent().key() if key is None else key).alias("okey"), "address")
    ends = rows.groupBy(F.input_file_name()).agg((F.min(here) if q.desc else F.max(here)).alias("end"), F.count("*").alias("n"))
    return sorted((((*r.end.okey, r.end.address), r.n) for r in ends.collect()), reverse=q.desc)


def _fence(fences: list[tuple], at: tuple, wanted: int, desc: bool) -> str:
    """The cursor of the first fence past ``at`` such that files which begin after ``at``, if files are in order, hold what is wanted; or none."""
    ahead = [f for f in fences if (f[0] < at if desc else f[0] > at)]
    for place, n in ahead[1:]:  # the first one may lie on both sides
        wanted -= n
        if wanted <= 0 and len((cursor := encode_cursor(*place)).encode()) <= model.MAX_CURSOR_BYTES:
            return cursor
    return ""


def point_get(nodes: DataFrame, address: str, who: Requester = ADMIN) -> DataFrame:
    return model.visible(nodes.filter(F.col("address") == address), who)


def multi_get(nodes: DataFrame, addresses: list[str], who: Requester = ADMIN) -> DataFrame:
    """The readable nodes in request order (``pos``), repeated as asked; missing ones are skipped."""
    if len(addresses) > model.MAX_MULTI_GET:
        raise Invalid(f"at most {model.MAX_MULTI_GET} addresses at once")
    wanted = nodes.sparkSession.createDataFrame(list(enumerate(addresses)), "pos int, address string")
    found = model.visible(nodes.filter(F.col("address").isin(*set(addresses))), who)
    return found.join(F.broadcast(wanted), "address").orderBy("pos")


def owned_by_subject(nodes: DataFrame, address: str, who: Requester = ADMIN) -> DataFrame:
    """All readable nodes of the owner of the node at ``address``."""
    owner = point_get(nodes, address, who).select(F.col("owner").alias("_owner")).limit(1)
    rows = model.visible(nodes, who)
    return rows.join(F.broadcast(owner), rows["owner"] == F.col("_owner"), "left_semi").orderBy("address")


def history_of(history: DataFrame, nodes: DataFrame, address: str, who: Requester = ADMIN) -> DataFrame:
    """Archived states of an address, oldest first, if its current node may be read."""
    allowed = point_get(nodes, address, who).select("address")
    return history.filter(F.col("address") == address).join(F.broadcast(allowed), "address", "left_semi").orderBy("version")


def to_json_rows(rows: DataFrame) -> DataFrame:
    """The rows as JSON texts."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))
