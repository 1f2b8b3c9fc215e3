"""The typed predicate language and its compiler to one Column.

Short-circuits and errors follow evaluation order: every operator that may
refuse a value is guarded by CASE, which never evaluates a branch that is not
taken, so a row that an earlier operand ruled out cannot fail the query.
Operators and shapes that no row could evaluate are refused when compiling.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph import model
from quillgraph.errors import Invalid
from quillgraph.functions import jsonval as J
from quillgraph.functions.lower import simple_lower
from quillgraph.functions.jsonval import Val


@dataclass
class Expr:
    """One node of a predicate; which fields count depends on ``kind``."""

    kind: str
    vtype: str | None = None
    val: object = None
    name: str | None = None
    obj: Expr | None = None
    field: str | None = None
    op: str | None = None
    x: Expr | None = None
    l: Expr | None = None  # noqa: E741
    r: Expr | None = None
    args: list[Expr] = dataclasses.field(default_factory=list)
    coll: Expr | None = None
    body: Expr | None = None

    @staticmethod
    def of(tree) -> Expr:
        """From decoded JSON; unknown members are ignored."""
        if isinstance(tree, Expr):
            return tree
        if not isinstance(tree, dict) or not isinstance(tree.get("kind"), str):
            raise Invalid("an expression is an object with a kind")
        out = Expr(tree["kind"])
        for f in fields(Expr):
            v = tree.get(f.name)
            if f.name in ("obj", "x", "l", "r", "coll", "body"):
                setattr(out, f.name, None if v is None else Expr.of(v))
            elif f.name == "args":
                out.args = [Expr.of(a) for a in v or []]
            elif f.name != "kind":
                setattr(out, f.name, v)
        return out

    def children(self) -> list[Expr]:
        return [c for c in (self.obj, self.x, self.l, self.r, self.coll, self.body, *self.args) if c is not None]


def lit(value) -> Expr:
    return Expr("lit", val=value)


def get(name: str, item: str = "item") -> Expr:
    return Expr("get", obj=Expr("ref", name=item), field=name)


def op(left, name: str, right) -> Expr:
    wrap = lambda v: v if isinstance(v, Expr) else lit(v)
    return Expr("bin", op=name, l=wrap(left), r=wrap(right))


def un(name: str, x: Expr) -> Expr:
    return Expr("un", op=name, x=x)


def lower(x: Expr) -> Expr:
    return Expr("call", name="lower", args=[x])


def all_of(*parts: Expr) -> Expr:
    out = parts[0]
    for p in parts[1:]:
        out = op(out, "&&", p)
    return out


def validate(expr: Expr) -> None:
    """Bounds on shape, checked before any row is read."""
    count, level = 0, [(expr, 1)]
    while level:
        node, depth = level.pop()
        count += 1
        if depth > model.MAX_DEPTH:
            raise Invalid(f"predicate nests deeper than {model.MAX_DEPTH} levels")
        if count > model.MAX_EXPR_NODES:
            raise Invalid(f"predicate has more than {model.MAX_EXPR_NODES} expressions")
        level += [(c, depth + 1) for c in node.children()]


def walk(expr: Expr):
    """The expression and all below it."""
    yield expr
    for c in expr.children():
        yield from walk(c)


def literal_value(e: Expr):
    """The JSON value that a literal stands for under its declared type."""
    v = e.val
    if e.vtype == "int":
        if isinstance(v, bool) or not isinstance(v, (int, float)):
            return None
        return int(v)
    if e.vtype == "text":
        if isinstance(v, str):
            return v
        return "" if v is None else J.json.dumps(v, separators=(",", ":"), ensure_ascii=False)
    if e.vtype == "bool":
        return v if isinstance(v, bool) else False
    return v


def _fail(message: str, kind: str) -> Column:
    return F.raise_error(F.lit(message)).cast(kind)


def _bool(c: Column) -> Val:
    return Val(F.lit(J.BOOL), c.cast("int").cast("double"), F.lit(""))


def truthy(v: Val) -> Column:
    """All but false and null."""
    return ~((v.rank == J.NULL) | ((v.rank == J.BOOL) & (v.num == 0.0)))


def equal(a: Val, b: Val) -> Column:
    return (a.rank == b.rank) & (a.num == b.num) & (a.txt == b.txt)


def _number(v: Val, message: str) -> Column:
    return F.when(v.rank == J.NUMBER, v.num).otherwise(_fail(message, "double"))


def _finite(n: Column) -> Val:
    bad = F.isnan(n) | (F.abs(n) == float("inf"))
    return Val(F.when(bad, J.NULL).otherwise(J.NUMBER), F.when(bad, 0.0).otherwise(n), F.lit(""))


class Compiler:
    """Compiles one predicate over a table with the given columns."""

    def __init__(self, columns: list[str], item: str = "item"):
        self.columns, self.item = list(columns), item
        self.bound: dict[str, Column] = {}  # the fields' keys, each computed once a row

    def condition(self, expr: Expr) -> Column:
        """True exactly where the predicate's value is the JSON value true."""
        names = {e.field for e in walk(expr) if e.kind == "get" and e.field is not None}
        names = sorted(n for n in names if J.key_column(n) not in self.columns)  # a declared key is a plain column
        if not names:
            return self._true(expr)
        keys = F.struct(*(J.field(n, self.columns).key().alias(f"f{i}") for i, n in enumerate(names)))

        def body(bound: Column) -> Column:
            self.bound = {n: bound[f"f{i}"] for i, n in enumerate(names)}
            try:
                return self._true(expr)
            finally:
                self.bound = {}

        return J.let(keys, body)

    def _true(self, expr: Expr) -> Column:
        v = self.value(expr)
        return (v.rank == J.BOOL) & (v.num == 1.0)

    def value(self, e: Expr) -> Val:
        if e.kind == "lit":
            return J.literal(literal_value(e))
        if e.kind == "get":
            name = self._field(e)
            k = self.bound.get(name)
            v = J.field(name, self.columns) if k is None else Val(k["rank"], k["num"], k["txt"])
            return Val(F.when(v.rank == J.ABSENT, J.NULL).otherwise(v.rank), v.num, v.txt)
        if e.kind == "un":
            return self._unary(e)
        if e.kind == "bin":
            return self._binary(e)
        if e.kind == "call":
            if e.name != "lower":
                raise Invalid(f"cannot call {e.name!r}: the only function is lower")
            if len(e.args) != 1:
                raise Invalid("lower takes exactly one argument")
            return Val(F.lit(J.STRING), F.lit(0.0), simple_lower(self._text(e.args[0])))
        raise Invalid(f"cannot evaluate {e.kind!r} expression")

    def _field(self, e: Expr) -> str:
        if e.obj is None or e.obj.kind != "ref" or e.obj.name != self.item:
            raise Invalid(f"cannot read field {e.field!r}: not of {self.item}")
        if e.field is None:
            raise Invalid("a field access without a field")
        return e.field

    def _text(self, e: Expr) -> Column:
        """What lower() reads: strings as they are, null as empty, anything else as its JSON text."""
        v = self.value(e)
        number = J.double_text(v.num)
        if e.kind == "get":
            raw = J.variant_field(F.col("data"), self._field(e))
            number = J.let(raw, lambda r: F.when(J.is_int(r), F.to_json(r)).otherwise(number))
        elif e.kind == "lit" and isinstance(literal_value(e), int):
            number = F.lit(str(literal_value(e)))
        return (
            F.when(v.rank.isin(J.STRING, J.COMPOSITE), v.txt)
            .when(v.rank == J.NUMBER, number)
            .when(v.rank == J.BOOL, F.when(v.num == 1.0, F.lit("true")).otherwise(F.lit("false")))
            .otherwise(F.lit(""))
        )

    def _unary(self, e: Expr) -> Val:
        if e.x is None or e.op not in ("!", "-"):
            raise Invalid(f"cannot evaluate unary operator {e.op!r}")
        v = self.value(e.x)
        if e.op == "!":
            return _bool(~truthy(v))
        return _finite(-_number(v, "cannot negate a value that is not a number"))

    def _binary(self, e: Expr) -> Val:
        if e.l is None or e.r is None or e.op is None:
            raise Invalid("a binary expression needs l, r and op")
        if e.op in ("&&", "||"):
            left, right = truthy(self.value(e.l)), truthy(self.value(e.r))
            return _bool(F.when(left, right).otherwise(False) if e.op == "&&" else F.when(left, True).otherwise(right))
        if e.op in ("in", "not in"):
            found = self._member(e)
            return _bool(found if e.op == "in" else ~found)
        a, b = self.value(e.l), self.value(e.r)
        if e.op in ("==", "!="):
            return _bool(equal(a, b) if e.op == "==" else ~equal(a, b))
        if e.op in ("starts_with", "ends_with", "contains"):
            both = (a.rank == J.STRING) & (b.rank == J.STRING)
            test = {"starts_with": a.txt.startswith, "ends_with": a.txt.endswith, "contains": a.txt.contains}[e.op]
            return _bool(both & test(b.txt))
        x, y = (_number(v, f"operator {e.op} needs numbers") for v in (a, b))
        if e.op in ("<", "<=", ">", ">="):
            return _bool({"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[e.op])
        if e.op == "+":
            return self._plus(a, b, x, y)
        if e.op in ("-", "*"):
            return _finite(x - y if e.op == "-" else x * y)
        if e.op in ("/", "%"):
            zero = F.when(y == 0.0, _fail("division by zero", "double"))
            return _finite(zero.otherwise(x / F.nullif(y, F.lit(0.0)) if e.op == "/" else x % F.nullif(y, F.lit(0.0))))
        raise Invalid(f"cannot evaluate binary operator {e.op!r}")

    def _plus(self, a: Val, b: Val, x: Column, y: Column) -> Val:
        texts = (a.rank == J.STRING) & (b.rank == J.STRING)
        joined = F.concat(a.txt, b.txt)
        fits = F.octet_length(a.txt) + F.octet_length(b.txt) <= model.MAX_CONCAT_BYTES
        total = _finite(F.when(texts, 0.0).otherwise(x + y))
        return Val(
            F.when(texts, J.STRING).otherwise(total.rank),
            total.num,
            F.when(texts, F.when(fits, joined).otherwise(_fail(f"a string of more than {model.MAX_CONCAT_BYTES} bytes", "string"))).otherwise(""),
        )

    def _member(self, e: Expr) -> Column:
        a = self.value(e.l)
        if e.r.kind == "lit":
            members = literal_value(e.r)
            if not isinstance(members, list):
                raise Invalid(f"{e.op} needs an array on its right")
            if len(members) > model.MAX_IN_SET:
                raise Invalid(f"{e.op} takes at most {model.MAX_IN_SET} members")
            numbers = [float(m) for m in members if isinstance(m, (int, float)) and not isinstance(m, bool)]
            texts = [m for m in members if isinstance(m, str)]
            found = F.lit(False)
            if numbers:
                found = found | ((a.rank == J.NUMBER) & a.num.isin(*numbers))
            if texts:
                found = found | ((a.rank == J.STRING) & a.txt.isin(*texts))
            for m in members:
                if m is None or isinstance(m, (bool, list, dict)):
                    found = found | equal(a, J.literal(m))
            return found
        if e.r.kind != "get":
            raise Invalid(f"{e.op} needs an array on its right")
        raw = J.variant_field(F.col("data"), self._field(e.r))
        members = F.when(J.json_type(raw).startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>"))
        members = F.coalesce(members, _fail(f"{e.op} needs an array on its right", "array<variant>"))
        members = F.when(F.size(members) <= model.MAX_IN_SET, members).otherwise(
            _fail(f"{e.op} takes at most {model.MAX_IN_SET} members", "array<variant>")
        )
        return F.exists(members, lambda m: equal(a, J.of_variant(m)))


def leading_tests(expr: Expr | None, item: str = "item") -> list[tuple[str, str, object, bool]]:
    """(field, operator, literal, lowered) of the conjuncts that come first and cannot be skipped.

    A filter on them that keeps the rows on which an earlier one, or the test
    itself, fails changes no result and hides no error: the rows that it
    removes would have ended the evaluation there. Only the comparisons can
    fail, on values that are not numbers.
    """
    out: list[tuple[str, str, object, bool]] = []

    def walk(e: Expr) -> bool:
        if e.kind == "bin" and e.op == "&&" and e.l and e.r:
            return walk(e.l) and walk(e.r)
        if e.kind != "bin" or e.op not in ("==", *TEXT_TESTS, *RANGE_TESTS) or e.l is None or e.r is None:
            return False
        side, lowered = e.l, False
        if side.kind == "call" and side.name == "lower" and len(side.args) == 1 and e.op in TEXT_TESTS:
            side, lowered = side.args[0], True
        if side.kind != "get" or e.r.kind != "lit" or side.obj is None or side.obj.kind != "ref" or side.obj.name != item or not side.field:
            return False
        value = literal_value(e.r)
        if e.op in TEXT_TESTS and not isinstance(value, str):
            return False
        if e.op in RANGE_TESTS and (isinstance(value, bool) or not isinstance(value, (int, float))):
            return False
        out.append((side.field, e.op, value, lowered))
        return True

    if expr is not None:
        walk(expr)
    return out


#: The operators' names.
TEXT_TESTS = ("starts_with", "ends_with", "contains")
RANGE_TESTS = ("<", "<=", ">", ">=")
