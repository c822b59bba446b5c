"""Expressions to typed columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.errors import InvalidComposition, TypeProblem, UnknownName
from strandflow.functions.scalar import Registry, Typed, converted, unified
from strandflow.language import nodes as n
from strandflow.types import SPARK_TYPES, elapsed, kind, micros, rfc3339, shifted

PERCENTILES = {"P50": 50, "P90": 90, "P95": 95, "P99": 99}


@dataclass
class Scope:
    """The columns that an expression can use, and what windows need."""

    columns: dict[str, Typed]
    functions: Registry
    entity: str | None = None
    time: str | None = None
    seq: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)  # other spellings of columns
    variables: dict[str, Typed] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, functions: Registry, **more) -> Scope:
        return cls({f.name: Typed(F.col(f"`{f.name}`"), kind(f.dataType)) for f in df.schema.fields}, functions, **more)

    def column(self, name: str) -> Typed:
        name = self.aliases.get(name, name)
        if name not in self.columns:
            raise UnknownName(f"no column {name}; there are {', '.join(c for c in self.columns if not c.startswith('__'))}")
        return self.columns[name]


def _as_time(p: Typed) -> Typed:
    if p.kind == "string" and isinstance(p.value, str):
        return Typed(F.timestamp_micros(F.lit(micros(p.value))), "timestamp")
    return p


def alike(a: Typed, b: Typed, what: str) -> tuple[Column, Column]:
    """Both sides of a comparison in one type; text literals become timestamps beside timestamps."""
    if "timestamp" in (a.kind, b.kind):
        a, b = _as_time(a), _as_time(b)
    common = unified([a, b], what)
    return converted(a, common), converted(b, common)


def binary(op: str, a: Typed, b: Typed) -> Typed:
    if op in ("AND", "OR"):
        for p in (a, b):
            if p.kind not in ("bool", "null"):
                raise TypeProblem(f"{op} takes bool, not {p.kind}")
        return Typed(a.col & b.col if op == "AND" else a.col | b.col, "bool")
    if op in ("=", "!=", "<", "<=", ">", ">="):
        x, y = alike(a, b, op)
        return Typed({"=": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op], "bool")
    if "timestamp" in (a.kind, b.kind):
        if op == "-":
            a, b = _as_time(a), _as_time(b)
        if op == "-" and a.kind == b.kind:
            return Typed(elapsed(a.col, b.col), "int")
        if op in "+-" and a.kind == "timestamp" and b.kind == "int":
            return Typed(shifted(a.col, b.col if op == "+" else -b.col), "timestamp")
        if op == "+" and a.kind == "int":
            return Typed(shifted(b.col, a.col), "timestamp")
        raise TypeProblem(f"{a.kind} {op} {b.kind} isn't defined")
    for p in (a, b):
        if p.kind not in ("int", "float", "null"):
            raise TypeProblem(f"{op} takes numbers, not {p.kind}")
    common = unified([a, b], op)
    x, y = converted(a, common), converted(b, common)
    if op in "+-*":
        return Typed({"+": x + y, "-": x - y, "*": x * y}[op], common)
    if common == "float":
        # as IEEE 754 has it: division by zero is infinite or no number
        inf, nan = F.lit(float("inf")), F.lit(float("nan"))
        if op == "%":
            return Typed(F.when(y == 0, nan).otherwise(x % y), "float")
        by_zero = F.when(x > 0, inf).when(x < 0, -inf).otherwise(nan)
        return Typed(F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, by_zero).otherwise(x / y), "float")
    return Typed(F.call_function("div", x, y) if op == "/" else x % y, common)


def cast(p: Typed, to: str) -> Typed:
    """A failed cast gives null. Floats lose their fraction, timestamps become RFC 3339 texts or
    nanoseconds."""
    if to not in SPARK_TYPES:
        raise TypeProblem(f"nothing can be cast to {to}")
    if p.kind == to:
        return Typed(p.col, to)
    if p.kind == "timestamp":
        if to == "string":
            return Typed(rfc3339(p.col), to)
        if to == "int":
            return Typed(F.unix_micros(p.col) * F.lit(1000).cast("long"), to)
        raise TypeProblem(f"a timestamp can't be cast to {to}")
    if to == "timestamp" and p.kind == "int":
        return Typed(F.timestamp_micros(F.call_function("div", p.col, F.lit(1000).cast("long"))), to)
    if to == "timestamp" and p.kind != "string" and p.kind != "null":
        raise TypeProblem(f"{p.kind} can't be cast to a timestamp")
    if p.kind == "float" and to == "int":
        return Typed(F.when(F.abs(p.col) < F.lit(9.2e18), F.when(p.col >= 0, F.floor(p.col)).otherwise(F.ceil(p.col))).cast("long"), to)
    return Typed(p.col.try_cast(SPARK_TYPES[to]), to)


class Binder:
    """Binds expressions in a scope. ``semi`` is called for IN with a query, where that is allowed."""

    def __init__(self, scope: Scope) -> None:
        self.scope = scope

    def bind(self, e: n.Expr) -> Typed:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def predicate(self, e: n.Expr) -> Column:
        found = self.bind(e)
        if found.kind not in ("bool", "null"):
            raise TypeProblem(f"a condition must be bool, not {found.kind}")
        return found.col

    def _literal(self, e: n.Literal) -> Typed:
        return Typed(F.lit(e.value).cast("long") if e.kind == "int" else F.lit(e.value), e.kind, e.value)

    def _name(self, e: n.Name) -> Typed:
        return self.scope.column(e.text)

    def _variable(self, e: n.Variable) -> Typed:
        if e.name in self.scope.columns:
            return self.scope.columns[e.name]
        raise UnknownName(f"no variable ${e.name}")

    def _unary(self, e: n.Unary) -> Typed:
        p = self.bind(e.operand)
        if e.op == "NOT":
            if p.kind not in ("bool", "null"):
                raise TypeProblem(f"NOT takes bool, not {p.kind}")
            return Typed(~p.col, "bool")
        if p.kind not in ("int", "float"):
            raise TypeProblem(f"- takes a number, not {p.kind}")
        return Typed(-p.col, p.kind)

    def _binary(self, e: n.Binary) -> Typed:
        return binary(e.op, self.bind(e.left), self.bind(e.right))

    def _isnull(self, e: n.IsNull) -> Typed:
        c = self.bind(e.operand).col
        return Typed(c.isNotNull() if e.negated else c.isNull(), "bool")

    def _between(self, e: n.Between) -> Typed:
        p = self.bind(e.operand)
        inside = binary("AND", binary(">=", p, self.bind(e.low)), binary("<=", p, self.bind(e.high)))
        return Typed(~inside.col, "bool") if e.negated else inside

    def _inlist(self, e: n.InList) -> Typed:
        p = self.bind(e.operand)
        if not e.items:
            return Typed(F.lit(e.negated), "bool")
        found = [alike(p, self.bind(x), "IN") for x in e.items]
        if all(x is found[0][0] for x, _ in found):
            inside = found[0][0].isin([y for _, y in found])
        else:
            inside = found[0][0] == found[0][1]
            for x, y in found[1:]:
                inside = inside | (x == y)
        return Typed(~inside if e.negated else inside, "bool")

    def _inquery(self, e: n.InQuery) -> Typed:
        raise InvalidComposition("IN with a query stands in WHERE, by itself or joined by AND")

    def _textmatch(self, e: n.TextMatch) -> Typed:
        p = self.bind(e.operand)
        if p.kind not in ("string", "null"):
            raise TypeProblem(f"{e.op} takes a string, not {p.kind}")
        c = {"like": p.col.like, "regex": p.col.rlike, "contains": p.col.contains}[e.op](e.pattern)
        return Typed(~c if e.negated else c, "bool")

    def _case(self, e: n.Case) -> Typed:
        values = [self.bind(v) for _, v in e.branches]
        other = self.bind(e.otherwise) if e.otherwise is not None else Typed(F.lit(None), "null")
        common = unified([*values, other], "CASE")
        out = None
        for (when, _), v in zip(e.branches, values, strict=True):
            test, value = self.predicate(when), converted(v, common)
            out = F.when(test, value) if out is None else out.when(test, value)
        return Typed(out.otherwise(converted(other, common)), common)

    def _cast(self, e: n.Cast) -> Typed:
        return cast(self.bind(e.operand), e.to)

    def _call(self, e: n.Call) -> Typed:
        if e.over is not None:
            return self.windowed(e)
        if e.star or e.name in ("COUNT", "COUNT_DISTINCT", "SUM", "AVG", "MIN", "MAX", *PERCENTILES):
            raise InvalidComposition(f"{e.name} is an aggregate: it stands in STATS or before OVER")
        return self.scope.functions.call(e.name, [self.bind(a) for a in e.args])

    # -- aggregates and windows -----------------------------------------------------------------

    def aggregate(self, e: n.Call) -> Typed:
        if e.star:
            if e.name != "COUNT":
                raise TypeProblem(f"{e.name} takes an expression")
            return Typed(F.count(F.lit(1)), "int")
        if len(e.args) != 1:
            raise TypeProblem(f"{e.name} takes 1 argument")
        p = self.bind(e.args[0])
        if e.name == "COUNT":
            return Typed(F.count(p.col), "int")
        if e.name == "COUNT_DISTINCT":
            return Typed(F.count_distinct(p.col), "int")
        if e.name in ("MIN", "MAX"):
            if p.kind not in ("int", "float", "string", "timestamp", "null"):
                raise TypeProblem(f"{e.name} doesn't take {p.kind}")
            return Typed((F.min if e.name == "MIN" else F.max)(p.col), p.kind)
        if p.kind not in ("int", "float", "null"):
            raise TypeProblem(f"{e.name} takes a number, not {p.kind}")
        if e.name == "SUM":
            return Typed(F.sum(p.col), p.kind)
        if e.name == "AVG":
            return Typed(F.avg(p.col), "float")
        raise UnknownName(f"no aggregate {e.name}")

    def ranked(self, e: n.Call) -> Typed:
        """What a percentile is taken of."""
        if e.star:
            raise TypeProblem(f"{e.name} takes an expression")
        if len(e.args) != 1:
            raise TypeProblem(f"{e.name} takes 1 argument")
        p = self.bind(e.args[0])
        if p.kind not in ("int", "float", "null"):
            raise TypeProblem(f"{e.name} takes a number, not {p.kind}")
        return p

    def windowed(self, e: n.Call) -> Typed:
        s = self.scope
        part = [s.column(s.entity).col] if s.entity else []
        part += [self.bind(x).col for x in e.over.partition]
        order = [ordered(self.bind(o.expr), o.descending) for o in e.over.order]
        if not order:
            if not s.time:
                raise InvalidComposition(f"{e.name} OVER needs an ORDER BY here")
            order = [s.column(s.time).col]
        tie = [F.col(f"`{s.seq}`")] if s.seq else []
        w = Window.partitionBy(*part).orderBy(*order, *tie)
        args = [self.bind(a) for a in e.args]
        if e.name in ("LAG", "LEAD"):
            if not 1 <= len(args) <= 2 or len(args) == 2 and not isinstance(args[1].value, int):
                raise TypeProblem(f"{e.name} takes a column and a literal number")
            return Typed((F.lag if e.name == "LAG" else F.lead)(args[0].col, args[1].value if len(args) == 2 else 1).over(w), args[0].kind)
        if e.name == "ROW_NUMBER":
            return Typed(F.row_number().over(w).cast("long"), "int")
        if e.name == "RANK":
            return Typed(F.rank().over(Window.partitionBy(*part).orderBy(*order)).cast("long"), "int")
        if e.name in ("SUM", "AVG", "COUNT", "MIN", "MAX"):
            found = self.aggregate(e)
            return Typed(found.col.over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)), found.kind)
        raise UnknownName(f"no window function {e.name}")


def ordered(p: Typed, descending: bool) -> Column:
    """Nulls last in ascending order, first in descending order."""
    if p.kind == "map":
        raise TypeProblem("maps have no order")
    return p.col.desc_nulls_first() if descending else p.col.asc_nulls_last()


def walk(e: object, visit: Callable[[n.Expr], None]) -> None:
    """Calls ``visit`` for every expression within a tree of expressions and stages."""
    if isinstance(e, n.Expr):
        visit(e)
    if isinstance(e, tuple):
        for x in e:
            walk(x, visit)
    elif hasattr(e, "__dataclass_fields__"):
        for f in e.__dataclass_fields__:
            if not isinstance(getattr(e, f), n.Pipeline):
                walk(getattr(e, f), visit)
