"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


class Expr:
    pass


@dataclass(frozen=True)
class Literal(Expr):
    value: Any
    kind: str  # bool, int, float, string, null


@dataclass(frozen=True)
class Name(Expr):
    parts: tuple[str, ...]

    @property
    def text(self) -> str:
        return ".".join(self.parts)


@dataclass(frozen=True)
class Variable(Expr):
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    operand: Expr
    negated: bool


@dataclass(frozen=True)
class Between(Expr):
    operand: Expr
    low: Expr
    high: Expr
    negated: bool


@dataclass(frozen=True)
class InList(Expr):
    operand: Expr
    items: tuple[Expr, ...]
    negated: bool


@dataclass(frozen=True)
class InQuery(Expr):
    operands: tuple[Expr, ...]
    query: Pipeline | str
    negated: bool


@dataclass(frozen=True)
class TextMatch(Expr):
    op: str  # like, regex, contains
    operand: Expr
    pattern: str
    negated: bool = False


@dataclass(frozen=True)
class Case(Expr):
    branches: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class Cast(Expr):
    operand: Expr
    to: str


@dataclass(frozen=True)
class Order:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Over:
    partition: tuple[Expr, ...] = ()
    order: tuple[Order, ...] = ()


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    over: Over | None = None
    star: bool = False


# -- patterns -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Step:
    events: tuple[str, ...]
    name: str | None = None
    where: Expr | None = None
    repeat: str = ""  # "", "+", "*"
    without: tuple[str, ...] = ()  # in the gap after this step
    immediately: bool = False  # the gap after this step has no relevant event


# -- stages -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Where:
    predicate: Expr


@dataclass(frozen=True)
class Select:
    items: tuple[tuple[Expr | str, str | None], ...]  # "*" and "t.*" are strings
    distinct: bool = False


@dataclass(frozen=True)
class Let:
    name: str
    expr: Expr


@dataclass(frozen=True)
class Match:
    mode: str  # first, all
    steps: tuple[Step, ...]
    within: int | None = None
    session: bool = False
    brackets: tuple[int, ...] = ()
    cumulative: bool = False
    emit_all: bool = False


@dataclass(frozen=True)
class Funnel:
    steps: tuple[Step, ...]
    within: int | None = None


@dataclass(frozen=True)
class Retention:
    entry: tuple[str, ...]
    activity: tuple[str, ...]
    brackets: tuple[int, ...]
    cumulative: bool = False


@dataclass(frozen=True)
class Sessionize:
    gap: int
    end: tuple[str, ...] = ()


@dataclass(frozen=True)
class Stats:
    outputs: tuple[tuple[str, Call], ...]
    groups: tuple[tuple[Expr, str], ...] = ()


@dataclass(frozen=True)
class Pick:
    which: str  # first, last, nth
    events: tuple[str, ...]
    n: int = 1
    where: Expr | None = None
    lookback: int = 0


@dataclass(frozen=True)
class Sample:
    fraction: float
    seed: int | None = None


@dataclass(frozen=True)
class Attribute:
    conversion: tuple[str, ...]
    touchpoints: tuple[str, ...]
    window: int
    key: Expr


@dataclass(frozen=True)
class OrderBy:
    items: tuple[Order, ...]


@dataclass(frozen=True)
class Limit:
    n: int


@dataclass(frozen=True)
class Pivot:
    column: str
    on: str
    values: tuple[Any, ...] = ()


@dataclass(frozen=True)
class Source:
    table: str
    last: int | None = None
    between: tuple[str, str] | None = None
    joined: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pipeline:
    source: Source
    stages: tuple[Any, ...] = ()


# -- statements ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Alias:
    name: str
    pipeline: Pipeline


@dataclass(frozen=True)
class Query:
    pipeline: Pipeline


@dataclass(frozen=True)
class Explain:
    pipeline: Pipeline


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    role: str = "property"
    not_null: bool = False
    default: Expr | None = None


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnSpec, ...]


@dataclass(frozen=True)
class AlterTable:
    name: str
    column: ColumnSpec


@dataclass(frozen=True)
class DropTable:
    name: str


@dataclass(frozen=True)
class Describe:
    name: str


@dataclass(frozen=True)
class InsertValues:
    table: str
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class InsertFile:
    table: str
    path: str
    options: dict[str, Any] = field(default_factory=dict, hash=False)


@dataclass(frozen=True)
class Delete:
    table: str
    predicate: Expr
    allow_scan: bool = False
