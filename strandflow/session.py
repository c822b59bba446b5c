"""The engine: text queries, and the same stages as methods."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.catalog import BATCH, SEQ, Catalog
from strandflow.errors import QueryError, TypeProblem
from strandflow.functions.scalar import Registry
from strandflow.language import nodes as n
from strandflow.language.parser import parse, parse_expression
from strandflow.plans.expressions import Binder, Scope, walk
from strandflow.plans.stream import Planner, conjuncts
from strandflow.sources.files import read_events
from strandflow.types import micros


@dataclass
class Result:
    """Rows, how many a statement changed, and what was worth a warning."""

    df: DataFrame
    rows_affected: int = 0
    warnings: list[str] = field(default_factory=list)


class Engine:
    """Tables by name and queries over them.

    ``now`` is the end of LAST ranges: a timestamp, its text, or None for the clock.
    """

    def __init__(self, spark: SparkSession, now: object = None) -> None:
        self.spark, self.catalog, self.functions = spark, Catalog(spark), Registry()
        self._now = None if now is None else micros(now)

    def now(self) -> int:
        return int(time.time() * 1e6) if self._now is None else self._now

    def register(self, name: str, df: DataFrame, entity: str, time: str, event: str, seq: str | None = None):
        return self.catalog.register(name, df, entity, time, event, seq)

    # -- text -----------------------------------------------------------------------------------

    def query(self, text: str) -> DataFrame:
        """The rows of a script's last statement."""
        return self.execute(text).df

    def execute(self, text: str) -> Result:
        statements = parse(text)
        planner = Planner(self.catalog, self.functions, self.now)
        result = None
        for i, s in enumerate(statements):
            later = {x.name for x in statements[i:] if isinstance(x, n.Alias)}
            planner.later = later
            if isinstance(s, n.Alias):
                planner.define(s, later)
            else:
                result = getattr(self, "_" + type(s).__name__.lower())(s, planner)
        return result

    @contextmanager
    def limits(self, tag: str, timeout: float | None = None) -> Iterator[Callable[[], None]]:
        """Runs what is inside under a tag; gives a function that cancels it, and cancels it by
        itself after ``timeout`` seconds."""
        import threading

        context = self.spark.sparkContext

        cancel = lambda: context.cancelJobsWithTag(tag)
        context.addJobTag(tag)
        timer = threading.Timer(timeout, cancel) if timeout else None
        if timer:
            timer.daemon = True
            timer.start()
        try:
            yield cancel
        finally:
            if timer:
                timer.cancel()
            context.removeJobTag(tag)

    def show(self, text: str, rows: int = 1000) -> str:
        """The first rows as a text table."""
        return self.query(text)._jdf.showString(rows, 0, False)

    def _query(self, s: n.Query, planner: Planner) -> Result:
        out = planner.plan(s.pipeline).settled()
        return Result(out.df.select(*(F.col(f"`{c}`") for c in out.visible)) if any(c.startswith("__") for c in out.df.columns) and not _selects_system(s.pipeline) else out.df.drop("__order"))

    def _explain(self, s: n.Explain, planner: Planner) -> Result:
        df = self._query(n.Query(s.pipeline), planner).df
        text = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return Result(self.spark.createDataFrame([(line,) for line in text.splitlines()], "plan string"))

    def _describe(self, s: n.Describe, planner: Planner) -> Result:
        return Result(self.catalog[s.name].described())

    def _createtable(self, s: n.CreateTable, planner: Planner) -> Result:
        self.catalog.create(s.name, [(c.name, c.type, c.role, c.not_null, None) for c in s.columns])
        self.defaults = getattr(self, "defaults", {}) | {(s.name, c.name): _value(c.default) for c in s.columns if c.default is not None}
        return self._done(0)

    def _altertable(self, s: n.AlterTable, planner: Planner) -> Result:
        default = _value(s.column.default) if s.column.default is not None else None
        self.catalog.add_column(s.name, s.column.name, s.column.type, default, s.column.not_null)
        if default is not None:
            self.defaults = getattr(self, "defaults", {}) | {(s.name, s.column.name): default}
        return self._done(0)

    def _droptable(self, s: n.DropTable, planner: Planner) -> Result:
        self.catalog.drop(s.name)
        return self._done(0)

    def _insertvalues(self, s: n.InsertValues, planner: Planner) -> Result:
        held = self.catalog[s.table]
        columns = [f for f in held.df.schema.fields if f.name not in (SEQ, BATCH)]
        rows = []
        for row in s.rows:
            if len(row) != len(columns):
                raise TypeProblem(f"table {s.table} has {len(columns)} columns, a row has {len(row)} values")
            rows.append(tuple(_coerced(_value(v), f) for v, f in zip(row, columns, strict=True)))
        spec = ", ".join(f"`{f.name}` {'long' if f.dataType.simpleString() == 'timestamp' else f.dataType.simpleString()}" for f in columns)
        df = self.spark.createDataFrame(rows, spec)
        return self._done(self.catalog.append(s.table, df.withColumns({f.name: F.timestamp_micros(f"`{f.name}`") for f in columns if f.dataType.simpleString() == "timestamp"})))

    def _insertfile(self, s: n.InsertFile, planner: Planner) -> Result:
        held = self.catalog[s.table]
        df = read_events(self.spark, s.path, held, **s.options)
        defaults = {c: F.lit(v) for (t, c), v in getattr(self, "defaults", {}).items() if t == s.table and c not in df.columns}
        return self._done(self.catalog.append(s.table, df.withColumns(defaults) if defaults else df))

    def _delete(self, s: n.Delete, planner: Planner) -> Result:
        held = self.catalog[s.table]
        if not s.allow_scan and not _cheap(s.predicate, {held.entity, held.time, SEQ, BATCH}):
            raise QueryError("this DELETE has to look at all rows: add ALLOW SCAN")
        scope = Scope.of(held.df, self.functions)
        gone = F.coalesce(Binder(scope).predicate(s.predicate), F.lit(False))
        many = held.df.where(gone).count()
        self.catalog.replace(s.table, held.df.where(~gone))
        return self._done(many)

    def _done(self, rows: int) -> Result:
        return Result(self.spark.createDataFrame([(rows,)], "rows_affected long"), rows)

    # -- methods --------------------------------------------------------------------------------

    def table(self, name: str) -> Events:
        return Events(self, name)


def _selects_system(p: n.Pipeline) -> bool:
    found: list[str] = []
    walk(p.stages, lambda e: found.append(e.text) if isinstance(e, n.Name) else None)
    return any(x.startswith("__") for x in found) and any(isinstance(s, (n.Select, n.Stats)) for s in p.stages)


def _value(e: n.Expr) -> object:
    if isinstance(e, n.Literal):
        return e.value
    raise TypeProblem("only literal values can be inserted")


def _coerced(v: object, f) -> object:
    of = f.dataType.simpleString()
    if v is None:
        return None
    if of == "timestamp":
        return micros(v)
    if of == "double" and isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    ok = {"bigint": int, "string": str, "boolean": bool, "double": float}.get(of)
    if ok is not None and (not isinstance(v, ok) or ok is int and isinstance(v, bool)):
        raise TypeProblem(f"{f.name} takes {of}, not {v!r}")
    return v


def _cheap(e: n.Expr, keys: set[str]) -> bool:
    """Whether a predicate is on the entity, the time and the system's columns only, by value or range."""
    for part in conjuncts(e):
        if isinstance(part, n.Binary) and isinstance(part.left, n.Name) and part.left.text in keys and part.op in ("=", "<", "<=", ">", ">="):
            continue
        if isinstance(part, n.InList) and not part.negated and isinstance(part.operand, n.Name) and part.operand.text in keys:
            continue
        if isinstance(part, n.Between) and not part.negated and isinstance(part.operand, n.Name) and part.operand.text in keys:
            continue
        return False
    return True


class Events:
    """A pipeline that is built by methods: each adds a stage, given as in the language."""

    def __init__(self, engine: Engine, text: str, aliases: str = "") -> None:
        self.engine, self.text, self.aliases = engine, text, aliases

    def pipe(self, stage: str) -> Events:
        return Events(self.engine, f"{self.text} | {stage}", self.aliases)

    def last(self, duration: str) -> Events:
        return Events(self.engine, f"{self.text} LAST {duration}", self.aliases)

    def between(self, low: str, high: str) -> Events:
        return Events(self.engine, f"{self.text} BETWEEN '{low}' AND '{high}'", self.aliases)

    def join(self, *tables: str) -> Events:
        return Events(self.engine, " JOIN ".join([self.text, *tables]), self.aliases)

    def where(self, predicate: str) -> Events:
        return self.pipe(f"WHERE {predicate}")

    def select(self, *items: str, distinct: bool = False) -> Events:
        return self.pipe(f"SELECT {'DISTINCT ' * distinct}{', '.join(items)}")

    def let(self, **columns: str) -> Events:
        out = self
        for name, expr in columns.items():
            out = out.pipe(f"LET {name} = {expr}")
        return out

    def match(self, pattern: str, mode: str = "first", within: str | None = None, brackets: list[str] | None = None, cumulative: bool = False, emit_all: bool = False) -> Events:
        text = f"MATCH {mode.upper()} SEQUENCE({pattern})"
        if within:
            text += f" WITHIN {within.upper() if within.lower() == 'session' else within}"
        if brackets:
            text += f" BRACKETS {'CUMULATIVE ' * cumulative}[{', '.join(brackets)}]"
        return self.pipe(text + " EMIT ALL" * emit_all)

    def funnel(self, pattern: str, within: str | None = None) -> Events:
        return self.pipe(f"FUNNEL({pattern})" + (f" WITHIN {within}" if within else ""))

    def retention(self, entry: str, activity: str, brackets: list[str], cumulative: bool = False) -> Events:
        return self.pipe(f"RETENTION(entry: {entry}, activity: {activity}, brackets: [{', '.join(brackets)}]{', cumulative: true' * cumulative})")

    def sessionize(self, gap: str, end: list[str] | None = None) -> Events:
        return self.pipe(f"SESSIONIZE(gap: {gap}" + (f", end: ({', '.join(end)})" if end else "") + ")")

    def first(self, events: str, lookback: str | None = None) -> Events:
        return self.pipe(f"FIRST({events}" + (f", lookback: {lookback}" if lookback else "") + ")")

    def latest(self, events: str) -> Events:
        return self.pipe(f"LAST({events})")

    def nth(self, events: str, number: int, lookback: str | None = None) -> Events:
        return self.pipe(f"NTH({events}, {number}" + (f", lookback: {lookback}" if lookback else "") + ")")

    def sample(self, fraction: float, seed: int | None = None) -> Events:
        return self.pipe(f"SAMPLE(fraction: {fraction}" + (f", seed: {seed}" if seed is not None else "") + ")")

    def attribute(self, conversion: str, touchpoints: str, window: str, key: str) -> Events:
        return self.pipe(f"ATTRIBUTE(conversion: {conversion}, touchpoints: {touchpoints}, window: {window}, touchpoint_key: {key})")

    def cohort(self, keys: str, name: str, other: Events) -> Events:
        """Keeps rows whose ``keys`` are among the rows of another pipeline."""
        return Events(self.engine, f"{self.text} | WHERE {keys} IN {name}", f"{other.aliases}{self.aliases}{name} = {other.text}\n")

    def stats(self, by: str | None = None, **outputs: str) -> Events:
        return self.pipe("STATS " + ", ".join(f"{k} = {v}" for k, v in outputs.items()) + (f" GROUP BY {by}" if by else ""))

    def pivot(self, column: str, on: str, values: list | None = None) -> Events:
        return self.pipe(f"PIVOT {column} ON {on}" + (" IN (" + ", ".join(repr(v) for v in values) + ")" if values else ""))

    def order_by(self, *items: str) -> Events:
        return self.pipe(f"ORDER BY {', '.join(items)}")

    def limit(self, rows: int) -> Events:
        return self.pipe(f"LIMIT {rows}")

    def df(self) -> DataFrame:
        return self.engine.query(self.aliases + self.text)


def seq(*steps: str) -> str:
    """Steps one after another."""
    return " THEN ".join(steps)


def event(*names: str, name: str | None = None, where: str | None = None, repeat: str = "", without: list[str] | None = None) -> str:
    """A step: one of these events."""
    text = names[0] if len(names) == 1 else f"({' OR '.join(names)})"
    text = f"{name}: {text}" if name else text
    text = f"{text} WHERE {where}" if where else text
    text = f"({text}){repeat}" if repeat and where else text + repeat
    return f"{text} WITHOUT ({' OR '.join(without)})" if without and len(without) > 1 else f"{text} WITHOUT {without[0]}" if without else text


__all__ = ["Engine", "Events", "Result", "event", "parse_expression", "seq"]
