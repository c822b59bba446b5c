"""What flows between stages, and the stages themselves."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.catalog import Catalog
from strandflow.errors import AliasCycle, InvalidComposition, NameCollision, TypeProblem, UnknownName
from strandflow.functions.scalar import Registry, Typed
from strandflow.language import nodes as n
from strandflow.operators import entity as ops
from strandflow.operators.match import PatternStep, match
from strandflow.operators.percentiles import percentiles
from strandflow.plans.expressions import PERCENTILES, Binder, Scope, binary, ordered, walk
from strandflow.types import micros

#: Cohorts of at most so many rows are sent to all tasks.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Stream:
    """Rows and what is known of them. ``events``: they are an entity's ordered events, so entity
    operators may follow. ``low`` and ``high`` (microseconds, inclusive) are the stated time range;
    it is applied only when a stage needs it, since some stages look beyond it."""

    df: DataFrame
    events: bool = True
    entity: str | None = None
    time: str | None = None
    event: str | None = None
    seq: str | None = None
    low: int | None = None
    high: int | None = None
    after: str = "source"
    session: bool = False
    tables: tuple[str, ...] = ()
    aliases: dict[str, str] = field(default_factory=dict)

    def ranged(self, back: int = 0, forth: int = 0) -> DataFrame:
        """The rows of the range, widened by nanoseconds."""
        at, df = F.col(f"`{self.time}`") if self.time else None, self.df
        if self.low is not None:
            df = df.where(at >= F.timestamp_micros(F.lit(self.low - back // 1000)))
        if self.high is not None:
            df = df.where(at <= F.timestamp_micros(F.lit(self.high + forth // 1000)))
        return df

    def settled(self) -> Stream:
        return replace(self, df=self.ranged(), low=None, high=None) if self.low is not None or self.high is not None else self

    @property
    def visible(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith("__")]


_ENTITY = (n.Match, n.Funnel, n.Retention, n.Sessionize, n.Pick, n.Sample, n.Attribute)
_NAMES = {n.OrderBy: "ORDER BY", n.Pick: "FIRST/LAST/NTH"}


class Planner:
    """Pipelines to DataFrames. ``now`` (microseconds) is the end of LAST ranges."""

    def __init__(self, catalog: Catalog, functions: Registry, now: Callable[[], int]) -> None:
        self.catalog, self.functions, self.now = catalog, functions, now
        self.aliases: dict[str, Stream] = {}
        self.defined: list[str] = []

    # -- sources --------------------------------------------------------------------------------

    def define(self, alias: n.Alias, later: set[str]) -> None:
        if alias.name in self.aliases or alias.name in self.catalog.tables:
            raise NameCollision(f"{alias.name} is taken")
        self.later = later
        self.aliases[alias.name] = self.plan(alias.pipeline, alias.name)

    def plan(self, p: n.Pipeline, within: str | None = None) -> Stream:
        self.within = within
        stream = self.source(p.source)
        for i, stage in enumerate(p.stages):
            stream = self.stage(stream, stage, p.stages[i + 1 :])
        return stream

    def alias(self, name: str) -> Stream:
        if name in self.aliases:
            return self.aliases[name]
        if name == getattr(self, "within", None) or name in getattr(self, "later", ()):
            raise AliasCycle(f"{name} isn't defined yet where it is used")
        raise UnknownName(f"no alias {name}")

    def source(self, s: n.Source) -> Stream:
        low = high = None
        if s.last is not None:
            high = self.now() - 1
            low = high + 1 - s.last // 1000
        elif s.between is not None:
            low, high = (micros(x) for x in s.between)
        if s.joined:
            stream = self.joined([s.table, *s.joined])
        elif s.table in self.catalog.tables:
            t = self.catalog[s.table]
            stream = Stream(t.df, True, t.entity, t.time, t.event, t.order, tables=(t.name,), aliases={f"{t.name}.{c}": c for c in t.df.columns})
        elif s.table in self.aliases or s.table in getattr(self, "later", ()) or s.table == getattr(self, "within", None):
            stream = self.alias(s.table)
            if low is not None and not stream.events:
                raise InvalidComposition(f"{s.table} has no event time for a range")
            stream = stream.settled() if low is not None else stream
        else:
            raise UnknownName(f"no table {s.table}")
        return replace(stream, low=low, high=high) if low is not None else stream

    def joined(self, names: list[str]) -> Stream:
        if len(set(names)) < len(names):
            raise InvalidComposition("a table is joined with others, not with itself")
        tables = [self.catalog[x] for x in names]
        kinds = {dict(t.df.dtypes)[t.entity] for t in tables}
        if len(kinds) > 1:
            raise TypeProblem(f"the entities of {', '.join(names)} have different types")
        df = ops.merged([(t.name, t.df, t.entity, t.time, t.event, t.order) for t in tables])
        return Stream(df, True, "entity_id", "ts", "event_type", "__seq", tables=tuple(names))

    # -- stages ---------------------------------------------------------------------------------

    def scope(self, s: Stream, **more) -> Scope:
        return Scope.of(s.df, self.functions, entity=s.entity if s.entity in s.df.columns else None, time=s.time if s.time in s.df.columns else None, seq=s.seq if s.seq in s.df.columns else None, aliases=s.aliases, **more)

    def stage(self, s: Stream, stage: Any, rest: tuple) -> Stream:
        name = _NAMES.get(type(stage), type(stage).__name__.upper())
        if s.after in ("FUNNEL", "RETENTION"):
            raise InvalidComposition(f"nothing follows {s.after}")
        if isinstance(stage, _ENTITY) and not s.events:
            raise InvalidComposition(f"{name} can't follow {s.after}: its rows aren't events")
        if isinstance(stage, n.Pivot) and s.after not in ("STATS", "WHERE", "SELECT", "LET"):
            raise InvalidComposition(f"PIVOT follows STATS, not {s.after}")
        made = getattr(self, "stage_" + type(stage).__name__.lower())(s, stage, rest)
        return replace(made, after=name)

    def stage_where(self, s: Stream, stage: n.Where, rest: tuple) -> Stream:
        df, binder = s.df, Binder(self.scope(s))
        for part in conjuncts(stage.predicate):
            df = self.semi(df, binder, part) if isinstance(part, n.InQuery) else df.where(binder.predicate(part))
        return replace(s, df=df)

    def semi(self, df: DataFrame, binder: Binder, e: n.InQuery) -> DataFrame:
        if e.negated:
            raise InvalidComposition("NOT IN takes a list, not a query")
        if isinstance(e.query, str):
            found = self.alias(e.query)
        else:
            found = Planner(self.catalog, self.functions, self.now)
            found.aliases = self.aliases
            found = found.plan(e.query)
        found = found.settled()
        keys = found.visible
        if len(keys) != len(e.operands):
            raise TypeProblem(f"IN compares {len(e.operands)} columns with {len(keys)}")
        other = found.df.select(*(F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(keys)))
        kinds = Scope.of(other, self.functions)
        test = None
        for i, x in enumerate(e.operands):
            left, right = binder.bind(x), kinds.column(f"__in{i}")
            if left.kind != right.kind:
                raise TypeProblem(f"IN compares {left.kind} with {right.kind}")
            one = left.col == right.col
            test = one if test is None else test & one
        return df.join(other, test, "left_semi")

    def stage_select(self, s: Stream, stage: n.Select, rest: tuple) -> Stream:
        s = s.settled()
        binder, out, names = Binder(self.scope(s)), [], []
        for expr, label in stage.items:
            if isinstance(expr, str):
                prefix = expr[:-1] if expr != "*" else ""
                single = len(s.tables) == 1 and prefix == f"{s.tables[0]}."
                found = [c for c in s.visible if c.startswith("" if single else prefix)]
                if not found:
                    raise UnknownName(f"no columns {expr}")
                out += [F.col(f"`{c}`") for c in found]
                names += found
                continue
            name = label or (expr.name if isinstance(expr, n.Variable) else s.aliases.get(expr.text, expr.text))
            out.append(binder.bind(expr).col.alias(name))
            names.append(name)
        for x in names:
            if names.count(x) > 1:
                raise NameCollision(f"SELECT gives two columns {x}")
        kept = s.events and not stage.distinct and all(c in names for c in (s.entity, s.time, s.event))
        if kept and s.seq not in names:
            out.append(F.col(f"`{s.seq}`").alias("__order"))
        df = s.df.select(*out)
        if stage.distinct:
            df = df.distinct()
        return replace(s, df=df, events=kept, seq=s.seq if s.seq in names else "__order" if kept else None, session=s.session and "session_id" in names, aliases={k: v for k, v in s.aliases.items() if v in names})

    def stage_let(self, s: Stream, stage: n.Let, rest: tuple) -> Stream:
        if stage.name in s.df.columns:
            raise NameCollision(f"there is a column {stage.name}")
        return replace(s, df=s.df.withColumn(stage.name, Binder(self.scope(s)).bind(stage.expr).col)) if not _windows(stage.expr) else self._let_windowed(s.settled(), stage)

    def _let_windowed(self, s: Stream, stage: n.Let) -> Stream:
        return replace(s, df=s.df.withColumn(stage.name, Binder(self.scope(s)).bind(stage.expr).col))

    def stage_orderby(self, s: Stream, stage: n.OrderBy, rest: tuple) -> Stream:
        s = s.settled()
        binder = Binder(self.scope(s))
        return replace(s, df=s.df.orderBy(*(ordered(binder.bind(o.expr), o.descending) for o in stage.items)), events=False)

    def stage_limit(self, s: Stream, stage: n.Limit, rest: tuple) -> Stream:
        s = s.settled()
        return replace(s, df=s.df.limit(stage.n), events=False)

    def stage_stats(self, s: Stream, stage: n.Stats, rest: tuple) -> Stream:
        s = s.settled()
        binder = Binder(self.scope(s))
        groups = [(binder.bind(e), s.aliases.get(name, name)) for e, name in stage.groups]
        names = [x for _, x in groups] + [x for x, _ in stage.outputs]
        for x in names:
            if names.count(x) > 1:
                raise NameCollision(f"STATS gives two columns {x}")
        keys, unfold = {}, {}
        for p, name in groups:
            if p.kind == "map":  # maps are grouped by their sorted entries
                keys[name] = F.array_sort(F.map_entries(p.col))
                unfold[name] = F.map_from_entries(F.col(f"`{name}`"))
            else:
                keys[name] = p.col
        made, percents = [], {}
        for name, call in stage.outputs:
            if call.name in PERCENTILES:
                percents.setdefault(call.args, (binder.ranked(call), {}))[1][name] = PERCENTILES[call.name]
            else:
                made.append(binder.aggregate(call).col.alias(name))
        parts = [percentiles(s.df, keys, p.col, wanted) for p, wanted in percents.values()]
        if made or not parts:
            parts.insert(0, s.df.groupBy(*(c.alias(name) for name, c in keys.items())).agg(*made))
        df = _side_by_side(parts, list(keys))
        if percents:
            df = df.select(*(F.col(f"`{x}`") for x in names))
        return Stream(df.withColumns(unfold) if unfold else df, events=False)

    def stage_pivot(self, s: Stream, stage: n.Pivot, rest: tuple) -> Stream:
        scope = self.scope(s)
        scope.column(stage.column), scope.column(stage.on)
        others = [F.col(f"`{c}`") for c in s.visible if c not in (stage.column, stage.on)]
        values = list(stage.values)
        if not values:  # the columns are not known before the values are
            values = [r[0] for r in s.df.select(F.col(f"`{stage.on}`")).where(F.col(f"`{stage.on}`").isNotNull()).distinct().orderBy(1).collect()]
        taken = {c for c in s.visible if c not in (stage.column, stage.on)}
        for v in values:
            if str(v) in taken:
                raise NameCollision(f"PIVOT gives two columns {v}")
            taken.add(str(v))
        df = s.df.groupBy(*others).agg(*(F.first(F.when(F.col(f"`{stage.on}`") == F.lit(v), F.col(f"`{stage.column}`")), ignorenulls=True).alias(str(v)) for v in values))
        return Stream(df, events=False)

    # -- entity operators -----------------------------------------------------------------------

    def stage_sample(self, s: Stream, stage: n.Sample, rest: tuple) -> Stream:
        return replace(s, df=ops.sample(s.df, entity=s.entity, fraction=stage.fraction, seed=stage.seed or 0))

    def stage_sessionize(self, s: Stream, stage: n.Sessionize, rest: tuple) -> Stream:
        s = s.settled()
        for c in ("session_id", "session_duration"):
            if c in s.df.columns:
                raise NameCollision(f"there is a column {c}")
        end = F.col(f"`{s.event}`").isin(list(stage.end)) if stage.end else None
        df = ops.sessionize(s.df, entity=s.entity, time=s.time, seq=s.seq, gap=stage.gap, end=end)
        # system columns go; the order of the events stays, hidden
        hidden = [c for c in df.columns if c.startswith("__") and c not in (s.seq, "__source_table_id")]
        return replace(s, df=df.drop(*hidden), session=True)

    def stage_pick(self, s: Stream, stage: n.Pick, rest: tuple) -> Stream:
        df = s.ranged(back=stage.lookback)
        wanted = F.col(f"`{s.event}`").isin(self.events(s, stage.events))
        if stage.where is not None:
            wanted = wanted & Binder(self.scope(s)).predicate(stage.where)
        out = ops.pick(df, entity=s.entity, time=s.time, seq=s.seq, which=stage.which, candidate=wanted, n=stage.n)
        return replace(s, df=out.drop(*(c for c in out.columns if c.startswith("__"))), events=False, low=None, high=None)

    def stage_attribute(self, s: Stream, stage: n.Attribute, rest: tuple) -> Stream:
        key = Binder(self.scope(s)).bind(stage.key)
        if key.kind not in ("string", "null"):
            raise TypeProblem(f"touchpoint_key must be a string, not {key.kind}")
        for x in stage.conversion:
            if x in s.df.columns:
                raise NameCollision(f"{x} is a column too")
        carry = {}
        for name in named(rest):
            prefix, _, column = name.rpartition(".")
            if prefix in stage.conversion and column in s.df.columns:
                carry[name] = column
        at = F.col(f"`{s.event}`")
        df = ops.attribute(
            s.ranged(back=stage.window), entity=s.entity, time=s.time, seq=s.seq, conversion=at.isin(self.events(s, stage.conversion)), touchpoint=at.isin(self.events(s, stage.touchpoints)),
            window=stage.window, key=key.col, carry=carry, low=s.low, high=s.high,
        )
        if s.entity != "entity_id":
            df = df.withColumnRenamed(s.entity, "entity_id")
        return Stream(df, events=False, entity="entity_id", time="conversion_ts", aliases={s.entity: "entity_id"})

    def events(self, s: Stream, names: tuple[str, ...]) -> list[str]:
        """Event types as they stand in the data: with their table where several are joined."""
        out = []
        for x in names:
            table, _, event = x.rpartition(".")
            if len(s.tables) > 1:
                if table not in s.tables:
                    raise UnknownName(f"{x}: name the table, one of {', '.join(s.tables)}")
                out.append(x)
            else:
                out.append(event if table in s.tables else x)
        return out

    def pattern(self, s: Stream, steps: tuple[n.Step, ...]) -> list[PatternStep]:
        names = step_names(steps)
        scope = self.scope(s)
        out = []
        for i, (step, name) in enumerate(zip(steps, names, strict=True)):
            own = replace_scope(scope, {f"{name}.{c}": c for c in scope.columns})
            flag, binds = F.col(f"`{s.event}`").isin(self.events(s, step.events)), {}
            for part in conjuncts(step.where) if step.where is not None else []:
                if bound := binding(part):
                    variable, column = bound
                    binds[variable] = Binder(own).bind(column).col
                    continue
                if uses_variable(part):
                    raise TypeProblem("a variable is compared by = with a column, joined by AND")
                flag = flag & Binder(own).predicate(part)
            without = F.col(f"`{s.event}`").isin(self.events(s, step.without)) if step.without else None
            skippable = step.repeat == "*" and 0 < i < len(steps) - 1
            out.append(PatternStep(name, flag, binds, without, step.immediately, skippable, bool(step.repeat)))
        return out

    def stage_match(self, s: Stream, stage: n.Match, rest: tuple) -> Stream:
        if stage.session and not s.session:
            raise InvalidComposition("WITHIN SESSION needs SESSIONIZE before it")
        if not stage.steps:
            raise InvalidComposition("a pattern needs a step")
        steps = self.pattern(s, stage.steps)
        seen = [x.name for x in steps]
        wanted = named(rest)
        carry: dict[str, list[str]] = {}
        for name in wanted:
            prefix, _, column = name.rpartition(".")
            if prefix in seen and column in s.df.columns:
                carry.setdefault(prefix, []).append(column)
        ahead = max([stage.within or 0, *stage.brackets]) if stage.within is not None or stage.brackets else None
        # without a window, a match may end at any time after the range
        df = s.ranged(forth=ahead) if ahead is not None else s.ranged()
        out = match(
            df, steps, entity=s.entity, time=s.time, seq=s.seq, mode=stage.mode, within=stage.within, session="session_id" if stage.session else None, brackets=stage.brackets,
            cumulative=stage.cumulative, emit_all=stage.emit_all, low=s.low, high=s.high, carry=carry, match_events="match_events" in wanted,
        )
        return Stream(out, events=False, entity="entity_id", aliases={s.entity: "entity_id"} if s.entity not in out.columns else {})

    def stage_funnel(self, s: Stream, stage: n.Funnel, rest: tuple) -> Stream:
        names = []
        for step in stage.steps:
            name = step.name or step.events[0].rpartition(".")[2]
            if name in names:
                raise NameCollision(f"two steps are called {name}: name them")
            names.append(name)
        matched = self.stage_match(s, n.Match("first", stage.steps, stage.within, emit_all=True), ())
        sums = [F.sum((F.col("step_reached") >= k).cast("long")).alias(x) for k, x in enumerate(names, 1)]
        return Stream(matched.df.agg(*sums), events=False)

    def stage_retention(self, s: Stream, stage: n.Retention, rest: tuple) -> Stream:
        steps = n.Step(stage.entry, "entry"), n.Step(stage.activity, "activity")
        matched = self.stage_match(s, n.Match("first", steps, brackets=stage.brackets, cumulative=stage.cumulative, emit_all=True), ())
        return Stream(matched.df.groupBy("bracket").agg(F.avg((F.col("step_reached") >= 2).cast("long")).alias("retention_rate")), events=False)


def _side_by_side(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Tables with one row for each of the same groups as one table."""
    df = parts[0]
    for part in parts[1:]:
        part, same = part.withColumnsRenamed({k: f"__of_{k}" for k in keys}), F.lit(True)
        for k in keys:
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__of_{k}`"))
        df = df.join(part, same).drop(*(f"__of_{k}" for k in keys))
    return df


def conjuncts(e: n.Expr) -> list[n.Expr]:
    if isinstance(e, n.Binary) and e.op == "AND":
        return conjuncts(e.left) + conjuncts(e.right)
    return [e]


def named(rest: tuple) -> set[str]:
    """Names that the following stages use, up to one that makes new rows."""
    out: set[str] = set()
    for stage in rest:
        walk(stage, lambda e: out.add(e.text) if isinstance(e, n.Name) else None)
        if isinstance(stage, n.Stats):
            break
    return out


def _windows(e: n.Expr) -> bool:
    found = []
    walk(e, lambda x: found.append(x) if isinstance(x, n.Call) and x.over else None)
    return bool(found)


def binding(e: n.Expr) -> tuple[str, n.Expr] | None:
    """``column = $v``, either way round."""
    if isinstance(e, n.Binary) and e.op == "=":
        if isinstance(e.right, n.Variable) and not uses_variable(e.left):
            return e.right.name, e.left
        if isinstance(e.left, n.Variable) and not uses_variable(e.right):
            return e.left.name, e.right
    return None


def uses_variable(e: n.Expr) -> bool:
    found = []
    walk(e, lambda x: found.append(x) if isinstance(x, n.Variable) else None)
    return bool(found)


def step_names(steps: tuple[n.Step, ...]) -> list[str]:
    """A step's own name, else its event's; events that repeat are numbered from 0."""
    plain = [s.events[0] for s in steps if s.name is None]
    out, seen = [], {}
    for s in steps:
        if s.name is not None:
            name = s.name
        elif plain.count(s.events[0]) > 1:
            i = seen.get(s.events[0], 0)
            seen[s.events[0]] = i + 1
            name = f"{s.events[0]}_{i}"
        else:
            name = s.events[0]
        if name in out:
            raise NameCollision(f"two steps are called {name}")
        out.append(name)
    return out


def replace_scope(scope: Scope, aliases: dict[str, str]) -> Scope:
    return replace(scope, aliases=scope.aliases | aliases)


__all__ = ["Binder", "Column", "Planner", "Stream", "Typed", "binary"]
