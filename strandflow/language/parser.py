"""Tokens to statements, by recursive descent."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from strandflow.errors import SyntaxProblem
from strandflow.language import nodes as n
from strandflow.language.tokens import Token, tokens

AGGREGATES = ("COUNT", "COUNT_DISTINCT", "SUM", "AVG", "MIN", "MAX", "P50", "P90", "P95", "P99")
_TYPES = {"STRING": "string", "INT": "int", "FLOAT": "float", "BOOL": "bool", "TIMESTAMP": "timestamp"}


def parse(text: str) -> list[Any]:
    """The statements of a script: alias definitions, then one statement (or several parted by ``;``)."""
    return Parser(text).script()


def parse_pipeline(text: str) -> n.Pipeline:
    p = Parser(text)
    out = p.pipeline()
    p.done()
    return out


def parse_expression(text: str) -> n.Expr:
    p = Parser(text)
    out = p.expression()
    p.done()
    return out


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens = tokens(text)
        self.at = 0

    # -- tokens ---------------------------------------------------------------------------------

    @property
    def here(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, by: int = 1) -> Token:
        return self.tokens[min(self.at + by, len(self.tokens) - 1)]

    def problem(self, message: str, token: Token | None = None) -> SyntaxProblem:
        token = token or self.here
        return SyntaxProblem(message, token.line, token.column)

    def next(self) -> Token:
        token = self.here
        self.at = min(self.at + 1, len(self.tokens) - 1)
        return token

    def word(self, *words: str) -> bool:
        """Takes these keywords if they come next."""
        if all((t := self.ahead(i)).kind == "keyword" and t.value == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        if self.here.kind == "op" and self.here.value == text:
            self.at += 1
            return True
        return False

    def is_op(self, text: str, by: int = 0) -> bool:
        return self.ahead(by).kind == "op" and self.ahead(by).value == text

    def need(self, *words: str) -> None:
        if not self.word(*words):
            raise self.problem(f"expected {' '.join(words)}, found {self.here.text or 'the end'!r}")

    def need_op(self, text: str) -> None:
        if not self.op(text):
            raise self.problem(f"expected {text!r}, found {self.here.text or 'the end'!r}")

    def take(self, kind: str, what: str) -> Any:
        if self.here.kind != kind:
            raise self.problem(f"expected {what}, found {self.here.text or 'the end'!r}")
        return self.next().value

    def identifier(self) -> str:
        return self.take("name", "a name")

    def name(self) -> str:
        if self.here.kind == "quoted":
            return str(self.next().value)
        return self.identifier()

    def label(self, name: str) -> None:
        """A named parameter, as ``gap:``."""
        token = self.here
        if token.text.lower() != name or token.kind not in ("name", "keyword"):
            raise self.problem(f"expected {name}:")
        self.next()
        self.need_op(":")

    def is_label(self, name: str, by: int = 0) -> bool:
        return self.ahead(by).text.lower() == name and self.is_op(":", by + 1)

    def listed(self, item: Callable[[], Any]) -> tuple:
        out = [item()]
        while self.op(","):
            out.append(item())
        return tuple(out)

    def done(self) -> None:
        if self.here.kind != "end":
            raise self.problem(f"unexpected {self.here.text!r}")

    # -- statements -----------------------------------------------------------------------------

    def script(self) -> list[Any]:
        out = []
        while self.here.kind != "end":
            out.append(self.statement())
            while self.op(";"):
                pass
        if not out:
            raise self.problem("an empty script")
        if isinstance(out[-1], n.Alias):
            raise self.problem("a script ends with a query or another statement, not with an alias")
        return out

    def statement(self) -> Any:
        if self.word("EXPLAIN"):
            return n.Explain(self.pipeline())
        if self.word("DESCRIBE"):
            return n.Describe(self.name())
        if self.word("CREATE"):
            self.need("TABLE")
            return self.create()
        if self.word("ALTER"):
            self.need("TABLE")
            table = self.name()
            self.need("ADD")
            self.word("COLUMN")
            return n.AlterTable(table, self.column())
        if self.word("DROP"):
            self.need("TABLE")
            return n.DropTable(self.name())
        if self.word("INSERT"):
            self.need("INTO")
            return self.insert()
        if self.word("DELETE"):
            self.need("FROM")
            table = self.name()
            self.need("WHERE")
            predicate = self.expression()
            allow = self.word("ALLOW")
            if allow:
                self.need("SCAN")
            return n.Delete(table, predicate, allow)
        if self.here.kind == "name" and self.is_op("=", 1):
            name = self.identifier()
            self.need_op("=")
            return n.Alias(name, self.pipeline())
        return n.Query(self.pipeline())

    def create(self) -> n.CreateTable:
        table = self.name()
        self.need_op("(")
        columns = self.listed(self.column)
        self.need_op(")")
        return n.CreateTable(table, columns)

    def column(self) -> n.ColumnSpec:
        name, kind = self.name(), self.type_name()
        role, not_null, default = "property", False, None
        while True:
            if self.phrase("ENTITY", "KEY"):
                role = "entity_key"
            elif self.phrase("EVENT", "TIME"):
                role = "event_time"
            elif self.phrase("EVENT", "TYPE"):
                role = "event_type"
            elif self.word("NOT"):
                self.need("NULL")
                not_null = True
            elif self.word("NULL"):
                pass
            elif self.word("DEFAULT"):
                default = self.unary()
            else:
                return n.ColumnSpec(name, kind, role, not_null or role != "property", default)

    def phrase(self, *words: str) -> bool:
        """Words that are names elsewhere."""
        if all(self.ahead(i).kind == "name" and self.ahead(i).text.upper() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def type_name(self) -> str:
        token = self.next()
        text = token.text.upper()
        if text in _TYPES:
            return _TYPES[text]
        if text in ("LIST", "MAP"):
            self.need_op("(")
            inner = self.type_name()
            self.need_op(")")
            return f"{text.lower()}<{inner}>"
        raise self.problem(f"{token.text!r} isn't a type", token)

    def insert(self) -> n.InsertValues | n.InsertFile:
        table = self.name()
        if self.word("VALUES"):

            def row() -> tuple:
                self.need_op("(")
                values = self.listed(self.expression)
                self.need_op(")")
                return values

            return n.InsertValues(table, self.listed(row))
        self.need("FROM")
        path = self.take("string", "a path")
        options: dict[str, Any] = {}
        if self.word("WITH"):
            self.need_op("(")
            while True:
                token = self.next()
                self.need_op(":")
                key = token.text.lower()
                if key == "map":
                    self.need_op("(")
                    pairs = self.listed(self.mapping)
                    self.need_op(")")
                    options["map"] = dict(pairs)
                elif key in ("format", "delimiter", "header"):
                    options[key] = {"TRUE": True, "FALSE": False}.get(str(self.here.value), self.here.value)
                    self.next()
                else:
                    raise self.problem(f"unknown option {token.text!r}", token)
                if not self.op(","):
                    break
            self.need_op(")")
        return n.InsertFile(table, path, options)

    def mapping(self) -> tuple[str, str]:
        source = self.name()
        self.need("AS")
        return source, self.name()

    # -- pipelines ------------------------------------------------------------------------------

    def pipeline(self) -> n.Pipeline:
        source = self.source()
        stages = []
        while self.op("|"):
            stages.append(self.stage())
        return n.Pipeline(source, tuple(stages))

    def source(self) -> n.Source:
        table, last, between = self.name(), None, None
        if self.word("LAST"):
            last = self.take("duration", "a duration")
        elif self.word("BETWEEN"):
            low = self.take("string", "a timestamp")
            self.need("AND")
            between = low, self.take("string", "a timestamp")
        joined = []
        while self.word("JOIN"):
            joined.append(self.name())
        return n.Source(table, last, between, tuple(joined))

    def stage(self) -> Any:
        token = self.next()
        made = getattr(self, f"stage_{token.value.lower()}", None) if token.kind == "keyword" else None
        if made is None:
            raise self.problem(f"{token.text or 'the end'!r} isn't a stage", token)
        return made()

    def stage_where(self) -> n.Where:
        return n.Where(self.expression())

    def stage_select(self) -> n.Select:
        return n.Select(distinct=self.word("DISTINCT"), items=self.listed(self.select_item))

    def select_item(self) -> tuple[n.Expr | str, str | None]:
        if self.op("*"):
            return "*", None
        if self.here.kind in ("name", "quoted") and self.is_op(".", 1) and self.is_op("*", 2):
            table = self.name()
            self.at += 2
            return f"{table}.*", None
        token = self.here
        expr = self.expression()
        if self.word("AS"):
            return expr, self.name()
        if not isinstance(expr, (n.Name, n.Variable)):
            raise self.problem("a computed column needs AS and a name", token)
        return expr, None

    def stage_let(self) -> n.Let:
        name = self.name()
        self.need_op("=")
        return n.Let(name, self.expression())

    def stage_match(self) -> n.Match:
        if self.word("FIRST"):
            mode = "first"
        elif self.word("ALL"):
            mode = "all"
        else:
            raise self.problem("MATCH is followed by FIRST or ALL")
        self.need("SEQUENCE")
        self.need_op("(")
        steps = self.steps()
        self.need_op(")")
        within, session, brackets, cumulative = None, False, (), False
        if self.word("WITHIN"):
            if self.word("SESSION"):
                session = True
            else:
                within = self.take("duration", "a duration or SESSION")
        if self.word("BRACKETS"):
            if within is not None or session:
                raise self.problem("WITHIN and BRACKETS exclude each other")
            cumulative = self.word("CUMULATIVE")
            brackets = self.durations()
        emit = self.word("EMIT", "ALL")
        if self.here.kind == "keyword" and self.here.value in ("WITHIN", "BRACKETS", "EMIT"):
            raise self.problem("the order is WITHIN or BRACKETS, then EMIT ALL")
        return n.Match(mode, steps, within, session, brackets, cumulative, emit)

    def durations(self) -> tuple[int, ...]:
        self.need_op("[")
        token = self.here
        found = self.listed(lambda: self.take("duration", "a duration"))
        self.need_op("]")
        if any(b <= a for a, b in zip(found, found[1:], strict=False)):
            raise self.problem("brackets must ascend", token)
        return found

    def stage_funnel(self) -> n.Funnel:
        self.need_op("(")
        steps = self.steps()
        self.need_op(")")
        return n.Funnel(steps, self.take("duration", "a duration") if self.word("WITHIN") else None)

    def stage_retention(self) -> n.Retention:
        self.need_op("(")
        self.label("entry")
        entry = (self.event(),)
        self.need_op(",")
        self.label("activity")
        activity = (self.event(),)
        self.need_op(",")
        self.label("brackets")
        brackets = self.durations()
        cumulative = False
        if self.op(","):
            self.label("cumulative")
            cumulative = self.word("TRUE")
            if not cumulative:
                self.need("FALSE")
        self.need_op(")")
        return n.Retention(entry, activity, brackets, cumulative)

    def stage_sessionize(self) -> n.Sessionize:
        self.need_op("(")
        self.label("gap")
        token = self.here
        gap, end = self.take("duration", "a duration"), ()
        if gap <= 0:
            raise self.problem("the gap must be above 0", token)
        if self.op(","):
            self.label("end")
            end = self.events(",")
        self.need_op(")")
        return n.Sessionize(gap, end)

    def stage_stats(self) -> n.Stats:
        outputs = self.listed(self.aggregate)
        groups: tuple = ()
        if self.word("GROUP"):
            self.need("BY")
            groups = self.listed(self.group)
        return n.Stats(outputs, groups)

    def aggregate(self) -> tuple[str, n.Call]:
        token = self.here
        name = self.name()
        if not self.op("="):
            raise self.problem("an aggregate needs a name, as in total = COUNT(*)", token)
        token = self.here
        call = self.primary()
        if not isinstance(call, n.Call) or call.name not in AGGREGATES or call.over:
            raise self.problem(f"expected one of {', '.join(AGGREGATES)}", token)
        return name, call

    def group(self) -> tuple[n.Expr, str]:
        token = self.here
        expr = self.expression()
        if self.word("AS"):
            return expr, self.name()
        if isinstance(expr, n.Name):
            return expr, expr.text
        raise self.problem("a computed group needs AS and a name", token)

    def stage_first(self) -> n.Pick:
        return self.pick("first")

    def stage_last(self) -> n.Pick:
        return self.pick("last")

    def stage_nth(self) -> n.Pick:
        return self.pick("nth")

    def pick(self, which: str) -> n.Pick:
        self.need_op("(")
        events = self.events(",")
        where = self.expression() if self.word("WHERE") else None
        count, lookback = 1, 0
        if which == "nth":
            self.need_op(",")
            token = self.here
            count = self.take("int", "a number")
            if count < 1:
                raise self.problem("NTH counts from 1", token)
        if self.op(","):
            if which == "last":
                raise self.problem("LAST takes no lookback")
            self.label("lookback")
            lookback = self.take("duration", "a duration")
        self.need_op(")")
        return n.Pick(which, events, count, where, lookback)

    def stage_sample(self) -> n.Sample:
        self.need_op("(")
        self.label("fraction")
        token, seed = self.here, None
        fraction = float(self.next().value) if token.kind in ("int", "float") else -1.0
        if not 0 <= fraction <= 1:
            raise self.problem("the fraction is from 0 to 1", token)
        if self.op(","):
            self.label("seed")
            seed = self.take("int", "a number")
        self.need_op(")")
        return n.Sample(fraction, seed)

    def stage_attribute(self) -> n.Attribute:
        self.need_op("(")
        self.label("conversion")
        conversion = self.events(",")
        self.need_op(",")
        self.label("touchpoints")
        touchpoints = self.events(",")
        self.need_op(",")
        self.label("window")
        window = self.take("duration", "a duration")
        self.need_op(",")
        self.label("touchpoint_key")
        key = self.expression()
        self.need_op(")")
        return n.Attribute(conversion, touchpoints, window, key)

    def stage_order(self) -> n.OrderBy:
        self.need("BY")
        return n.OrderBy(self.listed(self.order_item))

    def stage_sort(self) -> n.OrderBy:
        return n.OrderBy(self.listed(self.order_item))

    def order_item(self) -> n.Order:
        expr = self.expression()
        if self.word("DESC"):
            return n.Order(expr, True)
        self.word("ASC")
        return n.Order(expr)

    def stage_limit(self) -> n.Limit:
        return n.Limit(self.take("int", "a number"))

    def stage_pivot(self) -> n.Pivot:
        column = self.name()
        self.need("ON")
        on, values = self.name(), ()
        if self.word("IN"):
            self.need_op("(")
            values = self.listed(lambda: self.literal().value)
            self.need_op(")")
        return n.Pivot(column, on, values)

    # -- patterns -------------------------------------------------------------------------------

    def event(self) -> str:
        name = self.name()
        return f"{name}.{self.name()}" if self.op(".") else name

    def events(self, by: str) -> tuple[str, ...]:
        if not self.op("("):
            return (self.event(),)
        found = [self.event()]
        while self.op(by) if by == "," else self.word(by):
            found.append(self.event())
        self.need_op(")")
        return tuple(found)

    def steps(self) -> tuple[n.Step, ...]:
        out = [self.step()]
        while True:
            token = self.here
            without = self.events("OR") if self.word("WITHOUT") else ()
            if not (self.word("THEN") or self.op("->")):
                if without:
                    raise self.problem("WITHOUT stands between two steps", token)
                return tuple(out)
            near = self.word("IMMEDIATELY")
            last = out.pop()
            out += [n.Step(last.events, last.name, last.where, last.repeat, without, near), self.step()]

    def step(self) -> n.Step:
        if self.is_op("(") and not self.is_alternation():
            self.need_op("(")
            inner = self.step()
            self.need_op(")")
        else:
            label = None
            if self.here.kind in ("name", "quoted") and self.is_op(":", 1):
                label = self.name()
                self.next()
            events = self.events("OR")
            where = self.expression() if self.word("WHERE") else None
            inner = n.Step(events, label, where)
            if where is not None and (self.is_op("+") or self.is_op("*")):
                raise self.problem("a step with WHERE and a repetition needs parentheses")
        repeat = "+" if self.op("+") else "*" if self.op("*") else ""
        if repeat and inner.repeat:
            raise self.problem("a step is repeated once at most")
        return n.Step(inner.events, inner.name, inner.where, repeat or inner.repeat)

    def is_alternation(self) -> bool:
        """Whether a parenthesis holds event names parted by OR."""
        i = 1
        while self.ahead(i).kind in ("name", "quoted") or self.is_op(".", i):
            i += 1
        return i > 1 and self.ahead(i).kind == "keyword" and self.ahead(i).value == "OR"

    # -- expressions ----------------------------------------------------------------------------

    def expression(self) -> n.Expr:
        out = self.conjunction()
        while self.word("OR"):
            out = n.Binary("OR", out, self.conjunction())
        return out

    def conjunction(self) -> n.Expr:
        out = self.negation()
        while self.word("AND"):
            out = n.Binary("AND", out, self.negation())
        return out

    def negation(self) -> n.Expr:
        return n.Unary("NOT", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> n.Expr:
        if many := self.tuple_in():
            return many
        left = self.sum()
        if self.here.kind == "op" and self.here.value in ("=", "!=", "<", ">", "<=", ">="):
            op = str(self.next().value)
            left = n.Binary(op, left, self.sum())
        while True:
            if self.word("IS"):
                negated = self.word("NOT")
                self.need("NULL")
                left = n.IsNull(left, negated)
                continue
            negated = self.here.kind == "keyword" and self.here.value == "NOT" and self.ahead().value in ("IN", "BETWEEN", "LIKE")
            if negated:
                self.next()
            if self.word("IN"):
                left = self.in_rest((left,), negated)
            elif self.word("BETWEEN"):
                low = self.sum()
                self.need("AND")
                left = n.Between(left, low, self.sum(), negated)
            elif self.word("LIKE"):
                left = n.TextMatch("like", left, self.take("string", "a pattern"), negated)
            elif self.op("~="):
                left = n.TextMatch("regex", left, self.take("string", "a pattern"))
            elif self.word("CONTAINS"):
                left = n.TextMatch("contains", left, self.take("string", "a text"))
            else:
                return left

    def tuple_in(self) -> n.Expr | None:
        if not self.is_op("("):
            return None
        start = self.at
        try:
            self.next()
            found = self.listed(self.sum)
            self.need_op(")")
            negated = self.word("NOT")
            if len(found) > 1 and self.word("IN"):
                return self.in_rest(found, negated)
        except SyntaxProblem:
            pass
        self.at = start
        return None

    def in_rest(self, left: tuple, negated: bool) -> n.Expr:
        if self.word("QUERY"):
            self.need_op("(")
            inner = self.pipeline()
            self.need_op(")")
            return n.InQuery(left, inner, negated)
        if self.op("("):
            items = () if self.is_op(")") else self.listed(self.expression)
            self.need_op(")")
            if len(left) > 1:
                raise self.problem("a tuple is compared with a query or an alias")
            return n.InList(left[0], items, negated)
        return n.InQuery(left, self.identifier(), negated)

    def sum(self) -> n.Expr:
        out = self.product()
        while self.is_op("+") or self.is_op("-"):
            out = n.Binary(str(self.next().value), out, self.product())
        return out

    def product(self) -> n.Expr:
        out = self.unary()
        while self.is_op("*") or self.is_op("/") or self.is_op("%"):
            out = n.Binary(str(self.next().value), out, self.unary())
        return out

    def unary(self) -> n.Expr:
        if self.op("-"):
            inner = self.unary()
            if isinstance(inner, n.Literal) and inner.kind in ("int", "float"):
                return n.Literal(-inner.value, inner.kind)
            return n.Unary("-", inner)
        return self.unary() if self.op("+") else self.primary()

    def literal(self) -> n.Literal:
        if self.op("-"):
            inner = self.literal()
            return n.Literal(-inner.value, inner.kind)
        token = self.next()
        if token.kind in ("int", "float", "string"):
            return n.Literal(token.value, token.kind)
        if token.kind == "duration":
            return n.Literal(token.value, "int")
        if token.kind == "keyword" and token.value in ("TRUE", "FALSE", "NULL"):
            return n.Literal({"TRUE": True, "FALSE": False, "NULL": None}[token.value], "null" if token.value == "NULL" else "bool")
        raise self.problem(f"expected a value, found {token.text or 'the end'!r}", token)

    def primary(self) -> n.Expr:
        token = self.here
        if token.kind in ("int", "float", "string", "duration") or token.kind == "keyword" and token.value in ("TRUE", "FALSE", "NULL"):
            return self.literal()
        if self.op("("):
            inner = self.expression()
            self.need_op(")")
            return inner
        if self.op("$"):
            return n.Variable(self.identifier())
        if self.word("CASE"):
            return self.case()
        if self.word("CAST"):
            self.need_op("(")
            inner = self.expression()
            self.need("AS")
            to = self.type_name()
            self.need_op(")")
            return n.Cast(inner, to)
        if token.kind in ("name", "quoted"):
            if token.kind == "name" and self.is_op("(", 1):
                return self.call()
            first = self.name()
            return n.Name((first, self.name())) if self.op(".") else n.Name((first,))
        raise self.problem(f"unexpected {token.text or 'the end'!r}")

    def case(self) -> n.Case:
        branches = []
        while self.word("WHEN"):
            when = self.expression()
            self.need("THEN")
            branches.append((when, self.expression()))
        if not branches:
            raise self.problem("CASE needs a WHEN")
        otherwise = self.expression() if self.word("ELSE") else None
        self.need("END")
        return n.Case(tuple(branches), otherwise)

    def call(self) -> n.Call:
        name = self.identifier().upper()
        self.need_op("(")
        star = self.op("*")
        args: tuple = ()
        if not star and not self.is_op(")"):
            if self.here.kind == "keyword" and self.here.value == "DISTINCT":
                raise self.problem("DISTINCT isn't taken here: use COUNT_DISTINCT or SELECT DISTINCT")
            args = self.listed(self.expression)
        self.need_op(")")
        over = None
        if self.word("OVER"):
            self.need_op("(")
            partition: tuple = ()
            order: tuple = ()
            if self.word("PARTITION"):
                self.need("BY")
                partition = self.listed(self.expression)
            if self.word("ORDER"):
                self.need("BY")
                order = self.listed(self.order_item)
            self.need_op(")")
            over = n.Over(partition, order)
        return n.Call(name, args, over, star)
