import pytest

from strandflow.errors import AliasCycle, InvalidComposition, NameCollision, QueryError, SyntaxProblem, TypeProblem, UnknownName
from strandflow.language import nodes as n
from strandflow.language.parser import parse, parse_expression
from strandflow.types import duration
from tests.support import engine_of, rows


def test_precedence():
    e = parse_expression("NOT a = 1 + 2 * 3 OR b AND c")
    assert e.op == "OR" and e.left.op == "NOT" and e.right.op == "AND"
    assert e.left.operand == n.Binary("=", n.Name(("a",)), n.Binary("+", n.Literal(1, "int"), n.Binary("*", n.Literal(2, "int"), n.Literal(3, "int"))))


def test_names_comments_and_literals():
    q = parse("`odd ``name` -- a comment\n| where /* another */ `a b` = 'it''s' AND x > 1h30m")[0].pipeline
    assert q.source.table == "odd `name"
    left, right = q.stages[0].predicate.left, q.stages[0].predicate.right
    assert left.right.value == "it's" and right.right.value == duration("1h") + duration("30m")


def test_pattern():
    (m,) = parse("e | MATCH FIRST SEQUENCE(a: x WITHOUT (p OR q) -> IMMEDIATELY (y WHERE v = 1)+ THEN (z OR w)*) WITHIN 7d EMIT ALL")[0].pipeline.stages
    assert [s.repeat for s in m.steps] == ["", "+", "*"]
    assert m.steps[0].without == ("p", "q") and m.steps[0].immediately and m.steps[2].events == ("z", "w") and m.emit_all


@pytest.mark.parametrize(
    "text",
    [
        "e | MATCH FIRST SEQUENCE(a WITHOUT b)", "e | MATCH SEQUENCE(a)", "e | MATCH FIRST SEQUENCE(a THEN b) EMIT ALL WITHIN 7d", "e | MATCH FIRST SEQUENCE(a THEN b) WITHIN 1d BRACKETS [1d]",
        "e | MATCH FIRST SEQUENCE(a THEN b) BRACKETS [7d, 1d]", "e | STATS COUNT(*)", "e | SELECT a + 1", "e | STATS n = COUNT(DISTINCT a)", "e | LAST(a, lookback: 1d)", "e | NTH(a, 0)",
        "e | SAMPLE(fraction: 1.5)", "e | SESSIONIZE(gap: 0s)", "e | STATS n = COUNT(*) GROUP BY a + 1", "e | FROB", "a = e", "", "e | WHERE 'open", "e | MATCH FIRST SEQUENCE(a WHERE x = 1 +)",
    ],
)
def test_syntax_errors(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_error_says_where():
    with pytest.raises(SyntaxProblem) as e:
        parse("events\n| WHERE a >\n| LIMIT 1")
    assert (e.value.line, e.value.column) == (3, 1)


@pytest.fixture(scope="module")
def small(spark):
    return engine_of(spark, [("a", 0, "x", 1, "p"), ("a", 10, "y", None, None), ("b", 5, "x", 3, "q")])


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("events | WHERE nope = 1", UnknownName), ("nope | LIMIT 1", UnknownName), ("events | WHERE amount", TypeProblem), ("events | WHERE amount = 'x'", TypeProblem),
        ("events | SELECT user, user", NameCollision), ("events | LET amount = 1", NameCollision), ("events | STATS n = SUM(kind)", TypeProblem), ("events | SELECT FROB(1) AS f", UnknownName),
        ("events | FUNNEL(x THEN x)", NameCollision), ("events | FUNNEL(x THEN y) | LIMIT 1", InvalidComposition), ("events | STATS n = COUNT(*) | MATCH FIRST SEQUENCE(x)", InvalidComposition),
        ("events | MATCH FIRST SEQUENCE(x) | MATCH FIRST SEQUENCE(x)", InvalidComposition), ("events | MATCH FIRST SEQUENCE(x THEN y) WITHIN SESSION", InvalidComposition),
        ("events | WHERE user NOT IN QUERY(events | SELECT user)", InvalidComposition), ("events | WHERE user IN QUERY(events | SELECT user, kind)", TypeProblem), ("events | WHERE amount IN QUERY(events | SELECT user)", TypeProblem),
        ("a = b | SELECT user\nb = events\nevents | LIMIT 1", AliasCycle), ("events | ATTRIBUTE(conversion: x, touchpoints: y, window: 1d, touchpoint_key: amount)", TypeProblem),
        ("events | MATCH FIRST SEQUENCE(x WHERE category = $v THEN y WHERE category != $v)", TypeProblem), ("events JOIN events | LIMIT 1", InvalidComposition), ("events | SELECT COUNT(amount) AS c", InvalidComposition),
        ("events | SELECT QUANTIZE(ts, 1d, 'No/Where') AS q", TypeProblem), ("DROP TABLE nope", UnknownName), ("DELETE FROM events WHERE amount = 1", QueryError),
    ],
)
def test_planning_errors(small, text, error):
    with pytest.raises(error):
        small.query(text)


def test_nulls_and_wildcards(small):
    assert rows(small.query("events | WHERE amount > 0 | SELECT *, amount * 1.5 AS more | SELECT user, more")) == [("a", 1.5), ("b", 4.5)]
    assert rows(small.query("events | STATS n = COUNT(*), m = COUNT(amount), s = SUM(amount) GROUP BY category | ORDER BY category")) == [("p", 1, 1, 1), ("q", 1, 1, 3), (None, 1, 0, None)]
    assert [r.category for r in small.query("events | ORDER BY category DESC").collect()] == [None, "q", "p"]


def test_division(small):
    assert rows(small.query("events | WHERE amount = 3 | SELECT -7 / 2 AS a, -7 % 2 AS b, 7.0 / 2 AS c, 1.0 / 0.0 > 1e300 AS d, CAST('x' AS INT) AS e, CAST(-2.7 AS INT) AS f")) == [(-3, -1, 3.5, True, None, -2)]


def test_methods_are_the_language(small):
    from strandflow.session import event, seq

    built = small.table("events").where("amount > 0").funnel(seq("x", event("y", name="late")), within="1d")
    assert rows(built.df()) == rows(small.query("events | WHERE amount > 0 | FUNNEL(x THEN late: y) WITHIN 1d"))
    cohort = small.table("events").cohort("user", "c", small.table("events").where("kind = 'y'").select("user")).stats(n="COUNT(*)")
    assert rows(cohort.df()) == [(2,)]


def test_explain_and_show(small):
    assert any("Scan" in r.plan or "LocalTable" in r.plan for r in small.query("EXPLAIN events | WHERE amount > 1").collect())
    assert "user" in small.show("events | SELECT user")
