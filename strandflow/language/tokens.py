"""Text to tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

from strandflow.errors import SyntaxProblem
from strandflow.types import duration

# Reserved words of the language, fixed by its definition.
KEYWORDS = frozenset(
    """ADD ALL ALLOW ALTER AND AS ASC ATTRIBUTE BETWEEN BRACKETS BY CASE CAST COLUMN CONTAINS CREATE CUMULATIVE DEFAULT DELETE DESC DESCRIBE
    DISTINCT DROP ELSE EMIT END EXPLAIN FALSE FIRST FROM FUNNEL GROUP IMMEDIATELY IN INSERT INTO IS JOIN LAST LET LIKE LIMIT MATCH NOT NTH NULL ON OR
    ORDER OVER PARTITION PIVOT QUERY RETENTION SAMPLE SCAN SELECT SEQUENCE SESSION SESSIONIZE SORT STATS TABLE THEN TRUE VALUES WHEN WHERE WITH WITHIN
    WITHOUT""".split()
)

_TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
    |(?P<duration>(?:\d+(?:ms|us|ns|d|h|m|s))+(?![A-Za-z0-9_]))
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+)
    |(?P<int>\d+)
    |(?P<string>'(?:[^']|'')*')
    |(?P<quoted>`(?:[^`]|``)+`)
    |(?P<word>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>->|~=|!=|<>|<=|>=|[-+*/%=<>(),.|:$\[\];])
    """,
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    kind: str  # keyword, name, quoted, int, float, string, duration, op, end
    text: str
    value: object
    line: int
    column: int


def tokens(text: str) -> list[Token]:
    out: list[Token] = []
    at, line, begun = 0, 1, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        column = at - begun + 1
        if m is None:
            said = "a comment or quote isn't closed" if text.startswith(("/*", "'", "`"), at) else f"unexpected {text[at]!r}"
            raise SyntaxProblem(said, line, column)
        kind, found = m.lastgroup, m[0]
        value: object = found
        if kind == "word":
            upper = found.upper()
            kind, value = ("keyword", upper) if upper in KEYWORDS else ("name", found)
        elif kind == "int":
            value = int(found)
            if value >= 1 << 63:
                raise SyntaxProblem("the number is too large", line, column)
        elif kind == "float":
            value = float(found)
        elif kind == "string":
            value = found[1:-1].replace("''", "'")
        elif kind == "quoted":
            value = found[1:-1].replace("``", "`")
        elif kind == "duration":
            value = duration(found)
        elif kind == "op" and found == "<>":
            value = "!="
        if kind != "space":
            out.append(Token(kind, found, value, line, column))
        if breaks := found.count("\n"):
            line += breaks
            begun = at + found.rindex("\n") + 1
        at = m.end()
    out.append(Token("end", "", None, line, at - begun + 1))
    return out
