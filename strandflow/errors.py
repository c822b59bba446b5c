"""What can be wrong with a query, before or while it runs."""


class QueryError(ValueError):
    """The base of all errors of this package."""


class SyntaxProblem(QueryError):
    """The text isn't in the language; ``line`` and ``column`` count from 1."""

    def __init__(self, message: str, line: int, column: int) -> None:
        super().__init__(f"{message} at line {line}, column {column}")
        self.line, self.column = line, column


class UnknownName(QueryError):
    """No such table, column, step, alias or function."""


class TypeProblem(QueryError):
    """An operand or argument has a type that the operation doesn't take."""


class NameCollision(QueryError):
    """Two columns or steps would have one name."""


class AliasCycle(QueryError):
    """An alias that refers to itself or to one that is defined later."""


class InvalidComposition(QueryError):
    """A stage that can't follow the one before it."""
