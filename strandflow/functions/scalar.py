"""Scalar functions: each takes typed columns and gives one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandflow.errors import TypeProblem, UnknownName


@dataclass(frozen=True)
class Typed:
    """A column and its type in the language; ``value`` where it is a literal."""

    col: Column
    kind: str
    value: Any = None


def unified(parts: list[Typed], what: str) -> str:
    """The common type of values; integers become floats beside floats."""
    kinds = {p.kind for p in parts} - {"null"}
    if kinds == {"int", "float"}:
        return "float"
    if len(kinds) > 1:
        raise TypeProblem(f"{what}: types differ ({', '.join(sorted(kinds))})")
    return kinds.pop() if kinds else "null"


def converted(p: Typed, kind: str) -> Column:
    return p.col.cast("double") if kind == "float" and p.kind == "int" else p.col


def _want(name: str, args: list[Typed], *kinds: str) -> None:
    if len(args) != len(kinds):
        raise TypeProblem(f"{name} takes {len(kinds)} arguments, not {len(args)}")
    for a, k in zip(args, kinds, strict=True):
        if a.kind not in (k, "null") and not (k == "float" and a.kind == "int") and not (k == "number" and a.kind in ("int", "float")):
            raise TypeProblem(f"{name} takes {k}, not {a.kind}")


def quantize(args: list[Typed]) -> Typed:
    """The start of the bucket: of a timestamp by a width in nanoseconds, in UTC or a zone's local
    time, or of a number."""
    if not 2 <= len(args) <= 3:
        raise TypeProblem("QUANTIZE takes 2 or 3 arguments")
    v, w = args[:2]
    if w.value is not None and w.value <= 0:
        raise TypeProblem("QUANTIZE: the width must be above 0")
    if v.kind == "timestamp":
        _want("QUANTIZE", [w], "int")
        local, back = v.col, lambda c: c
        if len(args) == 3:
            zone = args[2].value
            try:
                ZoneInfo(str(zone))
            except (KeyError, ValueError, OSError):
                raise TypeProblem(f"QUANTIZE: no time zone {zone!r}") from None
            local, back = F.from_utc_timestamp(v.col, str(zone)), lambda c: F.to_utc_timestamp(c, str(zone))
        us = F.unix_micros(local)
        width = F.greatest(F.lit(1).cast("long"), F.call_function("div", w.col, F.lit(1000).cast("long")))
        return Typed(back(F.timestamp_micros(us - F.pmod(us, width))), "timestamp")
    _want("QUANTIZE", args, "number", "number")
    if v.kind == "int" and w.kind == "int":
        return Typed(v.col - F.pmod(v.col, w.col), "int")
    wide = w.col.cast("double")
    return Typed(F.floor(v.col.cast("double") / wide).cast("double") * wide, "float")


def _simple(name: str, kinds: tuple[str, ...], result: str, make: Callable[..., Column]) -> Callable[[list[Typed]], Typed]:
    def call(args: list[Typed]) -> Typed:
        _want(name, args, *kinds)
        return Typed(make(*(a.col for a in args)), result)

    return call


def _concat(args: list[Typed]) -> Typed:
    _want("CONCAT", args, *["string"] * len(args))
    return Typed(F.concat(*(a.col for a in args)), "string")


def _abs(args: list[Typed]) -> Typed:
    _want("ABS", args, "number")
    return Typed(F.abs(args[0].col), args[0].kind)


def _coalesce(args: list[Typed]) -> Typed:
    if not args:
        raise TypeProblem("COALESCE takes an argument at least")
    kind = unified(args, "COALESCE")
    return Typed(F.coalesce(*(converted(a, kind) for a in args)), kind)


def _if(args: list[Typed]) -> Typed:
    if len(args) != 3:
        raise TypeProblem("IF takes 3 arguments")
    _want("IF", args[:1], "bool")
    kind = unified(args[1:], "IF")
    return Typed(F.when(args[0].col, converted(args[1], kind)).otherwise(converted(args[2], kind)), kind)


class Registry:
    """Functions by name, whatever the case. ``register`` adds more."""

    def __init__(self) -> None:
        self.found: dict[str, Callable[[list[Typed]], Typed]] = {
            "QUANTIZE": quantize,
            "EPOCH_NANOS": _simple("EPOCH_NANOS", ("timestamp",), "int", lambda t: F.unix_micros(t) * F.lit(1000).cast("long")),
            "EPOCH_SECONDS": _simple("EPOCH_SECONDS", ("timestamp",), "float", lambda t: F.unix_micros(t) / F.lit(1e6)),
            "LENGTH": _simple("LENGTH", ("string",), "int", lambda s: F.char_length(s).cast("long")),
            "SUBSTRING": _simple("SUBSTRING", ("string", "int", "int"), "string", lambda s, a, b: F.substring(s, a.cast("int"), b.cast("int"))),
            "CONCAT": _concat,
            "LOWER": _simple("LOWER", ("string",), "string", F.lower),
            "UPPER": _simple("UPPER", ("string",), "string", F.upper),
            "TRIM": _simple("TRIM", ("string",), "string", F.trim),
            "ABS": _abs,
            "FLOOR": _simple("FLOOR", ("number",), "int", lambda x: F.floor(x).cast("long")),
            "CEIL": _simple("CEIL", ("number",), "int", lambda x: F.ceil(x).cast("long")),
            "EXP": _simple("EXP", ("number",), "float", lambda x: F.exp(x.cast("double"))),
            "LN": _simple("LN", ("number",), "float", lambda x: F.ln(x.cast("double"))),
            "POW": _simple("POW", ("number", "number"), "float", lambda x, y: F.pow(x.cast("double"), y.cast("double"))),
            "ROUND": self.round,
            "COALESCE": _coalesce,
            "IF": _if,
        }

    @staticmethod
    def round(args: list[Typed]) -> Typed:
        _want("ROUND", args, "number", "int")
        if args[1].value is None:
            raise TypeProblem("ROUND takes a literal number of places")
        return Typed(F.round(args[0].col.cast("double"), int(args[1].value)), "float")

    def register(self, name: str, function: Callable[[list[Typed]], Typed]) -> None:
        self.found[name.upper()] = function

    def call(self, name: str, args: list[Typed]) -> Typed:
        if name.upper() not in self.found:
            raise UnknownName(f"no function {name}")
        return self.found[name.upper()](args)
