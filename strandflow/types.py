"""Durations in nanoseconds, timestamps in microseconds, and their text forms.

Durations are plain 64-bit numbers of nanoseconds. Timestamps are Spark's, in microseconds and UTC,
so a difference of timestamps is a multiple of 1000.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.errors import TypeProblem

UNITS = {"d": 86_400_000_000_000, "h": 3_600_000_000_000, "m": 60_000_000_000, "s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
_DURATION = re.compile(r"(\d+)(d|h|ms|us|ns|m|s)")


def duration(value: str | int) -> int:
    """Nanoseconds of ``7d``, ``30m``, ``1h30m``, or of a number of them."""
    if isinstance(value, int):
        return value
    found = _DURATION.findall(value)
    if not found or "".join(a + b for a, b in found) != value:
        raise TypeProblem(f"{value!r} isn't a duration")
    return sum(int(a) * UNITS[b] for a, b in found)


def micros(value: str | int | dt.datetime) -> int:
    """Microseconds since 1970 of a datetime, an RFC 3339 text, or a number of nanoseconds."""
    if isinstance(value, int):
        return value // 1000
    if isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
        except ValueError:
            raise TypeProblem(f"{value!r} isn't a timestamp") from None
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    return (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def timestamp(us: Column | int) -> Column:
    return F.timestamp_micros(F.lit(us) if isinstance(us, int) else us)


def elapsed(later: Column, earlier: Column) -> Column:
    """Nanoseconds between two timestamps."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) * F.lit(1000).cast("long")


def shifted(ts: Column, ns: Column) -> Column:
    """A timestamp so many nanoseconds later, to the microsecond."""
    return F.timestamp_micros(F.unix_micros(ts) + F.floor(ns / F.lit(1000)).cast("long"))


def rfc3339(ts: Column) -> Column:
    """``2024-01-01T00:00:00Z``, with 3 or 6 digits of the second where there are any."""
    rest = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    shown = F.when(rest == 0, F.lit("")).when(F.pmod(rest, F.lit(1000)) == 0, F.concat(F.lit("."), F.lpad((rest / 1000).cast("int").cast("string"), 3, "0"))).otherwise(F.concat(F.lit("."), F.lpad(rest.cast("string"), 6, "0")))
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), shown, F.lit("Z"))


def kind(of: T.DataType) -> str:
    """The language's type of a Spark type."""
    if isinstance(of, T.BooleanType):
        return "bool"
    if isinstance(of, T.IntegralType):
        return "int"
    if isinstance(of, (T.FractionalType,)):
        return "float"
    if isinstance(of, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(of, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    if isinstance(of, T.ArrayType):
        return "list"
    if isinstance(of, T.MapType):
        return "map"
    if isinstance(of, T.NullType):
        return "null"
    return "other"


SPARK_TYPES = {"bool": "boolean", "int": "long", "float": "double", "string": "string", "timestamp": "timestamp"}
