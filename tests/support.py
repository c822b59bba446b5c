"""Small event tables and comparisons for tests."""

from __future__ import annotations

import datetime as dt
import math

from strandflow.session import Engine

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def engine_of(spark, rows, columns="amount long, category string", now="2024-02-01T00:00:00Z", name="events"):
    """rows: (entity, seconds, event type, ...); sequence numbers follow the order of the rows."""
    e = Engine(spark, now=now)
    full = [(i, r[0], BASE + dt.timedelta(seconds=r[1]), r[2], *r[3:]) for i, r in enumerate(rows)]
    kind = "string" if not rows or isinstance(rows[0][0], str) else "long"
    more = f", {columns}" if columns else ""
    e.register(name, spark.createDataFrame(full, f"seq long, user {kind}, ts timestamp, kind string{more}"), "user", "ts", "kind", "seq")
    return e


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__module__ == "numpy" and hasattr(value, "item") and not isinstance(value, str):
        value = value.item() if hasattr(value, "item") else value
        return round(float(value), 6) if isinstance(value, (int, float)) and not isinstance(value, bool) else value
    return str(value)
