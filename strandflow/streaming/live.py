"""Structured Streaming forms of bucketed counts, sessions and ordered patterns.

The language itself is for tables at rest. These functions take a streaming DataFrame with the same
roles and give one; late events are dropped beyond ``late``, a duration of the language.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandflow.types import duration


def _interval(text: str) -> str:
    return f"{duration(text) // 1000} microseconds"


def bucketed(df: DataFrame, *, time: str, width: str, late: str, by: list[str] | None = None, **outputs: Column) -> DataFrame:
    """Aggregates by time bucket and ``by``: column ``bucket``, the keys, the outputs. A bucket is
    given when no event of it can come any more."""
    groups = [F.window(time, _interval(width)).alias("bucket"), *(by or [])]
    made = df.withWatermark(time, _interval(late)).groupBy(*groups).agg(*(c.alias(n) for n, c in outputs.items()))
    return made.withColumn("bucket", F.col("bucket.start"))


def sessions(df: DataFrame, *, entity: str, time: str, gap: str, late: str, **outputs: Column) -> DataFrame:
    """Closed sessions of each entity: ``session_start``, ``session_end`` (the last event),
    ``events`` and the outputs. A pause of exactly ``gap`` doesn't end a session."""
    us = duration(gap) // 1000 + 1  # Spark's sessions end at the gap, these after it
    groups = df.withWatermark(time, _interval(late)).groupBy(entity, F.session_window(time, f"{us} microseconds").alias("s"))
    made = groups.agg(F.max(time).alias("session_end"), F.count(F.lit(1)).alias("events"), *(c.alias(n) for n, c in outputs.items()))
    return made.select(entity, F.col("s.start").alias("session_start"), "session_end", "events", *outputs)


def first_matches(df: DataFrame, *, entity: str, time: str, event: str, seq: str, steps: list[str], within: str, late: str) -> DataFrame:
    """The first completion of an ordered pattern of each entity: ``entity_id``, ``match_start``,
    ``match_end``, once.

    ``match_start`` is the latest first event that this end completes. An entity's state holds, for
    each step, the latest first event from which the step has been reached, and since when: of all
    first events that reach a step, the latest leaves the most time. Events of one micro-batch are
    taken in order; ones that come after later events were taken start from the state as it is then.
    State without hope goes when the watermark has passed its window.
    """
    limit = duration(within) // 1000
    n = len(steps)

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        begun, since, done = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([None] * n, [None] * n, False)
        if done:
            return
        rows = pd.concat(list(parts))
        rows["us"] = rows[time].astype("datetime64[us]").astype("int64")
        for at, kind in rows.sort_values(["us", seq])[["us", event]].itertuples(index=False):
            for k in range(n - 1, -1, -1):
                if kind != steps[k]:
                    continue
                if k == 0:
                    start = at
                elif since[k - 1] is not None and since[k - 1] < at and at - begun[k - 1] <= limit:
                    start = begun[k - 1]
                else:
                    continue
                if k == n - 1:
                    state.update(([], [], True))
                    yield pd.DataFrame({"entity_id": [key[0]], "match_start": pd.to_datetime([start], unit="us"), "match_end": pd.to_datetime([at], unit="us")})
                    return
                if begun[k] is None or start > begun[k]:
                    begun[k], since[k] = start, at
        state.update((begun, since, False))
        alive = [b for b in begun if b is not None]
        if alive:
            state.setTimeoutTimestamp(max((max(alive) + limit) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    kind = dict(df.dtypes)[entity]
    seen = df.where(F.col(event).isin(steps)).withWatermark(time, _interval(late))
    return seen.groupBy(entity).applyInPandasWithState(
        advance, f"entity_id {kind}, match_start timestamp, match_end timestamp", "begun array<long>, since array<long>, done boolean", "append", GroupStateTimeout.EventTimeTimeout
    )
