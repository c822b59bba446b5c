"""Sessions, event selection, sampling and attribution."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.types import elapsed

#: The seed of Spark's own xxhash64, which is XXH64.
NATIVE_SEED = 42


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def sessionize(df: DataFrame, *, entity: str, time: str, seq: str, gap: int, end: Column | None = None) -> DataFrame:
    """Adds ``session_id`` (from 1 for each entity) and ``session_duration`` (nanoseconds).

    A session ends with a pause of more than ``gap`` nanoseconds, or with an event for which ``end``
    holds, which belongs to it. Both windows share the shuffle by entity.
    """
    order = Window.partitionBy(_quoted(entity)).orderBy(_quoted(time), _quoted(seq))
    pause = elapsed(_quoted(time), F.lag(_quoted(time)).over(order)) > gap
    new = pause if end is None else pause | F.lag(F.coalesce(end, F.lit(False))).over(order)
    marked = df.withColumn("session_id", F.coalesce(new, F.lit(False)).cast("long"))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("session_id", F.sum("session_id").over(upto) + 1)
    whole = Window.partitionBy(_quoted(entity), "session_id")
    return marked.withColumn("session_duration", elapsed(F.max(_quoted(time)).over(whole), F.min(_quoted(time)).over(whole)))


def pick(df: DataFrame, *, entity: str, time: str, seq: str, which: str, candidate: Column, n: int = 1) -> DataFrame:
    """The first, last or nth event of each entity for which ``candidate`` holds, with all columns.

    First and last are aggregates, so each task sends a row an entity; nth ranks its candidates.
    """
    found = df.where(candidate)
    if which in ("first", "last"):
        choose = F.min_by if which == "first" else F.max_by
        row = F.struct(*(_quoted(c) for c in df.columns))
        best = found.groupBy(_quoted(entity).alias("of_entity")).agg(choose(row, F.struct(_quoted(time), _quoted(seq))).alias("row"))
        return best.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))
    order = Window.partitionBy(_quoted(entity)).orderBy(_quoted(time), _quoted(seq))
    return found.withColumn("__nth", F.row_number().over(order)).where(F.col("__nth") == n).drop("__nth")


def sample(df: DataFrame, *, entity: str, fraction: float, seed: int = 0) -> DataFrame:
    """All events of the entities whose XXH64 is below the fraction of its range: UTF-8 bytes of a
    text, 8 little-endian bytes of a number. Seed 42 is Spark's own hash and stays in the JVM; for
    other seeds each distinct entity is hashed once, in Arrow batches."""
    if fraction >= 1:
        return df
    if fraction <= 0:
        return df.where(F.lit(False))
    threshold = int(fraction * float((1 << 64) - 1))
    flip = F.lit(-(1 << 63)).cast("long")  # unsigned order as signed order
    below = lambda h: h.bitwiseXOR(flip) < F.lit(threshold - (1 << 63)).cast("long")
    if seed == NATIVE_SEED:
        return df.where(below(F.xxhash64(_quoted(entity))))
    text = isinstance(df.schema[entity].dataType, T.StringType)

    @F.pandas_udf("long")
    def hash_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for keys in parts:
            raw = (k.encode() if text else int(k).to_bytes(8, "little", signed=True) for k in keys)
            yield pd.Series(np.array([xxhash.xxh64_intdigest(k, seed) for k in raw], dtype=np.uint64).view(np.int64))

    keys = df.select(_quoted(entity).alias("__sampled")).where("__sampled IS NOT NULL").distinct()
    chosen = keys.withColumn("h", hash_of("__sampled")).where(below(F.col("h"))).select("__sampled")
    return df.join(chosen, _quoted(entity) == F.col("__sampled"), "left_semi")


def attribute(
    df: DataFrame, *, entity: str, time: str, seq: str, conversion: Column, touchpoint: Column, window: int, key: Column, carry: dict[str, str] | None = None, low: int | None = None, high: int | None = None
) -> DataFrame:
    """A row for each conversion and each touchpoint of its entity in the ``window`` nanoseconds before
    it (the start included, the conversion's own time not); one row with nulls where there is none.
    Both sides are joined by entity and stretch of time, a window long; a touchpoint stands in its own
    stretch and the next one, so an entity's touchpoints meet the conversions of their time only.

    Columns: the entity's, ``conversion_ts``, ``carry`` (output name: column of the conversion),
    ``touchpoint_ts``, ``touchpoint_key``. ``low`` and ``high`` bound the conversions.
    """
    at = F.unix_micros(_quoted(time))
    found = df.where(conversion)
    if low is not None:
        found = found.where(at >= low)
    if high is not None:
        found = found.where(at <= high)
    found = found.select(_quoted(entity).alias("of"), at.alias("cm"), _quoted(time).alias("conversion_ts"), *(_quoted(c).alias(n) for n, c in (carry or {}).items()))
    stretch = lambda c: F.expr(f"`{c}` - pmod(`{c}`, {max(1, window // 1000)})")
    touches = df.where(touchpoint).select(_quoted(entity).alias("by"), at.alias("tm"), _quoted(time).alias("touchpoint_ts"), key.alias("touchpoint_key"))
    touches = touches.withColumn("tb", F.explode(F.array(stretch("tm"), stretch("tm") + max(1, window // 1000))))
    found = found.withColumn("cb", stretch("cm"))
    near = (F.col("of") == F.col("by")) & (F.col("cb") == F.col("tb")) & (F.col("tm") < F.col("cm")) & ((F.col("cm") - F.col("tm")) * 1000 <= window)
    return found.join(touches, near, "left").select(F.col("of").alias(entity), "conversion_ts", *(_quoted(n) for n in (carry or {})), "touchpoint_ts", "touchpoint_key")


def merged(parts: list[tuple[str, DataFrame, str, str, str, str]]) -> DataFrame:
    """Events of several tables in one stream: ``(table, df, entity, time, event, seq)`` each.

    Columns ``table.column`` hold a table's values and are null for the others' rows; ``entity_id``,
    ``ts``, ``event_type`` (``table.type``), ``__seq`` (table order, then the table's own) and
    ``__source_table_id`` hold for all.
    """
    out = None
    for i, (name, df, entity, time, event, seq) in enumerate(parts):
        own = df.select(
            _quoted(entity).alias("entity_id"), _quoted(time).alias("ts"), F.concat(F.lit(f"{name}."), _quoted(event)).alias("event_type"),
            F.struct(F.lit(i).alias("t"), _quoted(seq).cast("long").alias("s")).alias("__seq"), F.lit(i).cast("long").alias("__source_table_id"),
            *(_quoted(c).alias(f"{name}.{c}") for c in df.columns),
        )
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
