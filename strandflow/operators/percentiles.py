"""Exact percentiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the first round for each factor of e, so that one spans 2 %; ranges of the second round.
BY_LOGARITHM = 50
BY_RANGE = 65_536
#: The logarithm of a double, times BY_LOGARITHM, is between minus and plus this.
_FAR = 40_000
#: A whole number that never falls where the value rises; null for null.
_BUCKET = f"""CASE WHEN __v = 0 THEN 0 WHEN __v IS NOT NULL THEN int(signum(__v)) *
    CASE WHEN abs(__v) = double('infinity') THEN {2 * _FAR} ELSE int(floor(ln(abs(__v)) * {BY_LOGARITHM})) + {_FAR} END END"""
_RANGE = f"CASE WHEN __lo < __hi THEN floor((__v - __lo) / (__hi - __lo) * {BY_RANGE}) ELSE 0L END"


def percentiles(df: DataFrame, keys: dict[str, Column], value: Column, percents: dict[str, int]) -> DataFrame:
    """A row for each group: the keys and, for each of ``percents``, the smallest value that at least
    so many in 100 of the group's values don't exceed. Nulls and NaN don't count; a group of nothing
    else gets nulls.

    Equal values are counted once, dealt by key and value. Counts of buckets by logarithm, at most
    160,000 a group, tell which bucket holds a rank; that one is cut into equal ranges from its least to
    its greatest value, and only the values of the range that holds the rank are put in order. A value
    alone decides on its bucket and range, and all rounds read the same shuffle of counted values.
    """
    group, ranks = [f"__k{i}" for i in range(len(keys))], [f"__r{i}" for i in range(len(percents))]
    value = value.cast("double")
    values = df.select(*(k.alias(g) for k, g in zip(keys.values(), group, strict=True)), F.when(~F.isnan(value), value).alias("__v"))
    values = values.groupBy(*group, "__v").agg(F.expr("count(__v) AS __n")).selectExpr("*", f"{_BUCKET} AS __b")
    bounds = [F.expr(x) for x in ("sum(__n) AS __n", "min(__v) AS __lo", "max(__v) AS __hi")]

    buckets = values.groupBy(*group, "__b").agg(*bounds).selectExpr("*", f"sum(__n) OVER ({_partition(group)}) AS __all")
    buckets = buckets.selectExpr("*", *(f"({p} * __all + 99) DIV 100 AS {r}" for r, p in zip(ranks, percents.values(), strict=True)))
    parts = _holding(buckets, group, "__b", ["__lo", "__hi"], ranks)
    ranges = _within(values, parts, [*group, "__b"], ["__lo", "__hi", *ranks]).selectExpr("*", f"{_RANGE} AS __c")
    ranges = ranges.groupBy(*group, "__b", "__c").agg(*bounds, *(F.expr(f"first({r}) AS {r}") for r in ranks))
    parts = _holding(ranges, [*group, "__b"], "__c", ["__lo", "__hi"], ranks)
    ordered = _within(values, parts, [*group, "__b"], ["__c", "__lo", "__hi", *ranks]).where("__v IS NULL OR __v BETWEEN __lo AND __hi")
    found = _holding(ordered, [*group, "__b", "__c"], "__v", [], ranks)
    out = [F.expr(f"max(CASE WHEN {r} IS NOT NULL THEN __v END)").alias(name) for r, name in zip(ranks, percents, strict=True)]
    return found.groupBy(*(F.col(g).alias(name) for g, name in zip(group, keys, strict=True))).agg(*out)


def _partition(of: list[str]) -> str:
    return f"PARTITION BY {', '.join(of)}" if of else ""


def _holding(parts: DataFrame, of: list[str], by: str, more: list[str], ranks: list[str]) -> DataFrame:
    """Those of the parts, in their order, that hold a rank, with the rank counted from their own
    start; and the parts of nulls, of which the count is 0."""
    parts = parts.selectExpr("*", f"sum(__n) OVER ({_partition(of)} ORDER BY {by} ROWS UNBOUNDED PRECEDING) - __n AS __before")
    own = (f"CASE WHEN {r} > __before AND {r} <= __before + __n THEN {r} - __before END AS {r}" for r in ranks)
    return parts.selectExpr(*of, by, "__n", *more, *own).where(f"coalesce({', '.join(ranks)}) IS NOT NULL OR __n = 0")


def _within(values: DataFrame, parts: DataFrame, of: list[str], more: list[str]) -> DataFrame:
    """The counted values with their part's columns, for the parts given. They are few, so it is they
    that are held in memory, without being sent to all tasks. Nulls in keys are values."""
    parts = parts.selectExpr(*(f"{k} AS {k}_of" for k in of), *more)
    return values.join(parts.hint("shuffle_hash"), F.expr(" AND ".join(f"{k} <=> {k}_of" for k in of))).drop(*(f"{k}_of" for k in of))


__all__ = ["percentiles"]
