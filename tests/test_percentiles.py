"""Percentiles are exact: nearest ranks, whatever the size of a group and the spread of its values."""

import math
import random

import duckdb
import pytest

from strandflow.queries import ORACLE_SQL, QUERIES
from strandflow.session import Engine
from tests.support import engine_of, rows

ALL = "p50 = P50(x), p90 = P90(x), p95 = P95(x), p99 = P99(x)"


def nearest(values):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    return tuple(float(values[(p * len(values) + 99) // 100 - 1]) if values else None for p in (50, 90, 95, 99))


def engine_with(spark, pairs, kind="double"):
    return engine_of(spark, [(g, i, "e", x) for i, (g, x) in enumerate(pairs)], f"x {kind}")


def test_query_matches_sql_on_larger_groups(spark, tmp_path):
    """Groups of 60,000 values; one type has nulls only, one value is null."""
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMPTZ '2024-01-01 00:00:00+00' + to_seconds(i) AS ts, i % 100 AS user_id,
        CASE WHEN i % 1000 = 7 THEN 'none' ELSE 'type' || i % 3 END AS event_type,
        CASE WHEN i % 1000 <> 7 AND i <> 5 THEN (i * 7919 % 180001) / 7.0 - 9000 END AS value, '{{}}' AS props
        FROM range(180000) r(i)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = rows(QUERIES["a07_percentiles"](spark, str(tmp_path)))
    assert found == sorted(db.sql(ORACLE_SQL["a07_percentiles"]).fetchall(), key=str)
    assert [r[0] for r in found] == ["type0", "type1", "type2"]


def test_values_of_all_sizes(spark):
    r = random.Random(5)
    inf, nan = float("inf"), float("nan")
    groups = {
        "spread": [r.choice((-1, 1)) * 10 ** r.uniform(-320, 308) for _ in range(700)] + [0.0, -0.0, inf, -inf, 5e-324, 1.7e308, nan, None],
        "close": [1e15 + i / 8 for i in range(500)] + [1e15 + 1e13],
        "negative": [-float(i) for i in range(333)],
        "same": [2.5] * 100,
        "one": [7.0],
        "endless": [inf] * 3 + [-inf] * 5,
        "none": [None, nan],
        None: [float(i % 10) for i in range(100)],
    }
    pairs = [(g, x) for g, xs in groups.items() for x in xs]
    found = engine_of(spark, [("u", i, "e", *p) for i, p in enumerate(pairs)], "g string, x double").query(f"events | STATS {ALL} GROUP BY g").collect()
    assert {x[0]: tuple(x[1:]) for x in found} == {g: nearest(xs) for g, xs in groups.items()}


@pytest.mark.parametrize("n", [1, 2, 9, 10, 11, 19, 20, 21, 99, 100, 101, 700])
def test_ranks_of_small_groups(spark, n):
    assert rows(engine_with(spark, [("a", i) for i in range(n)], "long").query(f"events | STATS {ALL}")) == [nearest(range(n))]


def test_beside_other_aggregates(spark):
    e = engine_with(spark, [("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", None), ("c", 5.0)])
    text = "events | STATS p = P50(x), n = COUNT(*), q = P50(x * 2 + 1), hi = P99(x), s = SUM(x)"
    assert rows(e.query(text)) == [(2.0, 5, 5.0, 5.0, 12.0)]
    assert rows(e.query(f"{text} GROUP BY user")) == [("a", 2.0, 3, 5.0, 4.0, 7.0), ("b", None, 1, None, None, None), ("c", 5.0, 1, 11.0, 5.0, 5.0)]
    assert rows(e.query("events | STATS `a b` = P50(x) GROUP BY QUANTIZE(ts, 1d) AS `a day` | SELECT `a b`")) == [(2.0,)]
    assert rows(e.query("events | WHERE x > 100 | STATS p = P50(x), q = P90(x + 1)")) == [(None, None)]
    assert rows(e.query("events | WHERE x > 100 | STATS p = P50(x), n = COUNT(*) GROUP BY user")) == []


def test_rows_are_read_once_and_no_values_broadcast(spark):
    e = Engine(spark)
    e.register("events", spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "user_id", "ts", "event_type", "event_id")
    df = e.query("events | STATS p = P50(value), q = P99(value) GROUP BY event_type")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") == 1 and "Broadcast" not in plan
