import json

import pytest

from strandflow.errors import NameCollision, QueryError, TypeProblem, UnknownName
from strandflow.session import Engine
from strandflow.sources.files import compacted, write_events
from tests.support import rows

CREATE = "CREATE TABLE t (u STRING ENTITY KEY, ts TIMESTAMP EVENT TIME, e STRING EVENT TYPE, amount INT, ok BOOL, price FLOAT)"


@pytest.fixture
def engine(spark):
    e = Engine(spark, now="2024-02-01T00:00:00Z")
    e.execute(CREATE)
    return e


def test_insert_alter_delete_drop(engine):
    assert engine.execute("INSERT INTO t VALUES ('a', '2024-01-01T00:00:00Z', 'x', 1, TRUE, 2), ('b', 0, 'y', NULL, FALSE, 0.5)").rows_affected == 2
    engine.execute("ALTER TABLE t ADD COLUMN plan STRING DEFAULT 'free'")
    engine.execute("INSERT INTO t VALUES ('c', 1, 'z', 3, NULL, NULL, 'pro')")
    assert rows(engine.query("t | SELECT u, amount, ok, price, plan")) == [("a", 1, True, 2.0, "free"), ("b", None, False, 0.5, "free"), ("c", 3, None, None, "pro")]
    ids = [r[0] for r in engine.query("t | SELECT __seq_id, __batch_id").collect()]
    assert len(set(ids)) == 3 and engine.query("t").columns == ["u", "ts", "e", "amount", "ok", "price", "plan"]
    assert engine.execute("DELETE FROM t WHERE u = 'a'").rows_affected == 1
    assert engine.execute("DELETE FROM t WHERE amount > 2 ALLOW SCAN").rows_affected == 1
    assert rows(engine.query("t | SELECT u")) == [("b",)]
    with pytest.raises(QueryError):
        engine.execute("DELETE FROM t WHERE amount > 2")
    engine.execute("DROP TABLE t")
    with pytest.raises(UnknownName):
        engine.query("t")


def test_describe(engine):
    found = rows(engine.query("DESCRIBE t"))
    assert ("u", "STRING", False, "entity_key") in found and ("__seq_id", "INT", False, "system") in found and ("price", "FLOAT", True, "property") in found


@pytest.mark.parametrize(
    "text",
    ["INSERT INTO t VALUES ('a', 0, 'x')", "INSERT INTO t VALUES ('a', 0, 'x', 'no', TRUE, 1.0)", "INSERT INTO t VALUES (NULL, 0, 'x', 1, TRUE, 1.0)", "INSERT INTO t VALUES ('a', 'never', 'x', 1, TRUE, 1.0)"],
)
def test_bad_rows(engine, text):
    with pytest.raises(TypeProblem):
        engine.execute(text)


def test_bad_tables(engine):
    with pytest.raises(NameCollision):
        engine.execute(CREATE)
    with pytest.raises(QueryError):
        engine.execute("CREATE TABLE v (u STRING ENTITY KEY, e STRING EVENT TYPE)")
    with pytest.raises(QueryError):
        engine.execute("CREATE TABLE v (u STRING ENTITY KEY, ts TIMESTAMP, e STRING EVENT TYPE, __x INT)")


def test_csv(engine, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text("uid;ts;e;amount;ok;price\na;1000000000;x;5;yes;1.5\nb;2024-01-01T00:00:00Z;y;;0;\n")
    engine.execute(f"INSERT INTO t FROM '{f}' WITH (delimiter: ';', map: (uid AS u))")
    assert rows(engine.query("t | SELECT u, EPOCH_NANOS(ts) AS n, amount, ok, price")) == [("a", 10**9, 5, True, 1.5), ("b", 1704067200 * 10**9, None, False, None)]
    f.write_text("u,ts,e,amount,ok,price\na,0,x,five,yes,1\n")
    with pytest.raises(Exception, match="five"):
        engine.execute(f"INSERT INTO t FROM '{f}'")
        engine.query("t").collect()


def test_jsonl_and_parquet(spark, engine, tmp_path):
    f = tmp_path / "in.jsonl"
    f.write_text("\n".join(json.dumps(x) for x in [{"u": "a", "ts": 5000, "e": "x", "amount": 1}, {"u": "b", "ts": "2024-01-01T00:00:00Z", "e": "y", "price": 2.5}]))
    engine.execute(f"INSERT INTO t FROM '{f}'")
    assert rows(engine.query("t | SELECT u, EPOCH_NANOS(ts) AS n, amount, price")) == [("a", 5000, 1, None), ("b", 1704067200 * 10**9, None, 2.5)]
    out = str(tmp_path / "out")
    write_events(engine.catalog["t"], out, 3)
    compacted(spark, out, str(tmp_path / "one"), 1)
    assert spark.read.parquet(str(tmp_path / "one")).count() == 2
    spark.createDataFrame([("c", 1, "z", 7)], "u string, w int, e string, amount int").selectExpr("u", "timestamp_seconds(w) AS ts", "e", "amount").write.parquet(str(tmp_path / "p"))
    engine.execute(f"INSERT INTO t FROM '{tmp_path / 'p'}' WITH (format: parquet)")
    assert ("c", 7) in rows(engine.query("t | SELECT u, amount"))
    with pytest.raises(QueryError):
        engine.execute(f"INSERT INTO t FROM '{tmp_path / 'p'}'")


def test_times_without_a_zone_are_utc(spark):
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.sql("SELECT 'a' AS u, TIMESTAMP_NTZ '2024-01-01 01:00:00' AS ts, 'x' AS e, DATE '2024-01-02' AS d")
            e = Engine(spark)
            e.register("t", df, "u", "ts", "e")
            assert rows(e.query("t | SELECT EPOCH_NANOS(ts) AS n, EPOCH_NANOS(d) AS d, EPOCH_NANOS(QUANTIZE(ts, 1d)) AS q")) == [(1704070800 * 10**9, 1704153600 * 10**9, 1704067200 * 10**9)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_time_ranges_reach_the_files(spark):
    from strandflow.queries import engine

    plan = engine(spark, "/root/testdata/sf0.001").query("events LAST 7d | STATS n = COUNT(*)")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(ts," in scan and "LessThan" in scan


def test_pushdown_and_one_shuffle(spark):
    """Filters and columns reach the scan; a pattern with an aggregate takes one shuffle by entity."""
    e = Engine(spark)
    e.register("events", spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "user_id", "ts", "event_type", "event_id")
    plan = e.query("events | WHERE value > 10 | FUNNEL(signup THEN view THEN purchase) WITHIN 7d")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThan(value,10.0)" in scan and "props" not in scan.split("ReadSchema")[1]
    assert plan.count("Exchange hashpartitioning") == 1
