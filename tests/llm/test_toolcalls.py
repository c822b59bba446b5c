import json

import duckdb
from pyspark.sql import functions as F

from strandflow.llm.toolcalls import OP3_SQL, canonical, link, op3_tool_calls
from tests.support import plain

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>"
SCHEMAS = {"add": [("a", "integer", True, 0), ("b", "number", True, None), ("note", "string", False, 2)]}


def run(spark, calls, results, schemas=SCHEMAS):
    made = link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "call_id string, turn long, content string"), schemas)
    return {(r.conv_id, r.turn, r.call_id): r for r in made.collect()}


def test_links_validates_and_orders(spark):
    calls = [
        (1, 5, "c1", "add", '{"b": 1.5, "a": 2}', []), (1, 1, "c2", "add", '{"a": -1, "b": 2}', ["c1"]), (1, 2, "c3", "add", '{"a": "x"}', ["c2", "zz"]), (1, 7, "c4", "frob", "{}", None),
        (2, 0, "d1", "add", "not json", []), (2, 1, "d2", "add", '{"a": 1, "b": 2, "note": "n"}', ["d1"]),
    ]
    got = run(spark, calls, [("c1", 6, "three"), ("c1", 9, "later"), ("nobody", 1, "x")])
    assert {k[2]: r.position for k, r in got.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": 3, "d1": 0, "d2": 1}
    assert got[1, 5, "c1"].valid and json.loads(got[1, 5, "c1"].json)["result"] == {"content": "three", "turn": 6}
    assert got[1, 5, "c1"].json.startswith('{"arguments":{"a":2,"b":1.5},"depends_on":[],"id":"c1","name":"add"')
    assert got[1, 1, "c2"].errors == "a: below 0"
    assert got[1, 2, "c3"].errors == "a: not integer; b: missing; depends on unknown zz"
    assert got[1, 7, "c4"].errors == "unknown tool" and got[2, 0, "d1"].errors == "arguments: not an object" and got[2, 1, "d2"].errors == "note: below 2"


def test_circles_repeated_and_missing_ids(spark):
    ok = '{"a": 1, "b": 2}'
    got = run(spark, [(1, 0, "x", "add", ok, ["y"]), (1, 1, "y", "add", ok, ["x"]), (1, 2, "z", "add", ok, [])], [])
    assert "depends on itself" in got[1, 0, "x"].errors and got[1, 2, "z"].valid
    calls = [(None, None, None, "add", ok, ["q"]), (1, 0, "r", "add", ok, []), (1, 0, "r", "add", ok, [])]
    rows = link(spark.createDataFrame(calls, CALLS), spark.createDataFrame([("r", 1, "v"), (None, 1, "w")], "call_id string, turn long, content string"), SCHEMAS).collect()
    assert len(rows) == 3 and sorted(r.errors for r in rows) == ["id used twice", "id used twice", "no id"] and sorted(r.position for r in rows if r.conv_id == 1) == [0, 1]
    assert run(spark, [], []) == {}


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": [1, 2.50, null], "a": {"z": "é\\n", "y": true}}',), ("nope",), (None,)], "j string")
    assert [r[0] for r in df.select(canonical(F.col("j"))).collect()] == ['{"a":{"y":true,"z":"é\\n"},"b":[1,2.5,null]}', None, None]


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet'")
    found = c.sql(OP3_SQL)
    ours = op3_tool_calls(spark, d)
    names = sorted(ours.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(x) for x in names]
    assert sorted((tuple(plain(r[x]) for x in names) for r in ours.collect()), key=str) == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_plan_has_no_python(spark):
    plan = op3_tool_calls(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_random_graphs_are_ordered(spark):
    """Positions follow the latest turn that a call waits for, then the steps it takes from there."""
    import random

    rng, ok = random.Random(6), '{"a": 1, "b": 2}'
    calls, wanted = [], {}
    for conv in range(12):
        turns = {f"{conv}:{i}": rng.randrange(30) for i in range(14)}
        names = list(turns)
        rng.shuffle(names)
        deps = {x: rng.sample(names[:i], min(i, rng.randrange(3))) for i, x in enumerate(names)}  # no circle
        keys = {}
        for x in names:
            keys[x] = max([(turns[x], 0), *((keys[d][0], keys[d][1] + 1) for d in deps[x])])
        wanted |= {x: (conv, keys[x], deps[x]) for x in names}
        calls += [(conv, turns[x], x, "add", ok, deps[x]) for x in names]
    got = {k[2]: r.position for k, r in run(spark, calls, []).items()}
    for conv in range(12):
        own = sorted((got[x], key) for x, (c, key, _) in wanted.items() if c == conv)
        assert [p for p, _ in own] == list(range(14)) and [k for _, k in own] == sorted(k for _, k in own)
    assert all(got[d] < got[x] for x, (_, _, deps) in wanted.items() for d in deps)


def test_very_long_arguments(spark):
    calls = spark.createDataFrame([(1, 0, "c", "say", [], 25_000_000), (1, 1, "d", "say", [], 10)], "conv_id long, turn long, call_id string, name string, depends_on array<string>, n int")
    text = F.concat(F.lit('{"words":1,"turn":2,"text":"'), F.expr("repeat('x', n)"), F.lit('"}'))
    made = link(calls.withColumn("arguments", text), spark.createDataFrame([], "call_id string, turn long, content string"))
    long, short = made.select("call_id", "valid", F.length("json").alias("n")).orderBy("call_id").collect()
    assert long.valid and short.valid and long.n - short.n == 25_000_000 - 10


def test_what_is_not_json_is_kept(spark):
    got = run(spark, [(1, 0, "c", "add", "not json", [])], [])
    assert json.loads(got[1, 0, "c"].json)["unread"] == "not json"


def test_long_conversations_are_numbered_without_gaps(spark):
    calls = spark.range(5000).selectExpr("7L AS conv_id", "id AS turn", "string(id) AS call_id", "'add' AS name", "'{}' AS arguments", "cast(array() AS array<string>) AS depends_on")
    made = link(calls, spark.createDataFrame([], "call_id string, turn long, content string"), SCHEMAS)
    assert made.where("position <> turn").count() == 0
