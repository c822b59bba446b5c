import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandflow.streaming.live import bucketed, first_matches, sessions
from tests.support import BASE, rows

SCHEMA = "seq long, user string, ts timestamp, kind string"


@pytest.fixture
def stream(spark, tmp_path):
    """Gives a function that writes rows as a file, and the streaming DataFrame over the folder."""
    folder = tmp_path / "in"
    folder.mkdir()
    made = [0]

    def add(*events):
        full = [(made[0] + i, u, BASE + dt.timedelta(seconds=t), k) for i, (u, t, k) in enumerate(events)]
        made[0] += len(full)
        spark.createDataFrame(full, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))

    return add, lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_buckets(spark, stream, tmp_path):
    add, read = stream
    add(("a", 1, "x"), ("b", 59, "x"), ("a", 61, "y"))
    add(("a", 400, "x"))
    got = run(spark, bucketed(read(), time="ts", width="1m", late="10s", by=["kind"], n=F.count(F.lit(1))), tmp_path, "buckets")
    assert rows(got.select(F.unix_seconds("bucket") - int(BASE.timestamp()), "kind", "n")) == [(0, "x", 2), (60, "y", 1)]


def test_sessions_keep_events_at_the_gap(spark, stream, tmp_path):
    add, read = stream
    add(("a", 0, "x"), ("a", 10, "x"), ("a", 21, "x"))
    add(("z", 1000, "x"))
    got = run(spark, sessions(read(), entity="user", time="ts", gap="10s", late="1s"), tmp_path, "sessions")
    assert rows(got.select("user", F.unix_seconds("session_end") - F.unix_seconds("session_start"), "events")) == [("a", 0, 1), ("a", 10, 2)]


def test_patterns_across_batches(spark, stream, tmp_path):
    add, read = stream
    add(("a", 0, "x"), ("b", 0, "x"), ("c", 0, "y"))
    add(("a", 5, "y"), ("b", 50, "x"), ("c", 5, "z"))
    add(("a", 20, "z"), ("b", 55, "y"), ("b", 60, "z"))
    add(("a", 30, "x"), ("a", 31, "y"), ("a", 32, "z"))
    made = first_matches(read(), entity="user", time="ts", event="kind", seq="seq", steps=["x", "y", "z"], within="30s", late="5s")
    got = run(spark, made, tmp_path, "patterns")
    base = int(BASE.timestamp())
    assert rows(got.select("entity_id", F.unix_seconds("match_start") - base, F.unix_seconds("match_end") - base)) == [("a", 0, 20), ("b", 50, 60)]
