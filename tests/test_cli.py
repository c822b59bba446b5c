import threading
import time

import pytest
from pyspark.sql import functions as F

from strandflow.__main__ import main
from strandflow.session import Engine

TABLE = "events=file:///root/testdata/sf0.001/events.parquet:user_id:ts:event_type:event_id"


def test_prints_and_writes(spark, capsys, tmp_path):
    assert main(["--table", TABLE, "events | STATS n = COUNT(*)"]) == 0
    assert "|n" in capsys.readouterr().out
    assert main(["--table", TABLE.replace("file://", ""), "--out", str(tmp_path / "o"), "events | FIRST(signup) | SELECT user_id"]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() > 0


def test_errors(spark, capsys):
    assert main(["--table", TABLE, "events | FROB"]) == 1
    assert "line 1" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        main(["--table", "events=/x:user", "events"])


def test_cancelled_by_time_and_by_hand(spark):
    e = Engine(spark)
    slow = spark.range(1 << 34).select(F.xxhash64("id").alias("x")).agg(F.max("x"))
    with pytest.raises(Exception, match="(?i)cancel|interrupt"), e.limits("timed", timeout=1.0):
        slow.collect()
    with pytest.raises(Exception, match="(?i)cancel|interrupt"), e.limits("by-hand") as cancel:
        threading.Thread(target=lambda: (time.sleep(1), cancel()), daemon=True).start()
        slow.collect()
    with e.limits("quick", timeout=60):
        assert spark.range(3).count() == 3
