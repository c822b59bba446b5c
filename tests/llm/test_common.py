import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strandflow.llm import common


def test_written_tables_are_released(spark):
    made = common.written(spark.range(5), "x")
    assert made.count() == 5 and made.columns == ["id"]
    path = made.inputFiles()[0].rsplit("/", 1)[0]
    common.release(spark)
    with pytest.raises(AnalysisException):
        spark.read.parquet(path)


@pytest.mark.parametrize("rows", [0, 1, 5000])
def test_ranks_are_gapless(spark, rows):
    df = spark.range(rows).select((F.col("id") % 3).alias("k"), "id", F.lit("x").alias("Rank_Bucket"))
    df = df.union(df.where("k = 0")) if rows > 1 else df
    found: dict = {}
    for r in common.ranked(df, ["k"], F.col("id"), "r", 3).collect():
        found.setdefault(r.k, []).append(r.r)
    for own in found.values():
        assert sorted(own) == list(range(len(own)))
