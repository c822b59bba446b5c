"""A corpus pipeline: reject toxic texts, keep one of each near-duplicate group, replace personal
data, mix the sources, pack the rest into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the
shared folder and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm import common, mixing, neardup, packing, pii, toxicity

#: A text with a score of at least this goes.
TOXIC = 0.5


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores below TOXIC. Labels are looked up for the stage's own input."""
    scored = toxicity.toxicity(docs, common.table(spark, sf_dir, "labels"))
    return scored.where(F.col("score") < TOXIC).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates (five words, 0.8), and one row
    of those that repeat its id. Rows without an id take part, with ids of their own after all others."""
    if docs.where("doc_id IS NULL").isEmpty():
        return _one_of_each(docs)
    first, last = docs.agg(F.coalesce(F.min("doc_id"), F.lit(0)), F.coalesce(F.max("doc_id"), F.lit(-1))).head()
    kept = _one_of_each(_numbered(docs, first, last))
    return kept.withColumn("doc_id", F.when(F.col("doc_id").between(first, last), F.col("doc_id"))).select(*docs.columns)


def _numbered(docs: DataFrame, first: int, last: int) -> DataFrame:
    """``docs`` whose ids are from ``first`` to ``last``, with an id outside that for each text without one."""
    bare = _once(docs.where("doc_id IS NULL")).withColumn("_row", F.monotonically_increasing_id())
    bare = common.written(bare, "unnamed").withColumn("_task", F.shiftright("_row", 33))
    sizes = bare.groupBy("_task").count()  # a row for each task that has written
    start = F.coalesce(F.sum("count").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = bare.count()
    base = last + 1 if last + n < 1 << 63 else first - n
    number = F.lit(base).cast("long") + F.col("_start") + F.col("_row").bitwiseAND((1 << 33) - 1)
    bare = bare.join(F.broadcast(sizes.select("_task", start.alias("_start"))), "_task").withColumn("doc_id", number)
    return docs.where("doc_id IS NOT NULL").union(bare.select(*docs.columns))


def _once(docs: DataFrame) -> DataFrame:
    """One of the rows that have the same id and text."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = docs.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("_others"))
    return least.select("doc_id", "text", "_others.*").select(*docs.columns)


def _one_of_each(docs: DataFrame) -> DataFrame:
    found = neardup.near_duplicates(docs, k=5, percent=80).groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count(F.lit(1)).alias("rows"))
    other = common.written(found.where("NOT kept OR rows > 1").select("doc_id", "kept"), "gone")
    few = other.count() <= neardup.BROADCAST_ROWS  # else the texts are shuffled
    other = F.broadcast(other) if few else other
    left = docs.join(other, "doc_id", "left_anti").select(*docs.columns)
    again = other.where("kept")
    return left if again.isEmpty() else left.union(_once(docs.join(F.broadcast(again) if few else again, "doc_id", "left_semi").select(*docs.columns)))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms in their texts; ``n_chars`` follows the text."""
    made = pii.pseudonymised(docs, pii.sample_key(spark), counts=False)
    return made.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that it doesn't take goes."""
    made = mixing.mixed(docs).where("copies > 0")
    return made.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs.select("doc_id", "text"), packing.vocabulary())


STAGES = [
    ("reject_toxic", reject_toxic),
    ("keep_one_of_each", keep_one_of_each),
    ("replace_personal_data", replace_personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
