"""Mixing sources to target weights by hash thresholds, without a sort of the documents.

Each document has a 60-bit hash. A source's budget of words beyond its whole repeats is met by the
documents below a threshold of that hash. The threshold is found from histograms: words are summed
by source and bucket of the upper hash bits, the bucket in which the budget ends is the only one
that is split by the next bits, and so on until it holds one hash. Budgets of more copies give
thresholds above those of fewer, so mixes of growing size are nested. Documents are then filtered
by comparing hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm.common import fresh, table, written

#: Hash bits, bits of a histogram level, words of a text, weights by rank of the source, most repeats.
BITS, LEVEL = 60, 12
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id, of the text where there is no id."""
    key = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes``: ``source``, ``source_size``. Adds ``target``: the sources share all words by
    weight, in code point order, null last; what goes beyond ``most`` times a source is shared
    again by weight. One row a source, so these windows see the sources only."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", most * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    full = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(full), F.lit(0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(full), F.lit(0)))
    open_ = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    target = F.when(F.col("w") * F.col("level") < F.col("cap"), F.col("w") * F.col("level")).otherwise(F.col("cap").cast("double"))
    return open_.select("source", "source_size", F.round(F.coalesce(target, F.lit(0.0)), 6).alias("target"))


def thresholds(narrow: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """For each source of ``narrow`` (``source``, ``size``, ``hash``; it should be cheap to read):
    ``source_size``, ``target``, ``whole`` (copies of every document), ``cut`` (documents with a
    smaller hash get one more copy; -1: none)."""
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    goals = goals.withColumn("whole", whole).withColumn("budget", F.round(F.col("target") - F.col("whole") * F.col("source_size"), 6))
    at = written(goals.withColumns({"low": F.lit(0).cast("long"), "before": F.lit(0).cast("long")}), "goals")
    rest, shift = narrow.where("size > 0").select(F.col("source").alias("s"), "size", "hash"), BITS
    while shift > 0:
        wide, shift = shift, shift - LEVEL
        inside = rest.join(at.select("source", "low"), F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("hash", wide) == F.shiftright("low", wide)))
        sums = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("n"), F.min("hash").alias("first"), F.max("hash").alias("last"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("earlier", F.coalesce(F.sum("n").over(upto), F.lit(0)))
        goal = at.select(F.col("source").alias("s"), "budget", "before")
        ends = sums.join(goal, F.col("s").eqNullSafe(F.col("source"))).where("before + earlier <= budget")
        ends = ends.groupBy("source").agg(F.max_by(F.struct("bucket", "n", "first", "last", "earlier"), "bucket").alias("e")).select(F.col("source").alias("s"), "e.*")
        at = written(
            at.drop("first", "last", "n").join(ends, F.col("s").eqNullSafe(F.col("source")), "left").select(
                "source", "source_size", "target", "whole", "budget", (F.col("before") + F.coalesce("earlier", F.lit(0))).alias("before"), F.coalesce(F.shiftleft("bucket", shift), "low").alias("low"), "first", "last", F.coalesce("n", F.lit(0)).alias("n")
            ),
            "boundaries",
        )
        if at.where("first < last").isEmpty():
            break
    cut = F.when(F.col("first").isNull(), F.lit(-1)).when(2 * (F.col("budget") - F.col("before")) > F.col("n"), F.col("first") + 1).otherwise(F.col("first"))
    return written(at.select("source", "source_size", "target", "whole", cut.cast("long").alias("cut")), "thresholds")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, narrow: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (its source's), ``copies`` and
    ``taken`` (words with repeats) appended; columns of those names are replaced.

    The mix of a source ends with the document that brings it nearest its target. Null texts have
    size 0, a null source is a source of its own, rows with an equal hash (a repeated id) are taken
    or left together, an empty table gives an empty one. ``narrow``: ``source``, ``size``, ``hash``
    of the same rows, where the caller has written them; else they are read from ``docs`` first.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*own)
    c = fresh(docs.withColumns({x: F.lit(0) for x in own}), "mix_hash", "mix_source", "mix_whole", "mix_cut")
    if narrow is None:
        narrow = written(docs.select("source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")), "narrow")
    cuts = thresholds(narrow, weights, most).select(F.col("source").alias(c["mix_source"]), "source_size", "target", F.col("whole").alias(c["mix_whole"]), F.col("cut").alias(c["mix_cut"]))
    if cuts.count() <= 50_000:
        cuts = F.broadcast(cuts)
    made = docs.withColumns({"size": word_count(F.col("text")), c["mix_hash"]: row_hash(F.col("doc_id"), F.col("text"))})
    return _taken(made.join(cuts, F.col("source").eqNullSafe(F.col(c["mix_source"]))), c)


def _taken(made: DataFrame, c: dict[str, str]) -> DataFrame:
    copies = F.col(c["mix_whole"]) + (F.col(c["mix_hash"]) < F.col(c["mix_cut"])).cast("int")
    made = made.withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    return made.drop(*c.values())


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``; nulls, repeated rows and empty tables as in ``mixed``."""
    docs = table(spark, sf_dir, "documents")
    narrow = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_hash(F.col("doc_id"), F.col("text")).alias("hash")), "narrow")
    cuts = thresholds(narrow).withColumnRenamed("source", "mix_source")
    if cuts.count() <= 50_000:
        cuts = F.broadcast(cuts)
    c = {"mix_hash": "hash", "mix_source": "mix_source", "mix_whole": "whole", "mix_cut": "cut"}
    return _taken(narrow.join(cuts, F.col("source").eqNullSafe(F.col("mix_source"))), c).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w, 3 * source_size AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (
  SELECT *, ((sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER f, 0))::DOUBLE) AS level
  FROM r WINDOW f AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT source, source_size, round(coalesce(CASE WHEN w * m.level < cap THEN w * m.level ELSE cap::DOUBLE END, 0), 6) AS target FROM r LEFT JOIN m ON true),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(3, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM t),
b AS (SELECT *, round(target - whole * source_size, 6) AS budget FROM g),
e AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, b.budget, d.h,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * (budget - (upto - own)) > own THEN 1 ELSE 0 END))::BIGINT AS taken
FROM e"""
