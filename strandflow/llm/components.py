"""Connected components of a link table: minimum labels, hooked by their roots, and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import tidy, written


def components(links: DataFrame) -> DataFrame:
    """``links``: columns ``a``, ``b``. Returns ``node``, ``label``: the smallest node reachable,
    for every node that has a link.

    In each round the least label's label among a node's neighbours goes to the node and to the
    node's own label, so whole trees are hooked at once, and each node takes its label's label. The
    rounds needed grow with the logarithm of a component's size (chains of 2000 nodes take 13). Each round is
    written to the shared folder. Null nodes and loops are ignored; repeated links count once; an
    empty table gives an empty one.
    """
    return _labelled(links)[0]


def _labelled(links: DataFrame) -> tuple[DataFrame, int]:
    """The labels, and the rounds that they took."""
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b")
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    rounds = 0
    while True:
        far = labels.join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", "label", "far")
        near = both.join(far.select(F.col("node").alias("b"), "far"), "b").select(F.col("a").alias("node"), F.lit(None).cast("long").alias("label"), "far")
        seen = far.union(near).groupBy("node").agg(F.max("label").alias("label"), F.min("far").alias("m"))
        told = F.array(
            F.struct("node", F.col("m").alias("value"), F.col("label").alias("was")),
            F.struct(F.col("label").alias("node"), F.col("m").alias("value"), F.lit(None).cast("long").alias("was")),
        )
        now = seen.select(F.explode(told).alias("t")).groupBy("t.node").agg(F.min("t.value").alias("value"), F.max("t.was").alias("was"))
        now = written(now.select("node", F.least("value", "was").alias("label"), "was"), "labels")
        labels, rounds = now.select("node", "label"), rounds + 1
        tidy(links.sparkSession)
        if now.where("label <> was").isEmpty():
            return labels, rounds
