"""Sharding by Karmarkar-Karp differencing, with equal texts kept together.

Rows with equal texts are one indivisible group. Differencing keeps partial partitions, each a
tuple of one load per shard, and repeatedly combines the two of the largest spread, the largest load
of one with the smallest of the other. It runs in two places: over the head (groups of at least
1/``HEAD`` of a shard's share, so at most shards x HEAD of them) on the driver, and over the other groups
in buckets of about ``BUCKET`` groups on the executors. A bucket starts with its share of the head's loads as a
partial partition, so what the head leaves uneven is evened out by all buckets alike. The shards stand in
another order in each bucket, so that what buckets leave doesn't fall to the same shards, and one bucket comes
last: it is differenced with the summed loads of all others.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import fresh, ranked, ship, table, written

ROW_BYTES = 16
HEAD = 20
BUCKET = 5000


def difference(sizes: np.ndarray, shards: int, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The shard of each size, and the loads. With ``start``, loads that the shards have already.

    Deterministic: ties go by the order of ``sizes``. No sizes give the start's loads.
    """
    n = len(sizes)
    out = np.zeros(n, np.int64)
    if not n:
        return out, np.zeros(shards) if start is None else np.asarray(start, float)
    if start is not None:
        # shards that have more than an even share of what is left get nothing
        start, active = np.asarray(start, float), np.arange(shards)
        while (over := start[active] > (start[active].sum() + sizes.sum()) / len(active)).any():
            active = active[~over]
        if len(active) < shards:
            of, loads = difference(sizes, len(active), start[active])
            final = start.copy()
            final[active] = loads
            return active[of], final
    # each partial partition: loads ascending, and for each load the root of the tree of its sizes
    loads: list[np.ndarray] = []
    roots: list[np.ndarray] = []
    heap: list[tuple[float, int]] = []
    children: dict[int, tuple[int, int]] = {}
    node = n + shards

    def push(load: np.ndarray, root: np.ndarray) -> None:
        order = np.argsort(load, kind="stable")
        load, root = load[order], root[order]
        load = load - load[0] if start is None else load
        loads.append(load)
        roots.append(root)
        heapq.heappush(heap, (float(load[0] - load[-1]), len(loads) - 1))

    for i, size in enumerate(sizes):
        load, root = np.zeros(shards), np.full(shards, -1)
        load[-1], root[-1] = size, i
        loads.append(load)
        roots.append(root)
        heap.append((-float(size), i))
    if start is not None:
        load = np.asarray(start, float)
        order = np.argsort(load, kind="stable")
        loads.append(load[order])
        roots.append(n + order)  # leaves n .. n + shards - 1 stand for the shards as they were
        heap.append((float(load.min() - load.max()), n))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        ra, rb = roots[a], roots[b][::-1]
        root = np.where(ra < 0, rb, ra)
        for j in np.flatnonzero((ra >= 0) & (rb >= 0)):
            children[node] = int(ra[j]), int(rb[j])
            root[j] = node
            node += 1
        load = loads[a] + loads[b][::-1]
        loads[a] = loads[b] = roots[a] = roots[b] = None
        push(load, root)
    last = heap[0][1]
    member: list[list[int]] = []
    for root in roots[last]:
        stack, own = [int(root)] if root >= 0 else [], []
        while stack:
            x = stack.pop()
            if x >= n + shards:
                stack += children[x]
            else:
                own.append(x)
        member.append(own)
    final = np.zeros(shards) if start is None else np.asarray(start, float).copy()
    for j, own in enumerate(member):
        shard = next((x - n for x in own if x >= n), j) if start is not None else j
        for x in own:
            if x < n:
                out[x] = shard
                final[shard] += sizes[x]
    return out, final


def _unsigned(text):
    return F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long")


def shard(docs: DataFrame, shards: int = 40, head: int = HEAD, bucket: int = BUCKET, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``size`` (bytes of the text and ROW_BYTES), ``shard`` and ``slot`` appended;
    columns of those names are replaced.

    Equal texts share a shard, null texts are a group of their own (size ROW_BYTES each), empty
    texts another. A group larger than a shard's share gets a shard that receives nothing else.
    Slots count from 0 without gaps in each shard; rows of an equal id stand side by side in any
    order. The result is the same for the same rows. An empty table gives an empty one. The rows are
    written to the shared folder; without ``keep_text`` the texts are not.
    """
    ship(docs.sparkSession)
    docs = docs.drop("size", "shard", "slot")
    c = fresh(docs.withColumns({x: F.lit(0) for x in ("size", "shard", "slot")}), "shard_group", "shard_bucket", "group_bytes")
    key = F.coalesce(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)), F.lit(b"").cast("binary"))
    rows = docs.withColumns({"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long"), c["shard_group"]: key})
    rows = written(rows if keep_text else rows.drop("text"), "rows")
    groups = written(rows.groupBy(c["shard_group"]).agg(F.sum("size").alias(c["group_bytes"])), "groups")
    total, many = groups.agg(F.sum(c["group_bytes"]), F.count(F.lit(1))).head()
    limit = max(1.0, (total or 0) / shards / head)
    large = groups.where(F.col(c["group_bytes"]) >= limit).orderBy(F.desc(c["group_bytes"]), c["shard_group"]).toPandas()
    of, loads = difference(large[c["group_bytes"]].to_numpy(float), shards)
    spark = docs.sparkSession
    kind = f"`{c['shard_group']}` binary, shard int"
    head_of = spark.createDataFrame(pd.DataFrame({c["shard_group"]: [bytes(x) for x in large[c["shard_group"]]], "shard": of.astype("int32")}), kind) if len(large) else spark.createDataFrame([], kind)
    buckets = max(1, math.ceil((many or 0) / bucket))
    small = groups.where(F.col(c["group_bytes"]) < limit).withColumn(c["shard_bucket"], F.pmod(F.xxhash64(c["shard_group"]), F.lit(buckets)))
    rest = float((total or 0) - large[c["group_bytes"]].sum()) if len(large) else float(total or 0)
    name, amount = c["shard_group"], c["group_bytes"]

    def ordered(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values([amount, name], ascending=[False, True], key=lambda s: s.map(bytes) if s.name == name else s)

    def assign(at: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = ordered(found)
        sizes = found[amount].to_numpy(float)
        turn = np.random.default_rng(int(at[0])).permutation(shards)
        share = loads[turn] * (sizes.sum() / rest)
        return pd.DataFrame({name: found[name], "shard": turn[difference(sizes, shards, share)[0]].astype("int32"), amount: found[amount]})

    placed = head_of
    if buckets > 1:
        dealt = written(small.where(F.col(c["shard_bucket"]) > 0).groupBy(c["shard_bucket"]).applyInPandas(assign, f"{kind}, `{amount}` long"), "placed")
        loads = loads.copy()
        for row in dealt.groupBy("shard").agg(F.sum(amount).alias("n")).collect():  # at most one a shard
            loads[row["shard"]] += row["n"]
        placed = placed.union(dealt.drop(amount))
    last = ordered(small.where(F.col(c["shard_bucket"]) == 0).drop(c["shard_bucket"]).toPandas())
    if len(last):
        of, _ = difference(last[amount].to_numpy(float), shards, loads)
        placed = placed.union(spark.createDataFrame(pd.DataFrame({name: [bytes(x) for x in last[name]], "shard": of.astype("int32")}), kind))
    return ranked(written(rows.join(placed, c["shard_group"]).drop(c["shard_group"]), "sharded"), ["shard"], F.struct("doc_id", "size"), "slot", shards)


def op1_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards by the law ``bytes``; nulls, repeated rows and empty tables as in ``shard``."""
    docs = table(spark, sf_dir, "documents")
    made = shard(docs.select("doc_id", "text", _unsigned(F.col("text")).alias("text_crc32")), keep_text=False)
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
