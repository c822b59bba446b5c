"""Shared pieces: tables written to the cluster's shared folder, ids by rank, table reading."""

from __future__ import annotations

import atexit
import ctypes
import gc
import math
import pathlib
import shutil
import sys
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a rank bucket, about; the number of buckets follows the table.
RANK_ROWS = 1024
#: Buckets for each key of ``ranked`` at most, so the offsets that are broadcast keep a fixed bound.
RANK_BUCKETS = 2048
_written: list[str] = []
_shipped: set[str] = set()


#: ``tidy`` collects the driver's garbage when more than one part in so many of its heap is used.
HEAP_PARTS = 4

#: Bytes of rows that go to a Python worker at once; the default is large for tables of long texts.
BATCH_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application: their Python workers need not have
    it on their path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = pathlib.Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="strandflow-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    made = f"{folder}/{package.name}.zip"
    with zipfile.ZipFile(made, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, str(f.relative_to(package.parent)))
    context.addPyFile(made)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table. Sets the session's limit of bytes in an Arrow batch to BATCH_BYTES."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset and driver and executors are one
    process, as in tests, a temporary one. On a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="strandflow-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        found = f"file://{found}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: later steps neither repeat its
    work nor depend on executors that may be lost."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Gives back what finished steps leave in the driver: the free memory of its Python and, where
    the JVM's heap is filling, garbage. Spark removes broadcasts and shuffle files of queries that are
    gone only after the driver has collected its garbage; left to itself its heap grows first."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if HEAP_PARTS * (heap.totalMemory() - heap.freeMemory()) > heap.maxMemory():
        jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Removes the tables that this process has written. Results that were made from them must have
    been collected or written by then."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *wanted: str) -> dict[str, str]:
    """Names for helper columns that no column of ``df`` has, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in wanted:
        use = name
        while use.lower() in taken:
            use = f"_{use}"
        taken.add(use.lower())
        out[name] = use
    return out


def ranked(df: DataFrame, keys: list[str], by: Column, name: str, key_bound: int) -> DataFrame:
    """Adds ``name``: a gapless rank from 0 within ``keys``, in the order of a hash of ``by``.

    A key may hold any share of the rows: its rows are dealt to hash buckets, each bucket is ranked
    by itself, and the buckets' offsets (at most ``key_bound`` x ``RANK_BUCKETS`` rows, whatever the
    input) are added. ``df`` is read twice, so it should be cheap or written. Rows with an equal
    ``by`` fall into one bucket in any order.
    """
    from pyspark.sql import Window

    c = fresh(df, "rank_bucket", "rank_rows", "rank_offset", "rank_hash")
    largest = df.groupBy(*keys).count().agg(F.max("count")).head()[0] or 0
    buckets = max(1, min(RANK_BUCKETS, math.ceil(largest / RANK_ROWS)))
    dealt = df.withColumn(c["rank_hash"], F.xxhash64(by)).withColumn(
        c["rank_bucket"], F.pmod(F.shiftright(c["rank_hash"], 20), F.lit(buckets)).cast("int")
    )
    at = [*keys, c["rank_bucket"]]
    sizes = dealt.groupBy(*at).agg(F.count(F.lit(1)).alias(c["rank_rows"]))
    before = Window.partitionBy(*keys).orderBy(c["rank_bucket"]).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*at, F.coalesce(F.sum(c["rank_rows"]).over(before), F.lit(0)).alias(c["rank_offset"]))
    if key_bound * buckets <= 100_000:
        offsets = F.broadcast(offsets)
    own = F.row_number().over(Window.partitionBy(*at).orderBy(c["rank_hash"], by)) - 1
    return (
        dealt.withColumn(name, own.cast("long"))
        .join(offsets, at)
        .withColumn(name, F.col(name) + F.col(c["rank_offset"]))
        .drop(c["rank_bucket"], c["rank_offset"], c["rank_hash"])
    )


def schema(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)


def extended(df: DataFrame, spec: str) -> T.StructType:
    """The schema of ``df`` and the fields of ``spec`` after it."""
    return T.StructType([*df.schema.fields, *schema(spec).fields])
