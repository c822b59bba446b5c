"""CSV, JSON lines and Parquet in; Parquet out, dealt by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.catalog import BATCH, SEQ, EventTable, widened
from strandflow.errors import QueryError, TypeProblem, UnknownName

_BY_ENDING = {"csv": "csv", "tsv": "csv", "json": "jsonl", "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet", "pq": "parquet"}


def format_of(path: str, given: str | None = None) -> str:
    found = given.lower() if given else _BY_ENDING.get(path.rsplit(".", 1)[-1].lower())
    if found == "json":
        found = "jsonl"
    if found not in ("csv", "jsonl", "parquet"):
        raise QueryError(f"{path}: say the format, csv, jsonl or parquet")
    return found


def _time(c: Column) -> Column:
    """Nanoseconds since 1970, or an RFC 3339 text."""
    number = c.try_cast("long")
    return F.when(number.isNotNull(), F.timestamp_micros(F.call_function("div", number, F.lit(1000).cast("long")))).otherwise(c.try_cast("timestamp"))


def _from_text(c: Column, of: T.DataType) -> Column:
    if isinstance(of, T.TimestampType):
        return _time(c)
    if isinstance(of, T.BooleanType):
        low = F.lower(F.trim(c))
        return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)
    return c.try_cast(of)


def _strict(df: DataFrame, made: dict[str, tuple[Column, Column]], path: str) -> DataFrame:
    """Columns from (raw, converted) pairs; a value that is there but can't be converted ends the job
    with its place in the file."""
    out = []
    for name, (raw, value) in made.items():
        where = F.concat(F.lit(f"{path}: {name}: can't read "), raw.cast("string"))
        out.append(F.when(raw.isNotNull() & value.isNull(), F.raise_error(where).cast("string")).otherwise(F.lit(None).cast("string")).alias(f"__check_{name}"))
    checked = df.select("*", *out)
    ok = F.coalesce(*(F.col(f"`__check_{name}`") for name in made), F.lit("")) == ""
    return checked.where(ok).select(*(value.alias(name) for name, (_, value) in made.items()))


def read_events(spark: SparkSession, path: str, table: EventTable, format: str | None = None, delimiter: str = ",", header: bool = True, map: dict[str, str] | None = None) -> DataFrame:
    """A file's columns that ``table`` has, in its types. ``map``: file's name to table's name; other
    names stay. CSV: timestamps in nanoseconds or RFC 3339, an empty field is null, nested types
    aren't read. Columns that the file lacks are left to the caller."""
    map = map or {}
    own = {f.name: f.dataType for f in table.df.schema.fields if f.name not in (SEQ, BATCH)}
    kind = format_of(path, format)
    if kind == "csv":
        df = spark.read.csv(path, sep=delimiter, header=header, mode="FAILFAST", quote='"', escape='"')
        if not header:
            df = df.toDF(*list(own)[: len(df.columns)])
        if bad := [c for c, t in own.items() if c in {map.get(x, x) for x in df.columns} and isinstance(t, (T.ArrayType, T.MapType))]:
            raise TypeProblem(f"{bad[0]}: CSV has no nested types")
    elif kind == "jsonl":
        back = {v: k for k, v in map.items()}
        fields = [T.StructField(back.get(c, c), T.StringType() if isinstance(t, T.TimestampType) else t) for c, t in own.items()]
        df = spark.read.schema(T.StructType(fields)).json(path, mode="FAILFAST")
    else:
        df = widened(spark.read.parquet(path))
    df = df.withColumnsRenamed({k: v for k, v in map.items() if k in df.columns})
    if extra := [c for c in df.columns if c not in own]:
        raise UnknownName(f"table {table.name} has no column {extra[0]}; map it to one")
    if kind == "parquet":
        return df
    made = {}
    for c in df.columns:
        raw = F.col(f"`{c}`")
        made[c] = (raw, _from_text(raw, own[c]) if kind == "csv" or isinstance(own[c], T.TimestampType) else raw)
    return _strict(df, made, path)


def write_events(table: EventTable, path: str, partitions: int | None = None, mode: str = "overwrite") -> None:
    """A table as Parquet: an entity's events stand together in one file, in order, so readers skip
    by entity and time."""
    parts = [F.col(f"`{table.entity}`")]
    df = table.df.repartition(partitions, *parts) if partitions else table.df.repartition(*parts)
    df.sortWithinPartitions(f"`{table.entity}`", f"`{table.time}`", f"`{table.order}`").write.mode(mode).parquet(path)


def write_bucketed(table: EventTable, name: str, buckets: int) -> None:
    """A table of the warehouse in buckets by entity: windows and joins by entity need no shuffle."""
    table.df.write.mode("overwrite").bucketBy(buckets, table.entity).sortBy(table.entity, table.time).saveAsTable(name)


def compacted(spark: SparkSession, path: str, to: str, files: int) -> None:
    """Many small files into ``files``, without a shuffle."""
    spark.read.option("mergeSchema", "true").parquet(path).coalesce(files).write.mode("overwrite").parquet(to)
