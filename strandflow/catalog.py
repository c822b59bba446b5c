"""Event tables: a DataFrame and the roles of its columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow.errors import NameCollision, QueryError, TypeProblem, UnknownName
from strandflow.types import SPARK_TYPES, kind

SEQ, BATCH = "__seq_id", "__batch_id"
#: Number of the first inserted row, above those of tables that are registered without one.
FIRST = 1 << 62


@dataclass(frozen=True)
class EventTable:
    """``seq`` orders events of equal time; where it is None the table has SEQ and BATCH columns."""

    name: str
    df: DataFrame
    entity: str
    time: str
    event: str
    seq: str | None = None
    nullable: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        missing = [c for c in (self.entity, self.time, self.event, self.order) if c not in self.df.columns]
        if missing:
            raise UnknownName(f"table {self.name} has no column {missing[0]}")
        kinds = {f.name: kind(f.dataType) for f in self.df.schema.fields}
        for column, wanted in ((self.entity, ("string", "int")), (self.time, ("timestamp",)), (self.event, ("string",))):
            if kinds[column] not in wanted:
                raise TypeProblem(f"{self.name}.{column} must be of type {' or '.join(wanted)}")

    @property
    def order(self) -> str:
        return self.seq or SEQ

    def role(self, column: str) -> str:
        found = {self.entity: "entity_key", self.time: "event_time", self.event: "event_type"}
        return "system" if column.startswith("__") else found.get(column, "property")

    def described(self) -> DataFrame:
        """``name``, ``type``, ``nullable``, ``role`` of each column, system columns last."""
        fields = sorted(self.df.schema.fields, key=lambda f: f.name.startswith("__"))
        rows = [(f.name, shown_type(f.dataType), self.role(f.name) == "property" and self.nullable.get(f.name, True), self.role(f.name)) for f in fields]
        return self.df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean, role string")


def shown_type(of: T.DataType) -> str:
    if isinstance(of, T.ArrayType):
        return f"LIST({shown_type(of.elementType)})"
    if isinstance(of, T.MapType):
        return f"MAP({shown_type(of.valueType)})"
    return kind(of).upper()


def spark_type(text: str) -> str:
    """Of a type as the parser gives it: ``int``, ``list<string>``, ``map<float>``."""
    if text.startswith("list<"):
        return f"array<{spark_type(text[5:-1])}>"
    if text.startswith("map<"):
        return f"map<string, {spark_type(text[4:-1])}>"
    return SPARK_TYPES[text]


def widened(df: DataFrame) -> DataFrame:
    """Integers as long, other numbers as double, dates and times without a zone as instants in UTC.
    Filters on a time without a zone don't reach the files: read such a column as ``timestamp``."""
    zone = df.sparkSession.conf.get("spark.sql.session.timeZone")
    out = []
    for f in df.schema.fields:
        c, k = F.col(f"`{f.name}`"), kind(f.dataType)
        if k == "int" and not isinstance(f.dataType, T.LongType):
            c = c.cast("long")
        elif k == "float" and not isinstance(f.dataType, T.DoubleType):
            c = c.cast("double")
        elif k == "timestamp" and not isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
            c = (c if zone in ("UTC", "Etc/UTC", "Z") else F.convert_timezone(F.lit("UTC"), F.lit(zone), c)).cast("timestamp")
        elif k == "other":
            raise TypeProblem(f"column {f.name} has a type that event tables don't take: {f.dataType.simpleString()}")
        out.append(c.alias(f.name))
    return df.select(*out)


class Catalog:
    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, EventTable] = {}
        self.batches = 0
        #: What the next inserted row is numbered; rows that a table was registered with have less.
        self.rows = FIRST

    def __getitem__(self, name: str) -> EventTable:
        if name not in self.tables:
            raise UnknownName(f"no table {name}")
        return self.tables[name]

    def register(self, name: str, df: DataFrame, entity: str, time: str, event: str, seq: str | None = None) -> EventTable:
        """A table over a DataFrame, which is read anew by every query. Without ``seq``, rows are
        numbered as they come."""
        df = widened(df)
        if seq is None and SEQ not in df.columns:
            df = df.withColumns({SEQ: F.monotonically_increasing_id(), BATCH: F.lit(0).cast("long")})
        self.tables[name] = EventTable(name, df, entity, time, event, seq)
        return self.tables[name]

    def create(self, name: str, columns: list[tuple[str, str, str, bool, object]]) -> EventTable:
        """columns: name, type, role, not null, default."""
        if name in self.tables:
            raise NameCollision(f"table {name} exists")
        names = [c[0] for c in columns]
        if len(set(names)) < len(names):
            raise NameCollision(f"table {name} names a column twice")
        if bad := [c for c in names if c.startswith("__")]:
            raise QueryError(f"{bad[0]}: names that begin with __ are the system's")
        roles = {}
        for role in ("entity_key", "event_time", "event_type"):
            found = [c[0] for c in columns if c[2] == role]
            if not found and role == "event_time":
                found = [c[0] for c in columns if c[1] == "timestamp"]
            if len(found) != 1:
                raise QueryError(f"table {name} needs one column that is {role.replace('_', ' ').upper()}")
            roles[role] = found[0]
        spec = ", ".join(f"`{c[0]}` {spark_type(c[1])}" for c in columns)
        df = self.spark.createDataFrame([], f"{spec}, {SEQ} long, {BATCH} long")
        made = EventTable(name, df, roles["entity_key"], roles["event_time"], roles["event_type"], nullable={c[0]: not c[3] for c in columns})
        self.tables[name] = made
        return made

    def append(self, name: str, rows: DataFrame) -> int:
        """Adds rows that have the table's columns but the system's; returns how many. They are
        numbered after those that are there, in one batch."""
        held = self[name]
        own = [c for c in held.df.columns if c not in (SEQ, BATCH)]
        if missing := [c for c in rows.columns if c not in own]:
            raise UnknownName(f"table {name} has no column {missing[0]}")
        kinds = dict(held.df.dtypes)
        rows = rows.select(*[F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in own])
        # one pass over the rows tells how many each task reads and what may not be null; ids then
        # follow those of the batches before without a gap
        at = F.monotonically_increasing_id()
        marked = rows.withColumn(SEQ, at)
        roles = (held.entity, held.time, held.event)
        read = marked.groupBy(F.shiftright(SEQ, 33).alias("task")).agg(F.count(F.lit(1)).alias("n"), *(F.max(F.col(f"`{c}`").isNull()).alias(f"null{i}") for i, c in enumerate(roles)))
        tasks = sorted(read.collect())  # a row for each task that reads a part of the input
        for i, role in enumerate(roles):
            if any(t[2 + i] for t in tasks):
                raise TypeProblem(f"{name}.{role} can't be null")
        self.batches += 1
        total = sum(t.n for t in tasks)
        if SEQ in held.df.columns:
            starts, start = [], self.rows
            for t in tasks:
                starts.append((t.task, start))
                start += t.n
            self.rows = start
            offsets = F.broadcast(self.spark.createDataFrame(starts, "__task long, __start long"))
            numbered = marked.withColumn("__task", F.shiftright(SEQ, 33)).join(offsets, "__task")
            number = F.col("__start") + F.col(SEQ).bitwiseAND((1 << 33) - 1)
            rows = numbered.withColumns({SEQ: number, BATCH: F.lit(self.batches).cast("long")}).select(*held.df.columns)
        self.tables[name] = replace(held, df=held.df.unionByName(rows))
        return total

    def add_column(self, name: str, column: str, type_: str, default: object = None, not_null: bool = False) -> None:
        held = self[name]
        if column in held.df.columns or column.startswith("__"):
            raise NameCollision(f"table {name} has or can't have a column {column}")
        if not_null and default is None:
            raise QueryError(f"{column}: a NOT NULL column needs a DEFAULT")
        df = held.df.withColumn(column, F.lit(default).cast(spark_type(type_)))
        self.tables[name] = replace(held, df=df, nullable=held.nullable | {column: not not_null})

    def drop(self, name: str) -> None:
        self[name]
        del self.tables[name]

    def replace(self, name: str, df: DataFrame) -> None:
        self.tables[name] = replace(self[name], df=df)
