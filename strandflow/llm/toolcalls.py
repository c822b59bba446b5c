"""Tool-call linking with DataFrame functions only: calls joined to results by identifier, ordered so
that each stands after what it depends on, arguments checked against schemas, canonical JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm.common import table, written
from strandflow.llm.components import components
from strandflow.llm.mixing import word_count

#: Turns of a stretch, as a power of two.
STRETCH = 10
#: Arguments of each tool: name, kind (string, integer, number, boolean, array, object), whether it must
#: be there, least value (of a string: least length) or None.
SCHEMAS: dict[str, list[tuple[str, str, bool, int | None]]] = {"say": [("text", "string", True, 1), ("turn", "integer", True, 0), ("words", "integer", True, 1)]}
_KINDS = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "FLOAT", "DECIMAL"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def parsed_json(text: Column) -> Column:
    """The value of a JSON text, null where it isn't one. Strings in it may be of any length, but the
    whole value is held to 128 MiB by Spark: beyond, it is null, too."""
    return F.from_json(text, "variant", {"maxStringLen": str((1 << 31) - 1), "allowSingleQuotes": "false"})


def canonical(text: Column) -> Column:
    """JSON with keys in order and without white space; null where ``text`` isn't JSON."""
    return F.to_json(parsed_json(text))


def faults(name: Column, arguments: Column, schemas: dict = SCHEMAS) -> Column:
    """An array of what is wrong with a call's arguments, in the order of the schema."""
    parsed = parsed_json(arguments)
    known = F.lit(False)
    checks: list[Column] = []
    for tool, fields in sorted(schemas.items()):
        of = name == tool
        known = known | of
        for field, kind, needed, least in fields:
            value = F.try_variant_get(parsed, f"$.{field}", "variant")
            sort = F.schema_of_variant(value)
            missing = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))
            fits = F.lit(False)
            for k in _KINDS[kind]:
                fits = fits | F.coalesce(sort.startswith(k), F.lit(False))
            said = F.when(missing, F.lit(f"{field}: missing") if needed else F.lit(None)).when(~fits, F.lit(f"{field}: not {kind}"))
            if least is not None:
                amount = F.length(F.try_variant_get(value, "$", "string")) if kind == "string" else F.try_variant_get(value, "$", "double")
                said = said.when(amount < least, F.lit(f"{field}: below {least}"))
            checks.append(F.when(of, said))
    whole = F.when(name.isNull() | ~F.coalesce(known, F.lit(False)), F.lit("unknown tool")).when(parsed.isNull() | ~F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), F.lit("arguments: not an object"))
    return F.when(whole.isNotNull(), F.array(whole)).otherwise(F.array_compact(F.array(*checks)))


def link(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """A row for each call.

    ``calls``: ``conv_id``, ``turn``, ``call_id``, ``name``, ``arguments`` (JSON), ``depends_on``
    (array of call ids); ``results``: ``call_id``, ``turn``, ``content``. Other columns are ignored.
    Returns ``conv_id``, ``turn``, ``call_id``, ``position`` (in its conversation, from 0, after all
    calls it depends on), ``result_turn``, ``valid``, ``errors`` (array) and ``json``.

    A call without an id or a result keeps its place with a null result. Of several results of an id
    the one of the least turn, then content, counts. Calls that share an id get the same result and
    an error each. Dependencies on unknown ids are errors and don't order anything; those on calls
    of a later turn move the call behind them, in as many rounds as the longest such chain has calls,
    and calls in a circle, or behind one, get an error. Null conversations
    are one conversation; null turns come first. Arguments that aren't JSON, or of more than 128 MiB, get an
    error and stand in ``json`` as they came, under ``unread``. Rows that repeat are calls that
    share an id. An empty table gives an empty one.
    """
    c = written(calls.select("conv_id", F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")), "calls")
    ids = c.where("call_id IS NOT NULL").groupBy("call_id").agg(F.count(F.lit(1)).alias("n_calls"), F.max(F.coalesce("turn", F.lit(-1))).alias("at"))
    ids = written(ids, "ids")
    needs = c.where("call_id IS NOT NULL").select("call_id", F.coalesce("turn", F.lit(-1)).alias("own"), F.explode(F.array_distinct("depends_on")).alias("dep"))
    edges = written(needs.join(ids.select(F.col("call_id").alias("dep"), "at"), "dep", "left"), "edges")
    lost = edges.where("at IS NULL").groupBy("call_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("depends on unknown "), "dep"))).alias("lost"))
    # only dependencies on the same or a later turn, and what hangs on them, can change the order
    place = ids.select("call_id", F.struct(F.col("at").alias("turn"), F.lit(0).cast("long").alias("hops")).alias("key"))
    if not edges.where("at >= own").isEmpty():
        known = edges.where("at IS NOT NULL")
        groups = components(known.select(F.xxhash64("call_id").alias("a"), F.xxhash64("dep").alias("b")))
        most = groups.groupBy("label").count().agg(F.max("count")).head()[0] or 1  # calls that hang together
        rounds = 0
        while True:
            ahead = known.join(place.select(F.col("call_id").alias("dep"), "key"), "dep").groupBy("call_id").agg(F.max(F.struct(F.col("key.turn").alias("turn"), (F.col("key.hops") + 1).alias("hops"))).alias("least"))
            moved = written(place.join(ahead, "call_id", "left").select("call_id", F.greatest("key", "least").alias("key"), F.coalesce(F.col("least") > F.col("key"), F.lit(False)).alias("moved")), "places")
            place, rounds = moved.select("call_id", "key"), rounds + 1
            if moved.where("moved").isEmpty() or rounds > 2 * most + 2:
                break
        # a chain has fewer steps than the group has calls
        place = moved.select("call_id", "key", (F.col("key.hops") > most).alias("circle"))
    else:
        place = place.withColumn("circle", F.lit(False))
    found = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct(F.col("turn").cast("long").alias("turn"), "content")).alias("result"))
    made = c.join(ids.select("call_id", "n_calls"), "call_id", "left").join(place, "call_id", "left").join(found, "call_id", "left").join(lost, "call_id", "left")
    notes = F.concat(
        faults(F.col("name"), F.col("arguments"), schemas),
        F.when(F.col("call_id").isNull(), F.array(F.lit("no id"))).otherwise(F.array().cast("array<string>")),
        F.when(F.col("n_calls") > 1, F.array(F.lit("id used twice"))).otherwise(F.array().cast("array<string>")),
        F.coalesce("lost", F.array().cast("array<string>")),
        F.when(F.col("circle"), F.array(F.lit("depends on itself"))).otherwise(F.array().cast("array<string>")),
    )
    shown = F.struct(
        parsed_json(F.col("arguments")).alias("arguments"), "depends_on", F.col("call_id").alias("id"), "name", F.struct(F.col("result.content").alias("content"), F.col("result.turn").alias("turn")).alias("result"),
        F.when(parsed_json(F.col("arguments")).isNull(), F.col("arguments")).alias("unread"),
    )
    made = written(
        made.select(
            "conv_id", "turn", "call_id", F.coalesce("key", F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.lit(0).cast("long").alias("hops"))).alias("key"),
            F.pmod(F.xxhash64("call_id", "arguments"), F.lit(16)).alias("part"), F.col("result.turn").alias("result_turn"), notes.alias("errors"), F.to_json(shown).alias("json"),
        ),
        "linked",
    )
    # places: rows of equal keys are dealt to parts, and turns to stretches of STRETCH with sums of their
    # own, so no conversation or turn is ranked in one task
    sizes = made.groupBy("conv_id", F.shiftright("key.turn", STRETCH).alias("stretch"), "key", "part").count()
    upto = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    long = sizes.groupBy("conv_id", "stretch").agg(F.sum("count").alias("count"))
    long = long.select(F.col("conv_id").alias("of"), F.col("stretch").alias("at"), upto(Window.partitionBy("conv_id").orderBy("stretch")).alias("before"))
    inner = sizes.withColumn("offset", upto(Window.partitionBy("conv_id", "stretch").orderBy("key", "part")))
    inner = inner.join(long, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")))
    offsets = inner.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), F.col("part").alias("p"), (F.col("before") + F.col("offset")).alias("offset"))
    own = F.row_number().over(Window.partitionBy("conv_id", "key", "part").orderBy("call_id", "json"))
    placed = made.withColumn("own", own).join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")) & (F.col("part") == F.col("p")))
    return placed.select("conv_id", "turn", "call_id", (F.col("own") - 1 + F.col("offset")).cast("long").alias("position"), "result_turn", (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), "json")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of a table of plain turns: each assistant turn calls the tool ``say``; the turn
    after it, unless it is the assistant's too, is its result. By pairs of turns, the second of each
    three depends on the pair after it, the third on the pair two before, the first on the pair before, so
    the order of the calls isn't that of the turns."""
    pair = F.floor(F.col("turn") / 2) % 3
    dep = F.when(pair == 1, F.col("turn") + 2).when(pair == 2, F.col("turn") - 4).otherwise(F.col("turn") - 2)
    ident = lambda turn: F.concat_ws(":", F.when(F.col("turn").isNotNull(), F.col("conv_id")).cast("string"), turn)
    calls = conversations.where("role = 'assistant'").select(
        "conv_id", "turn", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), ident(F.col("turn"))).alias("call_id"), F.lit("say").alias("name"),
        F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("turn").alias("turn"), word_count(F.col("text")).alias("words"))).alias("arguments"),
        F.when(F.col("conv_id").isNotNull() & (dep >= 0), F.array(ident(dep))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = conversations.where("role <> 'assistant' AND turn >= 1").select(F.when(F.col("conv_id").isNotNull(), ident(F.col("turn") - 1)).alias("call_id"), "turn", F.coalesce("text", F.lit("")).alias("content"))
    return calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All assistant turns of ``conversations`` as calls, linked; nulls and repeated rows as in ``link``."""
    return link(*turns_as_calls(table(spark, sf_dir, "conversations")))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id, coalesce(text, '') AS text,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS words,
         CASE (turn // 2) % 3 WHEN 1 THEN turn + 2 WHEN 2 THEN turn - 4 ELSE turn - 2 END AS on_turn,
         CASE WHEN on_turn >= 0 THEN conv_id::VARCHAR || ':' || on_turn::VARCHAR END AS dep
  FROM conversations WHERE role = 'assistant'),
r AS (SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id, turn AS result_turn, coalesce(text, '') AS content FROM conversations WHERE role <> 'assistant' AND turn >= 1),
j AS (SELECT c.*, r.result_turn, r.content, CASE WHEN d.turn > c.turn THEN d.turn ELSE c.turn END AS place, CASE WHEN c.dep IS NOT NULL AND d.call_id IS NULL THEN 'depends on unknown ' || c.dep END AS lost
      FROM c LEFT JOIN r USING (call_id) LEFT JOIN c d ON d.call_id = c.dep),
e AS (SELECT *, concat_ws('; ', CASE WHEN length(text) < 1 THEN 'text: below 1' END, CASE WHEN turn < 0 THEN 'turn: below 0' END, CASE WHEN words < 1 THEN 'words: below 1' END, lost) AS errors FROM j)
SELECT conv_id, turn, call_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, place > turn) - 1 AS position, result_turn, errors = '' AS valid, errors,
       '{"arguments":{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn || ',"words":' || words || '},"depends_on":[' || coalesce(to_json(dep)::VARCHAR, '') || '],"id":' || to_json(call_id)::VARCHAR
       || ',"name":"say","result":{' || CASE WHEN result_turn IS NULL THEN '' ELSE '"content":' || to_json(content)::VARCHAR || ',"turn":' || result_turn END || '}}' AS json
FROM e"""
