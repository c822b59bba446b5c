"""Sequence patterns, as windows over each entity's events.

A match is a chain of events, one a step, at strictly later times. The chains are found backwards:
at an event that can be step k, the best chain from there is the best among the chains of step k + 1
at later events. Ordered by descending time, "all later events" is a frame that grows, so each gap
is one running minimum; all gaps share one shuffle. A gap's WITHOUT events cut the entity's events
into segments that the gap can't cross.

When two events of an entity have equal times, neither follows the other. Ties between chains go to
the earlier last event, then the earlier events in step order, each by (time, sequence).

``x+`` is one x, since more never prevent a chain, but between two IMMEDIATELY, where it is a run of
events that are each x. An inner ``x*`` is the pattern with ``x+`` or the pattern without it, in
which what may not stand before or after it may not stand in the whole gap and the next step follows as
it did on ``x*``; both are matched and the better chain counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.errors import QueryError


@dataclass(frozen=True)
class PatternStep:
    """``flag``: whether an event can be this step. ``binds``: the column that gives each variable.
    ``without``: events that may not stand between this step and the next. ``immediately``: the next
    step is the next event. ``skippable``: zero occurrences will do (an inner ``x*``). ``repeated``: several will."""

    name: str
    flag: Column
    binds: dict[str, Column] = field(default_factory=dict)
    without: Column | None = None
    immediately: bool = False
    skippable: bool = False
    repeated: bool = False


@dataclass(frozen=True)
class _Variant:
    """A pattern without ``x*``: its steps, their numbers in the whole pattern from 1, and for each
    gap the numbers of the steps whose ``without`` holds in it."""

    steps: list[PatternStep]
    places: list[int]
    gaps: list[list[int]]

    def run(self, k: int) -> bool:
        """Whether step k (from 1) is a run of adjacent events."""
        return 1 < k < len(self.steps) and self.steps[k - 1].repeated and self.steps[k - 2].immediately and self.steps[k - 1].immediately


#: Inner ``x*`` whose presence matters, at most: each doubles the patterns to be matched.
MOST_OPTIONAL = 6


def _variants(steps: list[PatternStep]) -> list[_Variant]:
    inner = [i for i, s in enumerate(steps) if s.skippable and 0 < i < len(steps) - 1]
    matters = [i for i in inner if steps[i].binds or any(steps[j].without is not None or steps[j].immediately for j in (i - 1, i))]
    # next to an x* that matters, its neighbour does, too: their gaps are joined
    while more := [i for i in inner if i not in matters and (i - 1 in matters or i + 1 in matters)]:
        matters += more
    if len(matters) > MOST_OPTIONAL:
        raise QueryError(f"a pattern may have {MOST_OPTIONAL} steps with * beside WITHOUT, IMMEDIATELY or variables")
    out = []
    for chosen in product((False, True), repeat=len(matters)):
        gone = {i for i in inner if i not in matters} | {i for i, keep in zip(matters, chosen, strict=True) if not keep}
        kept, places, gaps = [], [], []
        for i, s in enumerate(steps):
            own = [i + 1] if s.without is not None else []
            if i in gone:
                kept[-1] = replace(kept[-1], immediately=s.immediately)
                gaps[-1] = gaps[-1] + own
            else:
                kept.append(s)
                places.append(i + 1)
                gaps.append(own)
        out.append(_Variant(kept, places, gaps))
    return out


def _sure(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def _tracked(df: DataFrame, steps: list[PatternStep], places: list[int], variables: list[str]) -> DataFrame:
    """Rows for each combination of variable values of their entity: column ``__v_<name>`` each.

    Where every step binds every variable by one column, an event's track is that column's value.
    Else a variable's values are those of the first step that binds it, and each event is repeated
    for its entity's tracks.
    """
    same = all(s.without is None and set(s.binds) == set(variables) for s in steps)
    if same and all(len({s.binds[v]._jc.toString() for s in steps}) == 1 for v in variables):
        out = df.withColumns({f"__v_{v}": steps[0].binds[v] for v in variables})
        return out.where(reduce(lambda a, b: a & b, [F.col(f"__v_{v}").isNotNull() for v in variables]))
    tracks = None
    for v in variables:
        first = next(i for i, s in enumerate(steps) if v in s.binds)
        values = df.where(F.col(f"__k{places[first]}") & steps[first].binds[v].isNotNull()).select("__entity", steps[first].binds[v].alias(f"__v_{v}")).distinct()
        tracks = values if tracks is None else tracks.join(values, "__entity")
    out = df.join(tracks, "__entity")
    checks = {}
    for i, s in zip(places, steps, strict=True):
        own = F.col(f"__k{i}")
        for v, c in s.binds.items():
            own = own & _sure(c == F.col(f"__v_{v}"))
        checks[f"__k{i}"] = own
    return out.withColumns(checks)


def match(
    df: DataFrame,
    steps: list[PatternStep],
    *,
    entity: str,
    time: str,
    seq: str,
    mode: str = "first",
    within: int | None = None,
    session: str | None = None,
    brackets: tuple[int, ...] = (),
    cumulative: bool = False,
    emit_all: bool = False,
    low: int | None = None,
    high: int | None = None,
    carry: dict[str, list[str]] | None = None,
    match_events: bool = False,
) -> DataFrame:
    """Matches of ``steps`` in each entity's events.

    Columns: ``entity_id``, one of each variable, ``step_reached`` with ``emit_all``, ``bracket`` and
    ``bracket_end`` with ``brackets``, ``match_duration`` (nanoseconds, null for partial matches),
    ``match_events`` (map of step name to time) if asked for, and ``step.column`` for each of
    ``carry``. ``low`` and ``high`` (microseconds, both inclusive) bound the first event only.

    ``mode`` ``first``: the completion of the earliest last event, then of the earliest first event,
    for each entity and variable values; with ``emit_all`` else the longest partial match, the
    earliest of those. ``all``: completions one after another, each beginning after the last one's
    end; with ``emit_all`` also the longest partial match of each first event that was not still
    open when a completion ended.
    """
    if within is not None and brackets or session and (brackets or within is not None):
        raise QueryError("WITHIN, WITHIN SESSION and BRACKETS exclude each other")
    carry = carry or {}
    n = len(steps)
    limit = max(brackets) if brackets else within
    variables = list(dict.fromkeys(v for s in steps for v in s.binds))
    wanted = list(dict.fromkeys(c for s in steps for c in carry.get(s.name, [])))
    keys = ["entity_id", *(f"v_{v}" for v in variables)]
    part = [*keys, *(["session"] if session else [])]

    # the events that matter, with what is needed of them
    flags = {f"__k{i}": _sure(s.flag) for i, s in enumerate(steps, 1)} | {f"__x{i}": _sure(s.without) for i, s in enumerate(steps, 1) if s.without is not None}
    events = df.where(reduce(lambda a, b: a | b, flags.values())).withColumns(flags | {"__entity": F.col(f"`{entity}`"), "__m": F.unix_micros(F.col(f"`{time}`")), "__q": F.col(f"`{seq}`")})
    kinds = {v: next(events.select(s.binds[v]).schema[0].dataType for s in steps if v in s.binds) for v in variables}

    def rows_of(variant: _Variant) -> DataFrame:
        rows, bound = events, list(dict.fromkeys(v for s in variant.steps for v in s.binds))
        if bound:
            rows = _tracked(rows, variant.steps, variant.places, bound)
        return rows.select(
            F.col("__entity").alias("entity_id"), *(F.col(f"__v_{v}").alias(f"v_{v}") if v in bound else F.lit(None).cast(kinds[v]).alias(f"v_{v}") for v in variables), *([F.col(f"`{session}`").alias("session")] if session else []),
            F.col("__m").alias("m"), F.col("__q").alias("q"), *(F.col(c).alias(c[2:]) for c in flags),
            F.struct(F.col("__m").alias("m"), F.col("__q").alias("q"), *(F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(wanted))).alias("own"),
        )

    variants = _variants(steps)
    found = [_anchors(rows_of(v), v, keys=keys, part=part, n=n, limit=limit, emit_all=emit_all, low=low, high=high) for v in variants]
    anchors = reduce(lambda a, b: a.unionByName(b), found)
    # completions before partial matches; among those the earliest end, then start; among these the furthest, then start
    rank = F.struct((F.col("c.t") < n).alias("partial"), F.coalesce(F.col("c.f"), F.lit(0)), -F.col("c.t"), F.col("c.m"), F.col("c.q"), F.col("c").alias("c"))
    if mode == "first":
        chosen = anchors.groupBy(*keys).agg(F.min(rank)["c"].alias("c"))
    else:
        if len(variants) > 1:  # one chain for each first event
            anchors = anchors.groupBy(*keys, F.col("c.m").alias("m"), F.col("c.q").alias("q")).agg(F.min(rank)["c"].alias("c")).select(*keys, "c")
        if emit_all and any(s.without is not None for s in steps):
            if any({v for s in x.steps for v in s.binds} != set(variables) for x in variants):
                raise QueryError("MATCH ALL with WITHOUT and EMIT ALL needs variables that are bound outside of steps with *")
            chosen = _surviving(anchors, rows_of(max(variants, key=lambda x: len(x.steps))), variants, keys, part, limit, low, high)
        else:
            chosen = _all(anchors, keys, n, limit, emit_all)

    done = F.col("c.t") == n
    out = [F.col("entity_id"), *(F.col(f"v_{v}").alias(v) for v in variables)]
    reached = F.col("c.t").cast("long")
    if brackets:
        delta = (F.col("c.f") - F.col("c.m")) * 1000
        spans = []
        for i, end in enumerate(brackets):
            inside = done & (delta <= end) & (F.lit(True) if i == 0 or cumulative else delta > brackets[i - 1])
            spans.append(F.struct(F.lit(i).cast("long").alias("bracket"), F.lit(end).cast("long").alias("bracket_end"), F.coalesce(inside, F.lit(False)).alias("hit")))
        chosen = chosen.withColumn("b", F.explode(F.array(*spans)))
        if not emit_all:
            chosen = chosen.where("b.hit")
        first = (F.col("b.bracket") == 0) | F.lit(cumulative)
        reached = F.when(F.col("b.hit"), F.lit(n)).when(first, 1).otherwise(0).cast("long")
    if emit_all:
        out.append(reached.alias("step_reached"))
    if brackets:
        out += [F.col("b.bracket").alias("bracket"), F.col("b.bracket_end").alias("bracket_end")]
    out.append(F.when(done, (F.col("c.f") - F.col("c.m")) * 1000).alias("match_duration"))
    if match_events:
        named = F.map_from_entries(F.array(*[F.struct(F.lit(s.name), F.timestamp_micros(F.col(f"c.s{i}.m"))) for i, s in enumerate(steps, 1)]))
        out.append(F.map_filter(named, lambda _, at: at.isNotNull()).alias("match_events"))
    for i, s in enumerate(steps, 1):
        out += [F.col(f"c.s{i}.c{wanted.index(c)}").alias(f"{s.name}.{c}") for c in carry.get(s.name, [])]
    return chosen.select(*out)


def _anchors(rows: DataFrame, variant: _Variant, *, keys: list[str], part: list[str], n: int, limit: int | None, emit_all: bool, low: int | None, high: int | None) -> DataFrame:
    """``keys`` and ``c`` for each first event: how far its best chain gets (``t``, a step of the whole
    pattern of ``n``), the time of its end if it is complete, its own time and sequence, its events."""
    steps, places, many = variant.steps, variant.places, len(variant.steps)
    segments = {}
    for i, gap in enumerate(variant.gaps[:-1], 1):
        if gap:
            upto = Window.partitionBy(*part).orderBy("m", "q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            segments[f"g{i}"] = F.count(F.when(reduce(lambda a, b: a | b, [F.col(f"x{j}") for j in gap]), 1)).over(upto)
    rows = rows.withColumns(segments)
    for i, p in enumerate(places, 1):
        if variant.run(i):
            before = Window.partitionBy(*part).orderBy("m", "q")
            goes_on = F.col(f"k{p}") & F.coalesce(F.lag(f"k{p}").over(before) & (F.lag("m").over(before) < F.col("m")), F.lit(False))
            rows = rows.withColumn(f"u{i}", F.when(goes_on, 0).otherwise(1))
            rows = rows.withColumn(f"u{i}", F.sum(f"u{i}").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    # chains: r<k>_<t> is the best chain from step k to step t; only complete ones unless partial are asked for
    ends = range(1, many + 1) if emit_all else [many]
    chain = lambda t: F.struct(F.col("m").alias("f"), F.col("own").alias(f"s{t}"))
    flag = lambda k: F.col(f"k{places[k - 1]}")
    rows = rows.withColumns({f"r{many}_{many}": F.when(flag(many), chain(many))})
    for k in range(many - 1, 0, -1):
        group = [*part, *([f"g{k}"] if f"g{k}" in segments else [])]
        later = Window.partitionBy(*group).orderBy((-F.col("m")).asc()).rangeBetween(Window.unboundedPreceding, -1)
        following = Window.partitionBy(*part).orderBy(F.col("m").desc(), F.col("q").desc())
        found = {}
        for t in ends:
            if t > k:
                column = f"r{k + 1}_{t}"
                if steps[k - 1].immediately:
                    best = F.when(F.lag("m").over(following) > F.col("m"), F.lag(column).over(following))
                    if f"g{k}" in segments:
                        best = F.when(F.lag(f"g{k}").over(following) == F.col(f"g{k}"), best)
                else:
                    best = F.min(column).over(later)
                found[f"b{t}"] = best
        rows = rows.withColumns(found)
        if variant.run(k):
            onwards = Window.partitionBy(*part, f"u{k}").orderBy(F.col("m").desc(), F.col("q").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
            rows = rows.withColumns({b: F.min(b).over(onwards) for b in found})
        made = {}
        for t in ends:
            if t > k:
                best = F.col(f"b{t}")
                made[f"r{k}_{t}"] = F.when(flag(k) & best.isNotNull(), F.struct(best["f"].alias("f"), F.col("own").alias(f"s{k}"), *(best[f"s{j}"].alias(f"s{j}") for j in range(k + 1, t + 1))))
            elif t == k:
                made[f"r{k}_{t}"] = F.when(flag(k), chain(k))
        rows = rows.withColumns(made).drop(*(f"r{k + 1}_{t}" for t in ends), *found)

    # first events, how far each gets, and whether it completes
    anchors = rows.where("k1")
    if low is not None:
        anchors = anchors.where(F.col("m") >= low)
    if high is not None:
        anchors = anchors.where(F.col("m") <= high)
    in_time = lambda t: F.col(f"r1_{t}").isNotNull() & ((F.col(f"r1_{t}")["f"] - F.col("m")) * 1000 <= limit if limit is not None else F.lit(True))
    empty = F.lit(None).cast(anchors.select(f"r1_{many}.s{many}").schema[0].dataType)
    step = lambda t, p: F.col(f"r1_{t}")[f"s{places.index(p) + 1}"] if p in places[:t] else empty

    def of(t: int) -> Column:
        return F.struct(F.lit(places[t - 1]).alias("t"), F.when(F.lit(t == many), F.col(f"r1_{t}")["f"]).alias("f"), F.col("m").alias("m"), F.col("q").alias("q"), *(step(t, p).alias(f"s{p}") for p in range(1, n + 1)))

    result = F.when(in_time(many), of(many))
    if emit_all:
        for t in range(many - 1, 0, -1):
            result = result.when(in_time(t) if t > 1 else F.lit(True), of(t))
    return anchors.select(*keys, result.alias("c")).where("c IS NOT NULL")


def _surviving(anchors: DataFrame, rows: DataFrame, variants: list[_Variant], keys: list[str], part: list[str], limit: int | None, low: int | None, high: int | None) -> DataFrame:
    """The first events that complete one after another, and those that were not open any more when a
    completion ended, by walking each entity's events. A task holds the flags of one entity at a time."""
    flags = [c for c in rows.columns if c[0] in "kx" and c[1:].isdigit()]
    narrow = rows.select(F.xxhash64(*keys).alias("__of"), *(F.col(c).alias(f"__p{i}") for i, c in enumerate(part[len(keys):])), *keys, "m", "q", *flags)
    sessions = [f"__p{i}" for i in range(len(part) - len(keys))]
    dealt = narrow.repartition("__of").sortWithinPartitions("__of", *keys, "m", "q")
    plans = [([p for p in v.places], v.gaps, [s.immediately for s in v.steps], [v.run(k) for k in range(1, len(v.steps) + 1)]) for v in variants]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def walked() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = {c: whole[c].to_pylist() for c in ("m", *flags, *sessions)}
            kept = _walk(columns, flags, [columns[c] for c in sessions], plans, limit, low, high)
            yield from whole.select([*keys, "m", "q"]).take(pa.array(kept, pa.int64())).to_batches()
            held.clear()

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *((of[1:] != of[:-1]).nonzero()[0] + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b:
                    if held and held[-1].column(0)[-1].as_py() != int(of[a]):
                        yield from walked()
                    held.append(batch.slice(a, b - a))
        if held:
            yield from walked()

    alive = dealt.mapInArrow(run, dealt.select(*keys, "m", "q").schema).distinct()
    alive = alive.select(*(F.col(c).alias(f"__{c}") for c in alive.columns))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], (F.col("c.m") == F.col("__m")) & (F.col("c.q") == F.col("__q")))
    return anchors.join(alive, same, "left_semi")


def _walk(columns: dict, flags: list[str], sessions: list, plans: list, limit: int | None, low: int | None, high: int | None) -> list[int]:
    """Rows of the first events that give a result, among one entity's rows in order."""
    times, out, ended = columns["m"], [], None
    at = {c: columns[c] for c in flags}
    live: dict[int, dict[tuple, int]] = {}  # first event: (variant, step, place of the last event where it counts) to the time of that
    for i, now in enumerate(times):
        over = [a for a in live if limit is not None and (now - times[a]) * 1000 > limit or any(s[a] != s[i] for s in sessions)]
        for a in over:
            out.append(a)
            del live[a]
        done = []
        for a in list(live):
            nextly: dict[tuple, int] = {}
            for (v, k, spot), last in live[a].items():
                places, gaps, immediately, runs = plans[v]
                if any(at[f"x{j}"][i] for j in gaps[k - 1]):
                    continue
                adjacent = spot in (-1, i - 1)
                if at[f"k{places[k]}"][i] and now > last and adjacent:
                    if k + 1 == len(places):
                        done.append(a)
                    else:
                        nextly.setdefault((v, k + 1, i if immediately[k] else -1), now)
                if spot == -1:
                    nextly[v, k, spot] = min(last, nextly.get((v, k, spot), last))
                elif runs[k - 1] and at[f"k{places[k - 1]}"][i] and now > last and spot == i - 1:
                    nextly.setdefault((v, k, i), now)
            if nextly or a in done:
                live[a] = nextly
            else:
                out.append(a)
                del live[a]
        first = at["k1"][i] and (low is None or now >= low) and (high is None or now <= high) and (ended is None or now > ended)
        if first:
            live[i] = {(v, 1, i if immediately[0] else -1): now for v, (places, _, immediately, _) in enumerate(plans) if len(places) > 1}
            if any(len(p[0]) == 1 for p in plans):
                done.append(i)
        if done:
            out.append(min(done))
            ended = now
            live.clear()
    return sorted(out + list(live))


def _all(anchors: DataFrame, keys: list[str], n: int, limit: int | None, emit_all: bool) -> DataFrame:
    """Completions that don't overlap, and the partial matches that stay. One row of ``keys`` holds
    its first events in an array while they are walked."""
    ordered = F.array_sort(F.collect_list(F.when(F.col("c.t") == n, F.struct(F.col("c.f").alias("f"), F.col("c.m").alias("m"), F.col("c").alias("c")))))
    parts = F.collect_list(F.when(F.col("c.t") < n, F.col("c")))
    lists = anchors.groupBy(*keys).agg(ordered.alias("done"), parts.alias("parts"))
    walked = F.aggregate(
        "done",
        F.struct(F.lit(None).cast("long").alias("last"), F.filter("done", lambda _: F.lit(False)).alias("kept")),
        lambda state, x: F.when(state["last"].isNull() | (x["m"] > state["last"]), F.struct(x["f"].alias("last"), F.concat(state["kept"], F.array(x)).alias("kept"))).otherwise(state),
        lambda state: state["kept"],
    )
    lists = lists.withColumn("kept", walked)
    found = F.transform("kept", lambda x: x["c"])
    if emit_all:
        ended = lambda p: F.exists("kept", lambda x: (x["f"] >= p["m"]) & ((x["f"] - p["m"]) * 1000 <= limit if limit is not None else F.lit(True)))
        found = F.concat(found, F.filter("parts", lambda p: ~ended(p)))
    return lists.select(*keys, F.explode(found).alias("c"))
