"""Patterns: hand-made cases, and random streams against an enumeration of all chains."""

from __future__ import annotations

import random

import pytest

from tests.support import engine_of, rows

DAY = 86_400


def found(spark, stream, stage, columns="amount long, category string"):
    return rows(engine_of(spark, stream, columns).query(f"events | {stage}"))


def plainly(*events):
    return [(u, t, k, None, None) for u, t, k in events]


def test_window_includes_its_end(spark):
    s = plainly(("a", 0, "x"), ("a", 100, "y"), ("b", 0, "x"), ("b", 101, "y"))
    assert found(spark, s, "MATCH FIRST SEQUENCE(x THEN y) WITHIN 100s | SELECT entity_id, match_duration") == [("a", 100_000_000_000)]


def test_equal_times_do_not_follow(spark):
    assert found(spark, plainly(("a", 5, "x"), ("a", 5, "y")), "MATCH FIRST SEQUENCE(x THEN y)") == []


def test_without(spark):
    s = plainly(("a", 0, "signup"), ("a", 1, "refund"), ("a", 2, "purchase"), ("b", 0, "refund"), ("b", 1, "signup"), ("b", 2, "purchase"), ("b", 3, "refund"))
    assert [r[0] for r in found(spark, s, "MATCH FIRST SEQUENCE(signup WITHOUT refund THEN purchase)")] == ["b"]


def test_immediately_starts_again(spark):
    s = plainly(("a", 100, "signup"), ("a", 200, "signup"), ("a", 250, "other"), ("a", 300, "purchase"))
    assert found(spark, s, "MATCH FIRST SEQUENCE(signup THEN IMMEDIATELY purchase)") == [("a", 100_000_000_000)]


def test_range_bounds_the_first_event_only(spark):
    s = plainly(("early", 0, "signup"), ("early", 3 * DAY, "purchase"), ("in", 2 * DAY, "signup"), ("in", 3 * DAY + 10, "purchase"), ("late", 4 * DAY, "signup"), ("late", 4 * DAY + 5, "purchase"))
    q = engine_of(spark, s).query("events BETWEEN '2024-01-02T00:00:00Z' AND '2024-01-03T12:00:00Z' | MATCH FIRST SEQUENCE(signup THEN purchase) WITHIN 2d")
    assert [r[0] for r in rows(q)] == ["in"]


def test_all_does_not_overlap(spark):
    s = plainly(*[("a", t, k) for t, k in [(0, "x"), (1, "x"), (5, "y"), (6, "x"), (9, "y")]])
    assert found(spark, s, "MATCH ALL SEQUENCE(x THEN y)") == [("a", 3_000_000_000), ("a", 5_000_000_000)]


def test_null_binds_nothing(spark):
    s = [("a", 0, "signup", None, None), ("a", 1, "purchase", None, None), ("b", 0, "signup", None, "p"), ("b", 1, "purchase", None, "q"), ("b", 2, "purchase", None, "p")]
    assert found(spark, s, "MATCH FIRST SEQUENCE(signup WHERE category = $c THEN purchase WHERE category = $c)") == [("b", "p", 2_000_000_000)]


def test_variables_with_exclusions_and_other_columns(spark):
    s = [("a", 0, "x", 1, "p"), ("a", 1, "churn", None, None), ("a", 2, "y", 1, "p"), ("b", 0, "x", 1, "p"), ("b", 2, "y", 1, "p"), ("b", 3, "y", 1, "q")]
    assert found(spark, s, "MATCH FIRST SEQUENCE(x WHERE category = $c WITHOUT churn THEN y WHERE category = $c)") == [("b", "p", 2_000_000_000)]


def test_funnel_generator(spark):
    s = []
    for i in range(20):
        if i < 15:
            s.append((f"u{i}", 0, "signup"))
        if i < 10:
            s.append((f"u{i}", 3600, "activation"))
        if i < 5:
            s.append((f"u{i}", 7200, "purchase"))
        if i >= 15:
            s.append((f"u{i}", 0, "browse"))
    assert found(spark, plainly(*s), "FUNNEL(signup THEN activation THEN purchase) WITHIN 7d") == [(15, 10, 5)]


def test_no_matches_give_no_rows(spark):
    assert found(spark, plainly(("a", 0, "x")), "MATCH FIRST SEQUENCE(x THEN y)") == []
    assert found(spark, [], "MATCH FIRST SEQUENCE(x THEN y) EMIT ALL") == []


def test_columns_with_inner_names(spark):
    s = [("a", 0, "x", 1, 2, "p", 3, 4), ("a", 1, "y", 5, 6, "p", 7, 8), ("a", 2, "y", 5, 6, "q", 7, 8)]
    columns = "m long, q long, own string, k1 long, entity_id long"
    got = found(spark, s, "MATCH FIRST SEQUENCE(s: x WHERE own = $v THEN t: y WHERE own = $v) | SELECT entity_id, v, s.m AS a, t.q AS b, t.k1 AS c, s.entity_id AS d", columns)
    assert got == [("a", "p", 1, 6, 7, 4)]
    assert found(spark, s, "SAMPLE(fraction: 0.99, seed: 3) | NTH(y, 2) | SELECT m, own", columns) == [(5, "q")]


# -- random streams -----------------------------------------------------------------------------


def chains(events, steps, within, without, start):
    """All chains from one first event, as lists of positions; a prefix that can't go on is listed too."""
    out = []

    def grow(path):
        out.append(path)
        k = len(path)
        if k == len(steps):
            return
        for j in range(path[-1] + 1, len(events)):
            t, kind = events[j]
            if kind in without.get(k, ()):
                return
            if kind == steps[k] and t > events[path[-1]][0] and (within is None or t - events[start][0] <= within):
                grow([*path, j])

    grow([start])
    return out


def brute(events, steps, mode, within, without, emit_all):
    """(steps reached, duration or None) of each match of one entity."""
    best = {}
    for i, (t, kind) in enumerate(events):
        if kind == steps[0]:
            found = chains(events, steps, within, without, i)
            ends = [events[c[-1]][0] for c in found if len(c) == len(steps)]
            best[i] = (max(len(c) for c in found), min(ends, default=None), t)
    full = len(steps)
    if mode == "first":
        done = [(end, t) for k, end, t in best.values() if k == full]
        if done:
            end, t = min(done)
            return [(full, end - t)]
        return [(max(k for k, _, _ in best.values()), None)] if emit_all and best else []
    last, kept = None, []
    for end, t in sorted((end, t) for k, end, t in best.values() if k == full):
        if last is None or t > last:
            kept.append((t, end))
            last = end
    out = [(full, end - t) for t, end in kept]
    if emit_all:
        for i, (k, _, t) in best.items():
            if k < full and not any(end >= t and (within is None or end - t <= within) and open_at(events, steps, within, without, i, end) for _, end in kept):
                out.append((k, None))
    return out


def open_at(events, steps, within, without, start, end):
    """Whether a first event has a chain that may go on after the completion at time ``end``."""
    done = min(j for j in range(len(events)) if events[j][0] == end and any(c[-1] == j and len(c) == len(steps) for i in range(j + 1) if events[i][1] == steps[0] for c in chains(events, steps, within, without, i)))
    if start > done:
        return True  # it isn't begun, being no later
    return any(c[-1] <= done and len(c) < len(steps) and not any(events[j][1] in without.get(len(c), ()) for j in range(c[-1] + 1, done + 1)) for c in chains(events, steps, within, without, start))


@pytest.mark.parametrize("mode", ["first", "all"])
@pytest.mark.parametrize("within", [None, 12])
@pytest.mark.parametrize("without", [{}, {1: ("d",)}, {2: ("d",)}, {1: ("d",), 2: ("e", "a")}])
def test_against_all_chains(spark, mode, within, without):
    rng = random.Random(f"{mode} {within} {without}")
    streams = {u: sorted((rng.randrange(30), rng.choice("abcde")) for _ in range(rng.randrange(0, 14))) for u in range(150)}
    streams = {u: sorted(s, key=lambda e: e[0]) for u, s in streams.items()}
    e = engine_of(spark, [(u, t, k) for u, s in streams.items() for t, k in s], columns="")
    gap = lambda k: f" WITHOUT ({' OR '.join(without[k])})" if len(without.get(k, ())) > 1 else f" WITHOUT {without[k][0]}" if k in without else ""
    pattern = f"a{gap(1)} THEN b{gap(2)} THEN c"
    limit = f" WITHIN {within}s" if within else ""
    for emit in (False, True):
        out = {}
        for r in e.query(f"events | MATCH {mode.upper()} SEQUENCE({pattern}){limit}{' EMIT ALL' * emit}").collect():
            out.setdefault(r.entity_id, []).append((r.step_reached if emit else 3, None if r.match_duration is None else r.match_duration // 10**9))
        for u, s in streams.items():
            wanted = brute(s, "abc", mode, within, without, emit)
            assert sorted(out.get(u, []), key=str) == sorted(wanted, key=str), (u, s, emit)


@pytest.mark.parametrize("emit", [False, True])
@pytest.mark.parametrize("gap", ["", " WITHOUT d"])
def test_variables_against_all_chains(spark, emit, gap):
    """Each value of the variable is a stream of its own; events of steps that don't use it are in all."""
    rng = random.Random(f"{emit} {gap}")
    streams = {u: sorted(((rng.randrange(25), rng.choice("abcd"), rng.choice(["p", "q", None])) for _ in range(rng.randrange(0, 12))), key=lambda e: e[0]) for u in range(120)}
    e = engine_of(spark, [(u, t, k, None, c) for u, s in streams.items() for t, k, c in s])
    q = f"events | MATCH FIRST SEQUENCE(a WHERE category = $v THEN b{gap} THEN c WHERE category = $v) WITHIN 15s{' EMIT ALL' * emit}"
    out = {(r.entity_id, r.v): (r.step_reached if emit else 3, None if r.match_duration is None else r.match_duration // 10**9) for r in e.query(q).collect()}
    wanted = {}
    for u, s in streams.items():
        for v in {c for _, k, c in s if k == "a" and c}:
            own = [(t, k) for t, k, c in s if k in "bd" or c == v]
            for found in brute(own, "abc", "first", 15, {2: ("d",)} if gap else {}, emit):
                wanted[u, v] = found
    assert out == wanted


@pytest.mark.parametrize("cumulative", [False, True])
def test_brackets_against_all_chains(spark, cumulative):
    rng = random.Random(cumulative)
    streams = {u: sorted(((rng.randrange(40), rng.choice("abc")) for _ in range(rng.randrange(0, 8))), key=lambda e: e[0]) for u in range(120)}
    e = engine_of(spark, [(u, t, k) for u, s in streams.items() for t, k in s], columns="")
    q = f"events | MATCH FIRST SEQUENCE(a THEN b) BRACKETS {'CUMULATIVE ' * cumulative}[5s, 12s, 20s] EMIT ALL | SELECT entity_id, bracket, step_reached"
    wanted = []
    for u, s in streams.items():
        for _, d in brute(s, "ab", "first", 20, {}, True):
            hits = [d is not None and low < d <= high for low, high in ((-1, 5), (5, 12), (12, 20))]
            steps = [2 if h else 1 if i == 0 else 0 for i, h in enumerate(hits)]
            wanted += [(u, i, max(steps[: i + 1]) if cumulative else steps[i]) for i in range(3)]
    assert rows(e.query(q)) == sorted(wanted, key=str)


def ends(events, steps, start):
    """The ends of all chains of steps (kind, repeat, immediately, without) from one first event, and how far chains get."""
    seen = [(t, k) for t, k in events if any(k == kind or k in without for kind, _, _, without in steps)]
    found, far = set(), set()

    def go(j, k, entered_at_once):
        far.add(k)
        if k == len(steps) - 1:
            found.add(seen[j][0])
            return
        kind, repeat, at_once, _ = steps[k]
        if repeat and k:
            for i in range(j + 1, len(seen)):
                near = not (entered_at_once and at_once) or i == j + 1
                if seen[i][1] == kind and seen[i][0] > seen[j][0] and near:
                    go(i, k, entered_at_once)
        for to in range(k + 1, len(steps)):
            shut = {x for s in steps[k:to] for x in s[3]}
            for i in range(j + 1, len(seen)):
                if seen[i][1] in shut:
                    break
                if seen[i][1] == steps[to][0] and seen[i][0] > seen[j][0] and (i == j + 1 or not steps[to - 1][2]):
                    go(i, to, steps[to - 1][2])
            if steps[to][1] != "*" or to == len(steps) - 1:
                break

    go(start, 0, False)
    return found, max(far)


REPEATS = [
    [("a", "", True, ""), ("x", "+", True, ""), ("b", "", False, "")],
    [("a", "", False, ""), ("x", "+", True, ""), ("b", "", False, "")],
    [("a", "", True, ""), ("x", "*", True, ""), ("b", "", False, "")],
    [("a", "", True, ""), ("x", "*", False, "c"), ("b", "", False, "")],
    [("a", "", False, "c"), ("x", "*", False, ""), ("b", "", False, "")],
    [("a", "", False, "c"), ("x", "*", False, "d"), ("b", "", True, ""), ("a", "", False, "")],
    [("a", "", True, ""), ("x", "*", False, "c"), ("y", "*", True, ""), ("b", "", False, "")],
    [("a", "", False, ""), ("x", "+", False, "c"), ("y", "*", False, "a"), ("b", "", False, "")],
    [("x", "+", True, ""), ("x", "+", True, ""), ("b", "+", False, "")],
]


@pytest.mark.parametrize("steps", REPEATS)
def test_repeats_against_all_chains(spark, steps):
    rng = random.Random(str(steps))
    streams = {u: sorted(((rng.randrange(25), rng.choice("aaxxxybcd")) for _ in range(rng.randrange(0, 9))), key=lambda e: e[0]) for u in range(150)}
    streams |= {1000: [(1, "a"), (2, "x"), (3, "x"), (4, "b")], 1001: [(1, "a"), (2, "x"), (3, "b")], 1002: [(1, "a"), (2, "x"), (3, "c"), (4, "b")], 1003: [(1, "a"), (2, "b")]}
    e = engine_of(spark, [(u, t, k) for u, s in streams.items() for t, k in s], columns="")
    text = ""
    for i, (kind, repeat, _, _) in enumerate(steps):
        before = steps[i - 1]
        text += (f"{f' WITHOUT {before[3]}' * bool(before[3])} THEN {'IMMEDIATELY ' * before[2]}" if i else "") + f"s{i}: {kind}{repeat}"
    out = {r.entity_id: (r.step_reached, r.match_duration and r.match_duration // 10**9) for r in e.query(f"events | MATCH FIRST SEQUENCE({text}) EMIT ALL").collect()}
    wanted = {}
    for u, s in streams.items():
        seen = [(t, k) for t, k in s if any(k == kind or k in without for kind, _, _, without in steps)]
        got = [(t, *ends(s, steps, i)) for i, (t, k) in enumerate(seen) if k == steps[0][0]]
        done = [(min(found), t) for t, found, _ in got if found]
        if done:
            end, t = min(done)
            wanted[u] = (len(steps), end - t)
        elif got:
            wanted[u] = (max(far for _, _, far in got) + 1, None)
    assert out == wanted


def test_a_variable_of_a_step_that_may_be_missing(spark):
    s = [("a", 0, "a", None, None), ("a", 1, "x", None, "p"), ("a", 2, "b", None, None), ("b", 0, "a", None, None), ("b", 3, "b", None, None)]
    got = found(spark, s, "MATCH FIRST SEQUENCE(a THEN (x WHERE category = $v)* THEN b)")
    assert sorted(got, key=str) == [("a", "p", 2_000_000_000), ("a", None, 2_000_000_000), ("b", None, 3_000_000_000)]


def test_partial_matches_that_were_shut_off_before_a_completion(spark):
    s = plainly(("u", 0, "a"), ("u", 1, "e"), ("u", 2, "a"), ("u", 3, "b"))
    for within in ("", " WITHIN 1h"):
        got = found(spark, s, f"MATCH ALL SEQUENCE(a WITHOUT e THEN b){within} EMIT ALL")
        assert sorted(got, key=str) == [("u", 1, None), ("u", 2, 1_000_000_000)]
