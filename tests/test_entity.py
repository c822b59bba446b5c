import pytest

from tests.support import engine_of, rows


def plainly(*events):
    return [(u, t, k, None, None) for u, t, k in events]


def test_session_gap_and_end(spark):
    s = plainly(("a", 0, "x"), ("a", 10, "x"), ("a", 21, "x"), ("a", 22, "bye"), ("a", 23, "x"), ("b", 5, "x"))
    e = engine_of(spark, s)
    assert rows(e.query("events | SESSIONIZE(gap: 10s) | SELECT seq, session_id, session_duration")) == [(0, 1, 10 * 10**9), (1, 1, 10 * 10**9), (2, 2, 2 * 10**9), (3, 2, 2 * 10**9), (4, 2, 2 * 10**9), (5, 1, 0)]
    assert rows(e.query("events | SESSIONIZE(gap: 10s, end: bye) | SELECT seq, session_id")) == [(0, 1), (1, 1), (2, 2), (3, 2), (4, 3), (5, 1)]


def test_pick_breaks_ties_by_sequence(spark):
    e = engine_of(spark, [("a", 1, "x", 1, None), ("a", 1, "x", 2, None), ("a", 1, "x", 3, None), ("b", 1, "y", 9, None)])
    assert rows(e.query("events | FIRST(x) | SELECT amount")) == [(1,)]
    assert rows(e.query("events | LAST(x) | SELECT amount")) == [(3,)]
    assert rows(e.query("events | NTH(x, 2) | SELECT amount")) == [(2,)]
    assert rows(e.query("events | NTH(x, 4) | SELECT amount")) == []
    assert rows(e.query("events | FIRST((x, y) WHERE amount > 2) | SELECT user, amount")) == [("a", 3), ("b", 9)]


def test_lookback(spark):
    e = engine_of(spark, plainly(("a", 0, "x"), ("a", 20 * 86400, "x")), now="2024-01-26T00:00:00Z")
    assert rows(e.query("events LAST 10d | FIRST(x) | SELECT seq")) == [(1,)]
    assert rows(e.query("events LAST 10d | FIRST(x, lookback: 20d) | SELECT seq")) == [(0,)]


def test_attribute(spark):
    s = [("a", 0, "ad", None, "web"), ("a", 50, "ad", None, None), ("a", 100, "buy", 7, None), ("a", 100, "ad", None, "late"), ("b", 5, "buy", 3, None)]
    e = engine_of(spark, s)
    q = "events | ATTRIBUTE(conversion: buy, touchpoints: ad, window: 100s, touchpoint_key: category) | SELECT entity_id, touchpoint_ts IS NULL AS none, touchpoint_key, buy.amount AS amount"
    assert rows(e.query(q)) == sorted([("a", False, "web", 7), ("a", False, None, 7), ("b", True, None, 3)], key=str)
    assert rows(e.query(q.replace("100s", "99s"))) == sorted([("a", False, None, 7), ("b", True, None, 3)], key=str)
    assert rows(e.query(q.replace("100s", "0s"))) == sorted([("a", True, None, 7), ("b", True, None, 3)], key=str)


def test_sample(spark):
    import xxhash

    e = engine_of(spark, plainly(*[(f"u{i}", t, "x") for i in range(200) for t in range(2)]))
    for seed in (0, 7, 42):
        got = {r.user for r in e.query(f"events | SAMPLE(fraction: 0.3, seed: {seed})").collect()}
        assert got == {f"u{i}" for i in range(200) if xxhash.xxh64_intdigest(f"u{i}", seed) < int(0.3 * 2.0**64)}
    numbers = engine_of(spark, plainly(*[(i - 50, 0, "x") for i in range(100)]))
    got = {r.user for r in numbers.query("events | SAMPLE(fraction: 0.5, seed: 42)").collect()}
    assert got == {i - 50 for i in range(100) if xxhash.xxh64_intdigest((i - 50).to_bytes(8, "little", signed=True), 42) < 1 << 63}
    assert e.query("events | SAMPLE(fraction: 0.0)").count() == 0 and e.query("events | SAMPLE(fraction: 1.0)").count() == 400
    a = rows(e.query("events | WHERE seq < 100 | SAMPLE(fraction: 0.3, seed: 42)"))
    assert a == rows(e.query("events | SAMPLE(fraction: 0.3, seed: 42) | WHERE seq < 100"))


def test_retention(spark):
    s = plainly(("a", 0, "s"), ("a", 3600, "p"), ("b", 0, "s"), ("b", 2 * 86400, "p"), ("c", 0, "s"), ("d", 0, "p"))
    e = engine_of(spark, s)
    assert rows(e.query("events | RETENTION(entry: s, activity: p, brackets: [1d, 7d])")) == [(0, pytest.approx(1 / 3)), (1, pytest.approx(1 / 3))]
    assert rows(e.query("events | RETENTION(entry: s, activity: p, brackets: [1d, 7d], cumulative: true)")) == [(0, pytest.approx(1 / 3)), (1, pytest.approx(2 / 3))]


def test_joined_sources(spark):
    e = engine_of(spark, plainly(("a", 0, "x"), ("a", 9, "x")))
    e.register("more", engine_of(spark, [("a", 5, "y", 3, "k"), ("b", 1, "y", 4, "k")]).catalog["events"].df, "user", "ts", "kind", "seq")
    assert rows(e.query("events JOIN more | STATS n = COUNT(*), m = COUNT(more.amount)")) == [(4, 2)]
    assert rows(e.query("events JOIN more | MATCH FIRST SEQUENCE(events.x THEN more.y) | SELECT entity_id, match_duration")) == [("a", 5 * 10**9)]


def test_maps_are_grouped_by_their_entries(spark):
    e = engine_of(spark, [("a", 0, "x", {"k": 1, "l": 2}), ("b", 0, "x", {"l": 2, "k": 1}), ("c", 0, "x", {"k": 1})], columns="m map<string, long>")
    assert sorted(r.n for r in e.query("events | STATS n = COUNT(*) GROUP BY m").collect()) == [1, 2]
