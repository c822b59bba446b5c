import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strandflow.llm.mixing import OP6_SQL, mixed, op6_source_mix
from tests.support import plain


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing again and again what goes beyond the caps."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        total = sum(w[s] for s in open_)
        now = {s: left * w[s] / total for s in open_}
        over = {s for s in open_ if now[s] > most * sizes[s]}
        if not over:
            return now | {s: float(most * sizes[s]) for s in capped}
        capped |= over


def test_targets_and_nearness(docs_of):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(0, 60), rng.choice(["a", "b", "B", "é", None, "z"] + ["hot"] * 6)) for i in range(1500)]
    found = mixed(docs_of(rows)).collect()
    assert len(found) == len(rows)
    sizes: dict = {}
    for r in found:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        assert r["size"] == len(r.text.split()) and r.taken == r.copies * r["size"] and r.copies <= 3
    for s, target in shares(sizes).items():
        own = [r for r in found if r.source == s]
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(target, abs=1e-5) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= max(r["size"] for r in own) / 2 + 1e-6
    again = mixed(docs_of(rows[::-1])).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in found}


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "", "a"), (2, None, "b")], [(None, "x y", "a"), (None, "x y", "a"), (3, "z", None)], [(7, "same words", "a")] * 9 + [(8, "w " * 50, "b")]])
def test_odd_tables(docs_of, rows):
    clash = docs_of(rows).withColumns({"Size": F.lit("x"), "mix_cut": F.lit(1), "MIX_HASH": F.lit(2), "Target": F.lit(3)})
    found = mixed(clash).collect()
    assert len(found) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in found)


def test_query_matches_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    found, ours = c.sql(OP6_SQL), op6_source_mix(spark, d)
    names = sorted(ours.columns)
    assert names == sorted(found.columns)
    at = [found.columns.index(x) for x in names]
    assert sorted(tuple(plain(r[x]) for x in names) for r in ours.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())
