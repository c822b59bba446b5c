import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import common, neardup
from strandflow.llm import textbatch as tb
from strandflow.llm.components import components
from strandflow.llm.neardup import near_duplicates

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    ids = [i for i, _ in rows]
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                if ids[a] < ids[b]:
                    up[b] = a
                else:
                    up[a] = b
    return {i: (len(s), ids[find(n)]) for n, (i, s) in enumerate(zip(ids, sets, strict=True))}


def families(rng, bases, copies, edits, length=60):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(bases):
        base = list(rng.choice(words, length))
        for _ in range(int(rng.integers(1, copies))):
            own = list(base)
            for at in rng.integers(0, length, int(rng.integers(0, edits))):
                own[at] = str(rng.choice(words))
            rows.append(" ".join(own))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [1, 2, 5])
def test_sets(k):
    texts = ["", " \t", "One", "one two", "a b a b a b", "x\x0by\x0cz é É", "É  é", "Á á", "long " * 3000, None]
    data, offsets = tb.utf8(pa.array(texts, pa.string()))
    sets, sizes = neardup.shingle_sets(data, offsets, k)
    assert sizes.tolist() == [len(shingles(t, k)) for t in texts]
    at = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in zip(at[:-1], at[1:], strict=True):
        assert (np.diff(sets[a:b].astype(object)) > 0).all()


def test_estimates():
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.8, 0.95):
        errors = []
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
            n = int(1000 * share)
            a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:n], pool[1000 : 2000 - n]]))
            marks = neardup.folded(neardup.registers(np.concatenate([a, b]), np.array([1000, 1000])))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(neardup.likeness((marks[0] == marks[1]).sum()[None], np.array([1000.0]), np.array([1000.0]))[0] - true)
        assert abs(np.mean(errors)) < 0.025 and np.max(np.abs(errors)) < 0.12


@pytest.mark.parametrize(("k", "seed"), [(2, 1), (5, 2), (1, 3)])
def test_components_are_those_of_all_pairs(docs_of, k, seed):
    rows = families(np.random.default_rng(seed), 25, 12, 9)
    rows += [(5000 + i, t) for i, t in enumerate(["", None, " ", "solo", "SOLO", "a b", "a b", "b a"])]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows), k=k).collect()}
    assert found == brute(rows, k)


def test_a_large_family_of_borderline_copies(docs_of, monkeypatch):
    """Small blocks, so that the family spans several; many pairs lie just below the threshold."""
    monkeypatch.setattr(neardup, "SETS", 16)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rows = families(np.random.default_rng(8), 1, 2, 1) + [(i + 10, t) for i, t in families(np.random.default_rng(9), 2, 150, 8)]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs_of(rows), k=2).collect()}
    assert found == brute(rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c"), (None, None)]])
def test_odd_tables(docs_of, rows):
    clash = docs_of(rows).withColumns({"REP": F.lit(1), "class": F.lit(2), "n_shingles": F.lit(3), "kept": F.lit("x")})
    found = near_duplicates(clash, k=2).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.kept if r.doc_id is None else r.component_id == (1 if rows[0][1] else r.doc_id)


def test_a_family_that_shares_a_frame_only(docs_of, monkeypatch):
    """5,000 pages at a likeness of 0.7, none linked but the planted ones: none of the rest gets to a block."""
    rng = np.random.default_rng(4)
    frame = " ".join(f"f{i}" for i in range(165))
    text = lambda seed, n=35: frame + " " + " ".join(f"x{seed}_{i}" for i in range(n))
    rows = [(i + 10, text(i)) for i in range(5000)]
    rows += [(9001, text(17) + " y"), (9002, text(17) + " y z"), (9003, frame.upper() + " " + text(4999).split(" ", 165)[165] + " w")]
    rng.shuffle(rows)
    rows = [(int(i), t) for i, t in rows]
    sent = []
    dealt = neardup._dealt

    def spy(left, group, carried, block, percent):
        out = dealt(left, group, carried, block, percent)
        if group == ["family"]:
            sent.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_dealt", spy)
    found = {r.doc_id: r.component_id for r in near_duplicates(docs_of(rows), k=2).collect()}
    assert found == {i: 27 if i in (9001, 9002) else 5009 if i == 9003 else i for i, _ in rows}
    assert sum(sent) <= 40


def test_blocks_are_not_dealt_by_their_group(docs_of, monkeypatch):
    """Below each step over blocks stands an exchange on the block, not only one on its family or key."""
    plans = []
    write = neardup.written

    def spy(df, label):
        if label in ("late", "star_links", "more_links"):
            plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(neardup, "written", spy)
    near_duplicates(docs_of(families(np.random.default_rng(2), 4, 30, 9)), k=2).collect()
    assert {x for x, _ in plans} >= {"late", "star_links", "more_links"}
    for _, plan in plans:
        below = plan[plan.index("FlatMapGroupsInPandas") :].split("\n")[1:4]
        assert any("Exchange hashpartitioning(spot" in line for line in below), below


def test_sizes_of_links_are_of_neighbouring_classes(spark):
    rows = [(n, m) for m in range(1, 400) for n in range(1, m + 1) if 100 * n >= 80 * m]
    df = spark.createDataFrame(rows, "n long, m long")
    a, b = ([r[0] for r in df.select(F.col(c).alias("n_shingles")).select(neardup._size_class(80)).collect()] for c in "nm")
    assert all(0 <= y - x <= 1 for x, y in zip(a, b, strict=True))


def test_components_of_a_chain_with_its_least_node_at_the_end(spark):
    from strandflow.llm.components import _labelled

    chain = [*range(1, 2000), 0]
    labels, rounds = _labelled(spark.createDataFrame(list(zip(chain[:-1], chain[1:], strict=True)), "a long, b long"))
    assert {r.label for r in labels.collect()} == {0} and labels.count() == 2000 and rounds <= 15


def test_components_of_random_links(spark):
    rng = np.random.default_rng(5)
    links = [tuple(map(int, x)) for x in rng.integers(0, 300, (180, 2))]
    up = list(range(300))
    for a, b in links * 300:
        up[a] = up[b] = min(up[a], up[b])
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: up[x] for a, b in links if a != b for x in (a, b)}


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, 900), (900, 950), (7000, 7000), (None, 3)]
    found = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {1000: 900, 900: 900, 950: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_leave_no_broadcasts_in_the_driver(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAP_PARTS", 1 << 30, raising=False)  # the tests' heap is large
    spark.sparkContext._jvm.System.gc()
    memory = spark.sparkContext._jsc.sc().env().memoryManager()
    time.sleep(2)
    before = memory.storageMemoryUsed()
    labels = components(spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    end = time.time() + 20
    while (left := memory.storageMemoryUsed() - before) > 3 << 20 and time.time() < end:
        time.sleep(0.5)
    assert left <= 3 << 20 and labels.where("label <> 0").isEmpty()


def test_query_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    assert sorted(tuple(r) for r in neardup.op9_near_duplicates(spark, d).collect()) == sorted(c.sql(neardup.OP9_SQL).fetchall())
