import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandflow.llm import textbatch as tb
from strandflow.llm import toxicity as tx


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioustrnl"), 4)) for _ in range(300)]
    bad = ["dolt", "grump", "snark"]
    texts, labels = [], []
    for _ in range(n):
        w = list(rng.choice(words, int(rng.integers(5, 120))))
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(int(rng.integers(1, 3))):
                w[int(rng.integers(len(w)))] = str(rng.choice(bad)) + str(rng.choice(["", "s", "ing"]))
        texts.append(" ".join(w))
        labels.append(y)
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def net():
    return tx.train(*corpus(500, 1))


def scores(net, texts):
    return net.scores(*tb.utf8(pa.array(texts, pa.string())))


def test_held_out_accuracy(net):
    texts, labels = (x[500:] for x in corpus(700, 1))  # the first 500 are those of the training
    assert ((scores(net, texts) >= 0.5) == labels).mean() >= 0.95


def test_gradients_are_those_of_differences():
    net = tx.Network(3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    data, offsets = tb.utf8(pa.array(["one two three two", "four", ""], pa.string()))
    ids, counts, v = tx.tokens(data, offsets)
    begin, size, _ = tx.windows(counts)
    up = np.array([0.3, -1.0, 0.5])
    loss = lambda: float(net.forward(net.embedded(v).astype(np.float64), ids, begin, size) @ up)
    inputs = net.embedded(v)
    _, memory = net.forward(inputs, ids, begin, size, keep=True)
    found = net.gradients(v, inputs, memory, up)
    for name in ("Wf", "Ub", "cf", "att", "att_v", "out", "bias"):
        flat = net.p[name].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 5)):
            was = flat[i]
            flat[i] = was + 1e-4
            high = loss()
            flat[i] = was - 1e-4
            low = loss()
            flat[i] = was
            assert found[name].reshape(-1)[i] == pytest.approx((high - low) / 2e-4, abs=2e-4)
    for name in ("word", "char"):
        dense = np.zeros(net.p[name].shape)
        np.add.at(dense, found[name][0], found[name][1])
        assert np.abs(dense[:, 0]).max() > 0
        for row in np.unique(found[name][0]):
            for column in (0, 1, 7):
                was = net.p[name][row, column]
                net.p[name][row, column] = was + 1e-4
                high = loss()
                net.p[name][row, column] = was - 1e-4
                low = loss()
                net.p[name][row, column] = was
                assert dense[row, column] == pytest.approx((high - low) / 2e-4, abs=2e-4)


def test_training_takes_windows_in_parts_and_no_very_long_text(docs_of, monkeypatch):
    texts, labels = corpus(60, 2)
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000, "dolt " * 40_000)]
    spark_docs = docs_of(rows)
    marks = spark_docs.sparkSession.createDataFrame([(i, 1, int(y)) for i, y in enumerate(labels)] + [(1000, 1, 1)], "doc_id long, quality int, toxic int")
    seen = []
    monkeypatch.setattr(tx, "train", lambda found, y: seen.extend(found))
    tx.fitted(spark_docs, marks)
    assert seen and max(map(len, seen)) <= tx.TRAIN_BYTES
    net = tx.Network(1)
    data, offsets = tb.utf8(pa.array(["a b c " * 900], pa.string()))
    ids, counts, v = tx.tokens(data, offsets)
    begin, size, _ = tx.windows(counts)
    assert np.allclose(net.logits(net.embedded(v), ids, begin, size, 7), net.forward(net.embedded(v), ids, begin, size), atol=1e-5)


def test_training_gives_its_memory_back(spark, docs_of, monkeypatch):
    anonymous = lambda: sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) >> 10
    last = []

    def train(found, y):
        made = [bytes(50_000) for _ in range(4000)]  # 200 MB, below what stays
        last.append(made[-1])

    monkeypatch.setattr(tx, "train", train)
    before = anonymous()
    tx.fitted(docs_of([(1, "a"), (2, "b")]), spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int"))
    assert last and anonymous() - before < 100


def test_windows_cover_all_words():
    for n in (0, 1, 31, 32, 33, 56, 57, 500):
        begin, size, row = tx.windows(np.array([n, 3]))
        own = [(b, s) for b, s, r in zip(begin, size, row, strict=True) if r == 0]
        assert set().union(*(range(b, b + s) for b, s in own)) == set(range(n)) and all(0 <= s <= tx.WINDOW for _, s in own)


def test_a_text_scores_as_its_worst_window(net):
    texts, labels = corpus(700, 1)
    clean = " ".join(t for t, y in zip(texts[500:], labels[500:], strict=True) if not y)
    low, high = scores(net, [clean, f"{clean} dolt {clean}"])
    assert high > low and scores(net, ["", None]).tolist() == [scores(net, [""])[0]] * 2
    together = scores(net, [clean, "dolt", "", clean])
    assert together[0] == pytest.approx(together[3]) and together[1] == pytest.approx(scores(net, ["dolt"])[0], abs=1e-6)


def test_one_label_only():
    assert (scores(tx.train(["a b", "c"], np.array([0, 0])), ["x", ""]) < 0.5).all()
    assert (scores(tx.train(["a b", "c"], np.array([1, 1])), ["x", ""]) >= 0.5).all()
    assert (scores(tx.train([], np.array([])), ["x"]) < 0.5).all()


def test_query_and_odd_tables(spark, docs_of, monkeypatch):
    monkeypatch.setattr(tx, "STEPS", 20)
    texts, labels = corpus(120, 5)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "x"), (500, None), (501, ""), (3, texts[3]), (502, "w " * 30_000)]
    known = spark.createDataFrame([(i, 1, int(y)) for i, y in enumerate(labels)] + [(None, 1, 1), (500, 1, None), (501, 1, 1)], "doc_id long, quality int, toxic int")
    clash = docs_of(rows).withColumns({"SCORE": F.lit("x"), "predicted": F.lit(9)})
    found = tx.toxicity(clash, known).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert len({r.score for r in found if r.doc_id == 3}) == 1
    assert tx.toxicity(docs_of([]), known).count() == 0 and tx.toxicity(docs_of(rows), known.limit(0)).where("predicted = 1").count() == 0
    # labels of held-out rows have no part in the scores
    flip = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id for r in known.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert [r.score for r in tx.toxicity(docs_of(rows), flip).orderBy("doc_id", "text").collect()] == [r.score for r in tx.toxicity(docs_of(rows), known).orderBy("doc_id", "text").collect()]
