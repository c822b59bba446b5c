import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import lzprint as lz


def phrases(text):
    found, start = set(), 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in found:
            found.add(text[start:end])
            start = end
    return found


def parsed(text):
    p = lz.Parse()
    p.feed(text)
    return [text[a:b] for a, b in zip([0, *p.ends], p.ends, strict=False)]


@pytest.mark.parametrize("text", ["", "a", "aaaaaaaaaa", "abababababab", "the cat sat on the mat " * 20, "é漢🙂" * 30])
def test_phrases(text):
    found = parsed(text)
    assert len(found) == len(set(found)) and set(found) == phrases(text)


def test_likeness_estimates_that_of_the_phrase_sets():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    base = " ".join(rng.choice(words, 1500))
    for share in (0.0, 0.3, 0.8):
        other = base[: int(len(base) * share)] + " ".join(rng.choice(words, int(1500 * (1 - share))))
        a, b = phrases(base), phrases(other)
        u = [np.frombuffer(bytes.fromhex(lz.fingerprint(t)), ">u2") for t in (base, other)]
        assert abs(lz.likeness(*u) - len(a & b) / len(a | b)) < 0.25
    u = np.frombuffer(bytes.fromhex(lz.fingerprint(base)), ">u2")
    assert lz.likeness(u, u) == 1 and lz.likeness(lz.marks("", []), lz.marks("", [])) == 1 and lz.likeness(u, lz.marks("", [])) == 0


def brute(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    out = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        other = text[: len(text) - half] + after[:half]
        m = [np.frombuffer(bytes.fromhex(lz.fingerprint(t)), ">u2") for t in (text, other, after)]
        out.append((doc, len(text), hashlib.sha256(other.encode()).hexdigest(), lz.fingerprint(text), lz.fingerprint(other), lz.likeness(m[0], m[1]), lz.likeness(m[0], m[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_neighbours(docs_of, parts):
    rng = np.random.default_rng(parts)
    rows = [(int(i), "".join(rng.choice(list("abc é🙂"), int(rng.integers(0, 60))))) for i in rng.permutation(40)] + [(100, None), (101, ""), (5, "again"), (None, "x"), (None, None)]
    got = lz.neighbour_fingerprints(docs_of(rows).withColumn("fingerprint", F.lit(1)), parts).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone here")], [(1, None)], [(2, "same"), (2, "same")]])
def test_odd_tables(docs_of, rows):
    got = lz.neighbour_fingerprints(docs_of(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)
    assert lz.with_fingerprint(docs_of(rows).withColumn("fingerprint", F.lit(3))).count() == len(rows)


def test_long_texts_have_the_same_phrases(monkeypatch):
    import random

    from strandflow.llm import lzprint

    draw = random.Random(3)
    texts = ["".join(draw.choices("abc é\U0001f600", k=n)) for n in (0, 1, 5, 3000, 60_000)] + ["a" * 5000]
    whole = [(lzprint.fingerprint(t), [lzprint._record(t, u)[0] for u in texts[:4]]) for t in texts]
    monkeypatch.setattr(lzprint, "LONG", 2)
    assert [(lzprint.fingerprint(t), [lzprint._record(t, u)[0] for u in texts[:4]]) for t in texts] == whole
    for t in texts:
        parse = lzprint.Parse()
        parse.feed(t)
        assert lzprint.long_ends(t).tolist() == parse.ends
        assert (lzprint.marks(t, parse.ends, most=100) == lzprint.marks(t, parse.ends)).all()


def test_memory_of_a_long_text():
    """No more than 64 bytes a character beyond the text."""
    import random
    import tracemalloc

    from strandflow.llm import lzprint

    text = "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz     ", k=500_000))
    tracemalloc.start()
    found = lzprint.marks(text, lzprint.long_ends(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and (found != lzprint.EMPTY).all()
