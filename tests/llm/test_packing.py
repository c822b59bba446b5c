import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm.packing import best_fit, cut, pack, plan, reduced, text_ids, token_ids, vocabulary


def fewest(items, limit):
    best, items = [len(items)], sorted(items, reverse=True)

    def rec(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= limit:
                bins[k] += items[i]
                rec(i + 1, bins)
                bins[k] -= items[i]
        rec(i + 1, [*bins, items[i]])

    rec(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_the_optimum(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(3, 18, 10).tolist()
    left = Counter(items)
    fixed = reduced(left, 20)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert Counter(w for p, n in fixed for w in p * n) + Counter(rest) == Counter(items)
    assert fewest(items, 20) == sum(n for _, n in fixed) + fewest(rest, 20)


def test_best_fit_is_that_of_single_pieces():
    rng = np.random.default_rng(5)
    counts = Counter(rng.integers(1, 101, 400).tolist())
    rooms = []
    for w in sorted(counts.elements(), reverse=True):
        fits = [r for r in rooms if r >= w]
        if fits:
            rooms[rooms.index(min(fits))] -= w
        else:
            rooms.append(100 - w)
    made = best_fit(counts, 100)
    assert sum(n for _, n in made) == len(rooms) and Counter(w for p, n in made for w in p * n) == counts


def test_plan_at_scale():
    sizes = np.clip(np.random.default_rng(0).lognormal(6.4, 1, 2_000_000).astype(int), 1, 2048)
    counts = Counter(sizes.tolist())
    made = plan(counts)
    got = Counter()
    for p, n in made:
        assert sum(p) <= 2048
        for w in p:
            got[w] += n
    assert got == counts and sum(n for _, n in made) <= max(1.001 * math.ceil(sizes.sum() / 2048), 0)
    with pytest.raises(ValueError):
        plan({2049: 1})


def test_ids_are_those_of_the_named_vocabulary():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for text in ["", " ", "Hello  world\n\n\t x", "naïve éàü ßñ 漢字 🙂 ­", "it's we'll I'M", "a" * 3000, "1234567890" * 20, "<|endoftext|> x", " a ​ b", "%%% ***"]:
        assert token_ids(text, vocabulary()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_own_ids(docs_of):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["<|endoftext|>", "a  <|endoftext|> b", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "<|ENDOFTEXT|>", "plain  text \n"]
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [text_ids(x, vocabulary()).tolist() for x in texts] == ids and ids[0] == [50256]
    found = pack(docs_of(list(enumerate(texts))), vocabulary()).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in found} == {(i, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(ids)}


@pytest.mark.parametrize("text", [" " * 1_200_000, "a b" + "\n" * 2_000_000 + "c", "\t \n" * 400_000 + "<|endoftext|>x", "x" + "\u3000 " * 600_000, ("word" + " " * 99_000) * 12])
def test_long_runs_of_white_space(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert text_ids(text, vocabulary()).tolist() == t.encode(text, add_special_tokens=False).ids
    t.encode_special_tokens = True
    assert token_ids(text, vocabulary()).tolist() == t.encode(text, add_special_tokens=False).ids


def test_a_panic_of_the_library_is_no_failure(monkeypatch):
    monkeypatch.setattr("strandflow.llm.packing._long_run", lambda text: False)
    assert len(token_ids(" " * 1_200_000, vocabulary())) == 1_200_000


def test_very_long_documents(docs_of):
    rows = [(1, " " * 1_500_000), (2, "word " * 400_000), (3, "short")]
    found = pack(docs_of(rows).select("doc_id", "text"), vocabulary()).collect()
    verify(found, dict(rows), 2048)
    assert sum(r.length for r in found if r.doc_id == 1) == 1_500_001


def test_pieces():
    assert cut(1, 8) == [0] and cut(8, 8) == [0] and cut(9, 8) == [0, 1] and cut(20, 8) == [0, 4, 12]


def verify(found, texts, limit):
    seqs = {}
    for r in found:
        ids = np.append(token_ids(texts[r.doc_id] or "", vocabulary()), np.uint32(0)).astype("<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= limit
    return seqs


def test_documents(docs_of):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "the", "of", "x1"], int(n)))) for i, n in enumerate(rng.integers(0, 150, 400))] + [(1000, None), (1001, ""), (1002, "long " * 700)]
    found = pack(docs_of(rows).select("doc_id", "text"), vocabulary(), 128).collect()
    seqs = verify(found, dict(rows), 128)
    whole = {}
    for r in found:
        whole.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for i, text in rows:
        total = len(token_ids(text or "", vocabulary())) + 1
        own = sorted(whole[i])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for _, _, n in own) == total and all(n == 128 for _, _, n in own[1:])
    assert len(seqs) <= math.ceil(sum(r.length for r in found) / 128) + 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "same text"), (1, "same text"), (None, "x"), (None, "y")] * 3])
def test_odd_tables(docs_of, rows):
    clash = docs_of(rows).withColumns({"LENGTH": F.lit(1), "rank_hash": F.lit(2), "rank_of_length": F.lit(3)})
    found = pack(clash, vocabulary(), 16).collect()
    assert len(found) == len(rows) and len({(r.sequence_id, r.offset) for r in found}) == len(rows)
