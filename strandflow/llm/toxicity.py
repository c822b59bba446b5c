"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is cut into words (runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased). The
input of a word is an embedding of its hash plus the mean of embeddings of its character three- and
four-grams, with marks at both ends. Windows of ``WINDOW`` words, a new one each ``STRIDE`` words,
are read by a GRU in either direction; attention pools the states, a linear layer gives a logit, and
the text's score is that of its highest window. All windows of every text are scored.

Training sees a bounded sample of labelled texts (``TRAIN_ROWS``) and takes a fixed number of
steps, each over as many toxic as clean texts, with the gradient through the highest window. So that
few labels do, the first number of each embedding begins as how surprisingly often toxic texts of the
sample hold that word or n-gram, in standard deviations; the rest begins at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import textbatch as tb
from strandflow.llm.common import extended, ship, table, tidy

U = np.uint64
WINDOW, STRIDE = 32, 24
HIDDEN, EMBED, ATTEND = 8, 16, 8
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 14
#: Labelled texts that training sees at most, half of them of each label where there are enough.
TRAIN_ROWS = 2400
#: Bytes of the longest text that training takes; longer ones are scored only.
TRAIN_BYTES = 1 << 16
STEPS, BATCH, RATE = 260, 32, 0.01
#: Embeddings learn more slowly than the rest; standard deviations that count as 1, and at most.
EMBED_RATE, SCALE, MOST = 0.1, 4.0, 3.0

#: Words whose n-grams are made at once.
_PART = 1 << 14

_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_IN_WORD[128:] = True


@dataclass
class Vocabulary:
    """The distinct words of a batch: rows of the word table, and their n-grams' rows one after another."""

    word: np.ndarray
    grams: np.ndarray
    cuts: np.ndarray


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Vocabulary]:
    """The id of each word (into the vocabulary), how many words each row has, the vocabulary."""
    low = tb.LOWER[data]
    starts, ends, row = tb.words(low, offsets, _IN_WORD)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    if not len(starts):
        return np.empty(0, np.int64), counts, Vocabulary(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    hashes = np.empty(len(starts), U)
    for i, j in tb.pieces(offsets, 1 << 20):
        a, b = np.searchsorted(starts, (offsets[i], offsets[j]))
        hashes[a:b] = tb.span_hashes(low[offsets[i] : offsets[j]], starts[a:b] - offsets[i], ends[a:b] - offsets[i])
    distinct, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    s, n = starts[first], (ends - starts)[first]
    grams = [_grams(low, s[i : i + _PART], n[i : i + _PART]) for i in range(0, len(s), _PART)]
    # a word of n characters, n + 2 with its marks, has n three-grams and n - 1 four-grams
    return ids.astype(np.int32), counts, Vocabulary((distinct >> U(64 - WORD_ROWS.bit_length() + 1)).astype(np.int32), np.concatenate(grams), np.concatenate([[0], np.cumsum(2 * n - 1)]))


def _grams(low: np.ndarray, s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Rows of the n-grams of words that start at ``s`` and have ``n`` bytes, word by word."""
    padded = n + 2  # a mark before and after
    at = np.concatenate([[0], np.cumsum(padded)])
    own = np.repeat(np.arange(len(s)), padded)
    place = np.arange(at[-1]) - at[own] - 1
    chars = np.where((place >= 0) & (place < n[own]), low[np.clip(s[own] + place, 0, len(low) - 1)], 1).astype(np.int64)
    left = at[own + 1] - np.arange(at[-1])  # characters from here to the word's end
    three = np.zeros(at[-1], np.int64)
    for j in range(3):
        three = three * 257 + np.concatenate([chars[j:], np.zeros(j, np.int64)])
    four = three * 257 + np.concatenate([chars[3:], np.zeros(3, np.int64)])
    pick = lambda x: ((x.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - CHAR_ROWS.bit_length() + 1)).astype(np.int32)
    # one position gives its three-gram and, if it is long enough, its four-gram
    return np.stack([pick(three), pick(four + 7)], axis=1)[np.stack([left >= 3, left >= 4], axis=1)]


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words, and row of every window; a row without words has one empty window."""
    many = np.maximum(1, -(-(counts - WINDOW) // STRIDE) + 1)
    row = np.repeat(np.arange(len(counts)), many)
    nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    return begin[row] + nth * STRIDE, np.minimum(WINDOW, counts[row] - nth * STRIDE), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters by name in ``p``; float32 throughout."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, by: rng.normal(0, by, shape).astype(np.float32)
        self.p = {"word": draw(WORD_ROWS, EMBED, by=0.05), "char": draw(CHAR_ROWS, EMBED, by=0.1), "att": draw(2 * HIDDEN, ATTEND, by=0.4), "att_v": draw(ATTEND, by=0.4), "out": draw(2 * HIDDEN, by=0.4), "bias": np.full(1, -1, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": draw(EMBED, 3 * HIDDEN, by=0.3), f"U{d}": draw(HIDDEN, 3 * HIDDEN, by=0.3), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}

    def embedded(self, v: Vocabulary) -> np.ndarray:
        if not len(v.word):
            return np.zeros((1, EMBED), np.float32)
        mean = np.add.reduceat(self.p["char"][v.grams], v.cuts[:-1], axis=0) / np.diff(v.cuts)[:, None].astype(np.float32)
        out = self.p["word"][v.word] + mean
        # a word is as surprising as its most surprising n-gram, not only as their mean
        out[:, 1] += np.maximum.reduceat(self.p["char"][v.grams, 0], v.cuts[:-1])
        return out

    def loudest(self, v: Vocabulary) -> np.ndarray:
        """The place in ``v.grams`` of each word's most surprising n-gram, the first of equal ones."""
        value, per = self.p["char"][v.grams, 0], np.diff(v.cuts)
        most = np.repeat(np.maximum.reduceat(value, v.cuts[:-1]), per)
        at = np.where(value == most, np.arange(len(value)), len(value))
        return np.minimum.reduceat(at, v.cuts[:-1])

    def forward(self, inputs: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows of the words ``ids[begin : begin + size]``, the rows of ``inputs``."""
        n, p = len(begin), self.p
        length = max(1, int(size.max()))
        at = np.arange(length)[None, :]
        there = at < size[:, None]
        if len(ids):
            word = ids[np.minimum(begin[:, None] + at, len(ids) - 1)]
        else:
            word = np.zeros((n, length), np.int64)
        states = np.zeros((length, n, 2 * HIDDEN), np.float32)
        kept = {}
        for d, order in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            table_ = inputs @ p[f"W{d}"] + p[f"c{d}"]
            h = np.zeros((n, HIDDEN), np.float32)
            half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            ug, uc = p[f"U{d}"][:, : 2 * HIDDEN], p[f"U{d}"][:, 2 * HIDDEN :]
            for t in order:
                x = table_[word[:, t]]
                g = _sigmoid(x[:, : 2 * HIDDEN] + h @ ug)
                z, r = g[:, :HIDDEN], g[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + (r * h) @ uc)
                m = there[:, t, None]
                new = np.where(m, h + z * (c - h), h)
                if keep:
                    kept[d, t] = h, z, r, c, m
                h = new
                states[t, :, half] = h
        hidden = np.tanh(states @ p["att"])
        weight = np.where(there.T, hidden @ p["att_v"], -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = (weight[..., None] * states).sum(axis=0)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (word, there, states, hidden, weight, pooled, kept)) if keep else logit

    def gradients(self, v: Vocabulary, inputs: np.ndarray, memory, up: np.ndarray) -> dict[str, np.ndarray]:
        """Of the parameters, for gradients ``up`` of the logits."""
        word, there, states, hidden, weight, pooled, kept = memory
        p, n, length = self.p, len(up), states.shape[0]
        g = {"out": pooled.T @ up, "bias": up.sum(keepdims=True)}
        d_pool = up[:, None] * p["out"]
        d_states = weight[..., None] * d_pool
        d_weight = (states * d_pool).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        g["att_v"] = np.einsum("tn,tna->a", d_score, hidden)
        d_hidden = d_score[..., None] * p["att_v"] * (1 - hidden**2)
        g["att"] = np.einsum("tnh,tna->ha", states, d_hidden)
        d_states = d_states + d_hidden @ p["att"].T
        d_inputs = np.zeros_like(inputs)
        for d, order in (("f", range(length - 1, -1, -1)), ("b", range(length))):
            half = slice(0, HIDDEN) if d == "f" else slice(HIDDEN, 2 * HIDDEN)
            u = p[f"U{d}"]
            ug, uc = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
            gu, d_h = np.zeros_like(u), np.zeros((n, HIDDEN), np.float32)
            d_table = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            for t in order:
                h, z, r, c, m = kept[d, t]
                d_new = d_h + d_states[t, :, half]
                d_in = np.where(m, d_new, 0)
                d_c = d_in * z * (1 - c**2)
                d_z = d_in * (c - h) * z * (1 - z)
                d_rh = d_c @ uc.T
                d_r = d_rh * h * r * (1 - r)
                d_g = np.concatenate([d_z, d_r], axis=1)
                gu[:, : 2 * HIDDEN] += h.T @ d_g
                gu[:, 2 * HIDDEN :] += (r * h).T @ d_c
                d_h = np.where(m, d_in * (1 - z) + d_rh * r + d_g @ ug.T, d_new)
                np.add.at(d_table, word[:, t], np.concatenate([d_g, d_c], axis=1))
            g[f"U{d}"], g[f"c{d}"], g[f"W{d}"] = gu, d_table.sum(axis=0), inputs.T @ d_table
            d_inputs += d_table @ p[f"W{d}"].T
        if len(v.word):
            g["word"] = (v.word, d_inputs)
            per = np.diff(v.cuts)
            d_grams = np.repeat(d_inputs / per[:, None].astype(np.float32), per, axis=0)
            d_grams[self.loudest(v), 0] += d_inputs[:, 1]
            g["char"] = (v.grams, d_grams)
        return g

    def logits(self, inputs: np.ndarray, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, most: int = 2048) -> np.ndarray:
        """Of any number of windows, ``most`` at a time."""
        return np.concatenate([self.forward(inputs, ids, begin[i : i + most], size[i : i + most]) for i in range(0, len(begin), most)])

    def scores(self, data: np.ndarray, offsets: np.ndarray, most: int = 2048) -> np.ndarray:
        """The score of each row: the highest of its windows, as a probability."""
        ids, counts, v = tokens(data, offsets)
        inputs = self.embedded(v)
        begin, size, row = windows(counts)
        logit = self.logits(inputs, ids, begin, size, most)
        best = np.maximum.reduceat(logit, np.searchsorted(row, np.arange(len(counts))))
        return 1 / (1 + np.exp(-best.astype(np.float64)))


def surprise(held: Iterator[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """For each of ``size`` table rows, the number of toxic texts that hold it, less what its number
    of texts lets expect, in standard deviations. ``held``: the rows that each text holds."""
    n, toxic = np.zeros(size), np.zeros(size)
    for rows, y in zip(held, labels, strict=True):
        rows = np.unique(rows)
        n[rows] += 1
        toxic[rows] += y
    share = labels.mean()
    return ((toxic - n * share) / np.sqrt(np.maximum(n * share * (1 - share), 1e-9))).astype(np.float32)


def grams_of(v: Vocabulary, words: np.ndarray) -> np.ndarray:
    """The n-grams' rows of some words, one after another."""
    per = v.cuts[words + 1] - v.cuts[words]
    before = np.cumsum(per) - per
    return v.grams[np.repeat(v.cuts[words] - before, per) + np.arange(per.sum())]


def train(texts: list[str], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over ``steps`` batches of as many toxic as clean texts. With one label only, or no
    texts, the network stays as it was drawn, with a bias towards that label (clean if none)."""
    net = Network(seed)
    labels = np.asarray(labels)
    of = [np.flatnonzero(labels == y) for y in (0, 1)]
    if not len(of[0]) or not len(of[1]):
        net.p["bias"][0] = 4.0 if len(of[1]) else -4.0
        net.p["out"][:] = 0
        return net
    rng = np.random.default_rng(seed)
    data, offsets = tb.utf8(pa.array(texts, pa.string()))
    ids, counts, v = tokens(data, offsets)
    first = np.concatenate([[0], np.cumsum(counts)])
    if len(ids):
        of_text = lambda: (np.unique(ids[a:b]) for a, b in zip(first[:-1], first[1:], strict=True))
        for name, held, size in (("word", (v.word[w] for w in of_text()), WORD_ROWS), ("char", (grams_of(v, w) for w in of_text()), CHAR_ROWS)):
            net.p[name][:, 0] = np.clip(surprise(held, labels, size) / SCALE, -MOST, MOST)
    mean, square = ({k: np.zeros_like(x) for k, x in net.p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        chosen = np.concatenate([rng.choice(o, BATCH // 2, replace=len(o) < BATCH // 2) for o in of])
        own = np.concatenate([ids[first[i] : first[i + 1]] for i in chosen]) if counts[chosen].sum() else np.empty(0, np.int64)
        used, own = np.unique(own, return_inverse=True)
        per = v.cuts[used + 1] - v.cuts[used] if len(used) else np.empty(0, np.int64)
        part = Vocabulary(v.word[used], grams_of(v, used) if len(used) else v.grams[:0], np.concatenate([[0], np.cumsum(per)]))
        begin, size, row = windows(counts[chosen])
        inputs = net.embedded(part)
        logit = net.logits(inputs, own, begin, size)
        heads = np.searchsorted(row, np.arange(len(chosen)))
        top = np.array([h + int(np.argmax(logit[h:e])) for h, e in zip(heads, [*heads[1:], len(row)], strict=True)])
        y = labels[chosen].astype(np.float32)
        logit, memory = net.forward(inputs, own, begin[top], size[top], keep=True)
        up = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
        rate = RATE * min(1, step / 20) * (0.2 if step > 0.8 * steps else 1)
        for k, g in net.gradients(part, inputs, memory, up).items():
            at = slice(None)
            if isinstance(g, tuple):
                at, inverse = np.unique(g[0], return_inverse=True)
                total = np.zeros((len(at), EMBED), np.float32)
                np.add.at(total, inverse, g[1])
                g = total
            mean[k][at] = 0.9 * mean[k][at] + 0.1 * g
            square[k][at] = 0.99 * square[k][at] + 0.01 * g**2
            own_rate = rate * EMBED_RATE if k in ("word", "char") else rate
            net.p[k][at] -= own_rate * (mean[k][at] / (1 - 0.9**step)) / (np.sqrt(square[k][at] / (1 - 0.99**step)) + 1e-8)
    return net


def fitted(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Network:
    """A network trained on at most ``rows`` labelled texts, those of the least hashes, whose
    crc32(doc_id) mod 5 isn't 0; of these, texts of more than TRAIN_BYTES are left out, so the driver gets
    ``rows`` x TRAIN_BYTES at most. Null labels and null ids are left out; of an id's labels the
    greatest counts."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    least = F.xxhash64("doc_id", F.lit(11))
    half = lambda y: known.where(F.col("toxic") == y).orderBy(least, "doc_id").limit(rows // 2)
    chosen = half(0).union(half(1))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES)
    found = texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("toxic").alias("toxic")).orderBy("doc_id").toPandas()
    net = train(list(found["text"]), found["toxic"].to_numpy().astype(int))
    del found
    tidy(docs.sparkSession)
    return net


def score_column(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` with a column ``score`` appended (one of that name is replaced)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net.p)
    docs = docs.drop("score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network.__new__(Network)
        own.p = shared.value
        for batch in batches:
            data, offsets = tb.utf8(batch.column(at))
            for i, j in tb.pieces(offsets, 1 << 18):
                score = own.scores(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, j - i).columns, pa.array(score)], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, extended(docs, "score double"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``. A null text counts as empty and gets the
    score of an empty window; texts may be of any length, all their windows are scored; repeated rows
    are each scored; an empty table gives an empty one; other columns pass through, but those named
    ``score`` and ``predicted`` are replaced."""
    return score_column(docs.drop("predicted"), fitted(docs, labels, rows)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents`` by a network trained on ``labels``; nulls and repeated rows as in ``toxicity``."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
