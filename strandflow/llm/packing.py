"""Packing documents into token sequences: dominance reduction, then best fit.

Only the number of pieces of each length matters to the packing, and there are at most ``limit``
lengths, so the plan is made on the driver from that histogram, whatever the number of documents:
it lists patterns of lengths and how often each is used. Pieces then look up their sequence by their
rank among the pieces of their length.

Reduction (Martello and Toth): a set that holds a piece and dominates every other set with it is
fixed, since swapping the others' contents into its place never needs a further sequence: a piece
with which nothing else fits; a piece and the largest that fits, if it fills the sequence, or if no
two others fit, or if it is as large as the best two; a piece and the best two, if no two others
between them fit. What is left goes to the fullest sequence that has room, largest piece first.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import extended, fresh, ranked, ship, table, written

LIMIT = 2048
#: The file's vocabulary; ids are those that the tokenizers library gives for byte_bpe_50k.json.
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Characters of one run of white space from which on ``tokenizers`` encodes a text: tiktoken's
#: pattern goes back over the whole run, and its stack ends near 1,000,000.
LONG_RUN = 100_000

Pattern = tuple[int, ...]


def _largest(lengths: list[int], most: int) -> int:
    """Position of the largest length that is at most ``most``, or -1."""
    return bisect_right(lengths, most) - 1


def reduced(counts: Counter, limit: int) -> list[tuple[Pattern, int]]:
    """Takes dominating sets out of ``counts`` (length: pieces) until none is found."""
    fixed: list[tuple[Pattern, int]] = []

    def fix(*pattern: int) -> None:
        need = Counter(pattern)
        times = min(counts[w] // n for w, n in need.items())
        fixed.append((pattern, times))
        for w, n in need.items():
            counts[w] -= times * n
            if not counts[w]:
                del counts[w]
                lengths.remove(w)

    changed = True
    while changed:
        changed = False
        lengths = sorted(counts)
        for w in sorted(counts, reverse=True):
            while counts.get(w):
                counts[w] -= 1  # the piece itself isn't among the others
                alone = not counts[w]
                if alone:
                    del counts[w]
                    lengths.remove(w)
                pattern = _dominating(w, counts, lengths, limit - w)
                counts[w] += 1
                if alone:
                    lengths.insert(bisect_left(lengths, w), w)
                if pattern is None:
                    break
                fix(*pattern)
                changed = True
    return fixed


def _dominating(w: int, counts: Counter, lengths: list[int], room: int) -> Pattern | None:
    top = _largest(lengths, room)
    if top < 0:
        return (w,)
    best = lengths[top]
    if best == room:
        return w, best
    low = []  # the three smallest
    for x in lengths[:3]:
        low += [x] * min(3, counts[x])
    low = low[:3]
    if len(low) < 2 or low[0] + low[1] > room:
        return w, best
    if len(low) == 3 and sum(low) <= room:
        return None
    a = b = 0
    j = top
    for i in range(top + 1):  # the best two: smaller one ascending, larger one descending
        if j < i:
            break
        while j >= i and lengths[i] + lengths[j] > room:
            j -= 1
        if j < i or j == i and counts[lengths[i]] < 2:
            continue
        if lengths[i] + lengths[j] > a + b:
            a, b = lengths[j], lengths[i]
    if best >= a + b:
        return w, best
    if a != best:
        return None
    above = []
    for x in lengths[bisect_right(lengths, b) :][:2]:
        above += [x] * min(2, counts[x])
    return (w, a, b) if len(above) < 2 or above[0] + above[1] > room else None


def best_fit(counts: Counter, limit: int) -> list[tuple[Pattern, int]]:
    """Best fit, longest first, for all pieces of a length at once."""
    rooms: dict[int, list[tuple[Pattern, int]]] = {limit: []}
    order = [limit]
    for w in sorted(counts, reverse=True):
        left = counts[w]
        while left:
            at = bisect_left(order, w)
            room = order[at]
            each = room // w
            if room == limit:
                pattern, many = (), left // each or 1
            else:
                pattern, many = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            use = min(many, left // each)
            parts = [(each, use)]
            if use < many and left - use * each:
                parts.append((left - use * each, 1))
            if (idle := many - sum(n for _, n in parts)) and room != limit:
                parts.append((0, idle))
            for items, n in parts:
                if not n:
                    continue
                rest = room - items * w
                if rest not in rooms:
                    rooms[rest] = []
                    order.insert(bisect_left(order, rest), rest)
                rooms[rest].append((pattern + (w,) * items, n))
                left -= items * n
    return [x for found in rooms.values() for x in found]


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[Pattern, int]]:
    """Patterns and how often each is used, for ``counts`` pieces of each length."""
    left = Counter({w: n for w, n in counts.items() if n})
    if any(not 0 < w <= limit for w in left):
        raise ValueError(f"lengths must be from 1 to {limit}")
    return reduced(left, limit) + best_fit(left, limit)


def lookup(patterns: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """For runs of ranks of a length: the key of the first rank, its sequence, the offset there."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for w in pattern:
            # pieces of one length in one pattern take one rank each, run after run
            rows.append((w, used[w], sequence, offset))
            used[w] += times
            offset += w
        sequence += times
    rows.sort()
    grid = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (grid[:, 0] << 48) | grid[:, 1], "first": grid[:, 1], "sequence": grid[:, 2], "offset": grid[:, 3]}


@functools.cache
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=_added(path))


@functools.cache
def _added(path: str) -> dict[str, int]:
    """The added tokens of the tokenizers file beside the vocabulary, if there is one."""
    file = Path(path).with_suffix(".json")
    return {x["content"]: x["id"] for x in json.loads(file.read_text("utf-8"))["added_tokens"]} if file.exists() else {}


@functools.cache
def _plain(path: str):
    """The tokenizers library's reading of the same vocabulary, for texts that tiktoken can't take."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(Path(path).with_suffix(".json")))


def _long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in re.finditer(r"\s+", text))


def _encoded(text: str, path: str, added: bool) -> list[int]:
    if not _long_run(text):
        try:
            return _encoding(path).encode(text, allowed_special="all") if added else _encoding(path).encode_ordinary(text)
        except BaseException as e:  # a panic of the library isn't an Exception
            if type(e).__name__ != "PanicException":
                raise
    plain = _plain(path)
    plain.encode_special_tokens = not added
    return plain.encode(text, add_special_tokens=False).ids


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids of ordinary text, which added tokens are read as, too."""
    return np.array(_encoded(text, path, False), dtype="<u4")


def text_ids(text: str, path: str) -> np.ndarray:
    """The ids of a text, in which added tokens have their own, as ``tokenizers`` gives them."""
    return np.array(_encoded(text, path, any(x in text for x in _added(path))), dtype="<u4")


def cut(length: int, limit: int) -> list[int]:
    """Where pieces start: all but the first have ``limit`` tokens."""
    first = length % limit or limit
    return [0, *range(first, length, limit)]


def _pieces(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                row, piece, begin, length, check = [], [], [], [], []
                for i, text in enumerate(pc.fill_null(part.column(batch.num_columns - 1), "")):
                    ids = np.append(text_ids(text.as_py(), path), np.uint32(0)).astype("<u4")
                    places = cut(len(ids), limit)
                    for k, (a, b) in enumerate(zip(places, [*places[1:], len(ids)], strict=True)):
                        row.append(i)
                        piece.append(k)
                        begin.append(a)
                        length.append(b - a)
                        check.append(zlib.crc32(ids[a:b].tobytes()))
                kept = part.take(pa.array(row, pa.int64())).columns[:-1]
                made = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (begin, length, check))]
                yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-1], "piece", "start", "length", "ids_crc32"])

    return run


def pack(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """A row for each piece of each row of ``docs``: its columns but ``text``, then ``piece``,
    ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``; columns of those names are
    replaced.

    A text's tokens are those of the vocabulary at ``path``, added tokens such as <|endoftext|>
    included, and an id 0 to end it, so a null or empty text is one token. Texts of more than
    ``limit`` tokens are cut, the first piece being the shorter one; a text may be as long as a row
    of the table can be, and so may a run of white space in it (from LONG_RUN characters on
    ``tokenizers`` reads it, with equal ids). Repeated rows are packed each. An empty table gives an
    empty one.
    """
    ship(docs.sparkSession)
    made = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    docs = docs.drop(*made)
    others = [c for c in docs.columns if c.lower() != "text"]
    kept = docs.select(*others, "text")
    kind = extended(kept.drop("text"), "piece int, start long, length long, ids_crc32 long")
    pieces = written(kept.mapInArrow(_pieces(path, limit), kind), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # limit rows at most
    shared = docs.sparkSession.sparkContext.broadcast(lookup(plan(counts, limit)))
    c = fresh(pieces.withColumns({"sequence_id": F.lit(0), "offset": F.lit(0)}), "rank_of_length")
    order = F.struct(*([F.col("doc_id")] if "doc_id" in others else []), "piece", "ids_crc32")
    placed = ranked(pieces, ["length"], order, c["rank_of_length"], limit).select(*pieces.columns, c["rank_of_length"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = shared.value
        at = placed_names.index("length")
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            run = np.searchsorted(runs["key"], (batch.column(at).to_numpy() << 48) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(runs["sequence"][run] + rank - runs["first"][run]), pa.array(runs["offset"][run])], [*batch.schema.names[:-1], "sequence_id", "offset"])

    placed_names = placed.columns
    return placed.mapInArrow(find, extended(pieces, "sequence_id long, offset long"))


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op2_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens; null and repeated rows as in ``pack``."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary())
