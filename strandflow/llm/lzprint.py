"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases: the next phrase is the shortest piece that isn't a phrase yet
(LZ78). Texts that would compress each other well share phrases, so the likeness of two texts is
estimated by that of their phrase sets: the phrases' hashes are dealt to ``SLOTS`` slots, the least
of each slot is kept to 16 bits, and fingerprints are compared slot by slot. A fingerprint is hex,
four digits a slot; ``EMPTY`` stands in a slot without phrases.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm import textbatch as tb
from strandflow.llm.common import extended, schema, ship, table, written

U = np.uint64
SLOTS = 64
EMPTY = 0xFFFF
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points from which on phrases are kept in arrays, some 40 bytes each, instead of dictionaries, some 600.
LONG = 1 << 20


class Parse:
    """The phrases of a text as a tree of dictionaries, and where they end."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.node = self.root
        self.ends: list[int] = []
        self.at = 0

    def feed(self, text: str, log: list | None = None) -> None:
        """Parses on; ``log`` gets what is added to the tree."""
        root, node, ends = self.root, self.node, self.ends
        for i, char in enumerate(text, self.at + 1):
            below = node.get(char)
            if below is None:
                node[char] = {}
                ends.append(i)
                if log is not None:
                    log.append((node, char))
                node = root
            else:
                node = below
        self.node, self.at = node, self.at + len(text)


def long_ends(text: str) -> array:
    """Where the phrases of a text end, as ``Parse`` finds them: the tree is one table from (phrase,
    next character) to phrase, with open addressing in arrays."""
    ends = array("q")
    size, mask = 1 << 16, (1 << 16) - 1
    keys, below = array("Q", bytes(8 * size)), array("I", bytes(4 * size))
    node = made = 0
    for i, char in enumerate(text, 1):
        key = node * 0x110000 + ord(char) + 1
        slot = (key * 0x9E3779B97F4A7C15 >> 24) & mask
        while (there := keys[slot]) != key and there:
            slot = (slot + 1) & mask
        if there:
            node = below[slot]
            continue
        made += 1
        keys[slot], below[slot], node = key, made, 0
        ends.append(i)
        if 2 * made > size:
            size, old, old_below = 2 * size, keys, below
            mask = size - 1
            keys, below = array("Q", bytes(8 * size)), array("I", bytes(4 * size))
            for key, value in zip(old, old_below, strict=True):
                if key:
                    slot = (key * 0x9E3779B97F4A7C15 >> 24) & mask
                    while keys[slot]:
                        slot = (slot + 1) & mask
                    keys[slot], below[slot] = key, value
    return ends


def phrase_ends(text: str) -> Sequence[int]:
    if len(text) >= LONG:
        return long_ends(text)
    parse = Parse()
    parse.feed(text)
    return parse.ends


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def marks(text: str, ends: Sequence[int], most: int = 1 << 19) -> np.ndarray:
    """The fingerprint as 16-bit numbers. A last piece that is a phrase already adds nothing. Phrases
    are hashed in pieces of about ``most`` code points."""
    out = np.full(SLOTS, EMPTY, np.uint16)
    if not len(ends):
        return out
    stop = np.array(ends, np.int64)
    start = np.concatenate([[0], stop[:-1]])
    if stop[-1] <= most:
        slots, least = _least(text, start, stop, 0)
    else:
        every, held, a = np.full(SLOTS, np.iinfo(U).max), np.zeros(SLOTS, bool), 0
        while a < len(stop):
            b = max(a + 1, int(np.searchsorted(stop, start[a] + most, "right")))
            slots, least = _least(text, start[a:b], stop[a:b], int(start[a]))
            every[slots] = np.minimum(every[slots], least)
            held[slots] = True
            a = b
        slots, least = np.flatnonzero(held), every[held]
    # the least of a slot is close to 0: its bits are mixed again so that all 16 count
    out[slots] = np.minimum((tb.mix(least) >> U(48)).astype(np.uint16), EMPTY - 1)
    return out


def _least(text: str, start: np.ndarray, stop: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots that some phrases fall into, and the least hash of each."""
    codes = code_points(text[base : int(stop[-1])]).astype(U) + U(1)
    total = np.zeros(len(codes) + 1, U)
    np.cumsum(codes * tb.powers(_BASE, len(codes)), out=total[1:])
    s, e = start - base, stop - base
    hashes = tb.mix((total[e] - total[s]) * tb.powers(_INVERSE, len(codes) + 1)[s] + (e - s).astype(U))
    hashes.sort()
    slot = (hashes >> U(58)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    return slot[first], hashes[first]


def fingerprint(text: str) -> str:
    return as_hex(marks(text, phrase_ends(text)))


def as_hex(found: np.ndarray) -> str:
    return found.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Equal slots among those that aren't empty in both; two empty texts are alike (1)."""
    used = (a != EMPTY) | (b != EMPTY)
    n = int(used.sum())
    return float(((a == b) & used).sum() / n) if n else 1.0


def edited(text: str, following: str) -> tuple[str, str]:
    """What stays of a text, and what replaces its last half: the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half], following[:half]


def _both(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """The marks of a text and of its edited text, and the latter's digest; the first part is parsed once."""
    stays, put = edited(text, following)
    if len(text) >= LONG:
        other = stays + put
        return marks(text, phrase_ends(text)), marks(other, phrase_ends(other)), hashlib.sha256(other.encode()).hexdigest()
    parse = Parse()
    parse.feed(stays)
    at, node, known = parse.at, parse.node, len(parse.ends)
    log: list = []
    parse.feed(text[at:], log)
    own = marks(text, parse.ends)
    for above, char in reversed(log):
        del above[char]
    parse.at, parse.node = at, node
    del parse.ends[known:]
    parse.feed(put)
    other = stays + put
    return own, marks(other, parse.ends), hashlib.sha256(other.encode()).hexdigest()


_SPEC = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _record(text: str, following: str, ahead: np.ndarray | None = None) -> tuple[tuple, np.ndarray]:
    own, other, digest = _both(text, following)
    if ahead is None:
        ahead = marks(following, phrase_ends(following))
    return (len(text), digest, as_hex(own), as_hex(other), likeness(own, other), likeness(own, ahead)), own


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one partition in order: each but the last is finished with the one after it. The
    first row's text and the last row are passed on for the partitions' seams."""
    names = ["doc_id", *(f.split()[0] for f in _SPEC.split(", ")), "seam", "part", "text"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]
    last: tuple | None = None
    rows: list[tuple] = []

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows.clear()
        return out

    none = (None,) * 6
    held: list = []  # the row before, until the next one's marks are known
    for b in batches:
        for part, doc_id, text in zip(b.column(0), b.column(1), b.column(2), strict=True):
            part, doc_id, text = part.as_py(), doc_id.as_py(), text.as_py() or ""
            if last is None:
                rows.append((None, *none, "first", part, text))
            else:
                own, other, digest = _both(last[1], text)
                if held:
                    doc, n, sha, mine, its = held.pop()
                    rows.append((doc, n, sha, as_hex(mine), as_hex(its), likeness(mine, its), likeness(mine, own), None, part, None))
                held.append((last[0], len(last[1]), digest, own, other))
            last = doc_id, text, part
            if len(rows) >= 1000:
                yield batch()
    if last is not None:
        if held:
            doc, n, sha, mine, its = held.pop()
            rows.append((doc, n, sha, as_hex(mine), as_hex(its), likeness(mine, its), likeness(mine, marks(last[1], phrase_ends(last[1]))), None, last[2], None))
        rows.append((last[0], *none, "last", last[2], last[1]))
        yield batch()


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [_record(x.as_py() or "", y.as_py() or "")[0] for x, y in zip(b.column(1), b.column(2), strict=True)]
        columns = list(zip(*found, strict=True)) if found else [[]] * 6
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *(f.split()[0] for f in _SPEC.split(", "))])


def neighbour_fingerprints(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """``doc_id`` and, for each row: ``n_chars`` (code points), ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The next document is the one of the next larger ``doc_id``, after the last the first; rows
    without an id come first, rows of an equal id in the order of their texts. Null texts are empty; a single row
    is its own next. Other columns are ignored. An empty table gives an empty one. Texts may be of any
    length; two of them are held at a time. Rows are dealt to ranges of ids; only the rows at the
    ranges' seams, two a range, are matched in a second step, whose window sees the ranges' numbers only.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = partitions or max(docs.select("doc_id").rdd.getNumPartitions(), spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, F.col("doc_id").asc_nulls_first())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    walked = written(
        dealt.select(F.spark_partition_id().alias("part"), "doc_id", "text").mapInArrow(_walk, schema(f"doc_id long, {_SPEC}, seam string, part int, text string")), "walked"
    )
    order = Window.orderBy("part")
    used = walked.where("seam = 'first'").select("part")  # a number for each range
    used = used.select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("after"))
    firsts = walked.where("seam = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    lasts = walked.where("seam = 'last'").select("part", "doc_id", "text")
    seams = lasts.join(used, "part").join(firsts, "after").select("doc_id", "text", "following")
    done = walked.where("seam IS NULL").select("doc_id", *(f.split()[0] for f in _SPEC.split(", ")))
    return done.unionAll(seams.mapInArrow(_finish, schema(f"doc_id long, {_SPEC}")))


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``fingerprint``; a column of that name is replaced, null texts are empty."""
    ship(docs.sparkSession)
    docs = docs.drop("fingerprint")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint(x.as_py() or "") for x in b.column(at)], pa.string())], [*b.schema.names, "fingerprint"])

    return docs.mapInArrow(run, extended(docs, "fingerprint string"))


def op7_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents``; nulls, repeated rows and long texts as in ``neighbour_fingerprints``."""
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))
