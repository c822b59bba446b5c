"""Near-duplicate documents by HyperMinHash registers, banding and verification on full sets.

A document is the set of its distinct shingles of ``k`` words (white space parts words, A-Z is
lower-cased). Documents with equal sets form one class. Each class gets ``REGISTERS`` registers: the
least value of the set under that register's own hash, kept as its count of leading zeros (6 bits)
and the 10 bits after the leading one. Four registers make a band key; half of the registers are
banded. Classes that share a band key are candidates, and those whose registers (folded to a byte
each, likeness corrected for collisions) are at least ``CLOSE`` alike are near. At a likeness of 0.8
the 32 bands miss a pair with a probability of 5e-8, ``CLOSE``, five standard deviations away, with
about 1e-7.

Near classes are gathered to families: in each band key's group, first all members are compared with
one hub, a linear number of pairs; groups whose other members are then in different families are
finished in blocks that give a spanning forest. Within a family, all sets are compared with one.
Families in which some aren't linked to it are finished in blocks, too, by an inverted index of the
full sets; a family of more than one block is first parted by its rare shingles (``_parted``), so
one whose members share a frame only never gets to blocks. Blocks pair sets whose sizes allow a link, and
each is a task's group of its own. The links so confirmed give the components; none is left out.

What stays quadratic: members of one part that have about equal sizes, share rare shingles and are
mostly not linked are paired block by block, each set going to as many blocks as the part has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm import textbatch as tb
from strandflow.llm.common import schema, ship, table, written
from strandflow.llm.components import components

U = np.uint64
REGISTERS, MANTISSA, ROWS, BANDS = 256, 10, 4, 32
CLOSE = 0.67
#: Members of a block of marks, of a block of sets.
BLOCK, SETS = 1024, 512
#: Members of families up to which their ids are broadcast to the texts, 8 MB; beyond, texts are shuffled.
BROADCAST_ROWS = 500_000
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_FOLD = U(0x9FB21C651E98DF25)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows one after another, and how many each row has.

    A row of fewer than ``k`` words has its whole sequence as one shingle, a row without words none.
    """
    rows = len(offsets) - 1
    starts, ends, row = tb.words(tb.LOWER[data], offsets, tb.NOT_SPACE)
    counts = np.bincount(row, minlength=rows)
    if not len(starts):
        return np.empty(0, U), np.zeros(rows, np.int64)
    hashes = tb.span_hashes(tb.LOWER[data], starts, ends)
    first = np.concatenate([[0], np.cumsum(counts)])
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(made)])
    base = np.repeat(first[:-1] - at[:-1], made) + np.arange(at[-1])
    own = np.repeat(np.minimum(counts, k), made)
    value = np.zeros(at[-1], U)
    for j in range(k):
        has = own > j
        value = np.where(has, value * _FOLD + hashes[np.minimum(base + j, len(hashes) - 1)], value)
    value = tb.mix(value + own.astype(U) * U(0xA24BAED4963EE407))
    for i in np.flatnonzero(made > 1):
        value[at[i] : at[i + 1]].sort()
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    new[at[:-1][made > 0]] = True
    return value[new], np.add.reduceat(np.append(new, False), at[:-1]) * (made > 0)


def registers(sets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each non-empty set."""
    at = np.concatenate([[0], np.cumsum(sizes[sizes > 0])])
    out = np.empty((len(at) - 1, REGISTERS), np.uint16)
    step = 1 << 15  # shingles at a time, to stay in the cache
    i = 0
    while i < len(at) - 1:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step, "right")) - 1)
        part, cuts = sets[at[i] : at[j]], at[i:j] - at[i]
        for r in range(REGISTERS):
            out[i:j, r] = compressed(np.minimum.reduceat(part * _MULTIPLY[r] + _ADD[r], cuts))
        i = j
    return out


def compressed(least: np.ndarray) -> np.ndarray:
    """Leading zeros in the upper 6 bits, the MANTISSA bits after the leading one below."""
    zeros = np.minimum(53 - np.frexp((least >> U(11)).astype(np.float64))[1], 53).astype(U)
    tail = (least << zeros << U(1)) >> U(64 - MANTISSA)
    return ((zeros << U(MANTISSA)) | tail).astype(np.uint16)


def folded(marks: np.ndarray) -> np.ndarray:
    """A byte of each register."""
    return ((marks * np.uint16(0x9E37)) >> np.uint16(8)).astype(np.uint8)


def likeness(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard likeness from the number of equal folded registers, less the collisions to be
    expected for sets of ``n`` and ``m``: of registers of 2^-MANTISSA resolution, and of bytes."""
    ratio = n / np.maximum(m, 1)
    chance = 0.169919487159739 / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2 + 1 / 256
    return np.clip((equal / REGISTERS - chance) / (1 - chance), 0, 1)


def _binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = tb.utf8(batch.column(1))
            for i, j in tb.pieces(offsets):
                sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                at = np.concatenate([[0], np.cumsum(sizes)])
                has = sizes > 0
                full = registers(sets, sizes)
                keys = np.zeros((j - i, 2), U)
                if has.any():
                    for c, odd in enumerate((U(1), U(0xC2B2AE3D27D4EB4F))):
                        keys[has, c] = tb.mix(np.add.reduceat(tb.mix(sets * odd + U(c)), at[:-1][has]))
                bands = tb.mix(np.ascontiguousarray(full[:, : BANDS * ROWS]).view(U) + np.arange(BANDS, dtype=np.uint64) * U(0x9E3779B97F4A7C15)).view(np.int64)
                marks = folded(full)
                spread = np.cumsum(has) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(i, j - i), pa.array(sizes), _binary([r.tobytes() for r in keys]),
                        pa.array([bands[x].tolist() if h else None for x, h in zip(spread, has, strict=True)], pa.list_(pa.int64())),
                        _binary([marks[x].tobytes() if h else None for x, h in zip(spread, has, strict=True)]),
                    ],
                    ["doc_id", "n_shingles", "class", "bands", "marks"],
                )

    return run


def _items(k: int):
    """(family, rep, text) to (family, rep, items): the set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tb.utf8(batch.column(2))
            for i, j in tb.pieces(offsets):
                sets, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], k)
                at = np.concatenate([[0], np.cumsum(sizes)])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:2]), _binary([sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])], ["family", "rep", "items"])

    return run


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose registers are at least CLOSE."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(c)), np.uint8).reshape(-1, REGISTERS) for c in (2, 3))
        n, m = (batch.column(c).to_numpy().astype(float) for c in (4, 5))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(likeness((x == y).sum(axis=1), n, m) >= CLOSE))


class _Forest:
    """Union-find over labels; ``join`` tells whether they were apart."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.above.get(x, x)) != x:
            self.above[x] = x = self.above.get(up, up)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.above[max(x, y)] = min(x, y)
        return x != y


def _pairs(out: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _near_block(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the near pairs of different labels between the block's two sides."""
    left, right = found[found["side"] == 0], found[found["side"] == 1]
    if left.empty or right.empty:
        return _pairs([])
    x, y = (np.frombuffer(b"".join(p["marks"]), np.uint8).reshape(-1, REGISTERS) for p in (left, right))
    a, b, la, lb = left["rep"].to_numpy(), right["rep"].to_numpy(), left["label"].to_numpy(), right["label"].to_numpy()
    na, nb = left["n_shingles"].to_numpy(float), right["n_shingles"].to_numpy(float)
    forest, out = _Forest(), []
    for i in range(len(a)):
        other = np.flatnonzero(lb != la[i])
        for j in other[likeness((y[other] == x[i]).sum(axis=1), na[i], nb[other]) >= CLOSE]:
            if forest.join(int(la[i]), int(lb[j])):
                out.append((int(a[i]), int(b[j])))
    return _pairs(out)


def _link_block(percent: int):
    """Links between a block's two sides on full sets, one for each two labels that they join."""

    def run(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        left, right = found[found["side"] == 0], found[found["side"] == 1]
        if left.empty or right.empty:
            return _pairs([])
        sets = [np.frombuffer(x, U) for x in right["items"]]
        size = np.array([len(x) for x in sets])
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        order = np.argsort(every, kind="stable")
        owner = owner[order]
        terms, first = np.unique(every[order], return_index=True)
        first = np.append(first, len(every))
        b, lb = right["rep"].to_numpy(), right["label"].to_numpy()
        forest, out = _Forest(), []
        for a, la, raw in zip(left["rep"], left["label"], left["items"], strict=True):
            own = np.frombuffer(raw, U)
            at = np.minimum(np.searchsorted(terms, own), len(terms) - 1)
            at = at[terms[at] == own]
            many = first[at + 1] - first[at]
            spots = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            same = np.bincount(owner[spots], minlength=len(sets))
            for j in np.flatnonzero((100 * same >= percent * (len(own) + size - same)) & (lb != la)):
                if forest.join(int(la), int(lb[j])):
                    out.append((int(a), int(b[j])))
        return _pairs(out)

    return run


def _size_class(percent: int):
    """The class of a set size: sets that are ``percent`` alike are of the same class or of the next one."""
    return F.floor(F.log(F.col("n_shingles").cast("double")) / -np.log(percent / 100 - 1e-6)).cast("int")


def _dealt(rows: DataFrame, group: list[str], carried: list[str], block: int, percent: int) -> DataFrame:
    """Deals the members of each group to blocks, so that each that isn't of the group's major label
    meets each member that its size lets it link with in one of them. ``rows``: ``group``, ``rep``,
    ``label``, ``n_shingles``, ``carried``; groups of one label only are left out.

    Members are dealt to cells by size class, being of the major label or not, and hash; two cells
    make a block if their classes are next to each other and one isn't of the major label. The
    blocks are grouped by one column of their own, so that a group's blocks go to many tasks."""
    rows = rows.withColumn("size_class", _size_class(percent))
    counts = rows.groupBy(*group, "label", "size_class").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.groupBy(*group, "label").agg(F.sum("n").alias("n"))
    groups = labels.groupBy(*group).agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count(F.lit(1)).alias("n_labels")).where("n_labels > 1").drop("n_labels")
    of_major = F.col("label") == F.col("major")
    cells = counts.join(groups, group).groupBy(*group, "major", "size_class").agg(
        F.ceil(F.coalesce(F.sum(F.when(~of_major, F.col("n"))), F.lit(0)) / block).alias("minors"), F.ceil(F.coalesce(F.sum(F.when(of_major, F.col("n"))), F.lit(0)) / block).alias("majors")
    )  # a group has few classes: they grow with the logarithm of the longest text
    cells = cells.groupBy(*group, "major").agg(F.map_from_entries(F.collect_list(F.struct("size_class", F.struct("minors", "majors")))).alias("cells"))
    rest = rows.join(cells, group).withColumn("is_major", of_major)

    def many(offset: int, kind: str):
        """The numbers of the cells of a kind whose class is ``offset`` from the row's own."""
        n = F.coalesce(F.try_element_at("cells", F.col("size_class") + offset)[kind], F.lit(0).cast("long"))
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))

    own = F.when(F.col("is_major"), F.col("cells")[F.col("size_class")]["majors"]).otherwise(F.col("cells")[F.col("size_class")]["minors"])
    rest = rest.withColumn("at", F.pmod(F.xxhash64("rep"), own))

    def spot(ci, i, cj, j, major: bool, side: int):
        return F.struct(F.struct(ci.alias("ci"), i.alias("i"), cj.alias("cj"), j.alias("j"), F.lit(major).alias("with_major")).alias("spot"), F.lit(side).alias("side"))

    c, at = F.col("size_class"), F.col("at")
    with_majors = lambda d: F.transform(many(d, "majors"), lambda j: spot(c, at, c + d, j, True, 0))
    with_minors = lambda d: F.transform(many(d, "minors"), lambda i: spot(c + d, i, c, at, True, 1))
    as_minor = F.concat(
        *map(with_majors, (-1, 0, 1)),
        F.transform(many(1, "minors"), lambda j: spot(c, at, c + 1, j, False, 0)),
        F.transform(many(-1, "minors"), lambda i: spot(c - 1, i, c, at, False, 1)),
        F.transform(F.filter(many(0, "minors"), lambda j: j >= at), lambda j: spot(c, at, c, j, False, 0)),
        F.transform(F.filter(many(0, "minors"), lambda i: i <= at), lambda i: spot(c, i, c, at, False, 1)),
    )
    as_major = F.concat(*map(with_minors, (-1, 0, 1)))
    kept = [*group, "rep", "label", "n_shingles", *carried]
    dealt = rest.select(*kept, F.explode(F.when(F.col("is_major"), as_major).otherwise(as_minor)).alias("to")).select(*kept, "to.*")
    return dealt.withColumn("spot", F.struct(*group, "spot.*"))


def _labelled(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """``rows`` with the label of ``rep`` as ``name``: itself where it has none."""
    return rows.join(labels.select(F.col("node").alias("rep"), F.col("label").alias("of")), "rep", "left").withColumn(name, F.coalesce("of", "rep")).drop("of")


def _families(classes: DataFrame, percent: int) -> DataFrame:
    """``node``, ``label`` for classes that have a near one: components of nearness."""
    own = classes.select("rep", "marks", "n_shingles")
    bands = classes.select("rep", F.explode("bands").alias("key"))
    crowd = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).where("hub <> most").select("key", "hub")
    members = written(bands.join(crowd, "key").where("rep <> hub"), "members")
    stars = members.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    sided = lambda side, m, n: own.select(F.col("rep").alias(side), F.col("marks").alias(m), F.col("n_shingles").alias(n))
    close = stars.join(sided("a", "x", "n"), "a").join(sided("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m")
    near = written(close.mapInArrow(_near, schema("a long, b long")), "near")
    labels = components(near)
    # members that are apart, though none of them is the hub they have been compared with
    placed = written(_labelled(members.select("key", "rep"), labels, "label"), "placed")
    several = placed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    late = _dealt(placed.join(several, "key").join(own, "rep"), ["key"], ["marks"], BLOCK, percent).groupBy("spot").applyInPandas(_near_block, "a long, b long")
    late = written(late.distinct(), "late")
    return labels if late.isEmpty() else components(near.union(late))


def _links(families: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Links on full sets that span the components of every family."""
    where = families.select(F.col("node").alias("rep"), F.col("label").alias("family"))
    few = where.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(where) if few else where, "rep").groupBy("family", "rep").agg(F.min("text").alias("text"))
    sets = written(texts.mapInArrow(_items(k), schema("family long, rep long, items binary")), "sets").withColumn("n_shingles", (F.octet_length("items") / 8).cast("long"))
    one = F.col("family") == F.col("rep")
    counts = where.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / SETS).alias("parts"))
    dealt = sets.join(counts, "family")
    parts = F.when(one, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), F.col("parts"))))
    dealt = dealt.select("family", "rep", F.col("rep").alias("label"), "items", F.when(one, 0).otherwise(1).alias("side"), F.explode(parts).alias("part")).withColumn("spot", F.struct("family", "part"))
    stars = written(dealt.groupBy("spot").applyInPandas(_link_block(percent), "a long, b long"), "star_links")
    linked = stars.select(F.col("b").alias("node"), F.col("a").alias("label"))
    rows = _labelled(sets, linked, "label")
    apart = written(rows.where("label <> family").select("family").distinct().join(counts, "family"), "apart")
    left = rows.join(apart, "family")
    if not apart.where("parts > 1").isEmpty():
        parted = _parted(left.where("parts > 1"), percent)
        left = left.where("parts = 1").select(*rows.columns).union(left.where("parts > 1").drop("family", "parts").join(parted, "rep").select(*rows.columns))
    more = _dealt(left.select(*rows.columns), ["family"], ["items"], SETS, percent).groupBy("spot").applyInPandas(_link_block(percent), "a long, b long")
    return stars.union(written(more, "more_links"))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(family, rep, n_shingles, items) to a row for each shingle."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            b = batch.slice(i, 256)
            found = [np.frombuffer(x.as_py(), np.int64) for x in b.column(3)]
            row = pa.array(np.repeat(np.arange(b.num_rows), [len(x) for x in found]))
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in b.columns[:3]), pa.array(np.concatenate(found) if found else np.empty(0, np.int64))], ["family", "rep", "n_shingles", "term"])


def _parted(sets: DataFrame, percent: int) -> DataFrame:
    """``rep``, ``family`` for members of large families: the family falls into the parts that rare
    shingles hold together; who shares none is left out.

    Shingles are taken in the order of how many members hold them, then of their hash. Of two linked
    sets of ``n`` <= ``m`` shingles at least ceil(percent m / 100) and ceil(2 percent n / (100 + percent)) are
    shared, so the first shared one is among the first m + 1 less that many of the larger set and the
    first n + 1 less that many, fewer, of the smaller one: links lie within the components of members
    and shingles that some member holds so early. The edges are linear in the sets; a shingle of one member only
    makes none, so members that are alike in a common frame only come apart here.
    """
    terms = sets.select("family", "rep", "n_shingles", "items").mapInArrow(_terms, schema("family long, rep long, n_shingles long, term long"))
    shared = terms.groupBy("family", "term").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1")
    held = terms.join(shared, ["family", "term"])
    of_one = Window.partitionBy("rep")
    alone = F.col("n_shingles") - F.count(F.lit(1)).over(of_one)  # these come first
    rank = alone + F.row_number().over(of_one.orderBy("holders", "term"))
    late = F.col("n_shingles") + 1 - F.expr(f"({percent} * n_shingles + 99) div 100")
    early = F.col("n_shingles") + 1 - F.expr(f"({2 * percent} * n_shingles + {99 + percent}) div {100 + percent}")
    rare = held.withColumn("rank", rank).where(F.col("rank") <= late).select("family", "rep", "term", (F.col("rank") <= early).alias("early"))
    rare = written(rare, "rare")
    hubs = rare.groupBy("family", "term").agg(F.min("rep").alias("hub"), F.max("rep").alias("most"), F.bool_or("early").alias("early")).where("hub <> most AND early").select("family", "term", "hub")
    return components(rare.join(hubs, ["family", "term"]).select(F.col("hub").alias("a"), F.col("rep").alias("b"))).select(F.col("node").alias("rep"), F.col("label").alias("family"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable over links), ``kept``.

    ``docs`` needs ``doc_id`` (long) and ``text``; other columns are ignored, whatever their names.
    Documents are linked if 100 x intersection >= ``percent`` x union of their shingle sets. Null
    and empty texts and texts without words have an empty set and no link. Rows without an id are
    returned with their set size, no component and ``kept`` true, and link nothing. Rows that repeat
    an id must repeat its text; ``kept`` is that of the id, so all of them have the same. Ties don't
    arise: ids are compared. Texts may be of any length; a set is held whole by the task that makes it. An empty
    table gives an empty result. ``percent`` should be 80 or more: the bands are set for that.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = written(docs.mapInArrow(_sketch(k), schema("doc_id long, n_shingles long, class binary, bands array<long>, marks binary")), "sketches")
    found = made.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("class").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands", "marks"), "doc_id").alias("c"))
    classes = written(found.select("class", F.col("c.doc_id").alias("rep"), "c.n_shingles", "c.bands", "c.marks"), "classes")
    labels = components(_links(_families(classes, percent), docs, k, percent))
    ids = _labelled(classes.select("class", "rep"), labels, "of_class").select("class", "of_class")
    out = made.select("doc_id", "n_shingles", "class").join(ids, "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of_class", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` by two-word shingles at a likeness of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


#: All pairs of classes of equal sets that share a shingle, and what is reachable over links.
OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) = 1 THEN words[1] ELSE words[i] || ' ' || words[i + 1] END AS shingle
      FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words), 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, '  ' ORDER BY shingle)) AS class FROM s GROUP BY doc_id),
c AS (SELECT class, min(doc_id) AS rep, any_value(n) AS n FROM n GROUP BY class),
t AS (SELECT rep, n, shingle FROM c JOIN s ON s.doc_id = c.rep),
shared AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n + b.n) AS total, count(*) AS same FROM t a JOIN t b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM shared WHERE 100 * same >= 80 * (total - same)),
reach AS (SELECT rep AS a, rep AS b FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS label FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(label, d.doc_id) AS component_id, coalesce(label, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (class) LEFT JOIN least ON least.a = c.rep"""
