"""Words of a whole Arrow batch at once: numpy over the concatenated UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 1 << 64
_INVERSE = pow(_BASE, -1, _STEP)
_powers: dict[int, np.ndarray] = {}

#: ASCII white space that parts words: a space and the bytes 9 to 13.
SPACES = b" \t\n\x0b\x0c\r"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(SPACES)] = False


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, one after another, and the n + 1 offsets of the rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    if column.buffers()[2] is None or not len(column):
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(rows, max(first + 1, last))
        yield first, last
        first = last


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.full(size, U(base & (_STEP - 1)))
        out[0] = 1
        have = np.multiply.accumulate(out)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bits of a 64-bit number spread over all of it (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * powers(_BASE, len(data)), out=total[1:])
    own = (total[ends] - total[starts]) * powers(_INVERSE, len(data) + 1)[starts]
    return mix(own + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes for which ``inside`` holds."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, none
    is_in = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_in[:-1]
    heads = offsets[:-1]
    before[heads[heads < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_in[1:]
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    starts = np.flatnonzero(is_in & ~before)
    return starts, np.flatnonzero(is_in & ~after) + 1, np.searchsorted(offsets[1:], starts, "right")
