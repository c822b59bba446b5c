"""Progressive JPEG in numpy: scans to coefficients, coefficients to scans, coefficients to RGB.

Coefficients are held per component as an int16 array (block rows, block columns, 64) in zigzag
order. Scans of either kind, spectral selection and successive approximation, are accumulated into
these arrays. Symbols are read one by one, except where a whole run of them has known places: a
table with a single code and no run, correction bits of an end-of-band run, DC refinements.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field

import numpy as np

ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_MARKER = re.compile(rb"\xff[^\x00\xff\xd0-\xd7]")
_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


class JpegError(ValueError):
    pass


@dataclass
class Component:
    id: int
    h: int
    v: int
    table: int
    coef: np.ndarray  # padded to whole units
    rows: int  # blocks of the component itself, as scans of one component have them
    columns: int


@dataclass
class Image:
    width: int
    height: int
    components: list[Component]
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    comment: bytes = b""


# -- Huffman tables -----------------------------------------------------------------------------


@functools.lru_cache(256)
def _table(counts: bytes, symbols: bytes) -> tuple[list[int], tuple[int, int, int] | None]:
    """For each 16 bits: symbol << 8 | length (0: no code). Also the only code, as symbol, length, bits."""
    lut = np.zeros(1 << 16, np.int64)
    code = at = 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            lut[code << (16 - length) : (code + 1) << (16 - length)] = symbols[at] << 8 | length
            code, at = code + 1, at + 1
        code <<= 1
    return lut.tolist(), (symbols[0], counts.index(1) + 1, 0) if len(symbols) == 1 else None


def _flat(symbols: bytes) -> tuple[bytes, bytes, dict[int, int], int]:
    """A table in which all symbols have codes of one length; the code of all ones stays free."""
    length = len(symbols).bit_length()
    return bytes(len(symbols) if i == length else 0 for i in range(1, 17)), symbols, {s: i for i, s in enumerate(symbols)}, length


def _dht(kind: int, counts: bytes, symbols: bytes) -> bytes:
    return b"\xff\xc4" + (19 + len(symbols)).to_bytes(2, "big") + bytes([kind << 4]) + counts + symbols


# -- reading ------------------------------------------------------------------------------------


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)
        self._all: np.ndarray | None = None

    def symbol(self, lut: list[int]) -> int:
        q = self.at >> 3
        found = lut[(int.from_bytes(self.data[q : q + 3], "big") >> (8 - (self.at & 7))) & 0xFFFF]
        if not found or self.at >= self.end:
            raise JpegError("no such code")
        self.at += found & 0xFF
        return found >> 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        q = self.at >> 3
        out = (int.from_bytes(self.data[q : q + 4], "big") >> (32 - (self.at & 7) - n)) & ((1 << n) - 1)
        self.at += n
        return out

    def many(self, n: int) -> np.ndarray:
        if self.at + n > self.end:
            raise JpegError("the scan ends early")
        q, skip = self.at >> 3, self.at & 7
        out = np.unpackbits(np.frombuffer(self.data, np.uint8, (skip + n + 7) >> 3, q))[skip : skip + n]
        self.at += n
        return out


def _signed(value: int, size: int) -> int:
    return value if not size or value >> (size - 1) else value - (1 << size) + 1


def _dc_first(bits: _Bits, luts: list, order: np.ndarray, parts: np.ndarray, low: int) -> np.ndarray:
    """Values of the blocks in scan order; parts: the component of each."""
    out, last = [], [0] * len(luts)
    data, at = bits.data, bits.at
    for c in parts.tolist():
        q = at >> 3
        window = int.from_bytes(data[q : q + 5], "big") << (at & 7)
        found = luts[c][(window >> 24) & 0xFFFF]
        if not found:
            raise JpegError("no such code")
        length, size = found & 0xFF, found >> 8
        at += length + size
        if size:
            value = (window >> (40 - length - size)) & ((1 << size) - 1)
            last[c] += value if value >> (size - 1) else value - (1 << size) + 1
        out.append(last[c])
    if at > bits.end:
        raise JpegError("the scan ends early")
    bits.at = at
    return np.array(out, np.int64) << low


def _ac_first(bits: _Bits, table, band: np.ndarray, low: int) -> None:
    lut, single = table
    n, width = band.shape
    if single and 0 < single[0] < 16:
        size, length, code = single
        if size + length == 8:
            q, skip = divmod(bits.at, 8)
            if not skip and bits.at + 8 * n * width <= bits.end:
                value = np.frombuffer(bits.data, np.uint8, n * width, q)
                if (value >> size).any():
                    raise JpegError("no such code")
                bits.at += 8 * n * width
                value = value.astype(np.int16)
                value -= (value < 1 << (size - 1)) * np.int16((1 << size) - 1)
                band[:] = (value << low).reshape(n, width)
                return
        each = bits.many(n * width * (size + length)).reshape(-1, size + length)
        if each[:, :length].any():
            raise JpegError("no such code")
        value = (each[:, length:] @ (1 << np.arange(size - 1, -1, -1))).astype(np.int64)
        value -= (value < 1 << (size - 1)) * ((1 << size) - 1)
        band[:] = (value << low).reshape(n, width)
        return
    i = 0
    while i < n:
        k = 0
        while k < width:
            found = bits.symbol(lut)
            run, size = found >> 4, found & 15
            if size:
                k += run
                if k >= width:
                    raise JpegError("a coefficient outside its band")
                band[i, k] = _signed(bits.take(size), size) << low
                k += 1
            elif run == 15:
                k += 16
            else:
                i += (1 << run) + bits.take(run) - 1
                break
        i += 1


def _correct(bits: _Bits, values: np.ndarray, low: int) -> np.ndarray:
    """Adds a correction bit to each value that isn't 0 and doesn't have that bit."""
    flat = values.reshape(-1)
    some = np.flatnonzero(flat) if not flat.all() else slice(None)
    old = flat[some]
    more = bits.many(len(old)).astype(bool) & (np.abs(old) & (1 << low) == 0)
    flat[some] = old + np.where(more, np.sign(old), 0).astype(np.int16) * np.int16(1 << low)
    return flat.reshape(values.shape)


def _ac_refine(bits: _Bits, table, band: np.ndarray, low: int) -> None:
    lut, _ = table
    n, width = band.shape
    i = 0
    while i < n:
        k = 0
        while k < width:
            found = bits.symbol(lut)
            run, size = found >> 4, found & 15
            value = 0
            if size:
                value = (1 if bits.take(1) else -1) << low
            elif run < 15:
                over = (1 << run) + bits.take(run)
                if k:
                    band[i, k:] = _correct(bits, band[i, k:].copy(), low)
                    i, over = i + 1, over - 1
                if over:
                    band[i : i + over] = _correct(bits, band[i : i + over].copy(), low)
                    i += over
                i -= 1  # the block is counted below
                break
            while k < width:
                old = int(band[i, k])
                if old:
                    if bits.take(1) and not abs(old) & (1 << low):
                        band[i, k] = old + ((1 << low) if old > 0 else -(1 << low))
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if value:
                if k >= width:
                    raise JpegError("a coefficient outside its band")
                band[i, k] = value
            k += 1
        i += 1


@functools.lru_cache(512)
def _interleaved(shape: tuple[tuple[int, int], ...], rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """For whole units of components of sampling (h, v): each block's component and its place there."""
    parts, places = [], []
    for c, (h, v) in enumerate(shape):
        y, x = np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij")
        inner = [(y * v + j) * columns * h + x * h + i for j in range(v) for i in range(h)]
        places.append(np.stack(inner, axis=-1).reshape(rows * columns, h * v))
        parts.append(np.full((rows * columns, h * v), c))
    return np.concatenate(parts, axis=1).reshape(-1), np.concatenate(places, axis=1).reshape(-1)


def read_coefficients(data: bytes) -> Image:
    """The coefficient arrays of a progressive image. Other kinds raise JpegError."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG")
    at, image, tables, restart = 2, None, {}, 0
    quant: dict[int, np.ndarray] = {}
    comment = b""
    while True:
        if data[at] != 0xFF:
            raise JpegError("a marker was expected")
        kind = data[at + 1]
        if kind == 0xD9:
            break
        if kind == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[1 + n :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif kind == 0xFE:
            comment = body
        elif kind == 0xC2:
            height, width, many = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5]
            spec = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(many)]
            hm, vm = max(x[1] for x in spec), max(x[2] for x in spec)
            units_x, units_y = -(-width // (8 * hm)), -(-height // (8 * vm))
            image = Image(width, height, [Component(i, h, v, t, np.zeros((units_y * v, units_x * h, 64), np.int16), -(-(-(-height * v // vm)) // 8), -(-(-(-width * h // hm)) // 8)) for i, h, v, t in spec], quant)
        elif kind in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise JpegError("only progressive Huffman-coded images are read")
        elif kind == 0xDA:
            end = _MARKER.search(data, at)
            if image is None or end is None:
                raise JpegError("a scan without a frame or an end")
            _scan(image, tables, body, data[at : end.start()], restart)
            at = end.start()
    if image is None:
        raise JpegError("no frame")
    image.comment = comment
    return image


def _scan(image: Image, tables: dict, head: bytes, data: bytes, restart: int) -> None:
    many = head[0]
    chosen = [(next(c for c in image.components if c.id == head[1 + 2 * i]), head[2 + 2 * i]) for i in range(many)]
    first, last, high, low = head[1 + 2 * many], head[2 + 2 * many], head[3 + 2 * many] >> 4, head[3 + 2 * many] & 15
    flats, luts = [c.coef.reshape(-1, 64) for c, _ in chosen], [tables.get(t >> 4) if not first else tables.get(16 | t & 15) for _, t in chosen]
    if many > 1:
        c = chosen[0][0]
        parts, places = _interleaved(tuple((c.h, c.v) for c, _ in chosen), c.coef.shape[0] // c.v, c.coef.shape[1] // c.h)
        unit = sum(c.h * c.v for c, _ in chosen)
    else:
        c = chosen[0][0]
        if (c.rows, c.columns) == c.coef.shape[:2]:
            places = np.arange(c.rows * c.columns)
        else:
            places = (np.arange(c.rows)[:, None] * c.coef.shape[1] + np.arange(c.columns)).reshape(-1)
        parts, unit = np.zeros(len(places), np.int64), 1
    segments = _RESTART.split(data) if restart else [data]
    step = restart * unit if restart else len(places)
    for i, segment in enumerate(segments):
        bits = _Bits(segment.replace(b"\xff\x00", b"\xff"))
        part, place = parts[i * step : (i + 1) * step], places[i * step : (i + 1) * step]
        if first == 0:
            if high:
                value = bits.many(len(place)).astype(np.int16) << low
            else:
                value = _dc_first(bits, [x[0] for x in luts], place, part, low).astype(np.int16)
            for j, flat in enumerate(flats):
                own = slice(None) if many == 1 else part == j
                if high:
                    flat[place[own], 0] |= value[own]
                else:
                    flat[place[own], 0] = value[own]
            continue
        whole = len(place) == len(flats[0])
        band = flats[0][:, first : last + 1] if whole else flats[0][place, first : last + 1]
        (_ac_refine if high else _ac_first)(bits, luts[0], band, low)
        if not whole:
            flats[0][place, first : last + 1] = band


# -- writing ------------------------------------------------------------------------------------


def _packed(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Bits of numbers of up to 32 bits one after another."""
    wide = int(lengths.max()) if len(lengths) else 0
    grid = (values[:, None] >> (lengths[:, None] - 1 - np.arange(wide))) & 1
    return grid[np.arange(wide) < lengths[:, None]].astype(np.uint8)


def _closed(bits: np.ndarray) -> bytes:
    fill = -len(bits) % 8
    data = np.packbits(np.append(bits, np.ones(fill, np.uint8)) if fill else bits).tobytes()
    return data.replace(b"\xff", b"\xff\x00")


_DC = _flat(bytes(range(12)))
_RUNS = _flat(bytes(r << 4 for r in range(15)))


def _sizes(values: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(values).astype(np.float64))[1]


def _write_dc_first(diffs: np.ndarray) -> tuple[bytes, bytes]:
    size = _sizes(diffs)
    extra = np.where(diffs < 0, diffs + (1 << size) - 1, diffs)
    return _dht(0, *_DC[:2]), _closed(_packed((size << size) | extra, size + _DC[3]))


def _write_symbols(made: list[tuple[int, int, int]], tail: dict[int, np.ndarray] | None = None) -> tuple[bytes, bytes]:
    """made: (symbol, extra bits, how many); tail: bits that follow the symbol at a position."""
    symbols = bytes(sorted({s for s, _, _ in made}))
    counts, symbols, codes, length = _flat(symbols) if len(symbols) != 1 else (b"\x01" + bytes(15), symbols, {symbols[0]: 0}, 1)
    bits = []
    for i, (s, extra, n) in enumerate(made):
        bits.append(_packed(np.array([(codes[s] << n) | extra], np.int64), np.array([length + n])))
        if tail and i in tail:
            bits.append(tail[i])
    return _dht(1, counts, symbols), _closed(np.concatenate(bits) if bits else np.empty(0, np.uint8))


def _runs(n: int) -> list[tuple[int, int, int]]:
    r = n.bit_length() - 1
    return [(r << 4, n - (1 << r), r)]


def _write_ac_first(band: np.ndarray, low: int) -> tuple[bytes, bytes]:
    size_of = np.abs(band) >> low
    least, most = int(size_of.min()), int(size_of.max())
    if least and (s := least.bit_length()) == most.bit_length():  # no zero and one size: one code does
        extra = np.where(band < 0, ((1 << s) - 1) - size_of, size_of)
        table = _dht(1, b"\x01" + bytes(15), bytes([s]))
        if s == 7:
            return table, extra.astype(np.uint8).tobytes()
        return table, _closed(_packed(extra.reshape(-1).astype(np.int64), np.full(extra.size, s + 1)))
    values = np.sign(band) * size_of
    made: list[tuple[int, int, int]] = []
    idle = 0

    def flush() -> None:
        nonlocal idle
        while idle:
            n = min(idle, 0x7FFF)
            made.extend(_runs(n))
            idle -= n

    for row in values.tolist():
        run, some = 0, False
        for v in row:
            if not v:
                run += 1
                continue
            flush()
            while run > 15:
                made.append((0xF0, 0, 0))
                run -= 16
            n = abs(v).bit_length()
            made.append((run << 4 | n, v if v > 0 else v + (1 << n) - 1, n))
            run = 0
        if run:
            idle += 1
    flush()
    return _write_symbols(made)


def _write_ac_refine(band: np.ndarray, low: int) -> tuple[bytes, bytes]:
    size_of = np.abs(band) >> low
    if int(size_of.min()) > 1:  # all known: end-of-band runs, then a bit for each
        n = len(band)
        bits = (size_of & 1).astype(np.uint8)
        parts = []
        for i in range(0, n, 0x7FFF):
            (s, extra, r), = _runs(min(0x7FFF, n - i))
            parts.append(_packed(np.array([(_RUNS[2][s] << r) | extra]), np.array([_RUNS[3] + r])))
            parts.append(bits[i : i + 0x7FFF].reshape(-1))
        return _dht(1, *_RUNS[:2]), _closed(np.concatenate(parts))
    made, tail = [], {}
    for row, signs in zip(size_of.tolist(), (band > 0).tolist(), strict=True):
        run, wait = 0, []
        last = max((k for k, v in enumerate(row) if v == 1), default=-1)
        for k, v in enumerate(row):
            if k > last:
                break
            if not v:
                run += 1
            elif v > 1:
                wait.append(v & 1)
            if run == 16 and k < last and not v:
                tail[len(made)] = np.array(wait, np.uint8)
                made.append((0xF0, 0, 0))
                run, wait = 0, []
            if v == 1:
                tail[len(made)] = np.array(wait, np.uint8)
                made.append((run << 4 | 1, int(signs[k]), 1))
                run, wait = 0, []
        if last < len(row) - 1:
            tail[len(made)] = np.array(wait + [v & 1 for v in row[last + 1 :] if v > 1], np.uint8)
            made.append((0, 0, 0))
    return _write_symbols(made, tail)


#: (components, first and last coefficient, approximation high and low) of each scan of three components.
SCANS = (
    ((0, 1, 2), 0, 0, 0, 1), ((0,), 1, 5, 0, 1), ((1,), 1, 63, 0, 1), ((2,), 1, 63, 0, 1), ((0,), 6, 63, 0, 1),
    ((0, 1, 2), 0, 0, 1, 0), ((1,), 1, 63, 1, 0), ((2,), 1, 63, 1, 0), ((0,), 1, 63, 1, 0),
)


def write_coefficients(image: Image, scans=SCANS) -> bytes:
    """A progressive image of these coefficients. Components must fill whole units."""
    out = [b"\xff\xd8"]
    if image.comment:
        out.append(b"\xff\xfe" + (2 + len(image.comment)).to_bytes(2, "big") + image.comment)
    for i, q in image.quant.items():
        out.append(b"\xff\xdb\x00\x43" + bytes([i]) + q.astype(np.uint8).tobytes())
    parts = image.components
    out.append(b"\xff\xc2" + (8 + 3 * len(parts)).to_bytes(2, "big") + b"\x08" + image.height.to_bytes(2, "big") + image.width.to_bytes(2, "big") + bytes([len(parts)]) + b"".join(bytes([c.id, c.h << 4 | c.v, c.table]) for c in parts))
    flats = [c.coef.reshape(-1, 64) for c in parts]
    for chosen, first, last, high, low in scans:
        if first == 0:
            if len(chosen) > 1:
                c = parts[chosen[0]]
                part, place = _interleaved(tuple((parts[j].h, parts[j].v) for j in chosen), c.coef.shape[0] // c.v, c.coef.shape[1] // c.h)
            else:
                part, place = np.zeros(len(flats[chosen[0]]), np.int64), np.arange(len(flats[chosen[0]]))
            value = np.empty(len(part), np.int64)
            diffs = np.empty(len(part), np.int64)
            for j, x in enumerate(chosen):
                own = np.flatnonzero(part == j)
                value[own] = flats[x][place[own], 0]
                diffs[own] = np.diff(value[own] >> low, prepend=0)
            table, data = (b"", _closed(((value >> low) & 1).astype(np.uint8))) if high else _write_dc_first(diffs)
        else:
            table, data = (_write_ac_refine if high else _write_ac_first)(flats[chosen[0]][:, first : last + 1], low)
        out.append(table)
        out.append(b"\xff\xda" + (6 + 2 * len(chosen)).to_bytes(2, "big") + bytes([len(chosen)]) + b"".join(bytes([parts[j].id, 0]) for j in chosen) + bytes([first, last, high << 4 | low]))
        out.append(data)
    out.append(b"\xff\xd9")
    return b"".join(out)


# -- pixels -------------------------------------------------------------------------------------


def _inverse() -> np.ndarray:
    """Coefficients in zigzag order (64) to samples in row order (64)."""
    x = np.arange(8)
    basis = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x[:, None] == 0, np.sqrt(1 / 8), 0.5)
    return np.einsum("vy,ux->vuyx", basis, basis).reshape(64, 64)[ZIGZAG].astype(np.float32)


INVERSE = _inverse()


def plane(component: Component, quant: np.ndarray) -> np.ndarray:
    """The samples of a component, as float32 around 128."""
    rows, columns, _ = component.coef.shape
    samples = (component.coef.reshape(-1, 64).astype(np.float32) * quant) @ INVERSE
    return samples.reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8) + np.float32(128)


def to_rgb(image: Image) -> np.ndarray:
    """Height x width x 3 of uint8, chroma upsampled to full resolution; grey is repeated."""
    hm, vm = max(c.h for c in image.components), max(c.v for c in image.components)
    planes = []
    for c in image.components:
        p = np.clip(plane(c, image.quant[c.table]), 0, 255)
        if hm // c.h > 1 or vm // c.v > 1:
            p = p.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)
        planes.append(p[: image.height, : image.width])
    if len(planes) == 1:
        planes = planes * 3
    else:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + np.float32(1.402) * cr, y - np.float32(0.344136) * cb - np.float32(0.714136) * cr, y + np.float32(1.772) * cb]
    out = np.empty((image.height, image.width, 3), np.uint8)
    for i, p in enumerate(planes):
        out[..., i] = np.clip(p + np.float32(0.5), 0, 255)
    return out
