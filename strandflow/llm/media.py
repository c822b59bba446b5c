"""Media columns: bytes kept losslessly in progressive JPEGs, and JPEGs opened to RGB tensors.

A payload is stored in the coefficients, the unit in which JPEG is lossless: 64 bytes a block, byte
``b`` as the coefficient ``b`` (from 128 on) or ``b - 255``, so all have eight bits and none is 0. Two
thirds of the blocks are luma, the rest chroma at half resolution; blocks to fill the last units
hold zero bytes. The payload's length is in the comment.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import jpeg
from strandflow.llm.common import extended, ship, table

BLOCK, UNIT, UNITS_WIDE = 64, 6, 256
#: Units across or down in a JPEG, of 16 pixels each.
MOST = 4095
_ONES = np.ones(64, np.float32)


def padded(raw: bytes) -> bytes:
    """Zero bytes up to a positive multiple of BLOCK."""
    return raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def grid(units: int) -> tuple[int, int]:
    """Units across and down: UNITS_WIDE across, or as many more as keep the height within MOST."""
    high = -(-units // max(UNITS_WIDE, -(-units // MOST)))
    wide = -(-units // high)
    if wide > MOST:
        raise ValueError("a JPEG holds 4095 x 4095 units of 384 bytes at most")
    return wide, high


def store(payload: bytes) -> bytes:
    """A progressive JPEG of a payload whose length is a positive multiple of BLOCK."""
    units = -(-len(payload) // (BLOCK * UNIT))
    wide, high = grid(units)
    n = wide * high
    coef = np.zeros(n * UNIT * BLOCK, np.int16)
    coef[: len(payload)] = np.frombuffer(payload, np.uint8)
    coef -= (coef < 128) * np.int16(255)
    coef = coef.reshape(-1, 64)
    parts = [
        jpeg.Component(1, 2, 2, 0, coef[: 4 * n].reshape(2 * high, 2 * wide, 64), 2 * high, 2 * wide),
        jpeg.Component(2, 1, 1, 0, coef[4 * n : 5 * n].reshape(high, wide, 64), high, wide),
        jpeg.Component(3, 1, 1, 0, coef[5 * n :].reshape(high, wide, 64), high, wide),
    ]
    return jpeg.write_coefficients(jpeg.Image(16 * wide, 16 * high, parts, {0: _ONES}, b"payload %d" % len(payload)))


def restore(image: jpeg.Image) -> bytes:
    """The payload of an image made by ``store``, from its coefficients."""
    coef = np.concatenate([c.coef.reshape(-1) for c in image.components])
    coef = coef + (coef < 0) * np.int16(255)
    return coef[: int(image.comment.split()[1])].astype(np.uint8).tobytes()


def with_media(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without ``column``, with ``n_bytes`` and ``media`` (the stored form) appended;
    columns of those names are replaced. Null is stored as an empty payload."""
    ship(docs.sparkSession)
    docs = docs.drop("n_bytes", "media")
    at = docs.columns.index(column)
    kept = docs.drop(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                raw = [(x.as_py() or "").encode() for x in b.column(at)]
                others = [c for j, c in enumerate(b.columns) if j != at]
                names = [c for j, c in enumerate(b.schema.names) if j != at]
                yield pa.RecordBatch.from_arrays([*others, pa.array([len(x) for x in raw], pa.int64()), pa.array([store(padded(x)) for x in raw], pa.binary())], [*names, "n_bytes", "media"])

    return docs.mapInArrow(run, extended(kept, "n_bytes long, media binary"))


def opened(media: DataFrame) -> DataFrame:
    """``media`` without the column ``media``, with ``height``, ``width``, ``rgb`` (bytes, row by
    row, three a pixel) and ``error`` appended. A null or unreadable image has null sizes and pixels."""

    def made(data: bytes | None):
        if data is None:
            return None, None, None, None
        try:
            pixels = jpeg.to_rgb(jpeg.read_coefficients(data))
        except (jpeg.JpegError, IndexError, KeyError, StopIteration) as e:
            return None, None, None, f"{type(e).__name__}: {e}"
        return *pixels.shape[:2], pixels.tobytes(), None

    return _per_image(media, made, "height int, width int, rgb binary, error string")


def _per_image(media: DataFrame, made, spec: str) -> DataFrame:
    ship(media.sparkSession)
    names = [x.split()[0] for x in spec.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in spec.split(", ")]
    media = media.drop(*names)
    at = media.columns.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                rows = [made(x.as_py()) for x in b.column(at)]
                others = [(n, c) for j, (n, c) in enumerate(zip(b.schema.names, b.columns, strict=True)) if j != at]
                yield pa.RecordBatch.from_arrays([*(c for _, c in others), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True))], [*(n for n, _ in others), *names])

    return media.mapInArrow(run, extended(media.drop("media"), spec))


def digests(data: bytes) -> tuple:
    """What the query returns of a stored payload: all of it is read back from ``data``."""
    image = jpeg.read_coefficients(data)
    payload = restore(image)
    pixels = jpeg.to_rgb(image)
    mean = pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (pixels.size // 3)
    feature = f"{pixels.shape[0]}x{pixels.shape[1]}x3 mean {mean[0]:.2f} {mean[1]:.2f} {mean[2]:.2f}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(data), hashlib.sha256(data).hexdigest(), feature


def op4_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` stored as progressive JPEGs, read back; a null text is empty, repeated rows are each stored,
    a text may have up to 6.4 GB, what a JPEG holds."""
    stored = with_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return _per_image(stored, digests, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
