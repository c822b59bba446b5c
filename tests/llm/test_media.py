import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.llm import jpeg, media


def random_image(rng, share, h=1, v=1, units=(2, 3)):
    def coef(rows, columns):
        c = np.round(rng.normal(0, 20, (rows, columns, 64)) * (rng.random((rows, columns, 64)) < share)).astype(np.int16)
        c[..., 0] = rng.integers(-500, 500, (rows, columns))
        return c

    y, x = units
    parts = [jpeg.Component(1, h, v, 0, coef(y * v, x * h), y * v, x * h), jpeg.Component(2, 1, 1, 0, coef(y, x), y, x), jpeg.Component(3, 1, 1, 0, coef(y, x), y, x)]
    return jpeg.Image(8 * h * x, 8 * v * y, parts, {0: np.full(64, 2, np.float32)})


@pytest.mark.parametrize("share", [0, 0.02, 0.3, 1])
@pytest.mark.parametrize("sampling", [(1, 1), (2, 2), (2, 1)])
def test_coefficients_come_back(share, sampling):
    image = random_image(np.random.default_rng(int(share * 100)), share, *sampling)
    back = jpeg.read_coefficients(jpeg.write_coefficients(image))
    for a, b in zip(image.components, back.components, strict=True):
        assert (a.coef == b.coef).all()


def test_other_scan_scripts():
    image = random_image(np.random.default_rng(1), 0.4)
    deep = [((0, 1, 2), 0, 0, 0, 2), *(((c,), 1, 63, 0, 3) for c in range(3)), ((0, 1, 2), 0, 0, 2, 1), *(((c,), 1, 63, 3, 2) for c in range(3)), ((0, 1, 2), 0, 0, 1, 0), *(((c,), 1, 63, 2, 1) for c in range(3)), *(((c,), a, b, 1, 0) for c in range(3) for a, b in ((1, 9), (10, 63)))]
    back = jpeg.read_coefficients(jpeg.write_coefficients(image, deep))
    for a, b in zip(image.components, back.components, strict=True):
        assert (a.coef == b.coef).all()


@pytest.mark.parametrize("share", [0.05, 0.5])
def test_pixels_are_those_of_another_decoder(spark, tmp_path, share):
    """The JVM has a JPEG reader of its own; without subsampling both give the same pixels but for rounding."""
    image = random_image(np.random.default_rng(9), share)
    for c in image.components:
        c.coef //= 4
    data = jpeg.write_coefficients(image)
    (tmp_path / "x.jpg").write_bytes(data)
    ours = jpeg.to_rgb(jpeg.read_coefficients(data)).astype(int)
    jvm = spark.sparkContext._jvm
    other = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(str(tmp_path / "x.jpg")))
    h, w = ours.shape[:2]
    px = np.array(list(other.getRGB(0, 0, w, h, None, 0, w))).astype(np.int64)
    theirs = np.stack([(px >> 16) & 255, (px >> 8) & 255, px & 255], -1).reshape(h, w, 3)
    assert np.abs(ours - theirs).max() <= 3


@pytest.mark.parametrize("raw", [b"", b"a", bytes(range(256)) * 5, b"\xff" * 1000, b"\x00" * 64, "é漢🙂".encode() * 700, b"q" * 250_000])
def test_payloads_come_back(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload.startswith(raw) and len(payload) - len(raw) <= 64
    data = media.store(payload)
    assert media.restore(jpeg.read_coefficients(data)) == payload and len(data) <= 1.2 * len(payload) + 1500


def test_long_payloads_make_wider_images(monkeypatch):
    for units in (1, 255, 256, 257, 1_000_000, 4095 * 256, 4095 * 256 + 1, 5_592_406, 4095 * 4095):
        wide, high = media.grid(units)
        assert units <= wide * high < units + high and 0 < wide <= 4095 and 0 < high <= 4095 and (wide <= 256 or units > 4095 * 256)
    with pytest.raises(ValueError):
        media.grid(4095 * 4095 + 1)
    monkeypatch.setattr(media, "MOST", 5)
    monkeypatch.setattr(media, "UNITS_WIDE", 2)
    payload = media.padded(bytes(range(256)) * 36)  # 24 units, more than 2 x 5
    assert media.grid(24) == (5, 5) and media.restore(jpeg.read_coefficients(media.store(payload))) == payload


@pytest.mark.parametrize("data", [b"", b"\xff\xd8", b"not an image at all", media.store(media.padded(b"x" * 500))[:300]])
def test_broken_images(spark, data):
    row = media.opened(spark.createDataFrame([(1, data)], "id long, media binary")).collect()[0]
    assert row.rgb is None and row.error


def test_columns(spark, docs_of):
    rows = [(1, "text"), (2, None), (3, ""), (4, "text"), (5, "x" * 9000)]
    stored = media.with_media(docs_of(rows).withColumns({"media": F.lit(1), "rgb": F.lit("x"), "N_BYTES": F.lit(2)}))
    got = {r.doc_id: r for r in media.opened(stored).collect()}
    assert len(got[1].rgb) == got[1].height * got[1].width * 3 and got[1].rgb == got[4].rgb and got[2].rgb == got[3].rgb and got[1].error is None
    assert media.opened(spark.createDataFrame([(1, None)], "id long, media binary")).collect()[0].rgb is None
    assert media.with_media(docs_of([])).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    found = media.op4_progressive_jpeg(spark, d).collect()
    assert {r.doc_id for r in found} == set(texts)
    for r in found:
        payload = media.padded(texts[r.doc_id].encode())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id].encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
