"""TIFF folders by row ranges against the image reader and against plain arrays."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from tests.test_sources import crop
from tests.test_sources import tiff_bytes as one_strip
from tilewright.operators.raster import cut_strips
from tilewright.sources.images import read_rasters
from tilewright.sources.tiff import UnreadableImage, layout, read_strips, rows_of, tiff_bytes


def reader(data):
    return lambda at, n: data[at : at + n]


@pytest.mark.parametrize("deflated", [False, True])
@pytest.mark.parametrize("rows", [1, 3, 7, 40])
def test_any_rows_of_any_layout(rows, deflated):
    pixels = np.random.default_rng(rows).integers(0, 256, (23, 5, 3)).astype(np.uint8)
    data = tiff_bytes(pixels, rows, deflated)
    found = layout(reader(data), len(data))
    assert (found.height, found.width, found.deflated) == (23, 5, deflated)
    for top in range(23):
        for bottom in range(top + 1, 24, 4):
            assert (rows_of(reader(data), found, top, bottom) == pixels[top:bottom]).all()
    for end in range(0, len(data) - 1, 11):
        with pytest.raises(UnreadableImage):
            cut = data[:end]
            rows_of(reader(cut), layout(reader(cut), len(cut)), 0, 23)


def big_endian_gray(pixels, meaning):
    """One deflated strip of 8-bit grey levels in the other byte order."""
    import zlib

    data, entries = zlib.compress(pixels.tobytes()), 8
    after = 8 + 2 + 12 * entries + 4
    tags = [(256, pixels.shape[1]), (257, pixels.shape[0]), (258, 8), (259, 8), (262, meaning), (273, after), (277, 1), (279, len(data))]
    return b"MM\0*" + struct.pack(">IH", 8, entries) + b"".join(struct.pack(">HHII", t, 4, 1, v) for t, v in tags) + struct.pack(">I", 0) + data


@pytest.mark.parametrize("meaning", [0, 1])
def test_grey_levels(meaning):
    pixels = np.arange(12, dtype=np.uint8).reshape(4, 3)
    data = big_endian_gray(pixels, meaning)
    found = rows_of(reader(data), layout(reader(data), len(data)), 1, 4)
    want = pixels[1:4] if meaning else 255 - pixels[1:4]
    assert all((found[:, :, k] == want).all() for k in range(3))


def test_folder_like_the_image_reader(spark, tmp_path):
    root = tmp_path / "Good Crops + more"
    for label in ("30", "45 days"):
        (root / label).mkdir(parents=True)
    for i in range(4):
        (root / "30" / f"a{i}.tif").write_bytes(one_strip(10, 8, crop(i)))
        pixels = np.random.default_rng(i).integers(0, 256, (9 + i, 6, 3)).astype(np.uint8)
        (root / "45 days" / f"b {i}%.TIFF").write_bytes(tiff_bytes(pixels, 2 + i, deflated=i % 2 == 0))
    (root / "30" / "broken.tif").write_bytes(b"II*\0")
    (root / "30" / "empty.tif").write_bytes(b"")
    (root / "30" / "note.png").write_bytes(b"not read")
    (root / "30" / "deep").mkdir()
    (root / "30" / "deep" / "0.tif").write_bytes(one_strip(10, 8, crop(9)))
    rasters = read_rasters(spark, str(root))
    for halo, pixels in ((0, 1 << 16), (2, 20)):
        images, strips = read_strips(spark, str(root), halo, pixels)
        facts = lambda df: sorted(map(tuple, df.select("image_id", "label", "h", "w", "ok").collect()))
        assert facts(images) == facts(rasters)
        shown = ["image_id", "h", "w", "r0", "n_rows", "top", "red", "green", "blue"]
        rows = lambda df: sorted((tuple(r) for r in df.select(*shown).collect()), key=lambda r: (r[0], r[3]))
        assert rows(strips) == rows(cut_strips(rasters, halo=halo, strip_pixels=pixels))


def test_tall_image_is_many_tasks(spark, tmp_path):
    """No record of a tall image exceeds a strip and its halo."""
    (tmp_path / "x").mkdir()
    pixels = np.random.default_rng(5).integers(0, 256, (60_000, 7, 3)).astype(np.uint8)
    (tmp_path / "x" / "tall.tif").write_bytes(tiff_bytes(pixels, 1000))
    _, strips = read_strips(spark, str(tmp_path), halo=1, strip_pixels=7 * 5000)
    rows = strips.selectExpr("r0", "n_rows", "top", "size(red) AS n", "aggregate(red, 0L, (a, v) -> a + v) AS red", "blue[0] AS blue").collect()
    assert sorted((r.r0, r.n_rows) for r in rows) == [(r0, 5000) for r0 in range(0, 60_000, 5000)]
    for r in rows:
        bottom = min(60_000, r.r0 + 5001)
        assert (r.top, r.n) == (max(r.r0 - 1, 0), (bottom - max(r.r0 - 1, 0)) * 7)
        assert r.red == int(pixels[r.top : bottom, :, 0].sum()) and r.blue == int(pixels[r.top, 0, 2])
