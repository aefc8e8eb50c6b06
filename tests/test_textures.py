"""Texture measures against direct computation, for any strip size."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tilewright.operators.texture import (
    gabor_stats,
    gabor_taps,
    glcm_matrix,
    glcm_stats,
    intensity_stats,
    lbp_codes,
    lbp_histogram,
)
from tilewright.plans.image_features import FAMILIES, image_features


def gray_image(grid):
    return grid, grid


def with_gray(spark, grids):
    from tests.conftest import RASTER

    rows = []
    for i, g in enumerate(grids):
        flat = [int(v) for row in g for v in row]
        rows.append((i, "a", len(g), len(g[0]), True, flat, flat, flat))
    return spark.createDataFrame(rows, RASTER)


def noise(seed, h=11, w=7):
    rng = random.Random(seed)
    return [[rng.randrange(256) for _ in range(w)] for _ in range(h)]


def test_constant_image(spark):
    images = with_gray(spark, [[[9] * 5] * 4])
    (i,) = intensity_stats(images).collect()
    assert (i.intensity_mean, i.intensity_std, i.intensity_skew, i.intensity_kurtosis) == (9, 0, 0, 0)
    (g,) = glcm_stats(images).collect()
    assert (g.glcm_contrast_mean, g.glcm_homogeneity_mean, g.glcm_energy_mean, g.glcm_ASM_mean, g.glcm_correlation_mean) == (0, 1, 1, 1, 1)


def test_single_row_has_empty_angles(spark):
    (g,) = glcm_stats(with_gray(spark, [[[0, 4, 8]]])).collect()
    assert g.glcm_contrast_mean == pytest.approx(0.25) and g.glcm_contrast_std == pytest.approx(math.sqrt(3) / 4)
    # Angles without pairs count as correlation 1.
    values = [0, 1, 1, 1]
    assert g.glcm_correlation_mean == pytest.approx(sum(values) / 4)


def test_one_pixel_image(spark):
    (g,) = glcm_stats(with_gray(spark, [[[200]]])).collect()
    assert (g.glcm_contrast_mean, g.glcm_correlation_mean, g.glcm_status) == (0, 1, "ok")
    (o,) = glcm_stats(with_gray(spark, [[[255]]]), levels=60).collect()
    assert (o.glcm_correlation_mean, o.glcm_status) == (0, "level_overflow")


def test_level_overflow_is_zero(spark):
    images = with_gray(spark, [[[255, 0], [3, 9]], [[10, 20], [30, 40]]])
    over, fine = glcm_stats(images, levels=60).orderBy("image_id").collect()
    assert over.glcm_status == "level_overflow" and over.glcm_homogeneity_mean == 0 and over.glcm_correlation_mean == 0
    assert fine.glcm_status == "ok" and fine.glcm_contrast_mean > 0
    with pytest.raises(ValueError):
        glcm_stats(images, levels=0)


@pytest.mark.parametrize("strip_pixels", [65536, 14, 7])
def test_glcm_is_a_symmetric_distribution(spark, strip_pixels):
    grid = noise(1)
    cells = {(r.angle, r.i, r.j): r.p for r in glcm_matrix(with_gray(spark, [grid]), strip_pixels=strip_pixels).collect()}
    q = np.array(grid) // 4
    want = {}
    for angle, (dr, dc) in {0: (0, 1), 45: (1, 1), 90: (1, 0), 135: (1, -1)}.items():
        counts = np.zeros((64, 64))
        for r in range(q.shape[0]):
            for c in range(q.shape[1]):
                if 0 <= r + dr < q.shape[0] and 0 <= c + dc < q.shape[1]:
                    counts[q[r, c], q[r + dr, c + dc]] += 1
        counts = counts + counts.T
        for i, j in zip(*np.nonzero(counts)):
            want[angle, i, j] = counts[i, j] / counts.sum()
    assert cells.keys() == want.keys()
    assert all(cells[k] == pytest.approx(want[k]) and cells[k[0], k[2], k[1]] == cells[k] for k in cells)


def direct_lbp(grid, points, radius):
    g = np.array(grid, dtype=float)
    at = lambda r, c: g[r, c] if 0 <= r < g.shape[0] and 0 <= c < g.shape[1] else 0.0
    out = {}
    for r in range(g.shape[0]):
        for c in range(g.shape[1]):
            bits = []
            for k in range(points):
                y = r + round(-radius * math.sin(2 * math.pi * k / points), 5)
                x = c + round(radius * math.cos(2 * math.pi * k / points), 5)
                r0, c0, r1, c1 = math.floor(y), math.floor(x), math.ceil(y), math.ceil(x)
                fy, fx = y - r0, x - c0
                v = (1 - fy) * ((1 - fx) * at(r0, c0) + fx * at(r0, c1)) + fy * ((1 - fx) * at(r1, c0) + fx * at(r1, c1))
                bits.append(int(v - g[r, c] >= 0))
            changes = sum(a != b for a, b in zip(bits, bits[1:]))
            out[r, c] = sum(bits) if changes <= 2 else points + 1
    return out


@pytest.mark.parametrize("points,radius,strip_pixels", [(8, 1.0, 65536), (8, 1.0, 7), (12, 2.0, 21), (16, 2.5, 7)])
def test_lbp_codes(spark, points, radius, strip_pixels):
    grid = noise(2)
    coded = lbp_codes(with_gray(spark, [grid]), points, radius, strip_pixels)
    assert {(r.r, r.c): r.code for r in coded.collect()} == direct_lbp(grid, points, radius)


def test_lbp_bins_sum_to_one(spark):
    (row,) = lbp_histogram(with_gray(spark, [noise(3)])).collect()
    assert sum(row[f"lbp_{k}"] for k in range(10)) == pytest.approx(1, abs=1e-6)


@pytest.mark.parametrize("strip_pixels", [65536, 14])
def test_gabor_matches_full_kernel(spark, strip_pixels):
    grid = np.array(noise(4), dtype=float)
    (row,) = gabor_stats(with_gray(spark, [grid]), strip_pixels=strip_pixels).collect()
    h, w = grid.shape
    fold = lambda i, n: i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
    for f in (0.1, 0.2):
        for degrees in (0, 45, 90):
            rows, cols = gabor_taps(f, math.radians(degrees))
            kernel, reach = np.outer(rows, cols), len(rows) // 2
            mags = []
            for r in range(h):
                for c in range(w):
                    window = grid[np.ix_([fold(r - k, h) for k in range(-reach, reach + 1)], [fold(c - k, w) for k in range(-reach, reach + 1)])]
                    mags.append(abs((kernel * window).sum()))
            assert row[f"gabor_f{f}_a{degrees}_mean"] == pytest.approx(np.mean(mags))
            assert row[f"gabor_f{f}_a{degrees}_std"] == pytest.approx(np.std(mags))


def test_feature_table_shape_and_unreadable_image(spark, rasters):
    images = rasters([None, (noise(5), noise(6))])
    wide = image_features(images, strip_pixels=21)
    names = [c for c in wide.columns if c not in ("image_id", "label", "status")]
    assert names == [n for family in FAMILIES.values() for n in family] and len(names) == 132
    broken, fine = wide.orderBy("image_id").collect()
    assert broken.status == "unreadable" and all(broken[n] == 0 for n in names)
    assert fine.status == "ok" and fine.area_count >= 1 and fine.intensity_std > 0
    whole = image_features(images).orderBy("image_id").collect()[1]
    assert all(fine[n] == pytest.approx(whole[n]) for n in names)


def test_features_without_nuclei(spark, rasters):
    wide = image_features(rasters([(noise(5), noise(6))]), nuclei=False, use_otsu=False)
    assert len(wide.columns) == 3 + 132 - 42 and wide.count() == 1


def test_strips_of_one_image_reach_several_tasks(spark, rasters):
    from pyspark.sql import functions as F

    from tilewright.operators.raster import cut_strips

    grid = [[(r * 7 + c) % 251 for c in range(4)] for r in range(64)]
    strips = cut_strips(rasters([(grid, grid)]), ("gray", "green"), halo=1, strip_pixels=8)
    # Tiny partitions would be put together again.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = strips.select("r0", "green", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == 32 and len({r.p for r in found}) > 1
    assert max(len(r.green) for r in found) <= (2 + 2) * 4
    assert all(r.green[(1 if r.r0 else 0) * 4] == grid[r.r0][0] for r in found)


def test_small_images_count_their_borders_in_the_budget(monkeypatch):
    import pyarrow as pa

    from tilewright.operators import texture

    n, h, w, filters = 300, 4, 5, [gabor_taps(0.1, 0.0), gabor_taps(0.2, math.pi / 4)]
    reach = max(len(taps) // 2 for pair in filters for taps in pair)
    values = np.random.default_rng(6).integers(0, 255, n * h * w).astype(np.int16)
    gray = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (h * w)), pa.array(values))
    columns = [gray, *(pa.array(np.full(n, v, np.int32)) for v in (h, w, 0, 0, h))]
    whole = texture._gabor_udf(filters).func(*columns).to_pylist()
    sizes, moments = [], texture._gabor_moments
    monkeypatch.setattr(texture, "_gabor_moments", lambda stack, *rest: sizes.append(len(stack)) or moments(stack, *rest))
    budget = 20 * (h + 2 * reach) * (w + 2 * reach)
    assert texture._gabor_udf(filters, budget).func(*columns).to_pylist() == whole
    assert sum(sizes) == n and max(sizes) <= 20
