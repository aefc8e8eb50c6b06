"""Hand-computed regions, and properties that do not depend on strips."""

from __future__ import annotations

import math
import random

import pytest

from tests.conftest import picture
from tilewright.operators.components import contract_links, label_pixels, labelled_runs
from tilewright.operators.regions import (
    cell_counts,
    cells_of,
    cells_with_nucleus,
    nearest_neighbour,
    region_table,
    shape_summary,
)
from tilewright.operators.segment import otsu_thresholds

BLANK = picture(["......"] * 6)


def regions_of(rasters, drawing, red=None, **kw):
    green = picture(drawing)
    images = rasters([(green, picture(red) if red else [[0] * len(green[0])] * len(green))])
    runs = labelled_runs(images, use_otsu=False, green_threshold=0.5, red_threshold=0.5, **kw)
    return images, runs, region_table(runs)


def cells(rasters, drawing, **kw):
    _, _, table = regions_of(rasters, drawing, **kw)
    return [r.asDict() for r in cells_of(table).orderBy("region").collect()]


def test_single_pixel(rasters):
    (r,) = cells(rasters, ["....", ".#..", "...."])
    assert (r["area"], r["centroid_r"], r["centroid_c"], r["perimeter"]) == (1, 1, 1, 0)
    assert (r["major_axis"], r["minor_axis"], r["eccentricity"], r["aspect_ratio"], r["circularity"]) == (0, 0, 0, 0, 0)
    assert r["solidity"] == 1


def test_rectangle(rasters):
    (r,) = cells(rasters, ["......", ".####.", ".####.", ".####.", "......"])
    assert r["area"] == 12 and (r["min_r"], r["min_c"], r["max_r"], r["max_c"]) == (1, 1, 4, 5)
    assert r["perimeter"] == pytest.approx(10)
    assert r["major_axis"] == pytest.approx(4 * math.sqrt(15 / 12)) and r["minor_axis"] == pytest.approx(4 * math.sqrt(8 / 12))
    assert r["eccentricity"] == pytest.approx(math.sqrt(1 - 8 / 15))
    assert r["solidity"] == 1 and r["circularity"] == pytest.approx(4 * math.pi * 12 / 100)


@pytest.mark.parametrize("drawing", [["......", ".####.", "......"], [".#.", ".#.", ".#.", ".#."]])
def test_thin_line(rasters, drawing):
    (r,) = cells(rasters, drawing)
    assert r["area"] == 4 and r["minor_axis"] == 0 and r["eccentricity"] == 1 and r["aspect_ratio"] == 0 and r["solidity"] == 1


def test_diagonal_pair_is_one_region(rasters):
    (r,) = cells(rasters, ["#...", ".#..", "...."])
    assert r["area"] == 2 and r["minor_axis"] == 0
    assert r["solidity"] == 1


def test_l_shape_solidity(rasters):
    (r,) = cells(rasters, ["#....", "#....", "#....", "#....", "#####"])
    # The hull edge from (-0.5, 0) and (0, 0.5) down to (4, 4.5) keeps the triangle
    # below the diagonal, with one more pixel centre beside it in each inner row.
    hull = sum(1 for y in range(5) for x in range(5) if x <= y)
    assert r["area"] == 9 and r["solidity"] == pytest.approx(9 / hull)


def brute_hull(pixels):
    points = sorted({(2 * r + dr, 2 * c + dc) for r, c in pixels for dr, dc in ((1, 0), (-1, 0), (0, 1), (0, -1))})

    def half(seq):
        out = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(points) + half(points[::-1])
    inside = 0
    for y in range(min(p[0] for p in pixels), max(p[0] for p in pixels) + 1):
        for x in range(min(p[1] for p in pixels), max(p[1] for p in pixels) + 1):
            edges = zip(hull, hull[1:] + hull[:1])
            inside += all((b[0] - a[0]) * (2 * x - a[1]) - (b[1] - a[1]) * (2 * y - a[0]) >= 0 for a, b in edges)
    return inside


def flood(mask):
    seen, out = {}, []
    for r, row in enumerate(mask):
        for c, on in enumerate(row):
            if not on or (r, c) in seen:
                continue
            stack, members = [(r, c)], []
            seen[r, c] = len(out)
            while stack:
                y, x = stack.pop()
                members.append((y, x))
                for dy in (-1, 0, 1):
                    for dx in (-1, 0, 1):
                        p = (y + dy, x + dx)
                        if 0 <= p[0] < len(mask) and 0 <= p[1] < len(row) and mask[p[0]][p[1]] and p not in seen:
                            seen[p] = len(out)
                            stack.append(p)
            out.append(members)
    return out


def random_drawings(seed, count=6, h=17, w=13, share=0.45):
    rng = random.Random(seed)
    return [["".join("#" if rng.random() < share else "." for _ in range(w)) for _ in range(h)] for _ in range(count)]


def spiral(n=15):
    grid = [["."] * n for _ in range(n)]
    r = c = 0
    dr, dc = 0, 1
    for _ in range(n * n):
        grid[r][c] = "#"
        ahead = (r + 2 * dr, c + 2 * dc)
        step = (r + dr, c + dc)
        blocked = not (0 <= step[0] < n and 0 <= step[1] < n) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead[0]][ahead[1]] == "#")
        if blocked:
            dr, dc = dc, -dr
            step = (r + dr, c + dc)
            ahead = (r + 2 * dr, c + 2 * dc)
            if not (0 <= step[0] < n and 0 <= step[1] < n) or (0 <= ahead[0] < n and 0 <= ahead[1] < n and grid[ahead[0]][ahead[1]] == "#"):
                break
        r, c = step
    return ["".join(row) for row in grid]


@pytest.mark.parametrize("strip_pixels", [65536, 60, 13])
def test_labels_and_hulls_match_brute_force(rasters, strip_pixels):
    drawings = random_drawings(3) + [spiral(13) + ["." * 13] * 4]
    zero = [[0] * 13] * 17
    images = rasters([(picture(d), zero) for d in drawings])
    runs = labelled_runs(images, use_otsu=False, green_threshold=0.5, nuclei=False, strip_pixels=strip_pixels)
    got = {}
    for row in label_pixels(runs).collect():
        got.setdefault((row.image_id, row.region_id), set()).add((row.r, row.c))
    want = {
        (i, k + 1): set(members)
        for i, d in enumerate(drawings) for k, members in enumerate(flood([[ch == "#" for ch in row] for row in d]))
    }
    assert got == want
    for row in region_table(runs).collect():
        members = next(m for (i, _), m in want.items() if i == row.image_id and (row.region // 13, row.region % 13) in m)
        assert row.area == len(members)
        assert row.solidity == pytest.approx(len(members) / brute_hull(members))


def test_rotation_keeps_shape(rasters):
    drawing = random_drawings(5, 1)[0]
    turned = [row[::-1] for row in drawing[::-1]]
    key = lambda rs: sorted((round(r["area"], 6), round(r["perimeter"], 6), round(r["major_axis"], 6), round(r["solidity"], 6)) for r in rs)
    assert key(cells(rasters, drawing)) == key(cells(rasters, turned, strip_pixels=26))


def test_largest_nucleus_ties_and_full_cover(rasters):
    green = ["#######", "#######", ".......", "##....."]
    red = ["##...##", ".......", ".......", "##....."]
    _, runs, table = regions_of(rasters, green, red)
    first, covered = [r.asDict() for r in cells_with_nucleus(runs, table).orderBy("region").collect()]
    assert first["nucleus_area"] == 2 and first["nc_ratio"] == pytest.approx(2 / 12)
    assert covered["nucleus_area"] == 2 and covered["nc_ratio"] is None


def test_cell_without_nucleus(rasters):
    _, runs, table = regions_of(rasters, ["##.", "##.", "..."])
    (only,) = cells_with_nucleus(runs, table).collect()
    assert only.nucleus_area == 0 and only.nucleus_solidity == 0 and only.nc_ratio == 0


def test_image_without_cells(rasters):
    images, runs, table = regions_of(rasters, ["....", "....", "...."])
    (s,) = shape_summary(images, cells_with_nucleus(runs, table)).collect()
    assert s.area_count == 1 and s.area_mean == 0 and s.nucleus_area_count == 0 and s.nc_ratio_count == 0
    (c,) = cell_counts(images, table).collect()
    assert (c.cell_count, c.cell_density) == (0, 0)
    (n,) = nearest_neighbour(images, cells_of(table)).collect()
    assert (n.nn_mean, n.nn_std) == (0, 0)


def test_two_cells_at_distance_five(rasters):
    images, _, table = regions_of(rasters, ["#....#", "......", "......"])
    (n,) = nearest_neighbour(images, cells_of(table)).collect()
    assert (n.nn_mean, n.nn_std) == (5, 0)


@pytest.mark.parametrize("small", [1, 4, 1000])
def test_neighbours_match_brute_force(rasters, small):
    rng = random.Random(9)
    # A dense corner, a few loners and one far point.
    spots = {(2 * rng.randrange(12), 2 * rng.randrange(12)) for _ in range(70)} | {(60, 3), (40, 70), (79, 79)}
    green = [[200 if (r, c) in spots else 0 for c in range(80)] for r in range(80)]
    images = rasters([(green, [[0] * 80] * 80)])
    runs = labelled_runs(images, use_otsu=False, green_threshold=0.5, nuclei=False)
    (n,) = nearest_neighbour(images, cells_of(region_table(runs, False)), small).collect()
    best = [min(math.dist(a, b) for b in spots if b != a) for a in spots]
    mean = sum(best) / len(best)
    assert n.nn_mean == pytest.approx(mean)
    assert n.nn_std == pytest.approx(math.sqrt(sum((d - mean) ** 2 for d in best) / len(best)))


def test_constant_channel_threshold_is_its_level(rasters):
    images = rasters([([[7] * 4] * 3, [[0] * 4] * 3)])
    (t,) = otsu_thresholds(images).collect()
    assert (t.green_threshold, t.red_threshold) == (7, 0)
    assert labelled_runs(images).count() == 0


def test_chain_and_hub_contract_to_their_smallest_node(spark):
    chain = [(0, i, i + 1) for i in range(1, 60)]
    hub = [(1, 1000, i) for i in range(200, 400)]
    links = spark.createDataFrame(chain + hub, "g INT, u BIGINT, v BIGINT")
    roots = {(r.g, r.u): r.root for r in contract_links(links, ["g"]).collect()}
    assert {k: v for k, v in roots.items() if k[0] == 0} == {(0, i): 1 for i in range(2, 61)}
    assert {v for k, v in roots.items() if k[0] == 1} == {200} and len(roots) == 59 + 200
