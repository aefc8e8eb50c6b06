"""Shape measures of regions, nuclei of cells, and neighbour distances."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.scalars import circularity, nc_ratio, number, safe_ratio
from tilewright.functions.summaries import STATS, summarise
from tilewright.session import cut_lineage

REGION_KEYS = ["image_id", "kind", "region"]

CELL_MEASURES = (
    "area", "perimeter", "major_axis", "minor_axis", "aspect_ratio", "eccentricity", "solidity", "circularity",
)
NUCLEUS_MEASURES = ("area", "perimeter", "major_axis", "minor_axis", "circularity", "solidity")


# ---------------------------------------------------------------- convex hulls


def _envelope(y, x, group):
    """Which points lie on the lower convex envelope of their group (sorted by y)."""
    import numpy as np

    keep = np.arange(len(y))
    while True:
        g, yy, xx = group[keep], y[keep], x[keep]
        inner = np.zeros(len(keep), dtype=bool)
        inner[1:-1] = (g[1:-1] == g[:-2]) & (g[1:-1] == g[2:])
        i = np.flatnonzero(inner)
        turn = (yy[i] - yy[i - 1]) * (xx[i + 1] - xx[i - 1]) - (yy[i + 1] - yy[i - 1]) * (xx[i] - xx[i - 1])
        # A point on or above the chord of its neighbours is no envelope corner.
        out = i[turn <= 0]
        if not len(out):
            return keep
        keep = np.delete(keep, out)


def _lowest_even(y, x, group, corner, query):
    """Smallest even number on or above the envelope at each queried point."""
    import numpy as np

    left = corner[np.searchsorted(corner, query, "right") - 1]
    at_right = np.minimum(np.searchsorted(corner, query, "left"), len(corner) - 1)
    right = corner[at_right]
    span = np.where(right == left, 1, y[right] - y[left])
    height = x[left] * span + (x[right] - x[left]) * (y[query] - y[left])
    return -2 * (-height // (2 * span))


@F.arrow_udf(T.LongType())
def hull_pixels(rows, lows, highs):
    """Pixels whose centre lies in the convex hull of a region, edges included.

    Input: per region its rows in order with the first and last column of each.
    The hull is spanned by the edge midpoints of the pixels. On a grid of half
    pixels a row's own line reaches half a pixel past its ends, and the line
    between two rows reaches the wider of the two.
    """
    import numpy as np
    import pyarrow as pa

    sizes = np.diff(rows.offsets.to_numpy())
    r, lo, hi = (x.flatten().to_numpy().astype(np.int64) for x in (rows, lows, highs))
    n_points = 2 * sizes + 1
    first = np.concatenate([[0], np.cumsum(n_points)])[:-1]
    row_first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    group = np.repeat(np.arange(len(sizes)), sizes)
    centre = np.repeat(first, sizes) + 2 * (np.arange(len(r)) - row_first[group]) + 1

    y = np.empty(n_points.sum(), dtype=np.int64)
    owner = np.repeat(np.arange(len(sizes)), n_points)
    y[centre], y[centre - 1], y[centre + 1] = 2 * r, 2 * r - 1, 2 * r + 1

    def profile(edge):
        x = np.full(len(y), np.iinfo(np.int64).max)
        for shift in (-1, 1):
            np.minimum.at(x, centre + shift, 2 * edge)
        x[centre] = 2 * edge - 1
        corner = _envelope(y, x, owner)
        return _lowest_even(y, x, owner, corner, centre)

    left, right = profile(lo), -profile(-hi)
    counts = np.bincount(group, weights=(right - left) // 2 + 1, minlength=len(sizes))
    return pa.array(counts.astype(np.int64))


# ---------------------------------------------------------------- region table


def _sum_of_squares(n: str) -> str:
    """0^2 + 1^2 + ... + n^2, also for use in differences with negative n."""
    return f"({n} * ({n} + 1) * (2 * {n} + 1) / 6)"


def region_moments(runs: DataFrame) -> DataFrame:
    """One row per region: area, box, raw moments about its first pixel, perimeter
    counts and the row extents, all summed from runs.

    Runs are first merged per image row, which bounds the list of row extents
    by the image height and lets a region of any size aggregate in parallel.
    """
    keys = [*REGION_KEYS, "w"]
    # Coordinates relative to the region's first pixel keep the sums small.
    relative = runs.selectExpr(
        *keys, "r", "c0", "c1", "p_unit", "p_diag", "p_mixed",
        "CAST(c0 - region % w AS DOUBLE) AS a", "CAST(c1 - region % w AS DOUBLE) AS b",
        "CASE WHEN r * CAST(w AS BIGINT) + c0 = region THEN host_c0 END AS host_c0",
    )
    # Rows of a region share y, so column sums suffice here.
    per_row = relative.groupBy(*keys, "r").agg(*[F.expr(x) for x in (
        "sum(b - a + 1) AS n",
        "sum((a + b) * (b - a + 1) / 2) AS sx",
        f"sum({_sum_of_squares('b')} - {_sum_of_squares('(a - 1)')}) AS sxx",
        "sum(p_unit) AS p_unit", "sum(p_diag) AS p_diag", "sum(p_mixed) AS p_mixed",
        "min(c0) AS lo", "max(c1) AS hi", "max(host_c0) AS host_c0",
    )])
    placed = per_row.withColumn("y", F.expr("CAST(r - region DIV w AS DOUBLE)"))
    return placed.groupBy(*keys).agg(*[F.expr(x) for x in (
        "sum(n) AS n", "sum(y * n) AS sy", "sum(sx) AS sx", "sum(y * y * n) AS syy", "sum(sxx) AS sxx", "sum(y * sx) AS sxy",
        "sum(p_unit) AS p_unit", "sum(p_diag) AS p_diag", "sum(p_mixed) AS p_mixed",
        "min(r) AS min_r", "min(lo) AS min_c", "max(r) + 1 AS max_r", "max(hi) + 1 AS max_c",
        "max(host_c0) AS host_c0", "array_sort(collect_list(struct(r, lo, hi))) AS extents",
    )])


def region_table(runs: DataFrame, solidity: bool = True) -> DataFrame:
    """Per region: area, centroid, half-open box, axes of the ellipse with equal
    second moments, eccentricity, border-walk perimeter and solidity."""
    walk = f"p_unit + p_diag * {number(math.sqrt(2))} + p_mixed * {number((1 + math.sqrt(2)) / 2)}"
    # Second moments times n squared: whole numbers, so equal or vanishing axes
    # come out exactly equal or zero.
    moments = region_moments(runs).selectExpr(
        *REGION_KEYS, "w", "n AS area", "region DIV w + sy / n AS centroid_r", "region % w + sx / n AS centroid_c",
        "min_r", "min_c", "max_r", "max_c", "host_c0", f"{walk} AS perimeter", "extents",
        "n * syy - sy * sy AS vr", "n * sxx - sx * sx AS vc", "n * sxy - sy * sx AS vrc",
    )
    spread = "sqrt((vr - vc) * (vr - vc) + 4 * vrc * vrc)"
    axes = moments.selectExpr(
        "*", f"(vr + vc + {spread}) / (2 * area * area) AS l1",
        f"greatest(vr + vc - {spread}, 0.0D) / (2 * area * area) AS l2",
    ).selectExpr("*", "4 * sqrt(l1) AS major_axis", "4 * sqrt(l2) AS minor_axis")
    shaped = axes.selectExpr(
        *REGION_KEYS, "w", "area", "centroid_r", "centroid_c", "min_r", "min_c", "max_r", "max_c",
        "major_axis", "minor_axis", "CASE WHEN l1 = 0 THEN 0.0D ELSE sqrt(1 - l2 / l1) END AS eccentricity",
        "perimeter", "host_c0", f"{safe_ratio('major_axis', 'minor_axis')} AS aspect_ratio",
        f"{circularity('area', 'perimeter')} AS circularity", *(["extents"] if solidity else []),
    )
    if not solidity:
        return shaped
    hull = hull_pixels("extents.r", "extents.lo", "extents.hi")
    return shaped.withColumn("solidity", F.col("area") / hull).drop("extents")


def cells_of(regions: DataFrame) -> DataFrame:
    return regions.filter("kind = 0").drop("kind", "host_c0")


def nuclei_with_cell(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """Nuclei with ``cell``, the region their first pixel lies in.

    The first pixel's cell run is known by row and start, so this is an
    equi-join, never a containment search.
    """
    cell_runs = runs.filter("kind = 0").selectExpr("image_id", "r", "c0 AS host_c0", "region AS cell")
    nuclei = regions.filter("kind = 1").withColumn("r", F.expr("CAST(region DIV w AS INT)"))
    return nuclei.join(cell_runs, ["image_id", "r", "host_c0"]).drop("r", "host_c0", "kind", "w")


def largest_nuclei(runs: DataFrame, regions: DataFrame, measures: Sequence[str] = NUCLEUS_MEASURES) -> DataFrame:
    """Largest nucleus per cell, the earlier one on equal area.

    A maximum over structs instead of a ranking window: it combines on the map
    side, so a cell holding most nuclei never fills one task.
    """
    rest = "".join(f", {m}" for m in measures if m != "area")
    return (
        nuclei_with_cell(runs, regions)
        .groupBy("image_id", "cell").agg(F.expr(f"max(struct(area, -region AS _order{rest})) AS n"))
        .selectExpr("image_id", "cell AS region", *[f"n.{m} AS nucleus_{m}" for m in measures])
    )


def cells_with_nucleus(
    runs: DataFrame, regions: DataFrame, measures: Sequence[str] = NUCLEUS_MEASURES
) -> DataFrame:
    """Every cell with its largest nucleus; cells without one get zeros."""
    cells = cells_of(regions)
    joined = cells.join(largest_nuclei(runs, regions, measures), ["image_id", "region"], "left")
    filled = [f"coalesce(nucleus_{m}, 0.0D) AS nucleus_{m}" for m in measures]
    return joined.selectExpr(*cells.columns, *filled).selectExpr("*", f"{nc_ratio('nucleus_area', 'area')} AS nc_ratio")


def overlay_share(masked: DataFrame) -> DataFrame:
    """``image_id`` with counts of green pixels and of red pixels inside them."""
    return masked.groupBy("image_id").agg(
        F.expr("sum(size(filter(green_mask, g -> g))) AS cell_pixels"),
        F.expr("sum(size(filter(zip_with(green_mask, red_mask, (g, r) -> g AND r), b -> b))) AS overlay_pixels"),
    )


def cell_counts(images: DataFrame, regions: DataFrame) -> DataFrame:
    """``cell_count`` and ``cell_density``; images without cells keep a row."""
    counts = regions.filter("kind = 0").groupBy("image_id").agg(F.expr("count(1) AS _n"))
    return images.filter("ok").select("image_id", "h", "w").join(counts, "image_id", "left").selectExpr(
        "image_id", "CAST(coalesce(_n, 0) AS DOUBLE) AS cell_count",
        f"{safe_ratio('coalesce(_n, 0)', '(CAST(h AS DOUBLE) * w)')} AS cell_density",
    )


def shape_summary(images: DataFrame, cells: DataFrame) -> DataFrame:
    """The 90 shape statistics per readable image.

    An image without cells counts one all-zero cell in the cell measures and
    none in the nucleus measures. Measures the cells do not carry are left out.
    """
    wanted = [*CELL_MEASURES, *[f"nucleus_{m}" for m in NUCLEUS_MEASURES], "nc_ratio"]
    measures = {m: m for m in wanted if m in cells.columns}
    stats = summarise(cells, ["image_id"], measures)
    columns = [
        f"coalesce({m}_{s}, {'1.0D' if s == 'count' and m in CELL_MEASURES else '0.0D'}) AS {m}_{s}"
        for m in measures for s in STATS
    ]
    return images.filter("ok").select("image_id").join(stats, "image_id", "left").selectExpr("image_id", *columns)


# ---------------------------------------------------------------- nearest neighbours

# Up to this many cells an image is searched as one grid square.
SMALL_IMAGE_CELLS = 64


def nearest_distances(images: DataFrame, cells: DataFrame, small: int = SMALL_IMAGE_CELLS) -> DataFrame:
    """``image_id, region, distance`` to the nearest other centroid of the image.

    Centroids are put on a grid and compared with the 3x3 squares around them;
    a distance up to the square's side is final. The side makes a square hold
    one cell on average, so comparisons grow with the cells (and stay below a
    small multiple of the pixels however cells cluster). Points not settled go
    on with squares four times as wide; they are sparse at the former width, so
    no round compares all pairs. Images of up to ``small`` cells take one square.
    """
    points = cells.selectExpr("image_id", "region", "centroid_r AS y", "centroid_c AS x")
    counts = points.groupBy("image_id").agg(F.expr("count(1) AS cells"))
    sides = counts.filter("cells > 1").join(images.select("image_id", "h", "w"), "image_id").selectExpr(
        "image_id", "CAST(greatest(h, w) AS DOUBLE) AS extent",
        f"CASE WHEN cells <= {small} THEN CAST(greatest(h, w) AS DOUBLE) "
        "ELSE least(greatest(h, w), greatest(2.0D, sqrt(CAST(h AS DOUBLE) * w / cells))) END AS side",
    )
    located = points.join(sides, "image_id")
    settled = "image_id", "region", "sqrt(d2) AS distance"
    if not _crowded(images, counts, small):
        return _grid_step(located, located).selectExpr(*settled)

    located = cut_lineage(located, "centroids")
    pending, done = located, []
    while True:
        found = cut_lineage(_grid_step(pending, located), "neighbours")
        final = "(d2 IS NOT NULL AND (d2 <= side * side OR side >= extent))"
        done.append(found.filter(final).selectExpr(*settled))
        pending = found.filter(f"NOT {final}").drop("d2").withColumn("side", F.expr("least(extent, side * 4)"))
        if pending.limit(1).count() == 0:
            break
        # Candidates take the side their image has reached.
        located = located.drop("side").join(pending.select("image_id", "side").distinct(), "image_id")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _crowded(images: DataFrame, counts: DataFrame, small: int) -> bool:
    """Whether some image exceeds ``small`` cells; image sizes settle most cases."""
    roomy = images.filter(f"ok AND ceil(h / 2) * ceil(w / 2) > {small}").limit(1).count() > 0
    return roomy and counts.filter(f"cells > {small}").limit(1).count() > 0


def _grid_step(pending: DataFrame, located: DataFrame) -> DataFrame:
    """Squared distance of each pending point to the nearest candidate in the 3x3 squares."""
    point = ["image_id", "region", "y", "x", "side", "extent"]
    around = ", ".join(f"struct({dy} AS dy, {dx} AS dx)" for dy in (-1, 0, 1) for dx in (-1, 0, 1))

    def square(v: str) -> str:
        # A side as long as the image puts every point into square (0, 0).
        return f"CASE WHEN side >= extent THEN 0 ELSE floor({v} / side) END"

    asking = pending.selectExpr(
        *point, f"explode(CASE WHEN side >= extent THEN array(struct(0 AS dy, 0 AS dx)) ELSE array({around}) END) AS o"
    ).selectExpr(*point, f"{square('y')} + o.dy AS by", f"{square('x')} + o.dx AS bx")
    offered = located.selectExpr(
        "image_id", "region AS other", "y AS oy", "x AS ox", f"{square('y')} + 0 AS by", f"{square('x')} + 0 AS bx"
    )
    return asking.join(offered, ["image_id", "by", "bx"]).groupBy(*point).agg(
        F.expr("min(CASE WHEN region <> other THEN (y - oy) * (y - oy) + (x - ox) * (x - ox) END) AS d2")
    )


def nearest_neighbour(images: DataFrame, cells: DataFrame, small: int = SMALL_IMAGE_CELLS) -> DataFrame:
    """``nn_mean, nn_std`` per readable image; 0 with fewer than two cells."""
    per_image = nearest_distances(images, cells, small).groupBy("image_id").agg(
        F.expr("avg(distance) AS _mean"), F.expr("stddev_pop(distance) AS _std")
    )
    return images.filter("ok").select("image_id").join(per_image, "image_id", "left").selectExpr(
        "image_id", "coalesce(_mean, 0.0D) AS nn_mean", "coalesce(_std, 0.0D) AS nn_std"
    )
