"""Grey-level tallies and the textures derived from them, plus Gabor filters.

All counting operators share one scan: every pixel emits the tallies asked for,
they are counted per (image, kind, key) with map-side combining, and the
statistics are computed from counts whose number per image is bounded by the
grey levels, never by the pixels.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.scalars import gabor_stem, number
from tilewright.operators.raster import STRIP_PIXELS, at, cut_strips, strip_positions

GRAY, GREEN, RED, LBP, GLCM = 0, 1, 2, 3, 10

# Fixed values: (row, column) step of the co-occurrence angles 0, 45, 90 and 135 degrees.
ANGLE_STEPS = {0: (0, 1), 45: (1, 1), 90: (1, 0), 135: (1, -1)}
GLCM_PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation", "ASM")


def _glcm_divisor(levels: int) -> int:
    if not 1 <= levels <= 256:
        raise ValueError("glcm levels must be between 1 and 256")
    return 256 // levels


# ---------------------------------------------------------------- local binary patterns


def _sample_steps(points: int, radius: float) -> list[tuple[float, float]]:
    """(row, column) offset of each sample on the circle, rounded to 5 places."""
    turns = [2 * math.pi * k / points for k in range(points)]
    return [(round(-radius * math.sin(t), 5) + 0.0, round(radius * math.cos(t), 5) + 0.0) for t in turns]


def _cell_name(dr: int, dc: int) -> str:
    return f"_n{dr}_{dc}".replace("-", "m")


def _corners(step: tuple[float, float]) -> tuple[list[int], list[int]]:
    dr, dc = step
    return sorted({math.floor(dr), math.ceil(dr)}), sorted({math.floor(dc), math.ceil(dc)})


def _interpolated(step: tuple[float, float]) -> str:
    """Bilinear sample from the neighbourhood columns."""
    rows, cols = _corners(step)
    fy, fx = (f"(({p} + {number(d)}) - floor({p} + {number(d)}))" for p, d in zip("rc", step))

    def along_row(dr: int) -> str:
        left = f"CAST({_cell_name(dr, cols[0])} AS DOUBLE)"
        if len(cols) == 1:
            return left
        return f"((1 - {fx}) * {left} + {fx} * {_cell_name(dr, cols[1])})"

    if len(rows) == 1:
        return along_row(rows[0])
    return f"((1 - {fy}) * {along_row(rows[0])} + {fy} * {along_row(rows[1])})"


def _lbp_neighbourhood(points: int, radius: float) -> list[tuple[int, int]]:
    cells = {(0, 0)}
    for step in _sample_steps(points, radius):
        rows, cols = _corners(step)
        cells.update((a, b) for a in rows for b in cols)
    return sorted(cells)


def _with_lbp(positions: DataFrame, points: int, radius: float, keep: Sequence[str]) -> DataFrame:
    """Positions with the pattern ``code``; ``keep`` are further expressions to carry."""
    cells = [
        f"coalesce({at('gray', dr, dc)}, CAST(0 AS SMALLINT)) AS {_cell_name(dr, dc)}"
        for dr, dc in _lbp_neighbourhood(points, radius)
    ]
    bits = [
        f"CAST({_interpolated(step)} - _n0_0 >= 0 AS INT) AS _s{k}"
        for k, step in enumerate(_sample_steps(points, radius))
    ]
    ones = " + ".join(f"_s{k}" for k in range(points))
    changes = " + ".join(f"abs(_s{k} - _s{k - 1})" for k in range(1, points))
    return (
        positions.selectExpr("image_id", "r", "c", *keep, *cells)
        .selectExpr("*", *bits)
        .selectExpr("*", f"CASE WHEN {changes} <= 2 THEN {ones} ELSE {points + 1} END AS code")
    )


def lbp_codes(
    rasters: DataFrame, points: int = 8, radius: float = 1.0, strip_pixels: int = STRIP_PIXELS
) -> DataFrame:
    """``image_id, r, c, gray, code``: rotation-invariant uniform pattern per pixel.

    A sample counts when it is at least the centre; samples outside the image are 0.
    """
    strips = cut_strips(rasters, ("gray",), math.ceil(radius), strip_pixels)
    coded = _with_lbp(strip_positions(strips, ("gray",)), points, radius, [])
    return coded.selectExpr("image_id", "r", "c", "_n0_0 AS gray", "code")


# ---------------------------------------------------------------- the shared tally


def pixel_tallies(
    rasters: DataFrame,
    kinds: Sequence[str] = ("gray", "green", "red", "lbp", "glcm"),
    *,
    points: int = 8,
    radius: float = 1.0,
    levels: int = 64,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """Counts ``image_id, kind, a, b, n`` of everything asked for, in one scan.

    ``gray``, ``green`` and ``red`` count values (in ``a``), ``lbp`` pattern codes,
    ``glcm`` unordered grey-level pairs (a <= b) with kind GLCM + angle.
    """
    wants_gray = bool({"gray", "lbp", "glcm"} & set(kinds))
    channels = [c for c, wanted in (("gray", wants_gray), ("green", "green" in kinds), ("red", "red" in kinds)) if wanted]
    halo = max(math.ceil(radius) if "lbp" in kinds else 0, 1 if "glcm" in kinds else 0)
    positions = strip_positions(cut_strips(rasters, channels, halo, strip_pixels), channels)

    def entry(kind: int, a: str, b: str = "0") -> str:
        return f"struct({kind} AS kind, CAST({a} AS INT) AS a, CAST({b} AS INT) AS b)"

    keep: list[str] = []
    entries: list[str] = []
    for name, kind in (("gray", GRAY), ("green", GREEN), ("red", RED)):
        if name in kinds:
            keep.append(f"{at(name)} AS _{name}")
            entries.append(entry(kind, f"_{name}"))
    if "glcm" in kinds:
        divisor = _glcm_divisor(levels)
        keep.append(f"CAST({at('gray')} DIV {divisor} AS INT) AS _q")
        for angle, (dr, dc) in ANGLE_STEPS.items():
            there = f"_q{angle}"
            keep.append(f"CAST({at('gray', dr, dc)} DIV {divisor} AS INT) AS {there}")
            # Outside the image the pair is NULL and filtered away below.
            entries.append(entry(GLCM + angle, *[
                f"CASE WHEN {there} IS NOT NULL THEN {f}(_q, {there}) END" for f in ("least", "greatest")
            ]))
    if "lbp" in kinds:
        seen = _with_lbp(positions, points, radius, keep)
        entries.append(entry(LBP, "code"))
    else:
        seen = positions.selectExpr("image_id", *keep)
    return (
        seen.selectExpr("image_id", f"explode(array({', '.join(entries)})) AS e")
        .selectExpr("image_id", "e.kind", "e.a", "e.b")
        .filter("a IS NOT NULL")
        .groupBy("image_id", "kind", "a", "b")
        .agg(F.expr("count(1) AS n"))
    )


# ---------------------------------------------------------------- statistics from tallies


def _per_image(df: DataFrame, aggregates: Sequence[str], keys: Sequence[str] = ("image_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.expr(f"struct({', '.join(aggregates)}) AS _s")).select(*keys, "_s.*")


def intensity_from_tallies(tallies: DataFrame) -> DataFrame:
    """Mean, population deviation, biased skewness and excess kurtosis of gray.

    The value histogram has at most 256 entries per image, so it is gathered and
    central moments are summed about the mean, where nothing cancels.
    """
    gathered = _per_image(tallies.filter(f"kind = {GRAY}"), [
        "CAST(sum(n) AS DOUBLE) AS _n", "sum(a * n) / sum(n) AS _mean", "collect_list(struct(a, n)) AS _h",
    ])
    powers = [
        f"aggregate(_h, 0.0D, (acc, e) -> acc + e.n * power(e.a - _mean, {k}D)) / _n AS _m{k}" for k in (2, 3, 4)
    ]
    return gathered.selectExpr("image_id", "_mean", *powers).selectExpr(
        "image_id",
        "_mean AS intensity_mean",
        "sqrt(_m2) AS intensity_std",
        "CASE WHEN _m2 > 0 THEN _m3 / power(_m2, 1.5D) ELSE 0.0D END AS intensity_skew",
        "CASE WHEN _m2 > 0 THEN _m4 / (_m2 * _m2) - 3.0D ELSE 0.0D END AS intensity_kurtosis",
    )


def intensity_stats(rasters: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    return intensity_from_tallies(pixel_tallies(rasters, ("gray",), strip_pixels=strip_pixels))


def lbp_from_tallies(tallies: DataFrame, points: int = 8) -> DataFrame:
    """``lbp_0 .. lbp_<points+1>``: share of each pattern code."""
    return _per_image(tallies.filter(f"kind = {LBP}"), [
        f"sum(CASE WHEN a = {code} THEN n ELSE 0 END) / (sum(n) + 1e-6D) AS lbp_{code}" for code in range(points + 2)
    ])


def lbp_histogram(
    rasters: DataFrame, points: int = 8, radius: float = 1.0, strip_pixels: int = STRIP_PIXELS
) -> DataFrame:
    tallies = pixel_tallies(rasters, ("lbp",), points=points, radius=radius, strip_pixels=strip_pixels)
    return lbp_from_tallies(tallies, points)


def glcm_matrix(rasters: DataFrame, levels: int = 64, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """Symmetric normalised co-occurrence ``image_id, angle, i, j, p``, zeros left out."""
    tallies = pixel_tallies(rasters, ("glcm",), levels=levels, strip_pixels=strip_pixels)
    # At most levels^2 entries per (image, angle), whatever the image size.
    shares = tallies.selectExpr(
        "image_id", f"kind - {GLCM} AS angle", "a", "b",
        "n / (2.0D * sum(n) OVER (PARTITION BY image_id, kind)) AS share",
    )
    cells = (
        "CASE WHEN a = b THEN array(struct(a AS i, b AS j, 2 * share AS p)) "
        "ELSE array(struct(a AS i, b AS j, share AS p), struct(b AS i, a AS j, share AS p)) END"
    )
    return shares.selectExpr("image_id", "angle", f"inline({cells})")


def glcm_angle_stats(tallies: DataFrame) -> DataFrame:
    """The six properties per (image, angle).

    An unordered pair seen n times stands for n in both mirror cells, so the
    matrix total is twice the number of pairs.
    """
    pairs = tallies.filter(f"kind >= {GLCM}").selectExpr(
        "image_id", f"kind - {GLCM} AS angle", "a", "b",
        "CAST(n AS DOUBLE) AS n", "CAST(b - a AS DOUBLE) AS d", "CAST(a AS DOUBLE) AS x", "CAST(b AS DOUBLE) AS y",
    )
    sums = _per_image(pairs, [
        "sum(n) AS _n",
        "sum(n * d * d) AS _contrast",
        "sum(n * d) AS _dissimilarity",
        "sum(n / (1 + d * d)) AS _homogeneity",
        # Squared cells: one diagonal cell of 2n, or two cells of n.
        "sum(CASE WHEN d = 0 THEN 4 * n * n ELSE 2 * n * n END) AS _squares",
        "sum(n * (x + y)) AS _first",
        "sum(n * (x * x + y * y)) AS _second",
        "sum(2 * n * x * y) AS _cross",
        "min(a) AS _low",
        "max(b) AS _high",
    ], ("image_id", "angle"))
    mean = "(_first / (2 * _n))"
    spread = f"(_second / (2 * _n) - {mean} * {mean})"
    return sums.selectExpr(
        "image_id", "angle",
        "_contrast / _n AS contrast",
        "_dissimilarity / _n AS dissimilarity",
        "_homogeneity / _n AS homogeneity",
        "sqrt(_squares) / (2 * _n) AS energy",
        f"CASE WHEN _low = _high THEN 1.0D ELSE (_cross / (2 * _n) - {mean} * {mean}) / {spread} END AS correlation",
        "_squares / (4 * _n * _n) AS ASM",
        "_high AS top_level",
    )


def glcm_from_tallies(
    tallies: DataFrame, levels: int = 64, properties: Sequence[str] = GLCM_PROPERTIES
) -> DataFrame:
    """Mean and population deviation of each property over the four angles.

    An angle without any pair has an all-zero matrix: properties 0, correlation 1.
    An image with a grey level beyond the matrix gets zeros throughout, with
    ``glcm_status`` saying so. A level outside every pair exists only in a
    one-pixel image, so the grey histogram is consulted where it was tallied.
    """
    columns = [
        f"coalesce(max(CASE WHEN angle = {angle} THEN {p} END), {1.0 if p == 'correlation' else 0.0}D) AS _{p}_{angle}"
        for p in properties for angle in ANGLE_STEPS
    ]
    by_angle = glcm_angle_stats(tallies).selectExpr("image_id", "angle", *properties, "top_level")
    # Grey levels ride along as rows without angle, so one aggregate sees both.
    lone = tallies.filter(f"kind = {GRAY}").selectExpr(
        "image_id", "CAST(NULL AS INT) AS angle", *[f"CAST(NULL AS DOUBLE) AS {p}" for p in properties],
        f"CAST(a DIV {_glcm_divisor(levels)} AS INT) AS top_level",
    )
    wide = _per_image(by_angle.unionByName(lone), [*columns, f"max(top_level) >= {levels} AS _over"])
    out = []
    for p in properties:
        four = [f"_{p}_{angle}" for angle in ANGLE_STEPS]
        mean = f"(({' + '.join(four)}) / 4)"
        spread = " + ".join(f"({v} - {mean}) * ({v} - {mean})" for v in four)
        out += [
            f"CASE WHEN _over THEN 0.0D ELSE {mean} END AS glcm_{p}_mean",
            f"CASE WHEN _over THEN 0.0D ELSE sqrt(({spread}) / 4) END AS glcm_{p}_std",
        ]
    return wide.selectExpr("image_id", *out, "CASE WHEN _over THEN 'level_overflow' ELSE 'ok' END AS glcm_status")


def glcm_stats(
    rasters: DataFrame,
    levels: int = 64,
    properties: Sequence[str] = GLCM_PROPERTIES,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    tallies = pixel_tallies(rasters, ("gray", "glcm"), levels=levels, strip_pixels=strip_pixels)
    return glcm_from_tallies(tallies, levels, properties)


# ---------------------------------------------------------------- Gabor filters


def gabor_taps(frequency: float, theta: float):
    """(row taps, column taps) of the separable complex kernel, bandwidth 1 octave."""
    import numpy as np

    sigma = 3.0 * math.sqrt(math.log(2) / 2) / (math.pi * frequency)
    along, across = abs(math.cos(theta)), abs(math.sin(theta))
    reach = math.ceil(max(3 * sigma * along, 3 * sigma * across, 1))
    k = np.arange(-reach, reach + 1)
    envelope = np.exp(-0.5 * (k / sigma) ** 2) / (math.sqrt(2 * math.pi) * sigma)
    wave = 2j * math.pi * frequency * k
    return envelope * np.exp(wave * math.sin(theta)), envelope * np.exp(wave * math.cos(theta))


def _mirrored(index, n: int):
    """Reflected position with the edge pixel repeated."""
    import numpy as np

    folded = np.mod(index, 2 * n)
    return np.where(folded < n, folded, 2 * n - 1 - folded)


def _gabor_moments(stack, h: int, top: int, r0: int, n_rows: int, filters):
    """Mean and centred square sum of every filter's magnitude, per strip of the stack."""
    import numpy as np

    w = stack.shape[2]
    out = []
    for row_taps, col_taps in filters:
        reach = len(row_taps) // 2
        rows = _mirrored(np.arange(r0 - reach, r0 + n_rows + reach), h) - top
        cols = _mirrored(np.arange(-reach, w + reach), w)
        padded = stack[:, rows][:, :, cols]
        across = sum(t * padded[:, :, i : i + w] for i, t in enumerate(col_taps))
        both = sum(t * across[:, i : i + n_rows] for i, t in enumerate(row_taps))
        magnitude = np.hypot(both.real, both.imag).reshape(len(stack), -1)
        mean = magnitude.mean(axis=1)
        out += [mean, ((magnitude - mean[:, None]) ** 2).sum(axis=1)]
    return np.stack(out, axis=1)


def _gabor_udf(filters, budget: int = 1_000_000):
    """Arrow function over strips: array of (mean, centred square sum) per filter.

    At most ``budget`` values, the mirrored border included, are worked on at
    a time, or one strip: small images have more border than pixels.
    """
    reach = max(len(taps) // 2 for pair in filters for taps in pair)

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def moments(gray, h, w, top, r0, n_rows):
        import numpy as np
        import pyarrow as pa

        values, starts = gray.flatten().to_numpy(), gray.offsets.to_numpy()
        starts = starts - starts[0]
        shapes = np.stack([x.to_numpy() for x in (h, w, top, r0, n_rows)], axis=1)
        result = np.empty((len(shapes), 2 * len(filters)))
        for shape in np.unique(shapes, axis=0):
            height, width, first, own, count = (int(x) for x in shape)
            members = np.flatnonzero((shapes == shape).all(axis=1))
            size = int(starts[members[0] + 1] - starts[members[0]])
            step = max(1, budget // ((count + 2 * reach) * (width + 2 * reach)))
            for at_ in range(0, len(members), step):
                part = members[at_ : at_ + step]
                stack = values[starts[part][:, None] + np.arange(size)].astype(float)
                result[part] = _gabor_moments(
                    stack.reshape(len(part), -1, width), height, first, own, count, filters
                )
        offsets = np.arange(0, result.size + 1, result.shape[1], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(result.ravel()))

    return moments


def gabor_stats(
    rasters: DataFrame,
    frequencies: Sequence[float] = (0.1, 0.2),
    angles: Sequence[float] = (0.0, math.pi / 4, math.pi / 2),
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """Mean and population deviation of each filter's response magnitude.

    The isotropic kernel factors into a column and a row pass. Strips carry a
    halo as wide as the kernel, so no pixel is shuffled; one small moment
    record per strip is merged per image.
    """
    stems = [gabor_stem(f, a) for f in frequencies for a in angles]
    filters = [gabor_taps(f, a) for f in frequencies for a in angles]
    reach = max(len(rows) // 2 for rows, _ in filters)
    strips = cut_strips(rasters, ("gray",), reach, strip_pixels)
    udf = _gabor_udf(filters)
    per_strip = strips.select(
        "image_id",
        F.expr("CAST(n_rows * w AS DOUBLE) AS n"),
        udf("gray", "h", "w", "top", "r0", "n_rows").alias("m"),
    )
    # One record per strip, so the gathered list is bounded by the image height.
    gathered = _per_image(per_strip, [
        "sum(n) AS _n",
        *[f"sum(n * m[{2 * i}]) / sum(n) AS _mean{i}" for i in range(len(stems))],
        "collect_list(struct(n, m)) AS _parts",
    ])
    columns = []
    for i, stem in enumerate(stems):
        off = f"(p.m[{2 * i}] - _mean{i})"
        spread = f"aggregate(_parts, 0.0D, (acc, p) -> acc + p.m[{2 * i + 1}] + p.n * {off} * {off})"
        columns += [f"_mean{i} AS `{stem}_mean`", f"sqrt({spread} / _n) AS `{stem}_std`"]
    return gathered.selectExpr("image_id", *columns)
