"""Rasters, strips and pixels.

A raster row holds one image: ``image_id, label, h, w, ok`` and the channels
``red, green, blue`` as row-major ``ARRAY<SMALLINT>``. Neighbourhood work never
joins pixels: a raster is cut into strips of whole image rows, each carrying
the extra rows (halo) its neighbourhood needs, so a pixel finds its neighbours
by index in its own record. Strips of images that need several are dealt to
tasks by (image, strip), each cut on its own, so one huge image is work for
many tasks and no record holds more than one strip and its halo.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tilewright.functions.scalars import gray

STRIP_PIXELS = 65_536


def rows_per_strip(strip_pixels: int) -> str:
    return f"CAST(greatest(1, {strip_pixels} DIV greatest(w, 1)) AS INT)"


def cut_strips(
    rasters: DataFrame,
    channels: Sequence[str] = ("red", "green", "blue"),
    halo: int = 0,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """Strips of readable images: ``image_id, h, w, r0, n_rows, top`` and the channels.

    ``r0`` is the strip's first own row and ``n_rows`` their number; the arrays
    start at row ``top`` = r0 - halo, cut at the image edges. ``gray`` may be
    asked for like a channel.
    """
    source = [c for c in channels if c != "gray"]
    if "gray" in channels:
        source = list(dict.fromkeys([*source, "red", "green", "blue"]))
    top = f"greatest(s * _rows - {halo}, 0)"
    bottom = f"least((s + 1) * _rows + {halo}, h)"
    cuts = [f"slice({c}, {top} * w + 1, ({bottom} - {top}) * w) AS {c}" for c in source]
    sized = (
        rasters.filter("ok AND h > 0 AND w > 0")
        .selectExpr("image_id", "h", "w", *source, f"{rows_per_strip(strip_pixels)} AS _rows")
    )
    out = [f"{_gray_of()} AS gray" if c == "gray" else c for c in channels]
    bounds = ["image_id", "h", "w", "s * _rows AS r0", "least(_rows, h - s * _rows) AS n_rows", f"{top} AS top"]
    # An image of one strip stays where it was read.
    single = sized.filter("h <= _rows").selectExpr("*", "0 AS s").selectExpr(*bounds, *cuts)
    tall = (
        sized.filter("h > _rows").selectExpr("*", "explode(sequence(0, CAST((h - 1) DIV _rows AS INT))) AS s")
        .selectExpr(*bounds, *cuts).repartition("image_id", "r0")
    )
    return single.unionByName(tall).selectExpr("image_id", "h", "w", "r0", "n_rows", "top", *out)


def _gray_of() -> str:
    """Grey levels from the channel arrays."""
    rest = "zip_with(green, blue, (g, b) -> CAST(g AS INT) + b)"
    return f"zip_with(red, {rest}, (r, s) -> CAST((r + s) DIV 3 AS SMALLINT))"


def at(channel: str, dr: int = 0, dc: int = 0) -> str:
    """Value at an offset from the current pixel; NULL outside the image."""
    if dr == 0 and dc == 0:
        return f"get({channel}, _at)"
    inside = []
    if dr:
        inside.append(f"r >= {-dr}" if dr < 0 else f"r < h - {dr}")
    if dc:
        inside.append(f"c >= {-dc}" if dc < 0 else f"c < w - {dc}")
    return f"CASE WHEN {' AND '.join(inside)} THEN get({channel}, _at + (w * {dr} + {dc})) END"


def strip_positions(strips: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per own pixel of a strip: ``r, c`` and its array index ``_at``.

    The arrays in ``keep`` stay addressable through ``at``; a projection has to
    follow at once so that they are not copied for every pixel.
    """
    return strips.selectExpr(
        "image_id", "h", "w", "r0", "top", *keep, "explode(sequence(0, n_rows * w - 1)) AS _i"
    ).selectExpr(
        "image_id", "h", "w", *keep,
        "CAST(_i DIV w AS INT) + r0 AS r", "_i % w AS c", "_i + (r0 - top) * w AS _at",
    )


def pixels(rasters: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """Long table ``image_id, r, c, red, green, blue, gray``, one row per pixel."""
    channels = ("red", "green", "blue")
    strips = cut_strips(rasters, channels, 0, strip_pixels)
    rgb = strip_positions(strips, channels).selectExpr("image_id", "r", "c", *[f"{at(k)} AS {k}" for k in channels])
    return rgb.selectExpr("*", f"{gray('red', 'green', 'blue')} AS gray")


def neighbour_pairs(
    rasters: DataFrame,
    offsets: Sequence[tuple[int, int]],
    channel: str = "gray",
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """Pixel pairs (p, p + offset) inside one image.

    The shifted self equi-join of the pixel table on (image_id, r+dr, c+dc),
    answered by index inside halo strips, so nothing is shuffled.
    """
    reach = max(abs(dr) for dr, _ in offsets)
    strips = cut_strips(rasters, (channel,), reach, strip_pixels)
    pairs = ", ".join(f"struct({dr} AS dr, {dc} AS dc, {at(channel, dr, dc)} AS there)" for dr, dc in offsets)
    return (
        strip_positions(strips, (channel,))
        .selectExpr("image_id", "r", "c", f"{at(channel)} AS here", f"explode(array({pairs})) AS p")
        .selectExpr("image_id", "r", "c", "here", "p.dr", "p.dc", "p.there")
        .filter("there IS NOT NULL")
    )
