"""Thresholds and masks of the two stained channels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.scalars import normalised, number
from tilewright.operators.raster import STRIP_PIXELS, at, cut_strips, strip_positions
from tilewright.operators.texture import GREEN, RED, pixel_tallies

BINS = 256

# Images whose thresholds may be broadcast: one record of about 50 bytes each.
BROADCAST_IMAGES = 1_000_000


def with_thresholds(strips: DataFrame, thresholds: DataFrame, images: int) -> DataFrame:
    """Strips with the thresholds of their image.

    Up to ``BROADCAST_IMAGES`` images the thresholds go to the strips, which then
    stay where they are. Beyond that both sides shuffle by image, and adaptive
    execution splits an image with many strips.
    """
    small = F.broadcast(thresholds) if images <= BROADCAST_IMAGES else thresholds
    return strips.join(small, "image_id")


def otsu_from_tallies(tallies: DataFrame) -> DataFrame:
    """``image_id, green_threshold, red_threshold`` from value histograms.

    256 equal bins span the channel's range. Grey levels are whole numbers and
    the range is at most 255, so no two levels share a bin and the value
    histogram, at most 256 rows per image, is the binned one. Empty bins repeat
    the split before them and never win the first-maximum rule.
    """
    channel = "PARTITION BY image_id, kind"
    upto = f"{channel} ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    ranged = tallies.filter(f"kind IN ({GREEN}, {RED})").selectExpr(
        "image_id", "kind", "a", "n", f"min(a) OVER ({channel}) AS lo", f"max(a) OVER ({channel}) AS hi"
    )
    position = f"least({BINS - 1}, ((a - lo) * {BINS}) DIV greatest(hi - lo, 1))"
    centred = ranged.selectExpr(
        "image_id", "kind", "a", "n",
        f"CASE WHEN lo = hi THEN CAST(a AS DOUBLE) ELSE lo + ({position} + 0.5D) * (hi - lo) / {BINS}D END AS x",
    )
    split = centred.selectExpr(
        "image_id", "kind", "x",
        f"CAST(sum(n) OVER ({upto}) AS DOUBLE) AS w1", f"sum(n * x) OVER ({upto}) AS s1",
        f"CAST(sum(n) OVER ({channel}) AS DOUBLE) AS wt", f"sum(n * x) OVER ({channel}) AS st",
    )
    gap = "(s1 / w1 - (st - s1) / (wt - w1))"
    scored = split.selectExpr(
        "image_id", "kind", "x", f"CASE WHEN wt > w1 THEN w1 * (wt - w1) * {gap} * {gap} END AS between_classes"
    ).selectExpr("*", f"max(between_classes) OVER ({channel}) AS best")
    # A constant channel has one level and no split: the level is its own threshold.
    chosen = "CASE WHEN best IS NULL OR between_classes = best THEN x END"
    return scored.groupBy("image_id").agg(*[
        F.expr(f"min(CASE WHEN kind = {kind} THEN {chosen} END) AS {name}_threshold")
        for name, kind in (("green", GREEN), ("red", RED))
    ])


def otsu_thresholds(rasters: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    return otsu_from_tallies(pixel_tallies(rasters, ("green", "red"), strip_pixels=strip_pixels))


def _above(channel: str, use_otsu: bool, fixed: float) -> str:
    """Strict comparison of a channel array with its threshold."""
    test = f"v > {channel}_threshold" if use_otsu else f"{normalised('v')} > {number(fixed)}"
    return f"transform({channel}, v -> {test})"


def masked_strips(
    rasters: DataFrame,
    use_otsu: bool = True,
    green_threshold: float = 0.2,
    red_threshold: float = 0.3,
    halo: int = 0,
    thresholds: DataFrame | None = None,
    strip_pixels: int = STRIP_PIXELS,
    images: int | None = None,
) -> DataFrame:
    """Strips with ``green_mask`` and ``red_mask`` as ``ARRAY<BOOLEAN>``.

    ``images`` is the number of rasters, counted here if not known.
    """
    strips = cut_strips(rasters, ("green", "red"), halo, strip_pixels)
    if use_otsu:
        found = otsu_thresholds(rasters, strip_pixels) if thresholds is None else thresholds
        strips = with_thresholds(strips, found, rasters.count() if images is None else images)
    return strips.selectExpr(
        "image_id", "h", "w", "r0", "n_rows", "top",
        f"{_above('green', use_otsu, green_threshold)} AS green_mask",
        f"{_above('red', use_otsu, red_threshold)} AS red_mask",
    )


def mask_pixels(
    rasters: DataFrame,
    use_otsu: bool = True,
    green_threshold: float = 0.2,
    red_threshold: float = 0.3,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """``image_id, r, c, green_mask, red_mask``, one row per pixel."""
    strips = masked_strips(rasters, use_otsu, green_threshold, red_threshold, strip_pixels=strip_pixels)
    names = ("green_mask", "red_mask")
    return strip_positions(strips, names).selectExpr("image_id", "r", "c", *[f"{at(n)} AS {n}" for n in names])


def channel_ranges(rasters: DataFrame, strip_pixels: int = STRIP_PIXELS) -> DataFrame:
    """Per-image scalars put on every pixel: ``image_id, r, c, green`` with the
    green range and threshold of the image."""
    tallies = pixel_tallies(rasters, ("green", "red"), strip_pixels=strip_pixels)
    ranges = tallies.filter(f"kind = {GREEN}").groupBy("image_id").agg(
        F.expr("min(a) AS green_min"), F.expr("max(a) AS green_max")
    )
    scalars = ranges.join(otsu_from_tallies(tallies).select("image_id", "green_threshold"), "image_id")
    strips = with_thresholds(cut_strips(rasters, ("green",), 0, strip_pixels), scalars, rasters.count())
    names = ("green_min", "green_max", "green_threshold")
    # Exploding after the join keeps the join at one row per strip.
    return strips.selectExpr("image_id", "w", "r0", *names, "posexplode(green) AS (_i, green)").selectExpr(
        "image_id", "CAST(_i DIV w AS INT) + r0 AS r", "_i % w AS c", "green", *names
    )
