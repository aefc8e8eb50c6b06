"""The wide feature table: one row per image, 132 measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tilewright.functions.scalars import gabor_stem
from tilewright.functions.summaries import STATS
from tilewright.operators.components import labelled_runs
from tilewright.operators.raster import STRIP_PIXELS
from tilewright.operators.regions import (
    CELL_MEASURES,
    NUCLEUS_MEASURES,
    cell_counts,
    cells_of,
    cells_with_nucleus,
    nearest_neighbour,
    region_table,
    shape_summary,
)
from tilewright.operators.segment import otsu_from_tallies
from tilewright.operators.texture import (
    GLCM_PROPERTIES,
    gabor_stats,
    glcm_from_tallies,
    intensity_from_tallies,
    lbp_from_tallies,
    pixel_tallies,
)
from tilewright.session import cut_lineage

FREQUENCIES = (0.1, 0.2)
ANGLES = (0.0, math.pi / 4, math.pi / 2)


def _six(*stems: str) -> list[str]:
    return [f"{stem}_{s}" for stem in stems for s in STATS]


def feature_families(
    points: int = 8, frequencies: Sequence[float] = FREQUENCIES, angles: Sequence[float] = ANGLES, nuclei: bool = True
) -> dict[str, list[str]]:
    """Column names by family, in table order."""
    families = {
        "intensity": [f"intensity_{s}" for s in ("mean", "std", "skew", "kurtosis")],
        "cells": ["cell_count", "cell_density"],
        "nucleus": _six(*[f"nucleus_{m}" for m in NUCLEUS_MEASURES]),
        "ratio": _six("nc_ratio"),
        "cell_shape": _six(*CELL_MEASURES),
        "neighbours": ["nn_mean", "nn_std"],
        "lbp": [f"lbp_{i}" for i in range(points + 2)],
        "glcm": [f"glcm_{p}_{s}" for p in GLCM_PROPERTIES for s in ("mean", "std")],
        "gabor": [f"{gabor_stem(f, a)}_{s}" for f in frequencies for a in angles for s in ("mean", "std")],
    }
    if not nuclei:
        del families["nucleus"], families["ratio"]
    return families


FAMILIES = feature_families()


def image_features(
    rasters: DataFrame,
    *,
    lbp_points: int = 8,
    lbp_radius: float = 1.0,
    green_threshold: float = 0.2,
    red_threshold: float = 0.3,
    use_otsu: bool = True,
    glcm_levels: int = 64,
    gabor_frequencies: Sequence[float] = FREQUENCIES,
    gabor_angles: Sequence[float] = ANGLES,
    nuclei: bool = True,
    strip_pixels: int = STRIP_PIXELS,
) -> DataFrame:
    """``image_id, label``, the features as doubles and a ``status``.

    Pixels are scanned three times: once for every tally, once for the runs,
    once for the filters. Runs and regions feed several families each and are
    written once. Every image keeps a row; an unreadable one is all zeros with
    status ``unreadable``.
    """
    tallies = cut_lineage(pixel_tallies(
        rasters, ("gray", "green", "red", "lbp", "glcm"),
        points=lbp_points, radius=lbp_radius, levels=glcm_levels, strip_pixels=strip_pixels,
    ), "tallies")
    runs = cut_lineage(labelled_runs(
        rasters, use_otsu, green_threshold, red_threshold,
        otsu_from_tallies(tallies) if use_otsu else None, nuclei, strip_pixels,
    ), "runs")
    regions = cut_lineage(region_table(runs), "regions")
    cells = cells_of(regions)
    shaped = cells_with_nucleus(runs, regions) if nuclei else cells
    parts = [
        intensity_from_tallies(tallies),
        cell_counts(rasters, regions),
        shape_summary(rasters, shaped),
        nearest_neighbour(rasters, cells),
        lbp_from_tallies(tallies, lbp_points),
        glcm_from_tallies(tallies, glcm_levels),
        gabor_stats(rasters, gabor_frequencies, gabor_angles, strip_pixels),
    ]
    wide = rasters.select("image_id", "label", "ok")
    for part in parts:
        wide = wide.join(part, "image_id", "left")
    families = feature_families(lbp_points, gabor_frequencies, gabor_angles, nuclei)
    names = [n for family in families.values() for n in family]
    return wide.selectExpr(
        "image_id", "label",
        *[f"coalesce(CAST(`{n}` AS DOUBLE), 0.0D) AS `{n}`" for n in names],
        "CASE WHEN ok THEN glcm_status ELSE 'unreadable' END AS status",
    )
