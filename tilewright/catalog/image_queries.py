"""Queries over the image tiles: pixels, masks, regions, textures, features."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog.fixture import table, tiles
from tilewright.functions.scalars import normalised
from tilewright.functions.summaries import countable_only, flatten_array, summarise
from tilewright.operators import components, raster, regions, segment, texture
from tilewright.plans.image_features import FAMILIES, image_features
from tilewright.session import cut_lineage, shared_dir
from tilewright.sources.images import first_image, read_rasters
from tilewright.sources.tiff import read_strips, scan_layouts, write_tiffs

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, negative zero folded, for comparison with SQL."""
    return df.selectExpr(*[
        f"round(`{n}`, {digits}) + 0.0D AS `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes
    ])


def _runs(spark, sf, nuclei=True, **kw):
    return components.labelled_runs(tiles(spark, sf), nuclei=nuclei, **kw)


def _cells(spark, sf, solidity=False):
    return regions.cells_of(regions.region_table(_runs(spark, sf, nuclei=False), solidity))


def _written_cells(spark, sf):
    """Cells written once, for queries that read them more than once."""
    return cut_lineage(_cells(spark, sf), "cells")


def explode_pixels(spark, sf):
    return raster.pixels(tiles(spark, sf)).drop("gray")


def gray_channel(spark, sf):
    return raster.pixels(tiles(spark, sf)).select("image_id", "r", "c", "gray")


def normalize_channel(spark, sf):
    px = raster.pixels(tiles(spark, sf))
    return rounded(px.selectExpr(
        "image_id", "r", "c", f"{normalised('red')} AS red_norm", f"{normalised('green')} AS green_norm"
    ), 9)


def _tile_folder(spark, sf):
    """Every tile as a file of its label's folder, every hundredth file cut off in the middle."""
    root = f"{shared_dir(spark)}/tiles-{uuid.uuid4().hex}"
    write_tiffs(tiles(spark, sf).withColumn("ok", F.expr("image_id % 100 <> 7")), root)
    return root


#: The number that the file is named after.
_FILE_NUMBER = "CAST(regexp_extract(image_id, '([0-9]+)[.]tif$', 1) AS BIGINT) AS image_id"


def scan_labelled_images(spark, sf):
    """Written tiles found again by their directories alone."""
    return scan_layouts(spark, _tile_folder(spark, sf)).selectExpr(_FILE_NUMBER, "label", "h", "w", "ok")


def decode_rgb(spark, sf):
    """Pixels of the written tiles through the image reader."""
    # Strips scan rasters twice, so files are opened and decoded once before.
    rasters = cut_lineage(read_rasters(spark, _tile_folder(spark, sf)), "rasters")
    return raster.pixels(rasters).selectExpr(_FILE_NUMBER, "r", "c", "red", "green", "blue")


def decode_row_ranges(spark, sf):
    """Pixels of the written tiles, read in ranges of three rows."""
    channels = ("red", "green", "blue")
    _, strips = read_strips(spark, _tile_folder(spark, sf), strip_pixels=24)
    found = raster.strip_positions(strips, channels).selectExpr("image_id", "r", "c", *[f"{raster.at(k)} AS {k}" for k in channels])
    return found.selectExpr(_FILE_NUMBER, "r", "c", *channels)


def first_image_query(spark, sf):
    return first_image(tiles(spark, sf), "image_id", ["label"])


def threshold_fixed(spark, sf):
    return segment.mask_pixels(tiles(spark, sf), use_otsu=False)


def threshold_otsu(spark, sf):
    return segment.mask_pixels(tiles(spark, sf), use_otsu=True)


def otsu_thresholds(spark, sf):
    return rounded(segment.otsu_thresholds(tiles(spark, sf)), 9)


def mask_share_by_label(spark, sf):
    images = tiles(spark, sf)
    strips = segment.masked_strips(images)
    share = regions.overlay_share(strips).join(images.select("image_id", "label", "h", "w"), "image_id")
    return rounded(share.groupBy("label").agg(
        F.count(F.lit(1)).alias("images"),
        F.avg(F.col("cell_pixels") / (F.col("h") * F.col("w"))).alias("mean_cell_share"),
        F.avg(F.col("overlay_pixels") / (F.col("h") * F.col("w"))).alias("mean_overlay_share"),
    ))


def histogram_threshold_join(spark, sf):
    return rounded(segment.channel_ranges(tiles(spark, sf)), 9)


def pixel_offset_join(spark, sf):
    offsets = list(texture.ANGLE_STEPS.values())
    return raster.neighbour_pairs(tiles(spark, sf), offsets)


def intensity_stats(spark, sf):
    return rounded(texture.intensity_stats(tiles(spark, sf)))


def lbp_codes(spark, sf):
    return texture.lbp_codes(tiles(spark, sf)).select("image_id", "r", "c", "code")


def lbp_codes_radius_2(spark, sf):
    coded = texture.lbp_codes(tiles(spark, sf), points=12, radius=2.0)
    return coded.select("image_id", "r", "c", "code")


def lbp_histogram(spark, sf):
    return rounded(texture.lbp_histogram(tiles(spark, sf)))


def glcm_matrix(spark, sf):
    return rounded(texture.glcm_matrix(tiles(spark, sf)), 9)


def _glcm(*properties: str) -> Query:
    return lambda spark, sf: rounded(texture.glcm_stats(tiles(spark, sf), properties=properties).drop("glcm_status"))


def glcm_overflow(spark, sf):
    return rounded(texture.glcm_stats(tiles(spark, sf), levels=52, properties=("contrast", "ASM")).drop("glcm_status"))


def gabor_stats(spark, sf):
    return rounded(texture.gabor_stats(tiles(spark, sf)), 5)


def label_components(spark, sf):
    return components.label_pixels(_runs(spark, sf, nuclei=False)).drop("kind")


def label_components_striped(spark, sf):
    return components.label_pixels(_runs(spark, sf, nuclei=False, strip_pixels=16)).drop("kind")


def region_area_centroid_bbox(spark, sf):
    return rounded(_cells(spark, sf).select(
        "image_id", "region", "area", "centroid_r", "centroid_c", "min_r", "min_c", "max_r", "max_c"
    ))


def region_axes(spark, sf):
    return rounded(_cells(spark, sf).select("image_id", "region", "major_axis", "minor_axis"))


def region_eccentricity(spark, sf):
    return rounded(_cells(spark, sf).select("image_id", "region", "eccentricity"))


def region_perimeter(spark, sf):
    return rounded(_cells(spark, sf).select("image_id", "region", "perimeter"))


def region_solidity(spark, sf):
    return rounded(_cells(spark, sf, True).select("image_id", "region", "area", "solidity"))


def safe_ratio(spark, sf):
    return rounded(_cells(spark, sf).select("image_id", "region", "aspect_ratio", "circularity"))


def _with_nuclei(spark, sf, solidity=False):
    runs = cut_lineage(_runs(spark, sf), "runs")
    table_ = cut_lineage(regions.region_table(runs, solidity), "regions")
    measures = tuple(m for m in regions.NUCLEUS_MEASURES if solidity or m != "solidity")
    return regions.cells_with_nucleus(runs, table_, measures)


def largest_nucleus(spark, sf):
    names = [f"nucleus_{m}" for m in regions.NUCLEUS_MEASURES]
    return rounded(_with_nuclei(spark, sf, True).select("image_id", "region", *names))


def nc_ratio(spark, sf):
    return rounded(_with_nuclei(spark, sf).select("image_id", "region", "nc_ratio"))


def overlay_masks(spark, sf):
    """Red mask laid over the cells: every cell with its overlapping pixels."""
    runs = cut_lineage(_runs(spark, sf), "runs")
    table_ = regions.region_table(runs, False)
    overlap = regions.nuclei_with_cell(runs, table_).groupBy("image_id", F.col("cell").alias("region")).agg(
        F.sum("area").alias("_overlap")
    )
    return regions.cells_of(table_).join(overlap, ["image_id", "region"], "left").select(
        "image_id", "region", "area", F.coalesce("_overlap", F.lit(0.0)).alias("overlap")
    )


def cell_count_density(spark, sf):
    images = tiles(spark, sf)
    return rounded(regions.cell_counts(images, regions.region_table(_runs(spark, sf, nuclei=False), False)))


def nearest_neighbour(spark, sf):
    return rounded(regions.nearest_neighbour(tiles(spark, sf), _written_cells(spark, sf)))


def nearest_neighbour_gridded(spark, sf):
    return rounded(regions.nearest_neighbour(tiles(spark, sf), _written_cells(spark, sf), small=2))


def shape_summary(spark, sf):
    return rounded(regions.shape_summary(tiles(spark, sf), _with_nuclei(spark, sf, True)))


def summary_stats_skip_missing(spark, sf):
    cells = _with_nuclei(spark, sf)
    return rounded(summarise(cells, ["image_id"], {"nc_ratio": "nc_ratio"}))


def cells_by_label(spark, sf):
    """Cells per tile and area per label, the flagship question."""
    images = tiles(spark, sf)
    cells = _written_cells(spark, sf).join(images.select("image_id", "label"), "image_id")
    areas = summarise(cells, ["label"], {"area": "area"})
    per_label = images.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("images"))
    return rounded(areas.join(per_label, "label").withColumn("cells_per_image", F.col("area_count") / F.col("images")))


_LINE_MEASURES = {"qty": "l_quantity", "price": "l_extendedprice", "discount": "l_discount"}


def order_line_summary(spark, sf):
    lines = table(spark, sf, "lineitem")
    # Means of few lines need all digits to miss rounding ties; deviations are kept shorter.
    stats = summarise(lines, ["l_orderkey"], _LINE_MEASURES)
    short = {f"{m}_std": F.expr(f"round({m}_std, 5)") for m in _LINE_MEASURES}
    return rounded(stats.withColumns(short), 7)


def line_summary_ranked_medians(spark, sf):
    lines = table(spark, sf, "lineitem")
    return rounded(summarise(lines, ["l_returnflag"], _LINE_MEASURES, accuracy=500), 4)


def flatten_arrays(spark, sf):
    columns = {
        **flatten_array("embedding", "emb"),
        **flatten_array("slice(embedding, 1, 8)", "head"),
        **flatten_array("slice(embedding, 1, 0)", "none"),
        **countable_only("transform(embedding, v -> CAST(v AS STRING))", "words"),
    }
    wanted = [f"emb_{s}" for s in ("count", "mean", "median", "std", "min", "max")]
    wanted += [f"head_{i}" for i in range(8)] + [f"none_{s}" for s in ("count", "mean", "max")] + ["words_count"]
    source = table(spark, sf, "embeddings")
    return rounded(source.selectExpr("vec_id", *[f"{columns[n]} AS {n}" for n in wanted]))


def image_features_query(spark, sf):
    return rounded(image_features(tiles(spark, sf)).drop("status"), 5)


def feature_families(spark, sf):
    """How many columns each family brings and their mean over all images."""
    wide = image_features(tiles(spark, sf))
    parts = ", ".join(
        f"struct('{family}' AS family, {len(names)} AS columns, {' + '.join(f'abs(`{n}`)' for n in names)} AS t)"
        for family, names in FAMILIES.items()
    )
    long = wide.selectExpr(f"inline(array({parts}))")
    return rounded(long.groupBy("family", "columns").agg(F.expr("avg(t) AS mean_total")), 3)


QUERIES: dict[str, Query] = {
    "explode_pixels": explode_pixels,
    "first_image": first_image_query,
    "scan_labelled_images": scan_labelled_images,
    "decode_rgb": decode_rgb,
    "decode_row_ranges": decode_row_ranges,
    "gray_channel": gray_channel,
    "normalize_channel": normalize_channel,
    "safe_ratio": safe_ratio,
    "flatten_arrays": flatten_arrays,
    "nc_ratio": nc_ratio,
    "threshold_fixed": threshold_fixed,
    "threshold_otsu": threshold_otsu,
    "otsu_thresholds": otsu_thresholds,
    "mask_share_by_label": mask_share_by_label,
    "label_components": label_components,
    "label_components_striped": label_components_striped,
    "region_area_centroid_bbox": region_area_centroid_bbox,
    "region_axes": region_axes,
    "region_eccentricity": region_eccentricity,
    "region_perimeter": region_perimeter,
    "region_solidity": region_solidity,
    "largest_nucleus": largest_nucleus,
    "overlay_masks": overlay_masks,
    "nearest_neighbour": nearest_neighbour,
    "nearest_neighbour_gridded": nearest_neighbour_gridded,
    "pixel_offset_join": pixel_offset_join,
    "histogram_threshold_join": histogram_threshold_join,
    "intensity_stats": intensity_stats,
    "order_line_summary": order_line_summary,
    "line_summary_ranked_medians": line_summary_ranked_medians,
    "summary_stats_skip_missing": summary_stats_skip_missing,
    "cell_count_density": cell_count_density,
    "cells_by_label": cells_by_label,
    "shape_summary": shape_summary,
    "lbp_codes": lbp_codes,
    "lbp_codes_radius_2": lbp_codes_radius_2,
    "lbp_histogram": lbp_histogram,
    "glcm_matrix": glcm_matrix,
    "glcm_contrast": _glcm("contrast"),
    "glcm_dissimilarity": _glcm("dissimilarity"),
    "glcm_homogeneity": _glcm("homogeneity"),
    "glcm_energy_asm": _glcm("energy", "ASM"),
    "glcm_correlation": _glcm("correlation"),
    "glcm_overflow": glcm_overflow,
    "gabor_stats": gabor_stats,
    "image_features": image_features_query,
    "feature_families": feature_families,
}
