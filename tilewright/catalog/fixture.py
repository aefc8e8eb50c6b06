"""The given tables, shaped as the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tilewright.sources.tables import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 64-vector as an 8x8 RGB image: green is the scaled vector, red the
    reversed one, blue the one shifted by 16 positions."""
    scaled = (
        "transform(embedding, v -> CAST(least(255, greatest(0, floor((CAST(v AS DOUBLE) + 0.5D) * 255))) AS SMALLINT))"
    )
    return (
        spread(table(spark, sf_dir, "embeddings"))
        .selectExpr("vec_id AS image_id", "CAST(label AS STRING) AS label", f"{scaled} AS green")
        .selectExpr(
            "image_id", "label", "8 AS h", "8 AS w", "true AS ok", "reverse(green) AS red", "green",
            "concat(slice(green, 17, 48), slice(green, 1, 16)) AS blue",
        )
    )


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, f_00..f_63, label`` with missing, infinite and constant columns
    put in by rule."""
    cells = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(64)]
    cells[0] = f"CASE WHEN vec_id % 7 <> 0 THEN {cells[0]} END"
    cells[1] = f"CASE WHEN vec_id % 2 <> 0 THEN {cells[1]} END"
    cells[2] = f"CASE WHEN vec_id % 11 = 0 THEN double('Infinity') ELSE {cells[2]} END"
    cells[3] = "1.0D"
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", *[f"{c} AS f_{i:02d}" for i, c in enumerate(cells)], "label"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vec_id, truth, prediction``: every fifth row is off by one class."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "CAST(label AS STRING) AS truth",
        "CAST(CASE WHEN vec_id % 5 = 0 THEN (label + 1) % 10 ELSE label END AS STRING) AS prediction",
    )
