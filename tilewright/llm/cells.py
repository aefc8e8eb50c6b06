"""Joins of two tables on a key, in cells of bounded size whatever a key's share of the rows.

A key with many rows becomes a grid: its left rows are dealt to rows of the
grid, its right rows to columns, and each is sent to every cell of its row or
column. Every pair of rows of a key meets in exactly one cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import hinted, written


def in_cells(left: DataFrame, right: DataFrame, key: str, left_deal: str, right_deal: str, left_rows: int, right_rows: int):
    """The cogroups of both sides per cell; about ``left_rows`` and ``right_rows`` rows in each.

    The deals are SQL expressions that tell a side's rows apart. Cells are
    work rather than bytes, so their partitions are not merged.
    """
    counts = left.groupBy(key).agg(F.expr("count(1) AS _l")).join(right.groupBy(key).agg(F.expr("count(1) AS _r")), key)
    sizes = counts.selectExpr(
        f"{key} AS _key", f"CAST(ceil(_l / {left_rows}) AS INT) AS _rows", f"CAST(ceil(_r / {right_rows}) AS INT) AS _columns"
    )
    grid = hinted(written(sizes, "cell-grid"))
    spark = left.sparkSession
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    placed = []
    for side, deal, own, other in ((left, left_deal, "row", "column"), (right, right_deal, "column", "row")):
        dealt = side.join(grid, side[key] == grid["_key"]).withColumn(f"_{own}", F.expr(f"CAST(pmod(xxhash64({deal}), _{own}s) AS INT)"))
        spread = dealt.withColumn(f"_{other}", F.expr(f"explode(sequence(0, _{other}s - 1))")).drop("_key", "_rows", "_columns")
        placed.append(spread.repartition(partitions, key, "_row", "_column").groupBy(key, "_row", "_column"))
    return placed[0].cogroup(placed[1])
