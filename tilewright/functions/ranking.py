"""Row numbers inside groups of any size.

A plain ``row_number() over (partition by g order by k)`` sorts each group in
one task, which fails when one group holds a large share of the rows. Here the
group is cut into buckets that follow the order; rows are numbered inside their
bucket and shifted by the number of rows in the buckets before it. The result
is the plain row number, with work split by (group, bucket).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def number_within(
    df: DataFrame, group: Sequence[str], bucket: str, order: str, name: str = "rn", per_group: DataFrame | None = None
) -> DataFrame:
    """Adds ``name`` = 1..n inside each group; ``bucket`` must rise with ``order``.

    ``per_group`` optionally brings further columns by group. They ride on the
    (group, bucket) sizes, so rows are never joined on the group alone.
    """
    by = ", ".join(group)
    keyed = df.withColumn("_bucket", F.expr(bucket))
    sizes = keyed.groupBy(*group, "_bucket").agg(F.expr("count(1) AS _n"))
    shifts = sizes.selectExpr(
        *group,
        "_bucket",
        f"coalesce(sum(_n) OVER (PARTITION BY {by} ORDER BY _bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _shift",
    )
    if per_group is not None:
        shifts = shifts.join(per_group, list(group))
    inside = f"CAST(row_number() OVER (PARTITION BY {by}, _bucket ORDER BY {order}) AS BIGINT)"
    return (
        keyed.join(shifts, [*group, "_bucket"])
        .withColumn(name, F.expr(f"{inside} + _shift"))
        .drop("_bucket", "_shift")
    )


def hashed_order(seed: int, key: str) -> str:
    """Repeatable shuffling key, the same in any SQL engine with MD5."""
    return f"md5(concat('{seed}:', CAST({key} AS STRING)))"


def hash_bucket(hashed: str, digits: int = 3) -> str:
    """16**digits evenly filled buckets in hash order."""
    return f"substring({hashed}, 1, {digits})"
