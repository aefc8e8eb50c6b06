"""The six summary statistics, grouped and for array columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.quantiles import ACCURACY, exact_quantile

STATS = ("count", "mean", "median", "std", "min", "max")


def _aggregates(prefix: str, column: str) -> list[str]:
    x = f"CAST({column} AS DOUBLE)"
    found = {
        "count": f"CAST(count({column}) AS DOUBLE)",
        "mean": f"avg({x})",
        "std": f"stddev_pop({x})",
        "min": f"min({x})",
        "max": f"max({x})",
    }
    return [f"coalesce({expression}, 0.0D) AS {prefix}_{stat}" for stat, expression in found.items()]


def _grouped(df: DataFrame, keys: Sequence[str], aggregates: Sequence[str]) -> DataFrame:
    packed = df.groupBy(*keys).agg(F.expr(f"struct({', '.join(aggregates)}) AS _s"))
    return packed.select(*keys, "_s.*")


def summarise(df: DataFrame, keys: Sequence[str], measures: Mapping[str, str], accuracy: int = ACCURACY) -> DataFrame:
    """One row per key with ``<prefix>_{count,mean,median,std,min,max}``.

    ``measures`` maps a prefix to a column. Missing values are skipped; a group
    with none left gives six zeros. The deviation is the population one.
    Medians are exact, and no task gathers a group for them.
    """
    keys = list(keys)
    plain = _grouped(df, keys, [a for p, c in measures.items() for a in _aggregates(p, c)])
    entries = ", ".join(f"struct('{p}' AS measure, CAST({c} AS DOUBLE) AS value)" for p, c in measures.items())
    long = (
        df.selectExpr(*keys, f"explode(array({entries})) AS m")
        .selectExpr(*keys, "m.measure", "m.value").filter("value IS NOT NULL")
    )
    medians = exact_quantile(long, [*keys, "measure"], "value", 0.5, "median", accuracy)
    wide = _grouped(medians, keys, [f"max(CASE WHEN measure = '{p}' THEN median END) AS {p}_median" for p in measures])
    return plain.join(wide, keys, "left").selectExpr(
        *keys, *[f"coalesce({p}_{s}, 0.0D) AS {p}_{s}" for p in measures for s in STATS]
    )


def flatten_array(array: str, name: str, limit: int = 20) -> dict[str, str]:
    """Scalars for one array column.

    Up to ``limit`` items become ``name_0 .. name_<limit-1>`` (absent ones NULL);
    empty and longer arrays become the six statistics (NULL for short arrays).
    Statistics are array expressions, so no row leaves its partition.
    """
    values = f"transform({array}, v -> CAST(v AS DOUBLE))"
    n = f"size({array})"
    short = f"({n} > 0 AND {n} <= {limit})"
    ordered = f"array_sort({values})"
    mean = f"(aggregate({values}, 0.0D, (acc, v) -> acc + v) / {n})"
    stats = {
        "mean": mean,
        "median": f"(get({ordered}, ({n} - 1) DIV 2) + get({ordered}, {n} DIV 2)) / 2",
        "std": f"sqrt(aggregate({values}, 0.0D, (acc, v) -> acc + (v - {mean}) * (v - {mean})) / {n})",
        "min": f"array_min({values})",
        "max": f"array_max({values})",
    }
    out = {f"{name}_{i}": f"CASE WHEN {short} THEN get({values}, {i}) END" for i in range(limit)}
    out[f"{name}_count"] = f"CASE WHEN NOT {short} THEN CAST({n} AS DOUBLE) END"
    for stat, expression in stats.items():
        out[f"{name}_{stat}"] = f"CASE WHEN {n} = 0 THEN 0.0D WHEN NOT {short} THEN {expression} END"
    return out


def countable_only(array: str, name: str) -> dict[str, str]:
    """For arrays that do not cast to numbers: just their size."""
    return {f"{name}_count": f"CAST(size({array}) AS DOUBLE)"}
