"""Scalar expressions shared by the operators, as SQL text.

Operators build their projections from SQL text: one call per projection
instead of one call per node of the expression tree keeps wide plans cheap to
construct, and Catalyst sees the same tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(value: float) -> str:
    """A DOUBLE literal."""
    return f"{float(value)!r}D"


def gray(red: str, green: str, blue: str) -> str:
    """Mean of the three channels, truncated to a whole grey level."""
    return f"CAST((CAST({red} AS INT) + {green} + {blue}) DIV 3 AS SMALLINT)"


def normalised(channel: str) -> str:
    """Channel value on the 0..1 scale."""
    return f"({channel} / 255.0D)"


def safe_ratio(numerator: str, denominator: str) -> str:
    """Division that gives 0 where the denominator is not positive."""
    return f"CASE WHEN {denominator} > 0 THEN {numerator} / {denominator} ELSE 0.0D END"


def circularity(area: str, perimeter: str) -> str:
    """4*pi*area / perimeter^2, 0 for a region without perimeter."""
    return safe_ratio(f"({number(4 * math.pi)} * {area})", f"({perimeter} * {perimeter})")


def nc_ratio(nucleus_area: str, cell_area: str) -> str:
    """Nucleus area over cytoplasm area.

    A cell without nucleus gives 0; a cell with no cytoplasm left gives NULL,
    so it drops out of the aggregates.
    """
    cytoplasm = f"greatest({cell_area} - {nucleus_area}, 0.0D)"
    return (
        f"CASE WHEN {nucleus_area} IS NULL OR {nucleus_area} = 0 THEN 0.0D "
        f"WHEN {cytoplasm} > 0 THEN {nucleus_area} / {cytoplasm} END"
    )


def finite(value: str) -> str:
    """NaN and both infinities become NULL."""
    return f"CASE WHEN abs(CAST({value} AS DOUBLE)) < double('Infinity') THEN CAST({value} AS DOUBLE) END"


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of numeric columns in table order; booleans and dates do not count."""
    skip = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def inf_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values of every numeric column as NULL, in one projection."""
    targets = set(numeric_columns(df) if columns is None else columns)
    return df.selectExpr(*[
        f"{finite(quoted(c))} AS {quoted(c)}" if c in targets else quoted(c) for c in df.columns
    ])


def fill_missing_zero(df: DataFrame) -> DataFrame:
    """NULL and NaN of numeric columns become 0; other columns stay."""
    return df.na.fill(0)


def label_to_string(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn(target, F.col(target).cast("string"))


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(features without the target, target alone); a missing target is an error."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    return df.drop(target), df.select(target)


def keep_available(names: Sequence[str], available: Iterable[str], limit: int | None = None) -> list[str]:
    """Requested names the table has, in the requested order, then the first ``limit``."""
    have = set(available)
    kept = [n for n in names if n in have]
    return kept if limit is None else kept[:limit]


def missing_columns(expected: Sequence[str], available: Iterable[str]) -> list[str]:
    have = set(available)
    return [n for n in expected if n not in have]


def display_name(name: str) -> str:
    """``nn_mean`` -> ``Nn Mean``."""
    return f"initcap(replace({name}, '_', ' '))"


def gabor_stem(frequency: float, theta: float) -> str:
    """Column stem of one Gabor filter, the angle in whole degrees."""
    return f"gabor_f{frequency}_a{int(math.degrees(theta))}"
