"""Cleaning of feature tables: missing profile, imputation, standardisation.

Fitting takes two passes over the table whatever its width: one aggregate for
counts and moments, one for the fill values. What returns to the driver is one
record per column. Applying is a projection of literals, without shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.quantiles import ACCURACY, column_medians
from tilewright.functions.scalars import (
    finite,
    inf_to_null,
    label_to_string,
    numeric_columns,
    number,
    quoted,
    split_target,
)

STRATEGIES = ("median", "mean", "most_frequent", "constant")
PARAMETER_SCHEMA = "position INT, feature STRING, kept BOOLEAN, missing DOUBLE, fill DOUBLE, mean DOUBLE, scale DOUBLE"


@dataclass(frozen=True)
class ColumnParameters:
    """What cleaning learned about one column."""

    position: int
    feature: str
    kept: bool
    missing: float
    fill: float | None
    mean: float | None
    scale: float | None


@dataclass(frozen=True)
class Preprocessor:
    columns: tuple[ColumnParameters, ...]

    @property
    def kept(self) -> list[ColumnParameters]:
        return [c for c in self.columns if c.kept]

    @property
    def feature_columns(self) -> list[str]:
        return [c.feature for c in self.kept]

    @property
    def dropped_columns(self) -> list[str]:
        return [c.feature for c in self.columns if not c.kept]

    def imputed(self, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        return df.selectExpr(*extra, *[f"{self._filled(c)} AS {quoted(c.feature)}" for c in self.kept])

    def transform(self, df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
        """Imputed and standardised features, after the columns in ``extra``."""
        return df.selectExpr(*extra, *[
            f"({self._filled(c)} - {number(c.mean)}) / {number(c.scale)} AS {quoted(c.feature)}" for c in self.kept
        ])

    @staticmethod
    def _filled(c: ColumnParameters) -> str:
        return f"coalesce({finite(quoted(c.feature))}, {number(c.fill)})"

    def table(self, spark: SparkSession) -> DataFrame:
        """One row per column, kept or dropped."""
        rows = [(c.position, c.feature, c.kept, c.missing, c.fill, c.mean, c.scale) for c in self.columns]
        return spark.createDataFrame(rows, PARAMETER_SCHEMA)

    @staticmethod
    def from_table(table: DataFrame) -> Preprocessor:
        rows = table.orderBy("position").collect()
        return Preprocessor(tuple(ColumnParameters(**row.asDict()) for row in rows))


def _column_facts(df: DataFrame, columns: Sequence[str]) -> tuple[int, dict[str, dict]]:
    """Row count and, per column, missing share and moments of the present values."""
    # Values are made finite once, below the aggregate.
    present = df.selectExpr(*[f"{finite(quoted(c))} AS {quoted(c)}" for c in columns])
    parts = ", ".join(
        f"struct(count({c}) AS present, avg({c}) AS mean, var_pop({c}) AS var) AS {c}" for c in map(quoted, columns)
    )
    row = present.agg(F.expr(f"struct(count(1) AS _rows, struct({parts}) AS _c) AS s")).first()["s"]
    return row["_rows"], {c: row["_c"][c].asDict() for c in columns}


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None, top: int = 30) -> DataFrame:
    """``feature, missing, fraction`` of columns with gaps, worst first."""
    columns = numeric_columns(df) if columns is None else list(columns)
    parts = ", ".join(
        f"struct('{c}' AS feature, count(1) - count({finite(quoted(c))}) AS missing, count(1) AS n)" for c in columns
    )
    return (
        df.agg(F.expr(f"array({parts}) AS a")).selectExpr("inline(a)").filter("missing > 0")
        .selectExpr("feature", "missing", "missing / n AS fraction")
        .orderBy(F.desc("fraction"), "feature").limit(top)
    )


def sparse_columns(df: DataFrame, columns: Sequence[str], max_fraction: float = 0.5) -> list[str]:
    """Columns whose missing share is at or above the limit."""
    rows, facts = _column_facts(df, columns)
    return [c for c in columns if 1 - facts[c]["present"] / max(rows, 1) >= max_fraction]


def drop_sparse_columns(df: DataFrame, columns: Sequence[str] | None = None, max_fraction: float = 0.5) -> DataFrame:
    columns = numeric_columns(df) if columns is None else columns
    return df.drop(*sparse_columns(df, columns, max_fraction))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = ", ".join(f"struct('{c}' AS feature, {finite(quoted(c))} AS value)" for c in columns)
    return df.selectExpr(f"inline(array({cells}))").filter("value IS NOT NULL")


def fill_values(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str = "median",
    constant: float = 0.0,
    means: dict[str, float] | None = None,
    accuracy: int = ACCURACY,
) -> dict[str, float]:
    """The value each column's gaps take.

    Medians are exact, and no task holds a whole column for them. The most
    frequent value is the smallest on ties.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown impute strategy '{strategy}'")
    if not columns:
        return {}
    if strategy == "constant":
        return {c: constant for c in columns}
    if strategy == "mean":
        if means is None:
            means = {c: f["mean"] for c, f in _column_facts(df, columns)[1].items()}
        return {c: means[c] for c in columns}
    if strategy == "most_frequent":
        counts = _long(df, columns).groupBy("feature", "value").count()
        best = counts.groupBy("feature").agg(F.expr("-max(struct(count, -value)).col2 AS value"))
        return {r["feature"]: r["value"] for r in best.collect()}
    return column_medians(df, {c: finite(quoted(c)) for c in columns}, accuracy)


def _scaled(present: int, rows: int, mean: float, var: float, fill: float) -> tuple[float, float]:
    """Mean and scale after the gaps are filled, without another pass."""
    gaps = rows - present
    if gaps:
        shift = fill - mean
        var = (present * var + present * gaps / rows * shift * shift) / rows
        mean = (present * mean + gaps * fill) / rows
    # A column constant up to rounding is only centred.
    eps = 2.220446049250313e-16
    constant = var <= rows * eps * var + (rows * mean * eps) ** 2
    return mean, 1.0 if constant or var == 0 else var**0.5


def fit_preprocessor(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_fraction: float = 0.5,
    strategy: str = "median",
    constant: float = 0.0,
) -> Preprocessor:
    """Parameters of drop-sparse, impute and standardise."""
    columns = numeric_columns(df) if columns is None else list(columns)
    rows, facts = _column_facts(df, columns)
    if rows == 0:
        raise ValueError("cannot fit on an empty table")
    share = {c: 1 - facts[c]["present"] / rows for c in columns}
    kept = [c for c in columns if share[c] < max_fraction]
    empty = [c for c in kept if facts[c]["present"] == 0]
    if empty and strategy != "constant":
        raise ValueError(f"columns without any value cannot be imputed: {empty}")
    means = {c: facts[c]["mean"] for c in kept}
    fills = fill_values(df, kept, strategy, constant, means)
    out = []
    for position, c in enumerate(columns):
        if c in fills:
            known = facts[c]["mean"] is not None
            mean, scale = _scaled(
                facts[c]["present"], rows, facts[c]["mean"] if known else 0.0, facts[c]["var"] if known else 0.0, fills[c]
            )
            out.append(ColumnParameters(position, c, True, share[c], float(fills[c]), mean, scale))
        else:
            out.append(ColumnParameters(position, c, False, share[c], None, None, None))
    return Preprocessor(tuple(out))


def impute(df: DataFrame, columns: Sequence[str] | None = None, strategy: str = "median", constant: float = 0.0,
           accuracy: int = ACCURACY) -> DataFrame:
    """Gaps of the given columns filled; other columns stay."""
    columns = numeric_columns(df) if columns is None else list(columns)
    fills = fill_values(df, columns, strategy, constant, accuracy=accuracy)
    return df.selectExpr(*[
        f"coalesce({finite(quoted(c))}, {number(fills[c])}) AS {quoted(c)}" if c in fills else quoted(c) for c in df.columns
    ])


def standardize(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(x - mean) / population deviation; constant columns are only centred."""
    columns = numeric_columns(df) if columns is None else list(columns)
    rows, facts = _column_facts(df, columns)
    moves = {c: _scaled(rows, rows, f["mean"], f["var"], 0.0) for c, f in facts.items() if f["mean"] is not None}
    return df.selectExpr(*[
        f"({finite(quoted(c))} - {number(moves[c][0])}) / {number(moves[c][1])} AS {quoted(c)}" if c in moves else quoted(c)
        for c in df.columns
    ])


def clean_features(
    df: DataFrame,
    target: str = "label",
    keys: Sequence[str] = (),
    max_fraction: float = 0.5,
    strategy: str = "median",
    fit_on: DataFrame | None = None,
) -> tuple[DataFrame, Preprocessor]:
    """Cleaned table ``keys..., features..., target`` and its parameters.

    By default the parameters are fitted on all rows, as the published numbers
    were; pass the training rows as ``fit_on`` to keep test rows out of them.
    """
    split_target(df, target)
    columns = numeric_columns(df, [target, *keys])
    source = inf_to_null(df if fit_on is None else fit_on, columns)
    fitted = fit_preprocessor(source, columns, max_fraction, strategy)
    labelled = label_to_string(df, target)
    cleaned = fitted.transform(labelled, [quoted(k) for k in [*keys, target]])
    return cleaned.select(*keys, *[quoted(c) for c in fitted.feature_columns], target), fitted
