"""Exact quantiles, of groups of any size and of any number of columns, in one way.

Mergeable sketches first give every wanted quantile a bracket that surely holds
its ranks: the rank error of a sketch is at most n / accuracy, and a bracket is
two of those wide on each side. A group of few rows is its own bracket. Rows
outside the brackets are only counted, rows inside are counted per distinct
value, both inside tasks first, and the values left are ranked. No task gathers
a group: what is ranked of n rows is at most some 4 n / accuracy values for
each quantile.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACCURACY = 10_000


def _ends(shares: Sequence[float], accuracy: int) -> str:
    """Shares of all brackets' ends, as an SQL array."""
    ends = [end for p in shares for end in (max(p - 2.0 / accuracy, 0.0), min(p + 2.0 / accuracy, 1.0))]
    return f"array({', '.join(f'{e!r}D' for e in ends)})"


def _sketch(value: str, shares: Sequence[float], accuracy: int) -> str:
    """Number, least and largest value, and the brackets, as an SQL struct."""
    return (
        f"struct(count({value}) AS n, min({value}) AS low, max({value}) AS high, "
        f"percentile_approx({value}, {_ends(shares, accuracy)}, {accuracy}) AS ends)"
    )


def _interpolated(shares: Sequence[float]) -> tuple[list[str], list[str]]:
    """Aggregates that pick the two values around each rank, and their interpolation."""
    picked, out = [], []
    for i, p in enumerate(shares):
        place = f"((_n - 1) * {p!r}D)"
        for side, k in (("a", f"floor{place}"), ("b", f"ceil{place}")):
            picked.append(f"max(CASE WHEN _upto - _c <= {k} AND {k} < _upto THEN _v END) AS _{side}{i}")
        out.append(f"CASE WHEN _a{i} = _b{i} THEN _a{i} ELSE _a{i} + (_b{i} - _a{i}) * ({place} - floor{place}) END")
    return picked, out


def exact_quantiles(
    long: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], names: Sequence[str], accuracy: int = ACCURACY
) -> DataFrame:
    """``keys..., names...`` of a long table, NULL-free in ``value``, interpolated between ranks."""
    keys = list(keys)
    sketches = long.groupBy(*keys).agg(F.expr(f"{_sketch(value, shares, accuracy)} AS _s"))
    few = f"_s.n <= {2 * accuracy}"
    brackets = sketches.selectExpr(
        *keys, "_s.n AS _n", f"CASE WHEN {few} THEN array(_s.low, _s.high) ELSE _s.ends END AS _ends"
    )
    # A row's place: its value inside a bracket, else the last bracket end below it.
    inside = f"exists(sequence(0, size(_ends) - 2, 2), i -> {value} >= _ends[i] AND {value} <= _ends[i + 1])"
    below = f"aggregate(_ends, CAST(NULL AS DOUBLE), (a, e) -> CASE WHEN e < {value} THEN greatest(a, e) ELSE a END)"
    placed = long.join(brackets, keys).selectExpr(
        *keys, "_n", f"CASE WHEN {inside} THEN {value} ELSE {below} END AS _v", f"NOT {inside} AS _outside"
    )
    tallies = placed.groupBy(*keys, "_n", "_v", "_outside").agg(F.expr("count(1) AS _c"))
    by = ", ".join(keys)
    ranked = tallies.withColumn("_upto", F.expr(
        f"sum(_c) OVER (PARTITION BY {by} ORDER BY _v ASC NULLS FIRST, _outside ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ))
    picked, out = _interpolated(shares)
    # One struct, so that groups with the same keys are aggregated once.
    ends = ranked.groupBy(*keys, "_n").agg(*[F.expr(p) for p in picked])
    return ends.selectExpr(*keys, *[f"{x} AS {name}" for x, name in zip(out, names)])


def exact_quantile(long: DataFrame, keys: Sequence[str], value: str, p: float, name: str, accuracy: int = ACCURACY) -> DataFrame:
    """``keys..., name`` of a long table."""
    return exact_quantiles(long, keys, value, [p], [name], accuracy)


def column_medians(df: DataFrame, columns: Mapping[str, str], accuracy: int = ACCURACY) -> dict[str, float | None]:
    """The median of every column (name to SQL expression), missing values left out; None without any.

    All columns are sketched in one pass. In the second, a row sends on only the
    cells that lie in their column's bracket.
    """
    if not columns:
        return {}
    names = list(columns)
    sketches = ", ".join(f"{_sketch(columns[c], [0.5], accuracy)} AS c{i}" for i, c in enumerate(names))
    # Four numbers per column.
    found = df.agg(F.expr(f"struct({sketches}) AS s")).first()["s"]
    known = {i: (s["low"], s["high"]) if s["n"] <= 2 * accuracy else tuple(s["ends"]) for i, s in enumerate(found) if s["n"]}
    if not known:
        return dict.fromkeys(names)
    double = lambda x: f"double('{x!r}')"
    below = ", ".join(f"count_if({columns[names[i]]} < {double(low)}) AS c{i}" for i, (low, _) in known.items())
    cells = ", ".join(
        f"struct({i} AS column, CASE WHEN {columns[names[i]]} BETWEEN {double(low)} AND {double(high)} THEN {columns[names[i]]} END AS v)"
        for i, (low, high) in known.items()
    )
    before = df.agg(F.expr(f"struct({below}) AS s")).first()["s"].asDict()
    tallies = df.selectExpr(f"inline(filter(array({cells}), x -> x.v IS NOT NULL))").groupBy("column", "v").agg(F.expr("count(1) AS _c"))
    facts = ", ".join(f"({i}, {found[i]['n']}L, {before[f'c{i}']}L)" for i in known)
    facts = F.broadcast(df.sparkSession.sql(f"SELECT * FROM VALUES {facts} AS t(column, _n, _before)"))
    ranked = tallies.join(facts, "column").selectExpr(
        "column", "_n", "_c", "v AS _v",
        "_before + sum(_c) OVER (PARTITION BY column ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _upto",
    )
    picked, out = _interpolated([0.5])
    medians = ranked.groupBy("column", "_n").agg(*[F.expr(p) for p in picked]).selectExpr("column", f"{out[0]} AS median").collect()
    return {**dict.fromkeys(names), **{names[r["column"]]: r["median"] for r in medians}}
