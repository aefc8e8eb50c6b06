"""Feature importances, trends over label order, and distribution summaries."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.quantiles import ACCURACY, exact_quantiles
from tilewright.functions.scalars import keep_available, quoted

# Features shown when no importance table exists.
DEFAULT_FEATURES = ["lbp_9", "minor_axis_median", "circularity_median", "solidity_mean"]


# ---------------------------------------------------------------- importances


def importance_table(spark: SparkSession, names: Sequence[str], by_learner: Mapping[str, Sequence[float]]) -> DataFrame:
    """``learner, feature, importance`` by joining names and scores on position."""
    for learner, scores in by_learner.items():
        if len(scores) != len(names):
            raise ValueError(f"{learner}: {len(scores)} scores for {len(names)} features")
    scores = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in by_learner.items()], "learner STRING, scores ARRAY<DOUBLE>")
    named = spark.createDataFrame([(list(names),)], "names ARRAY<STRING>")
    return name_scores(named, scores)


def name_scores(names: DataFrame, scores: DataFrame) -> DataFrame:
    """Inner join of ``names`` and ``learner, scores`` arrays on the position."""
    left = names.selectExpr("posexplode(names) AS (position, feature)")
    right = scores.selectExpr("learner", "posexplode(scores) AS (position, importance)")
    return right.join(left, "position").select("learner", "feature", "importance")


def average_importance(importances: DataFrame, normalize: bool = False) -> DataFrame:
    """Plain mean over learners, as published; ``normalize`` first brings each
    learner to a sum of 1, so that scales do not mix."""
    if normalize:
        importances = importances.selectExpr(
            "learner", "feature", "importance / sum(importance) OVER (PARTITION BY learner) AS importance"
        )
    return importances.groupBy("feature").agg(F.expr("avg(importance) AS importance"))


def sort_by_importance(importances: DataFrame) -> DataFrame:
    """Descending, names ascending on ties."""
    return importances.orderBy(F.desc("importance"), "feature")


def importance_by_learner(importances: DataFrame) -> DataFrame:
    """Each learner's list with its descending ``rank``."""
    return importances.selectExpr(
        "learner", "feature", "importance",
        "row_number() OVER (PARTITION BY learner ORDER BY importance DESC, feature) AS rank",
    )


def top_k(importances: DataFrame, k: int = 10) -> DataFrame:
    return sort_by_importance(importances).limit(k)


def features_to_show(importances: DataFrame | None, available: Sequence[str], k: int = 10) -> list[str]:
    """Names to plot: the top of the importance table, or the default list."""
    names = DEFAULT_FEATURES[:k] if importances is None else [r["feature"] for r in top_k(importances, k).collect()]
    return keep_available(names, available, k)


# ---------------------------------------------------------------- label order


def label_codes(df: DataFrame, label: str = "label") -> DataFrame:
    """``label, code`` = 0..n-1: numeric order if every label is a number, else by text.

    The window runs over distinct labels only.
    """
    labels = df.selectExpr(f"CAST({quoted(label)} AS STRING) AS label").distinct()
    codes = labels.agg(F.expr(
        "CASE WHEN count(1) = count(try_cast(label AS DOUBLE)) "
        "THEN transform(array_sort(collect_list(struct(try_cast(label AS DOUBLE) AS o, label))), x -> x.label) "
        "ELSE array_sort(collect_list(label)) END AS labels"
    ))
    return codes.selectExpr("posexplode(labels) AS (code, label)").select("label", "code")


def distinct_sorted(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels as strings, in string order."""
    return df.selectExpr(f"CAST({quoted(label)} AS STRING) AS label").distinct().orderBy("label")


def long_features(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """``feature, label, value`` for the chosen columns, missing values left out."""
    cells = ", ".join(f"struct('{f}' AS feature, CAST({quoted(f)} AS DOUBLE) AS value)" for f in features)
    return (
        df.selectExpr(f"CAST({quoted(label)} AS STRING) AS label", f"inline(array({cells}))")
        .filter("value IS NOT NULL AND NOT isnan(value)").select("feature", "label", "value")
    )


def trendlines(long: DataFrame, codes: DataFrame) -> DataFrame:
    """Least squares of value on label code: ``feature, slope, intercept, r2`` and the
    line's ends. Features seen under fewer than two labels are left out.

    Values are reduced to moments per (feature, label) before they meet the
    codes, so a label holding most rows costs no shuffle of rows.
    """
    per_label = long.groupBy("feature", "label").agg(
        F.expr("count(1) AS n"), F.expr("avg(value) AS m"), F.expr("var_pop(value) AS v")
    ).join(codes, "label")
    totals = per_label.groupBy("feature").agg(F.expr(
        "struct(sum(n) AS n, sum(n * code) / sum(n) AS mx, sum(n * m) / sum(n) AS my, "
        "min(code) AS x0, max(code) AS x1, collect_list(struct(n, m, v, code)) AS parts) AS s"
    )).select("feature", "s.*").filter("x1 > x0")
    sums = totals.selectExpr(
        "*",
        "aggregate(parts, 0.0D, (a, p) -> a + p.n * (p.code - mx) * (p.code - mx)) AS sxx",
        "aggregate(parts, 0.0D, (a, p) -> a + p.n * (p.code - mx) * (p.m - my)) AS sxy",
        "aggregate(parts, 0.0D, (a, p) -> a + p.n * (p.v + (p.m - my) * (p.m - my))) AS syy",
    ).selectExpr("feature", "x0", "x1", "my", "mx", "sxx", "sxy", "syy", "sxy / sxx AS slope")
    lines = sums.selectExpr(
        "feature", "slope", "my - slope * mx AS intercept",
        "CASE WHEN syy > 0 THEN sxy * sxy / (sxx * syy) ELSE 0.0D END AS r2", "x0", "x1",
    )
    return lines.selectExpr("*", "slope * x0 + intercept AS y0", "slope * x1 + intercept AS y1")


def trend_legend(r2: str) -> str:
    """``Trend (R²=0.12)``; two digits, ties to the even one."""
    return f"concat('Trend (R²=', format_string('%.2f', bround({r2}, 2)), ')')"


# ---------------------------------------------------------------- violins


def violin_summary(long: DataFrame, approximate: bool = False, accuracy: int = ACCURACY) -> DataFrame:
    """``feature, label, n, low, q1, median, q3, high``.

    Exact quartiles interpolate between order statistics, and no task gathers a
    group for them; ``approximate`` uses sketches.
    """
    by, shares, names = ["feature", "label"], [0.25, 0.5, 0.75], ["q1", "median", "q3"]
    ends = "count(1) AS n, min(value) AS low, max(value) AS high"
    if approximate:
        quartiles = f"percentile_approx(value, array(0.25D, 0.5D, 0.75D), {accuracy})"
        return long.groupBy(*by).agg(F.expr(f"struct({ends}, {quartiles} AS q) AS s")).selectExpr(
            *by, "s.n", "s.low", "s.q[0] AS q1", "s.q[1] AS median", "s.q[2] AS q3", "s.high"
        )
    facts = long.groupBy(*by).agg(F.expr(f"struct({ends}) AS s")).select(*by, "s.*")
    quartiles = exact_quantiles(long, by, "value", shares, names, accuracy)
    return facts.join(quartiles, by).select(*by, "n", "low", *names, "high")


#: Boxes of values are half a bandwidth wide; expansions of this order are then exact to some 1e-12 of a kernel.
DENSITY_ORDER = 12


def violin_density(long: DataFrame, grid: int = 100, cut: float = 2.0, order: int = DENSITY_ORDER) -> DataFrame:
    """Gaussian kernel density ``feature, label, step, x, density`` on a grid.

    The bandwidth is n^(-1/5) times the sample deviation and the grid reaches
    ``cut`` bandwidths past the data. A fast Gauss transform: values are reduced
    to their moments within boxes half a bandwidth wide, which combines inside
    tasks, and only boxes meet the grid, by Hermite expansions around their
    centres, no further than a kernel reaches. A group without spread gives one
    point of density 1.
    """
    by = ["feature", "label"]
    facts = long.groupBy(*by).agg(F.expr(
        "struct(count(1) AS n, min(value) AS low, max(value) AS high, stddev_samp(value) AS sd) AS s"
    )).select(*by, "s.*").selectExpr(*by, "n", "low", "high", "CASE WHEN n > 1 AND sd > 0 THEN power(n, -0.2D) * sd END AS h")
    flat = facts.filter("h IS NULL").selectExpr(*by, "0 AS step", "low AS x", "1.0D AS density")
    spread = facts.filter("h IS NOT NULL").selectExpr(
        *by, "n", "h", "low", f"low - {cut}D * h AS first", f"(high - low + {2 * cut}D * h) / {grid - 1} AS gap"
    )
    centre = "(low + (box + 0.5D) * h / 2)"
    boxed = long.join(spread, by).withColumn("box", F.expr("CAST(floor((value - low) / h * 2) AS BIGINT)"))
    off = boxed.selectExpr(*by, "n", "h", "first", "gap", f"{centre} AS centre", f"(value - {centre}) / (h * sqrt(2D)) AS s")
    moments = ", ".join(f"sum(power(s, {k}D)) / {math.factorial(k)}D" for k in range(order + 1))
    boxes = off.groupBy(*by, "n", "h", "first", "gap", "centre").agg(F.expr(f"array({moments}) AS m"))
    # Beyond nine bandwidths a kernel is less than 1e-17.
    low, high = (f"CAST({f}((centre {sign} 9D * h - first) / gap) AS INT)" for f, sign in (("ceil", "-"), ("floor", "+")))
    near = f"CASE WHEN {low} < {grid} AND {high} >= 0 THEN sequence(greatest({low}, 0), least({high}, {grid - 1})) ELSE array() END"
    met = boxes.withColumn("step", F.expr(f"explode({near})")).withColumn("t", F.expr("(first + step * gap - centre) / (h * sqrt(2D))"))
    # Hermite functions by their recurrence, from exp(-t^2) on.
    series = (
        f"aggregate(sequence(0, {order}), named_struct('last', 0D, 'now', exp(-t * t), 'total', 0D), "
        "(a, k) -> named_struct('last', a.now, 'now', 2 * t * a.now - 2 * k * a.last, 'total', a.total + m[k] * a.now), a -> a.total)"
    )
    sums = met.selectExpr(*by, "step", f"{series} AS k").groupBy(*by, "step").agg(F.expr("sum(k) AS total"))
    points = spread.withColumn("step", F.expr(f"explode(sequence(0, {grid - 1}))"))
    return points.join(sums, [*by, "step"], "left").selectExpr(
        *by, "step", "first + step * gap AS x", "coalesce(greatest(total, 0D), 0D) / (n * h * sqrt(2 * pi())) AS density"
    ).unionByName(flat)
