"""Cleaning, splits, reports and insights on hand-made tables and published numbers."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions.quantiles import column_medians, exact_quantiles
from tilewright.functions.ranking import number_within
from tilewright.functions.summaries import summarise
from tilewright.operators import cleaning, evaluation, insights, modelling, scoring
from tilewright.sources.tables import report_json


def test_exact_median_and_population_scale(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,), (None,)], "x DOUBLE")
    fitted = cleaning.fit_preprocessor(df)
    (p,) = fitted.columns
    assert p.fill == 3.0 and p.mean == 4.0
    assert p.scale == pytest.approx(math.sqrt((9 + 4 + 0 + 36 + 1) / 5))
    scaled = [r.x for r in fitted.transform(df).collect()]
    assert sum(scaled) == pytest.approx(0) and sum(v * v for v in scaled) / 5 == pytest.approx(1)


def test_sparse_limit_is_strict(spark):
    df = spark.createDataFrame([(1.0, None, 1.0), (None, None, 2.0)], "half DOUBLE, none DOUBLE, all DOUBLE")
    assert cleaning.sparse_columns(df, df.columns, 0.5) == ["half", "none"]
    assert cleaning.sparse_columns(df, df.columns, 0.6) == ["none"]
    with pytest.raises(ValueError, match="none"):
        cleaning.fit_preprocessor(df, max_fraction=2.0)
    assert cleaning.fit_preprocessor(df, max_fraction=2.0, strategy="constant").columns[1].fill == 0.0


def test_constant_column_is_only_centred(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0)], "k DOUBLE, x DOUBLE")
    out = cleaning.standardize(df).orderBy("x").collect()
    assert [tuple(r) for r in out] == [(0, -1), (0, 1)]


def test_most_frequent_takes_smallest_tie(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (1.0,), (1.0,), (9.0,)], "x DOUBLE")
    assert cleaning.fill_values(df, ["x"], "most_frequent") == {"x": 1.0}
    with pytest.raises(ValueError):
        cleaning.fill_values(df, ["x"], "mode")


@pytest.mark.parametrize("accuracy", [10_000, 20])
@pytest.mark.parametrize("values", [
    [3.0] * 50 + [1.0] * 49, [float(i) for i in range(40)], [1.0], [1.0, 2.0], [0.0] * 90 + [5.0] * 10,
    [float(i * 7919 % 1009) / 3 for i in range(900)], [float("inf")] * 3 + [-1.5] * 200, [1e-300 * (-1) ** i * i for i in range(301)],
])
def test_quantiles_whatever_the_brackets(spark, values, accuracy):
    want = spark.createDataFrame([(v,) for v in values], "x DOUBLE").selectExpr(
        "percentile(x, array(0D, 0.25D, 0.5D, 0.75D, 1D)) AS q").first()["q"]
    df = spark.createDataFrame([(1, v) for v in values] + [(2, 8.0), (3, None)], "g INT, x DOUBLE").repartition(3)
    found = exact_quantiles(df.filter("x IS NOT NULL"), ["g"], "x", [0.0, 0.25, 0.5, 0.75, 1.0], list("abcde"), accuracy)
    rows = {r["g"]: list(r)[1:] for r in found.collect()}
    assert rows.keys() == {1, 2} and rows[2] == [8.0] * 5 and rows[1] == pytest.approx(want, rel=1e-12, abs=0)
    own = df.filter("g = 1")
    medians = column_medians(own.withColumn("y", F.lit(None).cast("double")), {"x": "x", "-x": "-x", "y": "y"}, accuracy)
    assert medians.pop("y") is None and medians == pytest.approx({"x": want[2], "-x": -want[2]}, rel=1e-12, abs=0)
    if max(values) < float("inf"):
        summary = {r["g"]: r for r in summarise(df, ["g"], {"x": "x"}, accuracy).collect()}
        assert summary[1].x_median == pytest.approx(want[2], rel=1e-12, abs=0) and list(summary[3])[1:] == [0.0] * 6
        violin = insights.violin_summary(own.selectExpr("'f' AS feature", "'l' AS label", "x AS value"), accuracy=accuracy).first()
        assert [violin.low, violin.q1, violin.median, violin.q3, violin.high] == pytest.approx(want, rel=1e-12, abs=0)


def test_numbering_matches_plain_row_number(spark):
    df = spark.range(500).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id % 7 AS STRING) END AS g", "md5(CAST(id AS STRING)) AS h")
    ours = number_within(df, ["g"], "substring(h, 1, 1)", "h")
    both = ours.withColumn("plain", F.expr("row_number() OVER (PARTITION BY g ORDER BY h)"))
    assert both.filter("rn <> plain").count() == 0


def test_split_keeps_label_shares(spark):
    df = spark.range(326).selectExpr(
        "id", "CASE WHEN id < 14 THEN '0' WHEN id < 44 THEN '1' WHEN id < 88 THEN '2' WHEN id < 240 THEN '3' WHEN id < 303 THEN '4' ELSE '5' END AS label"
    )
    split = modelling.stratified_split(df, "id")
    assert split.filter("is_test").count() == 66
    shares = {r.label: (r.t, r.n) for r in split.groupBy("label").agg(F.expr("count_if(is_test) AS t"), F.expr("count(1) AS n")).collect()}
    assert all(abs(t - 0.2 * n) < 1 for t, n in shares.values())
    sizes = [r["count"] for r in modelling.stratified_folds(df, "id").groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


# The published report and the confusion counts it follows from.
COUNTS = {("0", "0"): 14, ("1", "1"): 30, ("2", "2"): 43, ("2", "3"): 1, ("3", "3"): 152, ("4", "4"): 62, ("4", "3"): 1, ("5", "5"): 23}
PUBLISHED = {
    "2": (1.0, 0.9772727272727273, 0.9885057471264368, 44.0),
    "3": (0.987012987012987, 1.0, 0.9934640522875817, 152.0),
    "4": (1.0, 0.9841269841269841, 0.992, 63.0),
    "accuracy": (0.9938650306748467,) * 3 + (326.0,),
    "macro avg": (0.9978354978354979, 0.9935666185666187, 0.9956616332356697, 326.0),
    "weighted avg": (0.9939447056011474, 0.9938650306748467, 0.9938551804333609, 326.0),
}


def published_predictions(spark):
    pairs = spark.createDataFrame([(t, p, n) for (t, p), n in COUNTS.items()], "truth STRING, prediction STRING, n INT")
    return pairs.selectExpr("truth", "prediction", "explode(sequence(1, n))").select("truth", "prediction")


def test_published_report(spark):
    report = evaluation.classification_report(published_predictions(spark))
    rows = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in report.collect()}
    for name, want in PUBLISHED.items():
        assert rows[name] == pytest.approx(want, abs=1e-12)
    assert evaluation.accuracy(published_predictions(spark)).first()[0] == pytest.approx(0.9938650306748467)
    metrics = spark.createDataFrame([(0.5, 5)], "cv_mean_score DOUBLE, cv_folds INT")
    parsed = json.loads(report_json(report, metrics).first().value)
    assert list(parsed) == ["0", "1", "2", "3", "4", "5", "accuracy", "macro avg", "weighted avg", "_training_metrics"]
    assert parsed["3"]["f1-score"] == pytest.approx(0.9934640522875817) and parsed["accuracy"] == pytest.approx(0.9938650306748467)
    assert parsed["_training_metrics"] == {"cv_mean_score": 0.5, "cv_folds": 5}


def test_class_never_predicted_and_never_true(spark):
    df = spark.createDataFrame([("10", "2"), ("2", "2"), ("2", "x")], "truth STRING, prediction STRING")
    rows = {r["class"]: r for r in evaluation.per_class_report(df).collect()}
    assert (rows["10"].precision, rows["10"].recall, rows["10"].f1, rows["10"].support) == (0, 0, 0, 1)
    assert (rows["x"].precision, rows["x"].support) == (0, 0)
    matrix = evaluation.confusion_matrix(df)
    assert matrix.count() == 9 and matrix.agg(F.sum("n")).first()[0] == 3
    wide = evaluation.confusion_wide(matrix, ["10", "2", "x"]).orderBy("truth").collect()
    assert [tuple(r) for r in wide] == [("10", 0, 1, 0), ("2", 0, 1, 1), ("x", 0, 0, 0)]


def test_published_importance_average(spark):
    # Top feature of the published lists, split counts, percentages and fractions.
    by_learner = {"lgbm": [275.0], "catboost": [10.878], "xgb": [0.027]}
    combined = insights.average_importance(insights.importance_table(spark, ["lbp_9"], by_learner)).first()
    assert combined.feature == "lbp_9" and combined.importance == pytest.approx(95.302, abs=1e-3)
    with pytest.raises(ValueError):
        insights.importance_table(spark, ["a", "b"], by_learner)


def test_label_order(spark):
    numbers = spark.createDataFrame([("10",), ("2",)], "label STRING")
    assert {r.label: r.code for r in insights.label_codes(numbers).collect()} == {"2": 0, "10": 1}
    assert [r.label for r in insights.distinct_sorted(numbers).collect()] == ["10", "2"]
    words = spark.createDataFrame([("10",), ("b",)], "label STRING")
    assert {r.label: r.code for r in insights.label_codes(words).collect()} == {"10": 0, "b": 1}


def test_trend_needs_two_labels(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0)], "label STRING, x DOUBLE, y DOUBLE")
    assert insights.trendlines(insights.long_features(df, ["x"]), insights.label_codes(df)).count() == 0
    two = df.unionByName(spark.createDataFrame([("b", 3.5, 0.0)], df.schema))
    line = insights.trendlines(insights.long_features(two, ["x"]), insights.label_codes(two)).first()
    assert (line.slope, line.intercept, line.y1) == pytest.approx((2.0, 1.5, 3.5))


def test_density_of_a_group_without_spread(spark):
    df = spark.createDataFrame([("f", "a", 2.0), ("f", "a", 2.0), ("f", "b", 1.0), ("f", "b", 3.0)], "feature STRING, label STRING, value DOUBLE")
    rows = insights.violin_density(df, grid=50).collect()
    assert [(r.x, r.density) for r in rows if r.label == "a"] == [(2.0, 1.0)]
    assert sum(r.label == "b" for r in rows) == 50


@pytest.mark.parametrize("shape", ["normal", "gaps", "heavy", "few"])
def test_density_against_all_kernels(spark, shape):
    rng = np.random.default_rng(len(shape))
    v = {
        "normal": rng.normal(5, 2, 3000), "gaps": np.concatenate([rng.normal(0, 1e-3, 500), rng.normal(1, 1e-3, 500)]),
        "heavy": rng.standard_cauchy(800), "few": np.array([1.0, 1.0, 2.5]),
    }[shape]
    df = spark.createDataFrame([("f", "a", float(x)) for x in v], "feature STRING, label STRING, value DOUBLE").repartition(4)
    rows = sorted(insights.violin_density(df, grid=37).collect(), key=lambda r: r.step)
    h = len(v) ** -0.2 * v.std(ddof=1)
    x = np.linspace(v.min() - 2 * h, v.max() + 2 * h, 37)
    want = np.exp(-(((x[:, None] - v[None]) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert [r.step for r in rows] == list(range(37)) and np.allclose([r.x for r in rows], x)
    assert np.allclose([r.density for r in rows], want, rtol=1e-8, atol=1e-12 * want.max())


def test_missing_feature_columns_are_named(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 5.0, "b")], "x DOUBLE, y DOUBLE, label STRING")
    _, saved = cleaning.clean_features(df)
    with pytest.raises(ValueError, match="y"):
        scoring.apply_saved_preprocessing(df.drop("y"), saved)
    again = cleaning.Preprocessor.from_table(saved.table(spark))
    assert again == saved
    with pytest.raises(ValueError, match="target"):
        cleaning.clean_features(df, "target")
    with pytest.raises(ValueError):
        modelling.class_names(df.limit(0), "label")


def test_report_class_names_are_escaped(spark):
    import json

    from tilewright.sources.tables import report_json

    rows = [('a"b\\c', 1.0, 0.5, 0.6, 2.0), ("x", 0.0, 0.0, 0.0, 1.0), ("accuracy", 0.5, 0.5, 0.5, 3.0)]
    report = spark.createDataFrame(rows, "class STRING, precision DOUBLE, recall DOUBLE, f1 DOUBLE, support DOUBLE")
    out = json.loads(report_json(report).first().value)
    assert set(out) == {'a"b\\c', "x", "accuracy"} and out["accuracy"] == 0.5 and out['a"b\\c']["recall"] == 0.5
