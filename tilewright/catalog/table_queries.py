"""Queries over feature tables: cleaning, splits, models, reports, insights."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.catalog.fixture import feature_matrix, predictions, table
from tilewright.catalog.image_queries import rounded
from tilewright.functions import scalars
from tilewright.operators import cleaning, evaluation, insights, modelling, scoring
from tilewright.plans.end_to_end import run_features
from tilewright.plans.score import score_csv
from tilewright.session import cut_lineage, shared_dir
from tilewright.sources import tables

Query = Callable[[SparkSession, str], DataFrame]

FEATURES = [f"f_{i:02d}" for i in range(64)]


def split_target(spark, sf):
    features, _ = scalars.split_target(feature_matrix(spark, sf), "label")
    return rounded(features.select("vec_id", *FEATURES), 9)


def label_to_string(spark, sf):
    return scalars.label_to_string(feature_matrix(spark, sf).select("vec_id", "label"), "label")


def select_numeric(spark, sf):
    customers = table(spark, sf, "customer").withColumn("is_debtor", F.expr("c_acctbal < 0"))
    return customers.select(*scalars.numeric_columns(customers))


def _labelled_documents(spark, sf):
    labels = table(spark, sf, "labels")
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left")


def fill_missing_zero(spark, sf):
    return scalars.fill_missing_zero(_labelled_documents(spark, sf))


def inf_to_null(spark, sf):
    return rounded(scalars.inf_to_null(feature_matrix(spark, sf).select("vec_id", *FEATURES), FEATURES), 9)


def keep_available_columns(spark, sf):
    matrix = feature_matrix(spark, sf)
    names = scalars.keep_available(["f_70", "f_05", "vec_id", "nothing", "f_04", "f_06"], matrix.columns, 3)
    return rounded(matrix.select(*names), 9)


def default_features(spark, sf):
    """What is shown without an importance table: the fallback names that the table has, with their values."""
    matrix = feature_matrix(spark, sf).withColumnsRenamed({"f_04": "solidity_mean", "f_05": "lbp_9", "f_06": "minor_axis_median"})
    names = insights.features_to_show(None, matrix.columns, 10)
    listed = ", ".join(f"'{n}'" for n in names)
    found = insights.long_features(matrix, names).groupBy("feature").agg(F.expr("count(1) AS n"), F.expr("avg(value) AS mean"))
    return rounded(found.selectExpr(f"array_position(array({listed}), feature) AS position", "feature", "n", "mean"), 9)


def union_records(spark, sf):
    matrix = feature_matrix(spark, sf)
    parts = [matrix.filter("vec_id % 3 = 0").select("vec_id", *FEATURES[:32]),
             matrix.filter("vec_id % 3 = 1").select("vec_id", *FEATURES[32:]),
             matrix.filter("vec_id % 3 = 2").select(*reversed(FEATURES[:32]), "vec_id")]
    return rounded(scalars.inf_to_null(scoring.union_records(parts), FEATURES), 9)


def union_rows(spark, sf):
    """Customers and suppliers as one list of parties."""
    customers = table(spark, sf, "customer").selectExpr("c_custkey AS party", "c_acctbal AS balance", "c_mktsegment AS segment")
    suppliers = table(spark, sf, "supplier").selectExpr("s_suppkey AS party", "s_acctbal AS balance")
    return scoring.union_records([customers, suppliers])


def images_left_features(spark, sf):
    """Every image stays, also one without any feature."""
    images = table(spark, sf, "embeddings").selectExpr("vec_id", "CAST(label AS STRING) AS label")
    found = feature_matrix(spark, sf).filter("f_00 IS NOT NULL").select("vec_id", *FEATURES)
    return rounded(scalars.fill_missing_zero(images.join(found, "vec_id", "left")), 9)


def missing_profile(spark, sf):
    return rounded(cleaning.missing_profile(feature_matrix(spark, sf), FEATURES), 9)


def missing_profile_documents(spark, sf):
    return rounded(cleaning.missing_profile(_labelled_documents(spark, sf)), 9)


def drop_sparse_columns(spark, sf):
    return rounded(cleaning.drop_sparse_columns(feature_matrix(spark, sf).select("vec_id", *FEATURES)), 9)


def drop_sparse_documents(spark, sf):
    """At 0.5 both label columns go; at 0.7 they stay and are imputed."""
    docs = _labelled_documents(spark, sf)
    kept = cleaning.drop_sparse_columns(docs, max_fraction=0.7)
    return rounded(cleaning.impute(kept, ["quality", "toxic"]))


def impute(spark, sf):
    return rounded(cleaning.impute(feature_matrix(spark, sf).select("vec_id", *FEATURES), FEATURES), 9)


def impute_ranked_medians(spark, sf):
    matrix = feature_matrix(spark, sf).select("vec_id", *FEATURES)
    return rounded(cleaning.impute(matrix, FEATURES, accuracy=100), 9)


def impute_mean(spark, sf):
    return rounded(cleaning.impute(feature_matrix(spark, sf).select("vec_id", *FEATURES), FEATURES, "mean"), 9)


def impute_most_frequent(spark, sf):
    return rounded(cleaning.impute(_labelled_documents(spark, sf), ["quality", "toxic"], "most_frequent"))


def impute_constant(spark, sf):
    return rounded(cleaning.impute(_labelled_documents(spark, sf), ["quality", "toxic"], "constant", -1.0))


def standardize(spark, sf):
    """All numeric columns of the customers."""
    return rounded(cleaning.standardize(table(spark, sf, "customer")))


def clean_features(spark, sf):
    cleaned, _ = cleaning.clean_features(feature_matrix(spark, sf), "label", ["vec_id"])
    return rounded(cleaned)


def clean_parameters(spark, sf):
    _, fitted = cleaning.clean_features(feature_matrix(spark, sf), "label", ["vec_id"])
    return rounded(fitted.table(spark))


def clean_features_train_fit(spark, sf):
    """Parameters from training rows only; f_01, half of it missing, is left out whatever the training share."""
    matrix = feature_matrix(spark, sf).drop("f_01")
    train = modelling.stratified_split(matrix, "vec_id").filter("NOT is_test").drop("is_test")
    cleaned, _ = cleaning.clean_features(matrix, "label", ["vec_id"], fit_on=train)
    return rounded(cleaned)


def stratified_split(spark, sf):
    return modelling.stratified_split(feature_matrix(spark, sf).select("vec_id", "label"), "vec_id")


def stratified_folds(spark, sf):
    return modelling.stratified_folds(feature_matrix(spark, sf).select("vec_id", "label"), "vec_id")


def holdout_score(spark, sf):
    split = modelling.stratified_split(predictions(spark, sf), "vec_id", "truth")
    return rounded(modelling.holdout_score(split))


SETTINGS = modelling.StackSettings()
#: The first two rounds, whose trees SQL can work out from the table.
FIRST_ROUNDS = modelling.StackSettings(n_estimators=2)

_fitted: dict[tuple[str, str, str], object] = {}


def _once(spark, sf, name, fit):
    """A model of a table is fitted once in a session, whatever the number of queries on it."""
    place = (spark.sparkContext.applicationId, sf, name)
    if place not in _fitted:
        _fitted[place] = fit()
    return _fitted[place]


def _trained(spark, sf):
    """(training, parameters, cleaned features): the whole stack with cross-validation, default sizes."""

    def fit():
        cleaned, fitted = cleaning.clean_features(feature_matrix(spark, sf), "label", ["vec_id"])
        cleaned = cut_lineage(cleaned, "cleaned")
        return modelling.train_stacking(cleaned, fitted.feature_columns, "vec_id", "label", SETTINGS), fitted, cleaned

    return _once(spark, sf, "trained", fit)


def _first_trees(spark, sf):
    """Two rounds of every learner on the table as it is, missing and infinite values included."""
    return _once(spark, sf, "first", lambda: modelling.fit_base(feature_matrix(spark, sf), FEATURES, "vec_id", "label", FIRST_ROUNDS))


def first_trees(spark, sf):
    """Splits of the first two rounds' trees."""
    return rounded(_first_trees(spark, sf).nodes, 6)


def first_leaves(spark, sf):
    """Leaf values of the first two rounds' trees."""
    return rounded(_first_trees(spark, sf).leaves, 9)


def first_predictions(spark, sf):
    """Class of every row by each learner's first two rounds."""
    return _first_trees(spark, sf).predict_each(feature_matrix(spark, sf)).select(
        "vec_id", *[f"{x.name}_prediction" for x in FIRST_ROUNDS.learners]
    )


def first_importances(spark, sf):
    """Importances of all features in the first two rounds, each learner on its own scale."""
    return rounded(_first_trees(spark, sf).importances(), 6)


def base_learners(spark, sf):
    training, _, cleaned = _trained(spark, sf)
    base = training.model.base
    return base.predict_each(cleaned).select("vec_id", "label", *[f"{x.name}_prediction" for x in base.learners])


def stacking(spark, sf):
    training, _, cleaned = _trained(spark, sf)
    return training.model.predict(cleaned).select("vec_id", "label", "prediction")


def cross_val_score(spark, sf):
    return _trained(spark, sf)[0].fold_scores


def training_metrics(spark, sf):
    return _trained(spark, sf)[0].metrics


def align_columns(spark, sf):
    """All features but the dropped one, in reverse."""
    wanted = [f for f in reversed(FEATURES) if f != "f_01"]
    return rounded(scalars.inf_to_null(scoring.align_columns(feature_matrix(spark, sf), wanted, ["f_01"], ["vec_id"]), wanted), 9)


def apply_saved_preprocessing(spark, sf):
    matrix = feature_matrix(spark, sf)
    saved = cleaning.fit_preprocessor(matrix.filter("vec_id % 3 = 0"), FEATURES)
    return rounded(scoring.apply_saved_preprocessing(matrix, saved, ["vec_id"]))


def predict(spark, sf):
    training, fitted, _ = _trained(spark, sf)
    scored = scoring.predict(feature_matrix(spark, sf), fitted, training.model)
    return rounded(scalars.inf_to_null(scored, FEATURES), 9)


def predict_raw_zero_fill(spark, sf):
    """A stack fitted on raw features, gaps as zeros."""
    matrix = feature_matrix(spark, sf)

    def fit():
        filled = cut_lineage(scalars.fill_missing_zero(scalars.inf_to_null(matrix, FEATURES)), "filled")
        return modelling.fit_stack(filled, FEATURES, "vec_id", "label", SETTINGS)

    model = _once(spark, sf, "raw", fit)
    return scoring.predict_raw_zero_fill(matrix, model).select("vec_id", "label", "prediction")


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_feature_csv(spark, sf):
    """How the written file spells every column, by label: infinite and missing values, and the sum of the others."""
    path = _folder(spark, "features")
    tables.write_feature_csv(feature_matrix(spark, sf), path)
    cells = ", ".join(f"struct('{c}' AS feature, `{c}` AS spelled)" for c in ["vec_id", *FEATURES])
    long = spark.read.option("header", True).csv(path).selectExpr("label", f"inline(array({cells}))")
    return rounded(long.groupBy("label", "feature").agg(
        F.expr("count(1) AS images"), F.expr("count_if(spelled = 'inf') AS infinite"), F.expr("count_if(spelled IS NULL) AS missing"),
        F.expr("sum(CASE WHEN spelled <> 'inf' THEN CAST(spelled AS DOUBLE) END) AS total"),
    ))


def read_feature_csv(spark, sf):
    """The feature table written and read again with inferred types."""
    path = _folder(spark, "features")
    tables.write_feature_csv(feature_matrix(spark, sf), path)
    found = tables.read_feature_csv(spark, path).withColumn("vec_id", F.expr("CAST(vec_id AS BIGINT)"))
    return rounded(scalars.inf_to_null(found.drop("label"), FEATURES), 9)


def write_report_json(spark, sf):
    """The report written as JSON and taken apart again; accuracy is a plain number."""
    path = _folder(spark, "report")
    tables.write_report_json(evaluation.classification_report(predictions(spark, sf)), path)
    classes = spark.read.text(path, wholetext=True).selectExpr("value", "explode(json_object_keys(value)) AS class")
    cell = "CAST(get_json_object(value, concat('$[\\'', class, '\\'].', '{}')) AS DOUBLE) AS {}"
    plain = "CAST(get_json_object(value, '$.accuracy') AS DOUBLE) AS accuracy"
    fields = [cell.format(a, b) for a, b in (("precision", "precision"), ("recall", "recall"), ("f1-score", "f1"), ("support", "support"))]
    return rounded(classes.filter("class <> 'accuracy'").selectExpr("class", *fields, plain), 9)


def full_pipeline(spark, sf):
    """Cleaning to reports in one run; the report it wrote, over all rows."""
    features = feature_matrix(spark, sf).withColumnRenamed("vec_id", "image_id")
    return rounded(run_features(features, _folder(spark, "run"), SETTINGS)["report"], 9)


def save_load_model(spark, sf):
    """A saved bundle loaded again scores a written feature file."""
    training, fitted, _ = _trained(spark, sf)
    bundle, path, out = (_folder(spark, name) for name in ("bundle", "features", "scored"))
    tables.save_bundle(spark, bundle, fitted, training.model)
    tables.write_feature_csv(feature_matrix(spark, sf), path)
    return score_csv(spark, path, bundle, out)["predictions"].selectExpr("CAST(vec_id AS BIGINT) AS vec_id", "CAST(label AS STRING) AS label", "prediction")


def per_class_report(spark, sf):
    return rounded(evaluation.per_class_report(predictions(spark, sf)), 9)


def accuracy(spark, sf):
    return rounded(evaluation.accuracy(predictions(spark, sf)), 9)


def macro_avg(spark, sf):
    return rounded(evaluation.macro_avg(evaluation.per_class_report(predictions(spark, sf))), 9)


def weighted_avg(spark, sf):
    return rounded(evaluation.weighted_avg(evaluation.per_class_report(predictions(spark, sf))), 9)


def classification_report(spark, sf):
    return rounded(evaluation.classification_report(predictions(spark, sf)), 9)


def confusion_matrix(spark, sf):
    return evaluation.confusion_matrix(predictions(spark, sf))


def _spread_scores(spark, sf):
    """Score vectors that stand for three learners: column deviations, ranges and counts."""
    matrix = scalars.inf_to_null(feature_matrix(spark, sf), FEATURES)
    facts = ", ".join(
        f"struct('{f}' AS feature, stddev_pop({f}) AS a, 100 * (max({f}) - min({f})) AS b, "
        f"CAST(count(CASE WHEN {f} > 0 THEN 1 END) AS DOUBLE) AS c)" for f in FEATURES
    )
    packed = matrix.agg(F.expr(f"array({facts}) AS x"))
    names = packed.selectExpr("x.feature AS names")
    scores = packed.selectExpr(
        "inline(array(struct('deviation' AS learner, x.a AS scores), struct('range' AS learner, x.b AS scores), "
        "struct('positive' AS learner, x.c AS scores)))"
    )
    return names, scores


def _importances(spark, sf):
    return insights.name_scores(*_spread_scores(spark, sf))


def importance_name_join(spark, sf):
    return rounded(_importances(spark, sf))


def average_importance(spark, sf):
    return rounded(insights.average_importance(_importances(spark, sf)))


def average_importance_normalized(spark, sf):
    return rounded(insights.average_importance(_importances(spark, sf), normalize=True))


def importance_by_learner(spark, sf):
    return rounded(insights.importance_by_learner(rounded(_importances(spark, sf))))


def sort_by_importance(spark, sf):
    return rounded(insights.sort_by_importance(insights.average_importance(_importances(spark, sf))))


def top_importances(spark, sf):
    return rounded(insights.top_k(insights.average_importance(_importances(spark, sf)), 10))


def top_k(spark, sf):
    prices = table(spark, sf, "orders").selectExpr("CAST(o_orderkey AS STRING) AS feature", "o_totalprice AS importance")
    return insights.top_k(prices, 25)


def collect_importances(spark, sf):
    """Importances of the stack's learners, 200 rounds each."""
    return _trained(spark, sf)[0].model.importances()


def importance_totals(spark, sf):
    """What does not depend on the fit: gains sum to 1 and shares to 100, and the constant column has none."""
    found = collect_importances(spark, sf).groupBy("learner").agg(
        F.expr("count(1) AS features"), F.expr("sum(importance) AS total"),
        F.expr("sum(CASE WHEN feature = 'f_03' THEN importance END) AS of_constant"),
    )
    return rounded(found.withColumn("total", F.expr("CASE WHEN learner <> 'leaves' THEN total END")))


def label_codes(spark, sf):
    return insights.label_codes(feature_matrix(spark, sf))


def label_codes_text(spark, sf):
    return insights.label_codes(table(spark, sf, "events"), "event_type")


def distinct_sorted(spark, sf):
    return insights.distinct_sorted(feature_matrix(spark, sf))


def _long(spark, sf):
    return insights.long_features(scalars.inf_to_null(feature_matrix(spark, sf), FEATURES), FEATURES)


def _event_values(spark, sf):
    return insights.long_features(table(spark, sf, "events"), ["value"], "event_type")


def trendline(spark, sf):
    lines = insights.trendlines(_long(spark, sf), insights.label_codes(feature_matrix(spark, sf)))
    return rounded(lines.select("feature", "slope", "intercept", "r2"))


def trend_endpoints(spark, sf):
    events = table(spark, sf, "events")
    lines = insights.trendlines(_event_values(spark, sf), insights.label_codes(events, "event_type"))
    return rounded(lines.select("feature", "x0", "x1", "y0", "y1"))


def violin_summary(spark, sf):
    return rounded(insights.violin_summary(_long(spark, sf)))


def violin_summary_ranked(spark, sf):
    return rounded(insights.violin_summary(_event_values(spark, sf), accuracy=100))


def violin_density(spark, sf):
    return rounded(insights.violin_density(_event_values(spark, sf)))


def column_difference(spark, sf):
    """Feature names that do not survive the missing-share rule, as found in the table."""
    profile = cleaning.missing_profile(feature_matrix(spark, sf), FEATURES)
    return scoring.column_difference(profile.select("feature"), profile.filter("fraction < 0.5").select("feature"))


def scalar_feature_names(spark, sf):
    """Display names of per-label Gabor columns."""
    labels = table(spark, sf, "embeddings").select("label").distinct()
    stem = "concat('gabor_f', format_string('%.1f', 0.1D * (1 + label % 2)), '_a', CAST(degrees(label * pi() / 18) AS INT), '_mean')"
    return labels.selectExpr("label", f"{stem} AS feature").selectExpr(
        "label", "feature", f"{scalars.display_name('feature')} AS title",
        f"{insights.trend_legend('label / 8.0D')} AS legend",
    )


QUERIES: dict[str, Query] = {
    name: fn for name, fn in list(globals().items())
    if callable(fn) and getattr(fn, "__module__", "") == __name__ and not name.startswith("_")
}
