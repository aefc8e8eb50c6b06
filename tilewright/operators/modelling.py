"""Stratified splits, and three boosted learners stacked under a logistic regression.

The learners differ in how their trees grow (``operators.boosting``). Models
for all folds, the folds inside cross-validation folds included, advance in the
same jobs: a row lists the fits that learn from it and those that only score it.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.ranking import hash_bucket, hashed_order, number_within
from tilewright.functions.scalars import quoted
from tilewright.operators import boosting
from tilewright.operators.boosting import LEAVES, LEVELS, SYMMETRIC, Learner
from tilewright.session import cut_lineage

# ---------------------------------------------------------------- splits


def _numbered(df: DataFrame, key: str, label: str, seed: int, classes: DataFrame, sets: Sequence[str] = ()) -> DataFrame:
    """Rows with the facts of their (set and) label, numbered within it in hash order; safe
    for a label holding most rows."""
    hashed = df.withColumn("_h", F.expr(hashed_order(seed, quoted(key))))
    return number_within(hashed, [*sets, label], hash_bucket("_h"), "_h", "_rn", classes)


def _class_table(df: DataFrame, label: str, test_size: float, sets: Sequence[str] = ()) -> DataFrame:
    """Per (set and) label: rows before it in label order and rows that go to the test side.

    The test side takes ceil(test_size * rows) rows. Training places are shared
    out by largest remainder, so every label keeps its share. Windows here run
    over labels, not rows.
    """
    counts = df.groupBy(*sets, label).agg(F.expr("count(1) AS n"))
    own = f"PARTITION BY {', '.join(sets)} " if sets else ""
    shared = counts.selectExpr(
        *sets, label, "n", f"sum(n) OVER ({own}) AS total",
        f"coalesce(sum(n) OVER ({own}ORDER BY {label} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rows_before",
    ).selectExpr("*", f"total - CAST(ceil({test_size}D * total) AS BIGINT) AS places")
    floors = shared.selectExpr("*", "(n * places) DIV total AS base", "(n * places) % total AS rest")
    ranked = floors.selectExpr(
        "*", f"places - sum(base) OVER ({own}) AS spare", f"row_number() OVER ({own}ORDER BY rest DESC, {label}) AS turn"
    )
    return ranked.selectExpr(*sets, label, "rows_before", "n - base - CASE WHEN turn <= spare THEN 1 ELSE 0 END AS test_rows")


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_size: float = 0.2, seed: int = 42
) -> DataFrame:
    """``df`` with ``is_test``; the row choice follows md5(seed:key), so it repeats anywhere."""
    sizes = _class_table(df, label, test_size).select(label, "test_rows")
    return _numbered(df, key, label, seed, sizes).selectExpr(
        *[quoted(c) for c in df.columns], "_rn <= test_rows AS is_test"
    )


def stratified_folds(
    df: DataFrame, key: str, label: str = "label", k: int = 5, seed: int = 42, sets: Sequence[str] = ()
) -> DataFrame:
    """``df`` with ``fold`` 0..k-1: rows in (label, hash) order take folds in turn, so
    folds are even overall and within each label; maybe in each set of rows by itself."""
    sizes = _class_table(df, label, 0.0, sets).select(*sets, label, "rows_before")
    return _numbered(df, key, label, seed, sizes, sets).selectExpr(
        *[quoted(c) for c in df.columns], f"CAST((rows_before + _rn - 1) % {k} AS INT) AS fold"
    )


# ---------------------------------------------------------------- learners


@dataclass(frozen=True)
class StackSettings:
    """Sizes of the stack."""

    n_estimators: int = 200
    depth: int = 3
    bins: int = boosting.BINS
    folds: int = 5
    test_size: float = 0.2
    seed: int = 42
    final_iterations: int = 100
    learners: Sequence[Learner] = (LEVELS, LEAVES, SYMMETRIC)


def _lists(matrix: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


@dataclass(frozen=True)
class BoostedModel:
    """The learners' trees as tables: one row per split, one per leaf."""

    classes: list[str]
    features: list[str]
    learners: tuple[Learner, ...]
    nodes: DataFrame
    leaves: DataFrame

    @cached_property
    def _arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, threshold and value of every (tree, learner x class, node or leaf); as large as the model."""
        names, k = [x.name for x in self.learners], len(self.classes)
        place = lambda table: np.array([names.index(x) for x in table.column("learner").to_pylist()], np.int64) * k + table.column("class").to_numpy()
        leaves, nodes = self.leaves.toArrow(), self.nodes.toArrow()
        width = int(leaves.column("leaf").to_numpy().max(initial=0)) + 1
        rounds = int(leaves.column("tree").to_numpy().max(initial=-1)) + 1
        value = np.zeros((rounds, len(names) * k, width))
        value[leaves.column("tree").to_numpy(), place(leaves), leaves.column("leaf").to_numpy()] = leaves.column("value").to_numpy()
        feature, threshold = np.full((rounds, len(names) * k, width - 1), -1, np.int64), np.zeros((rounds, len(names) * k, width - 1))
        at = nodes.column("tree").to_numpy(), place(nodes), 2 ** nodes.column("level").to_numpy().astype(np.int64) - 1 + nodes.column("node").to_numpy()
        number = {f: i for i, f in enumerate(self.features)}
        feature[at] = [number[f] for f in nodes.column("feature").to_pylist()]
        threshold[at] = nodes.column("threshold").to_numpy()
        return feature, threshold, value

    def scores(self) -> Column:
        """Class probabilities of every learner, side by side, as an array."""
        feature, threshold, value = self._arrays
        width, classes, depth = len(self.features), len(self.classes), value.shape[2].bit_length() - 1

        # Where nothing is split, no value is larger.
        places, limits = np.maximum(feature, 0), np.where(feature < 0, np.inf, threshold)

        def summed(x: np.ndarray) -> np.ndarray:
            values, trees = np.ascontiguousarray(x).ravel(), np.arange(value.shape[1])[None]
            row, total = np.arange(len(x))[:, None] * width, np.zeros((len(x), value.shape[1]))
            for number in range(len(value)):
                node = np.zeros(total.shape, np.int64)
                for level in range(depth):
                    at = node + (trees * (2**depth - 1) + 2**level - 1)
                    # Missing values are larger than nothing.
                    node = 2 * node + (values.take(places[number].ravel().take(at) + row) > limits[number].ravel().take(at))
                total += value[number].ravel().take(node + trees * 2**depth)
            return total

        @F.arrow_udf("ARRAY<DOUBLE>")
        def score(features: pa.Array) -> pa.Array:
            x = boosting.matrix_of(features, width)
            total = np.empty((len(x), value.shape[1]))
            # Some rows at a time, whose nodes stay in the cache; flat positions are the fastest to look up.
            for start in range(0, len(x), 512):
                total[start : start + 512] = summed(x[start : start + 512])
            return _lists(boosting.probabilities(total, classes))

        return score(F.expr(boosting.vector(self.features)))

    def predict_each(self, df: DataFrame) -> DataFrame:
        """``df`` with one ``<learner>_prediction`` per learner; the first class wins ties."""
        k, names = len(self.classes), F.array(*[F.lit(c) for c in self.classes])
        scored = df.withColumn("_scores", self.scores())
        top = "CAST(array_position({0}, array_max({0})) - 1 AS INT)"
        picked = [
            names[F.expr(top.format(f"slice(_scores, {i * k + 1}, {k})"))].alias(f"{x.name}_prediction") for i, x in enumerate(self.learners)
        ]
        return scored.select(*[quoted(c) for c in df.columns], *picked)

    def importances(self) -> DataFrame:
        """``learner, feature, importance``, each learner on its own scale."""
        features = self.nodes.sparkSession.createDataFrame(pa.table({"feature": pa.array(self.features, pa.string())}))
        return boosting.importances(self.nodes, self.learners, features)


@dataclass(frozen=True)
class StackModel:
    """The learners under a multinomial logistic regression."""

    base: BoostedModel
    final: LogisticRegressionModel

    @property
    def features(self) -> list[str]:
        return self.base.features

    @property
    def classes(self) -> list[str]:
        return self.base.classes

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with the predicted label as ``prediction``."""
        names = F.array(*[F.lit(c) for c in self.classes])
        classed = self.final.transform(df.withColumn("meta", array_to_vector(self.base.scores())))
        return classed.select(*[quoted(c) for c in df.columns], names[F.col("final_class").cast("int")].alias("prediction"))

    def importances(self) -> DataFrame:
        """Those of the learners; without learners, the absolute first row of the final coefficients."""
        if self.base.learners:
            return self.base.importances()
        weights = [abs(float(x)) for x in self.final.coefficientMatrix.toArray()[0]]
        rows = [("final", f, w) for f, w in zip(self.features, weights)]
        return self.base.nodes.sparkSession.createDataFrame(rows, "learner STRING, feature STRING, importance DOUBLE")

    def save(self, spark: SparkSession, path: str) -> None:
        """Splits, leaves, final model and column lists as tables."""
        self.base.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.base.leaves.write.mode("overwrite").parquet(f"{path}/leaves")
        self.final.write().overwrite().save(f"{path}/final")
        learners = [(x.name, x.growth, x.rate, x.ridge, x.least_weight, x.importance, x.leaf_share) for x in self.base.learners]
        info = spark.createDataFrame(
            [(self.classes, self.features, learners)],
            "classes ARRAY<STRING>, features ARRAY<STRING>, learners ARRAY<STRUCT<name: STRING, growth: STRING, rate: DOUBLE, "
            "ridge: DOUBLE, least_weight: DOUBLE, importance: STRING, leaf_share: DOUBLE>>",
        )
        info.write.mode("overwrite").parquet(f"{path}/info")

    @staticmethod
    def load(spark: SparkSession, path: str) -> StackModel:
        info = spark.read.parquet(f"{path}/info").first()
        learners = tuple(Learner(**x.asDict()) for x in info["learners"])
        base = BoostedModel(
            list(info["classes"]), list(info["features"]), learners, spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/leaves")
        )
        return StackModel(base, LogisticRegressionModel.load(f"{path}/final"))


# ---------------------------------------------------------------- training


def class_names(df: DataFrame, label: str) -> list[str]:
    """Distinct labels as sorted strings; an empty table is an error."""
    rows = df.select(F.col(label).cast("string").alias("l")).distinct().collect()
    if not rows:
        raise ValueError("features and labels cannot be empty")
    if any(r["l"] is None for r in rows):
        raise ValueError("every row needs a label")
    return sorted(r["l"] for r in rows)


def _prepared(df: DataFrame, features: Sequence[str], key: str, label: str, classes: list[str]) -> DataFrame:
    """``key, label``, ``target`` (class position) and the features."""
    spot = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1
    return df.select(key, F.col(label).cast("string").alias(label), spot.cast("int").alias("target"), *[quoted(f) for f in features])


def _parts(train: DataFrame, key: str, label: str, settings: StackSettings, sets: Sequence[int]) -> DataFrame:
    """``key, fits``: which fits learn from a training row and which score it.

    Set 0 is the whole training side, set o > 0 leaves out fold o - 1. Each set
    has one fit per inner fold, which scores the rows of that fold, and one on
    all of its rows, which scores what the set leaves out. The n-th set's fits
    are numbered from n x (folds + 1).
    """
    k = settings.folds
    folded = cut_lineage(stratified_folds(train.select(key, label), key, label, k, settings.seed), "folds")
    listed = f"array({', '.join(map(str, sets))})"
    first = f"CAST((array_position({listed}, {{}}) - 1) * {k + 1} AS INT)"
    # All sets are cut into folds in one go.
    members = folded.selectExpr(quoted(key), label, "fold AS _out", f"explode({listed}) AS _set").filter("_set - 1 <> _out").drop("_out")
    inside = stratified_folds(members, key, label, k, settings.seed, ["_set"])
    places = f"transform(sequence(0, {k}), i -> struct(i + {first.format('_set')} AS fit, i <> fold AS train))"
    part = inside.selectExpr(f"{quoted(key)} AS _key", f"{places} AS fits")
    alone = f"array(struct({first.format('fold + 1')} + {k} AS fit, false AS train)) AS fits"
    found = part.unionByName(folded.filter(f"array_contains({listed}, fold + 1)").selectExpr(f"{quoted(key)} AS _key", alone))
    # A row has one entry per set. Written once, as fits are counted, binned and dealt from it.
    return cut_lineage(found.groupBy("_key").agg(F.expr("flatten(collect_list(fits)) AS fits")), "fits")


def _metas(scored: DataFrame, classes: int, learners: int) -> DataFrame:
    """``fit, target, meta`` of the rows that their fit did not learn from."""
    held = scored.filter("NOT train").select("fit", "target", "scores")

    @F.arrow_udf("ARRAY<DOUBLE>")
    def chances(scores: pa.Array) -> pa.Array:
        return _lists(boosting.probabilities(boosting.matrix_of(scores, classes * learners), classes))

    found = held.select("fit", F.col("target").cast("double").alias("target"), array_to_vector(chances("scores")).alias("meta"))
    return cut_lineage(found, "meta")


#: Rows of a partition of the final model's fit.
FINAL_ROWS = 16_384


def _fit_final(rows: DataFrame, iterations: int) -> LogisticRegressionModel:
    """Multinomial logistic regression with unit ridge penalty on the summed loss."""
    count = rows.count()
    # Every iteration is a job over all partitions: few rows make few of them.
    return LogisticRegression(
        maxIter=iterations, family="multinomial", featuresCol="meta", labelCol="target", regParam=1.0 / max(count, 1),
        standardization=False, predictionCol="final_class", rawPredictionCol="final_raw", probabilityCol="final_score",
    ).fit(rows.coalesce(max(1, -(-count // FINAL_ROWS))))


def _stacked(
    rows: DataFrame, features: Sequence[str], key: str, label: str, classes: list[str], settings: StackSettings, sets: Sequence[int]
):
    """(boosting, final model per set, accuracy per set on what it leaves out) of rows with ``is_test``."""
    k = settings.folds
    parts = _parts(rows.filter("NOT is_test"), key, label, settings, sets)
    joined = rows.join(parts, rows[key] == parts["_key"], "left").drop("_key")
    # Test rows are scored by the first set's fit on all rows, if that set is the whole training side.
    alone = f"array(struct({k} AS fit, false AS train))" if sets[0] == 0 else "array()"
    joined = joined.withColumn("fits", F.expr(f"coalesce(fits, {alone})"))
    boosted, scored = boosting.boost(
        joined, features, key, len(classes), len(sets) * (k + 1), settings.learners, settings.n_estimators, settings.depth, settings.bins, held_out=True
    )
    metas = _metas(scored, len(classes), len(settings.learners))

    def finish(number: int):
        first = number * (k + 1)
        final = _fit_final(metas.filter(f"fit >= {first} AND fit < {first + k}"), settings.final_iterations)
        hits = "avg(CASE WHEN final_class = target THEN 1.0D ELSE 0.0D END) AS score"
        return final, final.transform(metas.filter(f"fit = {first + k}")).agg(F.expr(hits)).first()["score"]

    # The sets' final models are independent, so their jobs are submitted side by side. One of many
    # rows fills the cores by itself, and the driver keeps something for each job that runs.
    fills = boosted.sizes.max() > FINAL_ROWS * rows.sparkSession.sparkContext.defaultParallelism
    with ThreadPoolExecutor(max_workers=min(2, len(sets)) if fills else len(sets)) as pool:
        finals, scores = zip(*pool.map(finish, range(len(sets))))
    return boosted, finals, scores


def _model(spark: SparkSession, boosted: boosting.Boosting, classes: list[str], fit: int) -> BoostedModel:
    nodes, leaves = boosting.node_tables(spark, boosted, fit)
    return BoostedModel(classes, boosted.features, tuple(boosted.learners), nodes, leaves)


def fit_base(
    df: DataFrame, features: Sequence[str], key: str, label: str = "label", settings: StackSettings = StackSettings()
) -> BoostedModel:
    """The base learners alone, fitted on all rows."""
    classes = class_names(df, label)
    rows = _prepared(df, features, key, label, classes).withColumn("fits", F.expr("array(struct(0 AS fit, true AS train))"))
    boosted, _ = boosting.boost(rows, features, key, len(classes), 1, settings.learners, settings.n_estimators, settings.depth, settings.bins, held_out=True)
    return _model(df.sparkSession, boosted, classes, 0)


def fit_stack(
    df: DataFrame, features: Sequence[str], key: str, label: str = "label", settings: StackSettings = StackSettings()
) -> StackModel:
    """Out-of-fold scores train the final model; base learners are fitted on all rows."""
    classes = class_names(df, label)
    rows = _prepared(df, features, key, label, classes).withColumn("is_test", F.lit(False))
    boosted, finals, _ = _stacked(rows, features, key, label, classes, settings, [0])
    return StackModel(_model(df.sparkSession, boosted, classes, settings.folds), finals[0])


def _fold_scores(spark: SparkSession, scores: Sequence[float]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(scores)), "fold INT, score DOUBLE")


def cross_val_scores(
    df: DataFrame, features: Sequence[str], key: str, label: str = "label", settings: StackSettings = StackSettings()
) -> DataFrame:
    """``fold, score``: accuracy of the whole stack on each held-out fold."""
    classes = class_names(df, label)
    rows = _prepared(df, features, key, label, classes).withColumn("is_test", F.lit(False))
    _, _, scores = _stacked(rows, features, key, label, classes, settings, range(1, settings.folds + 1))
    return _fold_scores(df.sparkSession, scores)


def holdout_score(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Accuracy over the rows marked ``is_test``."""
    hit = f"CASE WHEN CAST({truth} AS STRING) = CAST({prediction} AS STRING) THEN 1.0D ELSE 0.0D END"
    return df.filter("is_test").agg(F.expr(f"avg({hit}) AS test_score"), F.expr("count(1) AS test_rows"))


@dataclass(frozen=True)
class Training:
    """A stack fitted on the training side, and what its metrics are made of."""

    model: StackModel
    fold_scores: DataFrame
    metrics: DataFrame


def train_stacking(
    df: DataFrame, features: Sequence[str], key: str, label: str = "label", settings: StackSettings = StackSettings()
) -> Training:
    """The stack fitted on the training side, its cross-validation there, and one record of metrics:
    ``cv_mean_score, cv_std_score, test_score, cv_folds, test_size``."""
    spark, classes = df.sparkSession, class_names(df, label)
    split = cut_lineage(
        stratified_split(_prepared(df, features, key, label, classes), key, label, settings.test_size, settings.seed), "split"
    )
    boosted, finals, scores = _stacked(split, features, key, label, classes, settings, range(settings.folds + 1))
    folds = _fold_scores(spark, scores[1:])
    held = "CAST(NULL AS DOUBLE)" if scores[0] is None else f"{scores[0]}D"
    metrics = folds.agg(
        F.expr("avg(score) AS cv_mean_score"), F.expr("stddev_pop(score) AS cv_std_score")
    ).selectExpr(
        "cv_mean_score", "cv_std_score", f"{held} AS test_score", f"{settings.folds} AS cv_folds", f"{settings.test_size}D AS test_size"
    )
    return Training(StackModel(_model(spark, boosted, classes, settings.folds), finals[0]), folds, metrics)
