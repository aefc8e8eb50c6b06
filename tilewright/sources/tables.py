"""Feature tables, reports, parameters and models on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilewright.operators.cleaning import Preprocessor
from tilewright.operators.modelling import StackModel


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the input has fewer files than that.

    Pixel work multiplies each record, so a handful of small files would leave
    cores idle. Large inputs have more files than cores and pass unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def read_feature_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Headered CSV. A schema saves the inference pass; a missing path is an error."""
    reader = spark.read.option("header", True).option("nanValue", "NaN").option("positiveInf", "inf").option("negativeInf", "-inf")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_feature_csv(df: DataFrame, path: str) -> None:
    """Headered CSV directory, one file per partition; infinities as ``inf``."""
    plain = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        if kind in ("double", "float"):
            text = column.cast("string")
            column = F.when(column == float("inf"), "inf").when(column == float("-inf"), "-inf").otherwise(text)
        plain.append(column.alias(name))
    df.select(*plain).write.mode("overwrite").option("header", True).csv(path)


def write_importances(importances: DataFrame, path: str) -> None:
    """Descending lists, one folder per learner."""
    listed = importances.repartition("learner").sortWithinPartitions("learner", F.desc("importance"), "feature")
    listed.write.mode("overwrite").option("header", True).partitionBy("learner").csv(path)


def report_json(report: DataFrame, training_metrics: DataFrame | None = None) -> DataFrame:
    """One row ``value``: the long report as nested JSON.

    Accuracy is a plain number; training metrics, if given, come last as
    ``_training_metrics``.
    """
    record = "struct(precision, recall, f1 AS `f1-score`, support)"
    entry = (
        "CASE WHEN class = 'accuracy' THEN concat(to_json(map('k', recall))) ELSE to_json("
        f"map('k', {record})) END"
    )
    # {"k": value} minus its wrapper leaves the bare value.
    members = report.selectExpr(
        "CASE class WHEN 'accuracy' THEN 1 WHEN 'macro avg' THEN 2 WHEN 'weighted avg' THEN 3 ELSE 0 END AS part", "class",
        f"substring({entry}, 6, length({entry}) - 6) AS body",
    )
    if training_metrics is not None:
        members = members.unionByName(training_metrics.selectExpr(
            "4 AS part", "'_training_metrics' AS class", "to_json(struct(*)) AS body"
        ))
    # The list is as long as the report: one record per class.
    joined = "array_join(transform(array_sort(collect_list(struct(part, class, body))), x -> concat(substring(to_json(map(x.class, 1)), 2, length(to_json(map(x.class, 1))) - 3), x.body)), ',')"
    return members.agg(F.expr(f"concat('{{', {joined}, '}}') AS value"))


def write_report_json(report: DataFrame, path: str, training_metrics: DataFrame | None = None) -> None:
    report_json(report, training_metrics).write.mode("overwrite").text(path)


def save_bundle(spark: SparkSession, path: str, preprocessor: Preprocessor, model: StackModel) -> None:
    """Parameters and model side by side."""
    preprocessor.table(spark).write.mode("overwrite").parquet(f"{path}/parameters")
    model.save(spark, f"{path}/model")


def load_bundle(spark: SparkSession, path: str) -> tuple[Preprocessor, StackModel]:
    parameters = Preprocessor.from_table(spark.read.parquet(f"{path}/parameters"))
    return parameters, StackModel.load(spark, f"{path}/model")
