"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
#: Folders written since each open ``intermediates`` began, innermost last.
_open_scopes: list[list[str]] = []


def build_session(app_name: str = "tilewright", master: str | None = None, **settings: str) -> SparkSession:
    """Session with the settings the operators are planned for.

    Results do not depend on any of them. Co-partitioning on a subset of the
    join keys lets joins on (image_id, ...) reuse a partitioning by image.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        "spark.sql.session.timeZone": "UTC",
        # Arrow batches carry whole strips, so bound them by rows as well as by bytes.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by spark.checkpoint.dir."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if sc.applicationId not in _local_dirs:
        _local_dirs[sc.applicationId] = tempfile.mkdtemp(prefix="tilewright-")
    return _local_dirs[sc.applicationId]


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The table survives the loss of executors, and re-reading it prunes columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tilewright-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _open_scopes:
        _open_scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    """(file system, path) as the cluster sees them."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _located(spark, path)
    return system.exists(found)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the library's own, if it is there."""
    system, found = _located(spark, path)
    system.delete(found, True)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Removes what ``cut_lineage`` writes within, at the end.

    Whatever is still wanted of it must have been written elsewhere by then.
    """
    _open_scopes.append([])
    try:
        yield
    finally:
        for path in _open_scopes.pop():
            remove(spark, path)
