"""Labelled image folders as raster rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIFF_NAME = r"(?i)\.tiff?$"


_CHANNEL = T.ArrayType(T.ShortType())


@F.arrow_udf(T.StructType([T.StructField(n, _CHANNEL) for n in ("red", "green", "blue")]))
def unpack_channels(data, n_channels):
    """Interleaved blue-green-red(-alpha) bytes as three lists; NULL stays NULL.

    Batches are bounded in bytes by Spark, so a batch of large images is short.
    """
    import numpy as np
    import pyarrow as pa

    buffers = [None if x is None else np.frombuffer(x, dtype=np.uint8) for x in data.to_pylist()]
    channels = []
    for place in (2, 1, 0):
        parts = [
            np.empty(0, np.int16) if b is None else b[(place if n > 1 else 0) :: n].astype(np.int16)
            for b, n in zip(buffers, n_channels.to_pylist())
        ]
        ends = np.cumsum([len(x) for x in parts])
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        channels.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts))))
    missing = pa.array([b is None for b in buffers])
    return pa.StructArray.from_arrays(channels, ["red", "green", "blue"], mask=missing)


def _plain_path(origin):
    """File path of a URI: percent escapes decoded, a plus sign kept."""
    return F.url_decode(F.replace(origin, F.lit("+"), F.lit("%2B")))


#: Tasks per core that read a folder, at most; small files would make a task of every few dozen.
TASKS_PER_CORE = 16


def labelled_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Files of TIFF-like name below the folders of ``root``, at any depth, through a file source.

    Folders are listed, no file is looked up by itself. A folder without such
    files is an error.
    """
    reader, pattern = spark.read.format(kind), "*.[tT][iI][fF]*"
    below = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(f"{root.rstrip('/')}/*")
    if below.isEmpty():
        return spark.read.format(kind).load(f"{root.rstrip('/')}/*/{pattern}")
    return below.coalesce(TASKS_PER_CORE * spark.sparkContext.defaultParallelism)


def scan_labelled_images(spark: SparkSession, root: str) -> DataFrame:
    """TIFF files at ``<root>/<label>/<file>``, suffix in any case.

    Columns ``image_id`` (the path), ``label`` (the folder) and Spark's ``image``
    struct. Unreadable files are kept.
    """
    images = labelled_files(spark, root, "image")
    path = _plain_path(F.col("image.origin"))
    depth = F.size(F.split(F.regexp_replace("image_id", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/"))
    return (
        images.filter(F.col("image.origin").rlike(TIFF_NAME))
        .select(path.alias("image_id"), "image").filter(depth == _folder_depth(spark, root) + 2)
        .select("image_id", F.regexp_extract("image_id", "([^/]+)/[^/]+$", 1).alias("label"), "image")
    )


def _folder_depth(spark: SparkSession, root: str) -> int:
    """Path parts of a folder once its file system has made it absolute."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(path.makeQualified(system.getUri(), system.getWorkingDirectory()).toUri().getPath().split("/"))


def decode_rgb(images: DataFrame) -> DataFrame:
    """Raster rows ``image_id, label, h, w, ok, red, green, blue``.

    Spark's bytes are blue, green, red; a fourth channel is dropped and a single
    one repeated. Files that did not decode get ``ok`` = false and no channels.
    """
    img = F.col("image")
    ok = F.coalesce(img["height"] > 0, F.lit(False))
    unpacked = unpack_channels(F.when(ok, img["data"]), img["nChannels"])
    return images.select(
        "image_id", "label",
        F.when(ok, img["height"]).otherwise(0).alias("h"),
        F.when(ok, img["width"]).otherwise(0).alias("w"),
        ok.alias("ok"), unpacked.alias("_c"),
    ).select("image_id", "label", "h", "w", "ok", "_c.red", "_c.green", "_c.blue")


def read_rasters(spark: SparkSession, root: str) -> DataFrame:
    return decode_rgb(scan_labelled_images(spark, root))


def first_tiff(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of the first TIFF at any depth, by name; no row contents are read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
        .filter(F.col("path").rlike(TIFF_NAME))
    )
    return files.agg(F.min("path").alias("path")).filter("path is not null")


def first_image(images: DataFrame, key: str, group: Sequence[str] = ()) -> DataFrame:
    """Smallest ``key``, overall or per group."""
    return images.groupBy(*group).agg(F.min(key).alias("first_image"))
