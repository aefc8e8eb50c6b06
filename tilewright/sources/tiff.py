"""TIFF folders read by (file, row range), so that one tall image is work for many tasks.

Every file's directory is read in a task; it says where the file's strips lie.
From it follow the row ranges, each with the rows around it that neighbourhoods
need, and a task fetches the bytes of its ranges alone. Files are opened
through ``pyarrow.fs``, so folders are local paths or URIs that it knows.

Read this way are grey and RGB images of 8 bits, with or without alpha, in
strips that are stored plainly or deflated. Other layouts (palettes, tiles, LZW)
go through Spark's image reader as a whole.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators.raster import STRIP_PIXELS, cut_strips
from tilewright.session import cut_lineage
from tilewright.sources.images import TIFF_NAME, _folder_depth, labelled_files, read_rasters

_WIDTH, _HEIGHT, _BITS, _COMPRESSION, _MEANING, _OFFSETS = 256, 257, 258, 259, 262, 273
_SAMPLES, _ROWS, _COUNTS, _PLANES, _PREDICTOR, _TILES = 277, 278, 279, 284, 317, 322
_SIZES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 16: ("Q", 8)}
_PLAIN, _DEFLATED = (1,), (8, 32946)


class UnreadableImage(ValueError):
    """Not a TIFF file, or one that ends too early."""


@dataclass(frozen=True)
class Layout:
    """Where an image's rows lie; ``offsets`` is empty for layouts that are left to Spark."""

    height: int
    width: int
    samples: int
    inverted: bool
    deflated: bool
    rows_per_strip: int
    offsets: list[int]
    counts: list[int]


def layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """The directory of a file, given a function that reads (offset, bytes)."""

    def unpack(form: str, at: int):
        data = read(at, struct.calcsize(form))
        if len(data) < struct.calcsize(form):
            raise UnreadableImage("the directory is cut off")
        return struct.unpack(form, data)

    head = read(0, 4)
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(head)
    if order is None:
        raise UnreadableImage("no TIFF header")
    (at,) = unpack(f"{order}I", 4)
    (entries,) = unpack(f"{order}H", at)
    tags: dict[int, list[int]] = {}
    for i in range(entries):
        place = at + 2 + 12 * i
        tag, kind, count = unpack(f"{order}HHI", place)
        if kind in _SIZES:
            letter, width = _SIZES[kind]
            where = place + 8 if width * count <= 4 else unpack(f"{order}I", place + 8)[0]
            if where + width * count > size:
                raise UnreadableImage("an entry points behind the file")
            tags[tag] = list(unpack(f"{order}{count}{letter}", where))
    one = lambda tag, default: tags.get(tag, [default])[0]
    height, width = one(_HEIGHT, 0), one(_WIDTH, 0)
    if height <= 0 or width <= 0:
        raise UnreadableImage("no size")
    samples, rows = one(_SAMPLES, 1), min(one(_ROWS, height), height)
    offsets, counts = tags.get(_OFFSETS, []), tags.get(_COUNTS, [])
    known = (
        _TILES not in tags and set(tags.get(_BITS, [1])) == {8} and one(_PLANES, 1) == 1 and one(_PREDICTOR, 1) == 1
        and one(_COMPRESSION, 1) in _PLAIN + _DEFLATED and one(_MEANING, 2) in ((0, 1) if samples < 3 else (2,))
    )
    if not known:
        return Layout(height, width, samples, False, False, rows, [], [])
    if len(offsets) != -(-height // rows) or len(counts) != len(offsets):
        raise UnreadableImage("strips do not cover the image")
    if any(o + n > size for o, n in zip(offsets, counts)):
        raise UnreadableImage("strips are cut off")
    return Layout(height, width, samples, one(_MEANING, 2) == 0, one(_COMPRESSION, 1) in _DEFLATED, rows, offsets, counts)


def rows_of(read: Callable[[int, int], bytes], image: Layout, top: int, bottom: int) -> np.ndarray:
    """Rows ``top`` to ``bottom`` of an image as (row, column, red-green-blue)."""
    line, parts = image.width * image.samples, []
    for number in range(top // image.rows_per_strip, -(-bottom // image.rows_per_strip)):
        first = number * image.rows_per_strip
        low, high = max(top, first) - first, min(bottom, first + image.rows_per_strip) - first
        if image.deflated:
            data = zlib.decompress(read(image.offsets[number], image.counts[number]))[low * line : high * line]
        else:
            data = read(image.offsets[number] + low * line, (high - low) * line)
        if len(data) != (high - low) * line:
            raise UnreadableImage("a strip is too short")
        parts.append(data)
    found = np.frombuffer(b"".join(parts), np.uint8).reshape(bottom - top, image.width, image.samples)
    found = found[:, :, :3] if image.samples >= 3 else np.repeat(found[:, :, :1], 3, axis=2)
    return 255 - found if image.inverted else found


def opened(uri: str):
    """An input file, for a path as Spark lists it: a URI without escapes."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem().open_input_file("/" + uri.removeprefix("file:").lstrip("/"))
    system, path = fs.FileSystem.from_uri(quote(uri, safe=":/@"))
    return system.open_input_file(path)


_LAYOUT = "h INT, w INT, samples INT, inverted BOOLEAN, deflated BOOLEAN, rows_per_strip INT, offsets ARRAY<BIGINT>, counts ARRAY<BIGINT>"


def scan_layouts(spark: SparkSession, root: str) -> DataFrame:
    """``image_id, label, ok, uri`` and the layout of TIFF files at ``<root>/<label>/<file>``, suffix in any case.

    Only directories are read. Files that are not TIFF or cut off have ``ok`` false.
    """
    names = labelled_files(spark, root, "binaryFile").select("path")
    # Named like the image reader's files once those are decoded.
    path = F.regexp_replace("path", "^file:/+", "file:///")
    depth = F.size(F.split(F.regexp_replace("image_id", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "/"))
    files = names.filter(F.col("path").rlike(TIFF_NAME)).select(path.alias("image_id"), "path").filter(depth == _folder_depth(spark, root) + 2)
    files = files.select("image_id", F.regexp_extract("image_id", "([^/]+)/[^/]+$", 1).alias("label"), "path")

    def look(batches):
        for batch in batches:
            for image_id, label, uri in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    with opened(uri) as stream:
                        size = stream.size()
                        found = layout(lambda at, n: stream.read_at(max(0, min(n, size - at)), min(at, size)), size)
                    facts = (True, found.height, found.width, found.samples, found.inverted, found.deflated, found.rows_per_strip, found.offsets, found.counts)
                except UnreadableImage:
                    facts = (False, 0, 0, 0, False, False, 0, [], [])
                yield pa.RecordBatch.from_pylist([dict(zip(names_out, (image_id, label, uri, *facts)))], schema=kinds)

    names_out = ["image_id", "label", "uri", "ok", "h", "w", "samples", "inverted", "deflated", "rows_per_strip", "offsets", "counts"]
    whole, bits = pa.int32(), pa.list_(pa.int64())
    kinds = pa.schema(list(zip(names_out, [pa.string()] * 3 + [pa.bool_(), whole, whole, whole, pa.bool_(), pa.bool_(), whole, bits, bits])))
    tasks = spark.sparkContext.defaultParallelism
    return files.repartition(tasks, "path").mapInArrow(look, f"image_id STRING, label STRING, uri STRING, ok BOOLEAN, {_LAYOUT}")


def read_strips(spark: SparkSession, root: str, halo: int = 0, strip_pixels: int = STRIP_PIXELS) -> tuple[DataFrame, DataFrame]:
    """(images, strips) of a labelled folder.

    Images are ``image_id, label, h, w, ok``. Strips are those of
    ``cut_strips`` (``image_id, h, w, r0, n_rows, top, red, green, blue``) with
    ``label``, each read on its own; unreadable images have none.
    """
    found = cut_lineage(scan_layouts(spark, root), "layouts")
    images = found.select("image_id", "label", "h", "w", "ok")
    per = f"CAST(greatest(1, {strip_pixels} DIV greatest(w, 1)) AS INT)"
    ranges = (
        found.filter("ok AND size(offsets) > 0").withColumn("_per", F.expr(per))
        .withColumn("s", F.expr("explode(sequence(0, CAST((h - 1) DIV _per AS INT)))"))
        .selectExpr("*", "s * _per AS r0", "least(_per, h - s * _per) AS n_rows", f"greatest(s * _per - {halo}, 0) AS top", f"least((s + 1) * _per + {halo}, h) AS bottom")
    )
    # A range takes along only the strips that it reads.
    low, high = "top DIV rows_per_strip", "(bottom - 1) DIV rows_per_strip"
    ranges = ranges.selectExpr(
        "image_id", "label", "uri", "h", "w", "samples", "inverted", "deflated", "rows_per_strip", "r0", "n_rows", "top", "bottom",
        f"CAST({low} AS INT) AS first", f"slice(offsets, CAST({low} AS INT) + 1, CAST({high} - {low} AS INT) + 1) AS offsets",
        f"slice(counts, CAST({low} AS INT) + 1, CAST({high} - {low} AS INT) + 1) AS counts",
    )
    channel = pa.list_(pa.int16())
    schema = pa.schema([
        ("image_id", pa.string()), ("label", pa.string()), *[(n, pa.int32()) for n in ("h", "w", "r0", "n_rows", "top")],
        *[(n, channel) for n in ("red", "green", "blue")],
    ])

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with opened(row["uri"]) as stream:
                    first, per_strip = row["first"] * row["rows_per_strip"], row["rows_per_strip"]
                    image = Layout(
                        row["h"] - first, row["w"], row["samples"], row["inverted"], row["deflated"], per_strip, row["offsets"], row["counts"]
                    )
                    pixels = rows_of(lambda at, n: stream.read_at(n, at), image, row["top"] - first, row["bottom"] - first)
                flat = [pa.array([pixels[:, :, k].ravel().astype(np.int16)], channel) for k in range(3)]
                facts = [pa.array([row[n]], schema.field(n).type) for n in ("image_id", "label", "h", "w", "r0", "n_rows", "top")]
                yield pa.RecordBatch.from_arrays([*facts, *flat], schema=schema)

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kinds = "image_id STRING, label STRING, h INT, w INT, r0 INT, n_rows INT, top INT, red ARRAY<SMALLINT>, green ARRAY<SMALLINT>, blue ARRAY<SMALLINT>"
    strips = ranges.repartition(tasks, "image_id", "r0").mapInArrow(decode, kinds)
    whole = found.filter("ok AND size(offsets) = 0")
    if not whole.isEmpty():
        left = read_rasters(spark, root).join(whole.select("image_id"), "image_id", "left_semi")
        labelled = cut_strips(left, halo=halo, strip_pixels=strip_pixels).join(images.select("image_id", "label"), "image_id")
        strips = strips.unionByName(labelled.selectExpr(*strips.columns))
    return images, strips


# ---------------------------------------------------------------- writing


def tiff_bytes(pixels: np.ndarray, rows_per_strip: int, deflated: bool = False) -> bytes:
    """A little-endian RGB file of (row, column, 3) bytes."""
    height, width, _ = pixels.shape
    strips = [pixels[r : r + rows_per_strip].astype(np.uint8).tobytes() for r in range(0, height, rows_per_strip)]
    strips = [zlib.compress(s) for s in strips] if deflated else strips
    entries = 10
    after = 8 + 2 + 12 * entries + 4
    data_at = after + 6 + 8 * len(strips)
    starts = np.cumsum([0, *map(len, strips)])[:-1] + data_at
    listed = len(strips) > 1
    tags = [
        (_WIDTH, 4, 1, width), (_HEIGHT, 4, 1, height), (_BITS, 3, 3, after), (_COMPRESSION, 3, 1, 8 if deflated else 1), (_MEANING, 3, 1, 2),
        (_OFFSETS, 4, len(strips), after + 6 if listed else int(starts[0])), (_SAMPLES, 3, 1, 3), (_ROWS, 4, 1, rows_per_strip),
        (_COUNTS, 4, len(strips), after + 6 + 4 * len(strips) if listed else len(strips[0])), (_PLANES, 3, 1, 1),
    ]
    directory = b"".join(struct.pack("<HHII", *t) for t in tags)
    tables = struct.pack("<3H", 8, 8, 8) + struct.pack(f"<{len(strips)}I", *map(int, starts)) + struct.pack(f"<{len(strips)}I", *map(len, strips))
    return struct.pack("<2sHIH", b"II", 42, 8, entries) + directory + struct.pack("<I", 0) + tables + b"".join(strips)


def write_tiffs(rasters: DataFrame, root: str, rows_per_strip: int = 8) -> int:
    """Rasters as ``<root>/<label>/<image_id>.tif``, written by tasks; returns their number.

    Rasters that are not ``ok`` are written cut off in the middle.
    """
    uri = root if "://" in root or root.startswith("file:") else f"file://{quote(root)}"

    def write(batches):
        from pyarrow import fs

        system, folder = (fs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
        for batch in batches:
            for row in batch.to_pylist():
                shape = (row["h"], row["w"])
                pixels = np.stack([np.array(row[k], np.uint8).reshape(shape) for k in ("red", "green", "blue")], axis=2)
                data = tiff_bytes(pixels, rows_per_strip, deflated=row["h"] % 2 == 1)
                system.create_dir(f"{folder}/{row['label']}", recursive=True)
                with system.open_output_stream(f"{folder}/{row['label']}/{row['image_id']}.tif") as out:
                    out.write(data if row["ok"] else data[: len(data) // 2])
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    named = rasters.selectExpr("CAST(image_id AS STRING) AS image_id", "label", "h", "w", "ok", "red", "green", "blue")
    return named.mapInArrow(write, "n BIGINT").agg(F.expr("coalesce(sum(n), 0) AS n")).first()["n"]
