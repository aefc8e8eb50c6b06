"""Approximate nearest neighbours by cross-polytope hashing.

A table turns every vector by a pseudo-rotation, three rounds of random signs
and a fast Hadamard transform, and files it under the signed axis that its unit
vector is nearest to. A query probes the buckets of its ``probes`` nearest
signed axes in each of ``tables`` tables; what they hold is ranked again by the
exact Euclidean distance of the original vectors, in double precision.

Equal vectors are one class. A class is filed once, under its k + 1 smallest
ids: a query is nobody's neighbour but others', so no more of them can be among
its k nearest. Queries of one class are searched once. Buckets are compared in
cells of bounded size; nothing in them is capped. A query that finds fewer than
k neighbours probes every axis of one table, hence all vectors, so it gets k,
or all that exist.

Vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do rows without an id. Vectors of different lengths are never
neighbours. An id stands for one vector: repeated rows count once, and of
several vectors the least is taken. Ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.cells import in_cells
from tilewright.llm.shared import map_batches, written

TABLES, PROBES, NEAREST = 4, 32, 10
#: Vectors and queries of a cell; queries of a class are spread over so many copies of its result.
CELL_VECTORS, CELL_QUERIES, COPIES = 8192, 1024, 16
#: Distances held at once.
_HELD = 1 << 21


def rotated(vectors: np.ndarray, table: int, seed: int = 42) -> np.ndarray:
    """Pseudo-rotated unit vectors, padded with zeros to a power of two."""
    width = vectors.shape[1]
    size = 1 << max(0, width - 1).bit_length()
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    out = np.zeros((len(vectors), size))
    out[:, :width] = vectors / largest
    out /= np.sqrt((out * out).sum(axis=1, keepdims=True))
    signs = np.random.default_rng([seed, width, table]).choice([-1.0, 1.0], (3, size))
    for sign in signs:
        out *= sign
        half = 1
        while half < size:
            pairs = out.reshape(len(out), -1, 2, half)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(out), size)
            half *= 2
        out /= np.sqrt(size)
    return out


def nearest_axes(turned: np.ndarray, count: int) -> np.ndarray:
    """Numbers of the ``count`` nearest signed axes, nearest first; axis i backwards is size + i."""
    signed = np.concatenate([turned, -turned], axis=1)
    count = min(count, signed.shape[1])
    if count == 1:
        return signed.argmax(axis=1)[:, None]
    top = np.argpartition(-signed, count - 1, axis=1)[:, :count]
    order = np.argsort(-np.take_along_axis(signed, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1)


def _by_length(column: pa.Array):
    """(rows, their vectors) for each length of vectors in the column."""
    flat, offsets = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.offsets)
    sizes = np.diff(offsets)
    starts = offsets[:-1] - offsets[0]
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)]


def _filed(vectors: DataFrame, tables: int, probes: int) -> DataFrame:
    """Each row once per bucket: of its own nearest axis, or of the ``probes`` nearest."""
    names = vectors.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema.fields)

    def file(batches):
        for batch in batches:
            for rows, matrix in _by_length(batch.column("vector")):
                width = matrix.shape[1]
                # Blocks, so that the probes of a batch of long vectors stay small.
                step = max(1, _HELD // (width * min(probes, 4 * width)))
                for table in range(tables):
                    for at in range(0, len(rows), step):
                        own = rows[at : at + step]
                        axes = nearest_axes(rotated(matrix[at : at + step], table), probes)
                        bucket = (width * tables + table) * (1 << 32) + axes
                        part = batch.take(pa.array(np.repeat(own, axes.shape[1])))
                        yield *(part.column(c) for c in names), bucket.ravel()

    return map_batches(vectors, file, f"{kinds}, bucket BIGINT")


def best(vectors: np.ndarray, ids: list[list[int]], queries: np.ndarray, keep: int):
    """(query, score, id) columns: for each query the ``keep`` nearest by exact distance, ties to smaller ids."""
    numbers = np.concatenate([np.asarray(i, np.int64) for i in ids])
    first = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    norms, out = (vectors * vectors).sum(axis=1), []
    step = max(1, _HELD // max(1, len(vectors)))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        own = (part * part).sum(axis=1)
        with np.errstate(invalid="ignore", over="ignore"):
            rough = own[:, None] + norms[None] - 2 * (part @ vectors.T)
            # Far beyond the rounding error of the products.
            slack = 1e-12 * vectors.shape[1] * (own[:, None] + norms.max())
            if len(vectors) > keep:
                edge = np.partition(rough, keep - 1, axis=1)[:, keep - 1 : keep]
                q, v = np.nonzero(~(rough > edge + slack))
            else:
                q, v = (x.ravel() for x in np.indices(rough.shape))
            away = vectors[v] - part[q]
            score = np.sqrt((away * away).sum(axis=1))
        sizes = first[v + 1] - first[v]
        entry = np.repeat(first[v] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        q, score, number = np.repeat(q, sizes), np.repeat(score, sizes), numbers[entry]
        order = np.lexsort((number, score, q))
        q, score, number = q[order], score[order], number[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        out.append((q[place < keep] + at, score[place < keep], number[place < keep]))
    return (np.concatenate([o[i] for o in out]) for i in range(3))


_FOUND = "query BIGINT, found ARRAY<STRUCT<score: DOUBLE, id: BIGINT>>"


def _search(index: DataFrame, probes: DataFrame, keep: int) -> DataFrame:
    """``query, found``: the best of all buckets that a query probes."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))
        schema = pa.schema([("query", pa.int64()), ("found", kind)])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        (_, vectors), = _by_length(left.column("vector").combine_chunks())
        (_, queries), = _by_length(right.column("vector").combine_chunks())
        q, score, number = best(vectors, left.column("ids").to_pylist(), queries, keep)
        offsets = np.searchsorted(q, np.arange(right.num_rows + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(score), pa.array(number)], ["score", "id"])
        return pa.table([right.column("query").combine_chunks(), pa.ListArray.from_arrays(pa.array(offsets), pairs)], schema=schema)

    met = in_cells(index, probes, "bucket", "ids[0]", "query", CELL_VECTORS, CELL_QUERIES).applyInArrow(compare, _FOUND)
    return met.groupBy("query").agg(F.expr(f"slice(array_sort(array_distinct(flatten(collect_list(found)))), 1, {keep}) AS found"))


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, vector``, one row per id; rows that take no part are left out."""
    sound = "forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(vector, x -> x <> 0)"
    narrow = vectors.select(F.col(vec_id).cast("bigint").alias("id"), F.col(embedding).alias("vector"))
    return narrow.filter(f"id IS NOT NULL AND vector IS NOT NULL AND {sound}").groupBy("id").agg(F.expr("min(vector) AS vector"))


def nearest(
    vectors: DataFrame, queries: str, vec_id: str = "vec_id", embedding: str = "embedding", k: int = NEAREST,
    tables: int = TABLES, probes: int = PROBES,
) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found of every query.

    ``queries`` is an SQL condition on ``id`` that picks the queries. Ids and
    vectors are written once; they move once for each table, probes as often.
    """
    keep = k + 1
    rows = written(usable(vectors, vec_id, embedding), "neighbour-vectors")
    # Groups are limited inside tasks before they move, so a vector with many copies stays small.
    smallest = rows.withColumn("place", F.expr("row_number() OVER (PARTITION BY vector ORDER BY id)")).filter(f"place <= {keep}")
    classes = smallest.groupBy("vector").agg(F.expr("array_sort(collect_list(id)) AS ids"))
    classes = written(classes.select("ids", "vector"), "neighbour-classes")
    asked = rows.filter(queries)
    wanted = written(asked.groupBy("vector").agg(F.expr("min(id) AS query")).select("query", "vector"), "neighbour-queries")

    found = written(_search(_filed(classes, tables, 1), _filed(wanted, tables, probes), keep), "neighbour-found")
    short = found.filter(f"size(found) < {keep}").select("query")
    if not short.isEmpty():
        # All axes of one table are all of its buckets.
        every = _filed(wanted.join(short, "query", "left_semi").select(*wanted.columns), 1, 1 << 31)
        again = _search(_filed(classes, 1, 1), every, keep)
        found = written(found.filter(f"size(found) >= {keep}").unionByName(again), "neighbour-all")

    copies = wanted.join(found, "query").select("vector", "found", F.expr(f"explode(sequence(0, {COPIES - 1})) AS copy"))
    each = asked.withColumn("copy", F.expr(f"CAST(pmod(xxhash64(id), {COPIES}) AS INT)")).join(copies, ["vector", "copy"])
    others = each.selectExpr("id AS query_id", f"posexplode(slice(filter(found, f -> f.id <> id), 1, {k})) AS (place, near)")
    return others.selectExpr("query_id", "place + 1 AS rank", "near.id AS vec_id", "near.score AS score")
