"""Written intermediates, checked broadcasts and Arrow plumbing of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from tilewright.session import cut_lineage

#: Rows up to which a table of a few numbers per row is broadcast (about 64 MB).
BROADCAST_ROWS = 1_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: survives lost executors and is computed once."""
    return cut_lineage(df, name)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether the (narrow) table has at most ``rows`` rows; never counts further than that."""
    return df.limit(rows + 1).count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcasting when its size was checked, else left to a shuffled join."""
    return F.broadcast(df) if small_enough(df, rows) else df


def on_id(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join on one column where null equals null; the right side's key is dropped."""
    renamed = right.withColumnRenamed(key, "_key")
    return left.join(renamed, left[key].eqNullSafe(renamed["_key"]), how).drop("_key")


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple]], schema: str) -> DataFrame:
    """mapInArrow over a function that yields tuples of columns (lists or arrays) in schema order."""
    struct: StructType = _parse_datatype_string(schema)
    fields = to_arrow_schema(struct)

    def run(batches):
        for columns in fn(batches):
            arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, fields)]
            if len(arrays[0]):
                yield pa.RecordBatch.from_arrays(arrays, schema=fields)

    return df.mapInArrow(run, struct)


def list_column(values, lengths, kind: pa.DataType) -> pa.ListArray:
    """Array column from concatenated values and the number of values of each row."""
    import numpy as np

    offsets = np.concatenate([[0], np.cumsum(np.asarray(lengths, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
