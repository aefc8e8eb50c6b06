"""Exact duplicates by grace hashing with complete comparison.

Each input task first folds equal texts of its own rows in an open-addressing
table, so a text with many copies travels once per task. The records that are
left are divided by digits of their hash, and a division whose distinct records
exceed the bound is divided again by the next digits, until all fit. The plan
of divisions is made from hashes and lengths alone; the records then move once,
through the shuffle's spill files, and each bucket is read as a stream into one
open-addressing table that compares complete content.

Null counts as the empty text. Of equal texts the row with the largest
``doc_id`` stays; null ids count below all others, and of rows that repeat the
largest id the first read stays.
"""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import hinted, map_batches, written

#: Bytes of distinct text that one table may hold.
TABLE_BYTES = 32 << 20
#: What an entry takes besides its text: the objects, the hash and its share of the slots.
ENTRY_BYTES = 160


class Table:
    """Open addressing with linear probing; equal means equal hash and equal content."""

    def __init__(self, slots: int = 1024):
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.texts: list[bytes] = []
        self.size = 0

    def find(self, h: int, text: bytes) -> int:
        """Number of the entry with this text, added if new."""
        mask = len(self.slots) - 1
        at = (h ^ (h >> 32)) & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.texts[entry] == text:
                return entry
            at = (at + 1) & mask
        entry = self.slots[at] = len(self.texts)
        self.hashes.append(h)
        self.texts.append(text)
        self.size += len(text) + ENTRY_BYTES
        if 2 * len(self.texts) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = (h ^ (h >> 32)) & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def _folded(bound: int):
    """Numbers the rows of one task; only the first of equal texts keeps its text."""

    def run(batches):
        table, firsts, row = Table(), [], None
        for batch in batches:
            hashes, texts = batch.column("h").to_pylist(), batch.column("text").to_pylist()
            if hashes and row is None:
                row = batch.column("part")[0].as_py() << 33
            rows, folds, kept = [], [], []
            for h, text in zip(hashes, texts):
                if table.size > bound:
                    table, firsts = Table(), []
                entry = table.find(h, text)
                new = entry == len(firsts)
                if new:
                    firsts.append(row)
                rows.append(row)
                folds.append(firsts[entry])
                kept.append(text if new else None)
                row += 1
            if hashes:
                yield batch.column("doc_id"), batch.column("h"), rows, folds, kept, batch.column("text_sha256")

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket as a stream: each record's class is the fold of the first record of equal content."""
    table, heads = Table(), []
    for batch in batches:
        folds, classes = batch.column("fold").to_pylist(), []
        for h, text, fold in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), folds):
            entry = table.find(h, text)
            if entry == len(heads):
                heads.append(fold)
            classes.append(heads[entry])
        yield pa.RecordBatch.from_arrays([batch.column("fold"), pa.array(classes, pa.int64())], names=["fold", "class"])


def _digit(bucket: str, level: int, fan_out: int) -> str:
    return f"xxhash64({bucket}, pmod(xxhash64(h, {level}), {fan_out}))"


def divisions(sizes: DataFrame, table_bytes: int, fan_out: int) -> tuple[int, list[DataFrame]]:
    """Number of first divisions, and for each level the divisions to divide again.

    ``sizes`` has ``h`` and ``bytes``, one row per distinct hash. A division of
    a single hash is not divided: its records are one text, read as a stream.
    """
    total = sizes.agg(F.expr("coalesce(sum(bytes), 0) AS b")).first()["b"]
    parts = max(1, -(-2 * total // table_bytes))
    levels: list[DataFrame] = []
    rest = sizes.withColumn("bucket", F.expr(f"pmod(h, {parts})"))
    while True:
        heavy = rest.groupBy("bucket").agg(F.expr("sum(bytes) AS b"), F.expr("count(1) AS n"))
        heavy = written(heavy.filter(f"b > {table_bytes} AND n > 1").select("bucket"), "grace-heavy")
        if heavy.isEmpty():
            return parts, levels
        levels.append(heavy)
        rest = written(
            rest.join(hinted(heavy), "bucket", "left_semi").withColumn("bucket", F.expr(_digit("bucket", len(levels), fan_out))),
            "grace-rest",
        )


def exact_duplicates(docs: DataFrame, table_bytes: int = TABLE_BYTES, fan_out: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``: one row per document row."""
    source = docs.selectExpr(
        "CAST(doc_id AS BIGINT) AS doc_id", "coalesce(text, '') AS t", "CAST(spark_partition_id() AS BIGINT) AS part"
    ).selectExpr("doc_id", "xxhash64(t) AS h", "CAST(t AS BINARY) AS text", "part", "sha2(t, 256) AS text_sha256")
    folded = map_batches(
        source, _folded(table_bytes), "doc_id BIGINT, h BIGINT, row BIGINT, fold BIGINT, text BINARY, text_sha256 STRING"
    )
    spill = written(folded, "grace-spill")
    records = spill.filter("text IS NOT NULL").select("h", "fold", "text")
    sizes = written(records.groupBy("h").agg(F.expr("max(octet_length(text)) + 64 AS bytes")), "grace-sizes")
    parts, levels = divisions(sizes, table_bytes, fan_out)
    placed = records.withColumn("bucket", F.expr(f"pmod(h, {parts})"))
    for level, heavy in enumerate(levels, 1):
        placed = placed.join(hinted(heavy.withColumn("again", F.lit(True))), "bucket", "left").withColumn(
            "bucket", F.expr(f"CASE WHEN again THEN {_digit('bucket', level, fan_out)} ELSE bucket END")
        ).drop("again")
    classes = written(placed.groupBy("bucket").applyInArrow(_classes, "fold BIGINT, class BIGINT"), "grace-classes")
    # From here on only numbers move: folds by class, then rows by fold.
    folds = spill.groupBy("fold").agg(F.expr("max(struct(doc_id, -row AS back)) AS top"), F.expr("count(1) AS n"))
    folds = folds.join(classes, "fold")
    groups = folds.groupBy("class").agg(F.expr("max(top) AS top"), F.expr("sum(n) AS group_size"))
    named = folds.select("fold", "class").join(groups, "class").select("fold", "top", "group_size")
    return spill.select("doc_id", "row", "fold", "text_sha256").join(named, "fold").selectExpr(
        "doc_id", "top.doc_id AS keep_id", "group_size", "row = -top.back AS kept", "text_sha256"
    )
