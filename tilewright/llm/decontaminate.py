"""Benchmark decontamination by winnowing.

Items and documents are cut into words. From every window of consecutive
k-gram hashes the smallest (the rightmost of equals) is kept, so a run of
``span`` equal words always keeps the same k-gram on both sides. Kept hashes
are joined, and each hit is extended along its diagonal (document position
minus item position) to the maximal run of equal words; runs of ``span`` words
or more count.

Items of fewer words than ``span`` match as a whole. Each such length is a
class of its own with k = span = length, for which winnowing keeps every gram.

Nulls and texts without words have no hits. Rows that repeat a ``doc_id`` are
judged row by row. Repeated item ids count once in ``item_ids``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import BROADCAST_ROWS, hinted, map_batches, on_id, written
from tilewright.llm.words import gram_hashes, merge_spans, mix, runs_of, sliding_min, word_hashes

SPAN = 13
GRAM = 5


def winnow(words: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps."""
    hashes = gram_hashes(words, gram)
    width = span - gram + 1
    lows = sliding_min(hashes, width)
    if not len(lows):
        return np.zeros(0, np.int64), hashes[:0]
    at = np.full(len(lows), -1, np.int64)
    base = np.arange(len(lows))
    for back in range(width - 1, -1, -1):
        hit = (at < 0) & (hashes[back : back + len(lows)] == lows)
        at[hit] = base[hit] + back
    at = np.unique(at)
    return at, mix(hashes[at] + np.uint64(span))


def _classes(n_words: int, lengths: tuple[int, ...], span: int, gram: int):
    """(span, gram) pairs under which a text of n_words words is fingerprinted."""
    return [(m, m) for m in lengths if m <= n_words] + ([(span, gram)] if n_words >= span else [])


def fingerprints(
    df: DataFrame, key: str, lengths: tuple[int, ...] = (), span: int = SPAN, gram: int = GRAM, own: bool = False
) -> DataFrame:
    """``key, pos, fp, n_words``: kept k-grams, and one row of pos -1 for each text.

    ``lengths`` are the short item lengths to look for. With ``own`` (items) a
    text shorter than ``span`` is fingerprinted as a whole only. The fp of a
    pos -1 row is arbitrary; it only spreads those rows over partitions.
    """

    def run(batches):
        for batch in batches:
            keys, pos, fps, sizes = [], [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text)
                if own:
                    wanted = [(span, gram)] if len(words) >= span else [(len(words), len(words))] if len(words) else []
                else:
                    wanted = _classes(len(words), lengths, span, gram)
                found = [winnow(words, *c) for c in wanted]
                pos += [np.array([-1])] + [f[0] for f in found]
                fps += [mix(np.array([zlib.crc32(repr(k).encode())], np.uint64))] + [f[1] for f in found]
                n = 1 + sum(len(f[0]) for f in found)
                keys.append((k, n))
                sizes.append((len(words), n))
            if keys:
                repeat = lambda pairs: np.repeat([x for x, _ in pairs], [n for _, n in pairs])
                ids = pa.array([k for k, _ in keys], type=batch.schema.field(0).type)
                ids = ids.take(pa.array(np.repeat(np.arange(len(keys)), [n for _, n in keys])))
                yield ids, np.concatenate(pos).astype(np.int32), np.concatenate(fps).view(np.int64), repeat(sizes)

    kind = dict(df.dtypes)[key]
    return map_batches(df.select(key, F.expr("CAST(text AS BINARY)")), run, f"{key} {kind}, pos INT, fp BIGINT, n_words BIGINT")


def _extend(batches):
    """Per document row: words, and the spans of each item along the diagonals of its hits."""
    for batch in batches:
        out = [[], [], [], []]
        ids, texts, hits = (batch.column(i).to_pylist() for i in range(3))
        for text, items in zip(texts, hits):
            words = word_hashes(text)
            spans, lows, highs = [], [], []
            for item in items:
                own = word_hashes(item["item_text"])
                need = min(item["span"], len(own))
                starts, ends = [], []
                for diag in item["diags"]:
                    a, b = max(diag, 0), min(diag + len(own), len(words))
                    if b - a < need:
                        continue
                    s, e = runs_of(words[a:b] == own[a - diag : b - diag])
                    keep = e - s >= need
                    starts.append(s[keep] + a)
                    ends.append(e[keep] + a)
                if starts and sum(map(len, starts)):
                    s, e = merge_spans(np.concatenate(starts), np.concatenate(ends))
                    lows.append(s)
                    highs.append(e)
                    spans += [{"item_ids": item["item_ids"], "start": int(x), "end": int(y)} for x, y in zip(s, e)]
            n_hit = 0
            if lows:
                s, e = merge_spans(np.concatenate(lows), np.concatenate(highs))
                n_hit = int((e - s).sum())
            for column, value in zip(out, (len(words), n_hit, spans)):
                column.append(value)
        if ids:
            yield batch.column(0), out[0], out[1], out[2]


def contamination(
    docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """``doc_id, n_words, n_hit, spans``: one row per document row.

    ``docs`` needs doc_id and text, ``items`` item_id and text. ``spans`` are
    (item_ids, start, end) in words. Documents are read once to fingerprint
    them; only those with a joined fingerprint are read again to extend hits.
    Item fingerprints are broadcast if their counted number allows it, else the
    join is shuffled.
    """
    docs = docs.select("doc_id", "text")
    # Items of equal text are one item with several ids.
    texts = items.select("item_id", "text").filter("text IS NOT NULL").groupBy("text").agg(
        F.expr("array_sort(collect_set(CAST(item_id AS STRING))) AS item_ids"), F.expr("xxhash64(text) AS item")
    )
    texts = written(texts, "bench-texts")
    marks = written(fingerprints(texts.select("item", "text"), "item", (), span, gram, own=True), "bench-marks")
    lengths = [r[0] for r in marks.filter(f"pos = -1 AND n_words > 0 AND n_words < {span}").select("n_words").distinct().collect()]
    bench = marks.filter("pos >= 0").selectExpr("fp", "item", "pos AS item_pos")

    wanted = bench.select("fp").distinct()
    rows = fingerprints(docs, "doc_id", tuple(sorted(lengths)), span, gram)
    rows = rows.join(hinted(wanted, broadcast_rows).withColumn("known", F.lit(True)), "fp", "left").filter("pos = -1 OR known")
    rows = written(rows.drop("known"), "bench-hits")

    hits = rows.filter("pos >= 0").join(hinted(bench, broadcast_rows), "fp").selectExpr("doc_id", "item", "pos - item_pos AS diag")
    pairs = hits.groupBy("doc_id", "item").agg(F.expr("collect_set(diag) AS diags"))
    pairs = pairs.join(hinted(texts.withColumnRenamed("text", "item_text"), broadcast_rows // 100), "item")
    by_doc = pairs.groupBy("doc_id").agg(
        F.expr(f"collect_list(struct(CAST(item_text AS BINARY) AS item_text, item_ids, diags, {span} AS span)) AS hits")
    )
    by_doc = written(by_doc, "bench-pairs")
    touched = by_doc.select("doc_id")
    found = docs.selectExpr("doc_id", "CAST(text AS BINARY) AS text")
    found = on_id(found, hinted(by_doc, broadcast_rows // 20), "doc_id")
    kind = dict(docs.dtypes)["doc_id"]
    extended = map_batches(
        found.select("doc_id", "text", "hits"), _extend,
        f"doc_id {kind}, n_words BIGINT, n_hit BIGINT, spans ARRAY<STRUCT<item_ids: ARRAY<STRING>, start: BIGINT, end: BIGINT>>",
    )
    clean = on_id(rows.filter("pos = -1"), hinted(touched, broadcast_rows), "doc_id", "left_anti").selectExpr(
        "doc_id", "n_words", "CAST(0 AS BIGINT) AS n_hit",
        "CAST(array() AS ARRAY<STRUCT<item_ids: ARRAY<STRING>, start: BIGINT, end: BIGINT>>) AS spans",
    )
    return extended.unionByName(clean)


def judged(found: DataFrame, one_in: int = 20) -> DataFrame:
    """Adds the items of each document, their digest, and whether 1 word in ``one_in`` or more was hit."""
    return found.withColumn("item_ids", F.expr("array_sort(array_distinct(flatten(transform(spans, s -> s.item_ids))))")).selectExpr(
        "doc_id", "n_words", "n_hit", "CAST(size(item_ids) AS BIGINT) AS n_items",
        "sha2(array_join(item_ids, ','), 256) AS items_sha256",
        f"(n_hit > 0 AND {one_in} * n_hit >= n_words) AS contaminated", "item_ids",
    )
