"""Importance resampling of documents towards the word runs of a target set.

Features of a text are its runs of one to three consecutive words, hashed into
``buckets`` by the CRC of their bytes. A bucket that is more usual in the
target than in the documents gains, and the gains of a document's features add
up to its weight; the Gumbel trick then draws without replacement.

No run is ever put together as text. An Aho-Corasick dictionary holds distinct
words between delimiters, each carrying the CRC and the length of its bytes. A
scan of the text emits these payloads in order, and the payloads of adjacent
words compose: the CRC of joined strings follows from the CRCs and lengths of
the parts, a shift over GF(2) and an exclusive or. Each task grows a dictionary
of up to ``MOST_WORDS`` words from the texts it meets. Words that it does not
hold, or that exceed ``LONGEST`` bytes, get their payload from their bytes, so
results never depend on the dictionary.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Null and
wordless texts have no features and weight 0. A null doc_id is the empty text
where an id is hashed. Repeated rows are documents of their own; rows equal in
score and doc_id take neighbouring ranks. Without documents, or without target
texts, the counts are zeros and the formulas still hold.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import map_batches, written

RUN = 3
BUCKETS = 10_000
LEAST_WORDS = 20
#: Words of a task's dictionary, and bytes of a word in it.
MOST_WORDS, LONGEST = 100_000, 48
#: Bytes of text that are scanned at a time, and words composed at a time.
BLOCK, STEP = 1 << 20, 1 << 19

_BLANK = 32
#: Every byte that is no part of a word becomes a blank; A-Z become a-z.
_SPACED = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else _BLANK for b in range(256)
)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_ONE = _crc_table()
_GAP = np.uint32(zlib.crc32(b" "))


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][(crc >> 8) & 255] ^ tables[2][(crc >> 16) & 255] ^ tables[3][crc >> 24]


def _shifts(bits: int = 40) -> list[np.ndarray]:
    """Effect on a CRC of 1, 2, 4, ... more bytes, as four tables over its bytes."""
    values = np.arange(256, dtype=np.uint32)
    spread = np.stack([values << np.uint32(8 * k) for k in range(4)])
    out = [(spread >> np.uint32(8)) ^ _ONE[spread & np.uint32(255)]]
    while len(out) < bits:
        out.append(_apply(out[-1], out[-1]))
    return out


_SHIFTS = _shifts()


def joined_crc(left: np.ndarray, right: np.ndarray, right_size: np.ndarray) -> np.ndarray:
    """CRCs of pairs of strings put together, from the CRCs of both and the size of the second."""
    out = left.copy()
    for bit in range(int(right_size.max(initial=0)).bit_length()):
        at = np.flatnonzero((right_size >> bit) & 1)
        out[at] = _apply(_SHIFTS[bit], out[at])
    return out ^ right


class WordDictionary:
    """Words between blanks, found by an automaton that emits their payloads.

    A word enters the automaton once it was met twice.
    """

    def __init__(self, most: int = MOST_WORDS, longest: int = LONGEST):
        import ahocorasick

        self.most, self.longest = most, longest
        self.automaton, self.built = ahocorasick.Automaton(ahocorasick.STORE_INTS), 0
        self.crc, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        #: Words outside the automaton, those of them that were met again, and their CRCs.
        self.once: dict[bytes, int] = {}
        self.fresh: dict[bytes, int] = {}

    def _settle(self) -> None:
        """Puts the words met again into the automaton once they are a fair share of it."""
        if len(self.fresh) > max(500, self.built // 4) and self.built < self.most:
            for at, word in enumerate(self.fresh, self.built):
                self.automaton.add_word(f" {word.decode()} ", at)
                self.once.pop(word, None)
            self.automaton.make_automaton()
            self.built += len(self.fresh)
            self.crc = np.concatenate([self.crc, np.array(list(self.fresh.values()), np.uint32)])
            self.size = np.concatenate([self.size, np.array([len(w) for w in self.fresh], np.int64)])
            self.fresh = {}
        if len(self.once) > 2 * self.most:
            self.once, self.fresh = {}, {}

    def _crc_of(self, word: bytes) -> int:
        value = self.once.get(word)
        if value is None:
            value = zlib.crc32(word)
            if len(word) <= self.longest:
                self.once[word] = value
        else:
            self.fresh[word] = value
        return value

    def payloads(self, spaced: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """CRC, size and first byte of every word of a text of words and blanks."""
        data = np.frombuffer(spaced, np.uint8)
        edges = np.diff((data != _BLANK).astype(np.int8), prepend=0, append=0)
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        size = ends - starts
        self._settle()
        crc = np.zeros(len(starts), np.uint32)
        rest = np.arange(len(starts))
        if self.built and len(starts):
            found = chain.from_iterable(self.automaton.iter(f" {spaced.decode()} "))
            hits = np.fromiter(found, np.int64).reshape(-1, 2)
            # The automaton counts characters; a match ends on the blank behind its word.
            last = np.cumsum((data & 0xC0) != 0x80)[ends - 1]
            at = np.searchsorted(last, hits[:, 0] - 1)
            if not np.array_equal(self.size[hits[:, 1]], size[at]):
                raise AssertionError("a match is not a whole word")
            crc[at] = self.crc[hits[:, 1]]
            known = np.zeros(len(starts), bool)
            known[at] = True
            rest = np.flatnonzero(~known)
        words = map(spaced.__getitem__, map(slice, starts[rest].tolist(), ends[rest].tolist()))
        crc[rest] = np.fromiter(map(self._crc_of, words), np.uint32, len(rest))
        return crc, size, starts


def _pieces(spaced: bytes) -> Iterator[bytes]:
    """The text in pieces of about BLOCK bytes that end at blanks."""
    at = 0
    while at < len(spaced):
        end = at + BLOCK
        if end < len(spaced):
            cut = spaced.rfind(b" ", at, end)
            if cut < 0:
                cut = spaced.find(b" ", end)
            end = len(spaced) if cut < 0 else cut + 1
        yield spaced[at:end]
        at = end


def _blocks(texts: Iterator[bytes | None]) -> Iterator[list[bytes]]:
    """Spaced texts, together about BLOCK bytes unless one alone has more."""
    held, size = [], 0
    for text in texts:
        held.append((text or b"").translate(_SPACED))
        size += len(held[-1]) + 1
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def features(block: list[bytes], words: WordDictionary, buckets: int = BUCKETS, run: int = RUN):
    """Words of each text, then chunks of (bucket, number of the text) over all its runs."""
    together = b" ".join(block)
    parts, base = [], 0
    for piece in _pieces(together):
        crc, size, starts = words.payloads(piece)
        parts.append((crc, size, starts + base))
        base += len(piece)
    crc, size, starts = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    ends = np.cumsum([len(t) + 1 for t in block])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    owner = np.repeat(np.arange(len(block)), counts)

    def chunks():
        for at in range(0, len(crc), STEP):
            word, length, whose = (x[at : at + STEP + run - 1] for x in (crc, size, owner))
            grams, first = word, min(STEP, len(crc) - at)
            yield (grams[:first] % buckets).astype(np.int64), whose[:first]
            for n in range(2, run + 1):
                if len(grams) < 2:
                    break
                spaced = _apply(_SHIFTS[0], grams[:-1]) ^ _GAP
                grams = joined_crc(spaced, word[n - 1 :], length[n - 1 :])
                keep = np.flatnonzero(whose[: len(grams)][:first] == whose[n - 1 :][:first])
                yield (grams[keep] % buckets).astype(np.int64), whose[keep]

    return counts, chunks()


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    """One text after another, so that a batch is never held as Python objects."""
    binary = column.cast(pa.large_binary())
    for i in range(len(binary)):
        yield binary[i].as_py()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """``bucket, n``: features of all texts per bucket, added up inside tasks first."""

    def count(batches):
        words, total = WordDictionary(), np.zeros(buckets, np.int64)
        for batch in batches:
            for block in _blocks(_texts(batch.column(0))):
                for bucket, _ in features(block, words, buckets, run)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        yield held, total[held]

    found = map_batches(docs.select("text"), count, "bucket BIGINT, n BIGINT")
    return found.groupBy("bucket").agg(F.expr("sum(n) AS n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """Per bucket, 1000 times the log of how much likelier the target holds it, rounded down.

    Two numbers per bucket reach the driver, whatever the tables' sizes.
    """
    raw, wanted = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for held, table in ((raw, docs), (wanted, target)):
        for row in bucket_counts(table, buckets, run).collect():
            held[row["bucket"]] = row["n"]
    total_raw, total_wanted = int(raw.sum()), int(wanted.sum())
    return np.array(
        [
            math.floor(1000 * math.log(float((t + 1) * (total_raw + buckets)) / float((s + 1) * (total_wanted + buckets))))
            for s, t in zip(raw.tolist(), wanted.tolist())
        ],
        np.int64,
    )


def weighed(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every document."""

    def weigh(batches):
        words = WordDictionary()
        for batch in batches:
            at = 0
            for block in _blocks(_texts(batch.column(1))):
                counts, chunks = features(block, words, len(gain), run)
                weight = np.zeros(len(block), np.int64)
                for bucket, whose in chunks:
                    weight += np.bincount(whose, weights=gain[bucket], minlength=len(block)).astype(np.int64)
                number = sum(np.maximum(counts - n, 0) for n in range(run))
                yield batch.column(0).slice(at, len(block)), counts, number, weight
                at += len(block)

    narrow = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return map_batches(narrow, weigh, "doc_id BIGINT, n_words BIGINT, n_features BIGINT, weight BIGINT")


def drawn(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = LEAST_WORDS, seed: int = 42,
    buckets: int = BUCKETS, run: int = RUN,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document row.

    ``percent`` of the documents with at least ``least_words`` words are drawn,
    those of the highest scores, ties to the smaller doc_id (nulls last); the
    others have a null rank. Candidates are range-sorted by score, numbered
    inside their range and shifted by the sizes of the ranges before it.
    """
    uniform = f"(CAST(conv(substring(sha2(concat('{seed}:', coalesce(CAST(doc_id AS STRING), '')), 256), 1, 8), 16, 10) AS DOUBLE) + 0.5D) / 4294967296D"
    scored = weighed(docs, gains(docs, target, buckets, run), run).withColumn(
        "score", F.expr(f"weight + CAST(floor(-1000D * ln(-ln({uniform}))) AS BIGINT)")
    )
    # The range exchange samples its input, which would weigh all texts once more.
    scored = written(scored, "resample-weights")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranges = scored.repartitionByRange(*order).withColumn("place", F.spark_partition_id())
    ranges = written(ranges.withColumn("entitled", F.expr(f"n_words >= {least_words}")), "resample-scores")
    sizes = ranges.filter("entitled").groupBy("place").agg(F.expr("count(1) AS n"))
    # One row per range partition.
    before = sizes.selectExpr(
        "place AS at", f"sum(n) OVER () * {percent} DIV 100 AS draws",
        "coalesce(sum(n) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift",
    )
    inside = "row_number() OVER (PARTITION BY place, entitled ORDER BY score DESC, doc_id ASC NULLS LAST)"
    numbered = ranges.withColumn("inside", F.expr(inside)).join(F.broadcast(before), F.expr("place = at"), "left")
    rank = "CASE WHEN entitled AND shift + inside <= draws THEN CAST(shift + inside AS BIGINT) END AS rank"
    return numbered.selectExpr("doc_id", "n_words", "n_features", "weight", "score", rank)
