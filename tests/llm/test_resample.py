"""Importance resampling against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from tests.llm.test_exact import ODD, docs_of, words
from tilewright.llm import resample
from tilewright.llm.resample import WordDictionary, drawn, features, joined_crc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected(ids, texts, targets, buckets=10_000, percent=5, least=20):
    counts = [[0] * buckets for _ in range(2)]
    of = lambda g: zlib.crc32(g.encode()) % buckets
    for held, table in zip(counts, (texts, targets)):
        for t in table:
            for g in grams(t)[1]:
                held[of(g)] += 1
    (s, t), (total_s, total_t) = counts, map(sum, counts)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in zip(ids, texts):
        n, found = grams(text)
        weight = sum(gain[of(g)] for g in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    entitled = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn_rows = entitled[: percent * len(entitled) // 100]
    place = {id(r): k for k, r in enumerate(drawn_rows, 1)}
    return sorted((tuple(r) + (place.get(id(r)),) for r in rows), key=str)


def outcome(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_joined_crc():
    rng = random.Random(3)
    a, b = ([rng.randbytes(rng.randrange(0, top)) for _ in range(200)] for top in (30, 700))
    got = joined_crc(np.array(list(map(zlib.crc32, a)), np.uint32), np.array(list(map(zlib.crc32, b)), np.uint32), np.array(list(map(len, b))))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b)]


@pytest.mark.parametrize("block, step, most", [(1 << 20, 1 << 19, 100_000), (37, 5, 20), (1, 1, 0)])
def test_features_whatever_the_pieces(monkeypatch, block, step, most):
    monkeypatch.setattr(resample, "BLOCK", block)
    monkeypatch.setattr(resample, "STEP", step)
    rng = random.Random(4)
    texts = [words(rng, rng.randrange(0, 60), 30) for _ in range(60)] + [t or "" for t in ODD] + ["Éa ÉA-éa b 1x", "ab cd"]
    dictionary = WordDictionary(most)
    for _ in range(12):
        for group in resample._blocks(t.encode() for t in texts):
            counts, chunks = features(group, dictionary)
            found = [[] for _ in group]
            for bucket, owner in chunks:
                for b, o in zip(bucket.tolist(), owner.tolist()):
                    found[o].append(b)
            for text, n, own in zip(group, counts.tolist(), found):
                want_n, want = grams(text.decode())
                assert n == want_n and sorted(own) == sorted(zlib.crc32(g.encode()) % 10_000 for g in want)
        dictionary.fresh = {**dictionary.fresh, **{f"pad{i}".encode(): zlib.crc32(f"pad{i}".encode()) for i in range(600)}}
    assert bool(dictionary.built) == bool(most)


def test_drawn_brute_force(spark):
    rng = random.Random(5)
    targets = [words(rng, 40, 300) for _ in range(10)] + [None, ""]
    texts = [words(rng, rng.randrange(0, 90), 900) + " " + rng.choice(targets[:10]) * rng.randrange(2) for _ in range(300)] + ODD
    texts += [texts[0], texts[0]]
    ids = [*range(len(texts) - 2), 0, None]
    target = spark.createDataFrame([(t, i) for i, t in enumerate(targets)], "text STRING, item_id BIGINT")
    assert outcome(drawn(docs_of(spark, texts, ids), target)) == expected(ids, texts, targets)
    assert outcome(drawn(docs_of(spark, texts, ids), target, buckets=50, percent=40)) == expected(ids, texts, targets, 50, 40)


def test_very_long_text(spark):
    rng = random.Random(6)
    texts = [words(rng, 400_000, 5000), "x" * 1_500_000 + " y", "short text"]
    got = outcome(drawn(docs_of(spark, texts), spark.createDataFrame([(texts[2],)], "text STRING"), percent=50))
    assert got == expected(range(3), texts, [texts[2]], percent=50)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text STRING")
    assert drawn(docs_of(spark, []), none).count() == 0
    texts = ["a b c", None]
    assert outcome(drawn(docs_of(spark, texts), none)) == expected(range(2), texts, [])
