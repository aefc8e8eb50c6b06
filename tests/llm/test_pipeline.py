"""Pipeline stages: what their decisions depend on, and rows that share an id."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_exact import DOCS, docs_of, words
from tilewright.llm import catalog
from tilewright.llm.dart_minhash import expanded, near_classes
from tilewright.llm.words import word_hashes

FRENCH = "le chat dort sur la table et le chien mange dans la cuisine avec des enfants"
GERMAN = "der hund schläft unter dem tisch und die katze frisst in der küche mit den kindern"


def test_language_stage_follows_the_profiles(spark, sf):
    texts = [FRENCH, FRENCH + " encore", GERMAN, GERMAN + " noch", None, "", "12 34", "中文字符測試文件內容" * 5, "кот спит на столе и собака ест на кухне"]
    langs = ["fr", "fr", "de", "de", "de", None, None, None, None]
    rows = [(i, t, lang, "s", 0, "k", "n", 1) for i, (t, lang) in enumerate(zip(texts, langs))]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("own"))
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 3]
    assert {r["score"] for r in kept.collect()} == {"own"}
    only = corpus_pipeline.language(spark, docs, sf, wanted=("de",))
    assert sorted(r["doc_id"] for r in only.collect()) == [2, 3]


def test_rows_that_share_an_id_are_not_lost(spark, sf):
    rng = random.Random(2)
    texts = [words(rng, 40) for _ in range(6)]
    ids = [1, 1, 1, 2, None, None]
    # An exact copy under another id, a repeated row, a near copy without an id.
    texts += [texts[1], texts[3], texts[0] + " tail", None, None, ""]
    ids += [9, 2, None, None, 1, 1]
    kept = corpus_pipeline.near_duplicates(spark, docs_of(spark, texts, ids), sf).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in kept), key=str)
    want = {(9, texts[1]), (2, texts[3]), (1, texts[2]), (None, texts[4]), (None, texts[5]), (None, None), (1, None), (1, "")}
    left = {(r["doc_id"], r["text"]) for r in kept}
    # Of the near copies under doc_id 1 and none, one is left.
    assert want <= left and len(left - want) == 1 and (left - want) <= {(1, texts[0]), (None, texts[8])}
    assert len(got) == len(left) == 9


def test_contaminated_rows_go_one_by_one(spark, sf):
    item = catalog.table(spark, sf, "benchmark").filter("text IS NOT NULL").orderBy("item_id").first()["text"]
    clean = words(random.Random(1), 50)
    kept = corpus_pipeline.decontaminated(spark, docs_of(spark, [item, clean, item, None], [5, 5, None, None]), sf).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept if r["text"]) == [("5", clean)] and len(kept) == 2


def test_stages_of_empty_tables(spark, sf):
    docs = docs_of(spark, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, sf)
        assert found.columns == docs.columns and found.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == 0


def test_weighted_links_against_all_pairs(spark):
    """Every two documents of weighted similarity 0.8 or more are in one class, on the whole table."""
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], expanded(word_hashes((r["text"] or "").encode()), 5, True)) for r in catalog.table(spark, sf, "documents").collect()]
    docs = [(i, e) for i, e in docs if len(e)]
    classes = {r["doc_id"]: r["class_id"] for r in catalog.op8_dart_minhash(spark, sf).collect()}
    linked, found = 0, 0
    by_size = sorted(docs, key=lambda d: len(d[1]))
    for k, (i, a) in enumerate(by_size):
        for j, b in by_size[k + 1 :]:
            if len(b) * 0.8 > len(a):
                break
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both >= 0.8 * (len(a) + len(b) - both):
                linked += 1
                found += classes[i] == classes[j]
    assert linked > 50 and found >= 0.99 * linked
    members = {}
    for i, e in docs:
        members.setdefault(classes[i], []).append(e)
    # Nothing is classed without a link: every member of a class has a partner at the threshold.
    for own in members.values():
        for n, a in enumerate(own):
            assert len(own) == 1 or any(
                (both := len(np.intersect1d(a, b, assume_unique=True))) >= 0.8 * (len(a) + len(b) - both) - 1e-6 for m, b in enumerate(own) if m != n
            )


def test_classes_by_count_differ_from_those_by_set(spark):
    once = " ".join(f"w{i}" for i in range(30))
    docs = docs_of(spark, [once, once + " " + " ".join(once.split()[:25])])
    assert {r["class_id"] for r in near_classes(docs).collect()} == {0}
    assert {r["class_id"] for r in near_classes(docs, by_count=True).collect()} == {0, 1}
