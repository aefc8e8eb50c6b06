"""Empty tables, clashing names, repeated labels, and the classifier against plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_exact import ODD, docs_of, words
from tilewright.llm import grace_dedup, toxicity
from tilewright.llm.chat import digests, format_conversations
from tilewright.llm.grace_dedup import Table, exact_duplicates
from tilewright.llm.url_rules import judged_urls

RULES = "host STRING, path STRING, verdict STRING"


def test_urls_keep_columns_of_any_name(spark):
    names = ["prefix", "best", "_rest", "_host", "_prefix", "key", "part", "_row", "rule", "host"]
    urls = spark.createDataFrame([("http://a.com/x/", 1), ("http://b.org", 2), (None, 3)], "url STRING, page_id INT")
    for name in names:
        urls = urls.withColumn(name, F.lit(f"own {name}"))
    rules = spark.createDataFrame([("com", "/x/", "block")], RULES)
    got = {r["page_id"]: r.asDict() for r in judged_urls(urls, rules).collect()}
    assert {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()} == {
        1: ("a.com", "/x/", "com/x/", "block"), 2: ("b.org", "", None, "allow"), 3: ("", "", None, "allow"),
    }
    assert all(r[n] == f"own {n}" for r in got.values() for n in names if n not in ("rule", "host"))


def test_empty_url_and_rule_tables(spark):
    urls, rules = spark.createDataFrame([("http://a.com/x/",)], "url STRING"), spark.createDataFrame([("com", "/x/", "block")], RULES)
    assert judged_urls(urls.limit(0), rules).count() == 0
    assert judged_urls(urls.limit(0), rules.limit(0)).count() == 0
    assert [r["verdict"] for r in judged_urls(urls, rules.limit(0), "block").collect()] == ["block"]


def test_chat_of_empty_tables(spark):
    rows = spark.createDataFrame([], "conv_id BIGINT, turn BIGINT, role STRING, text STRING")
    assert digests(format_conversations(rows), "conv_id", ["turn", "role", "text"]).count() == 0


def test_table_counts_entries():
    table = Table()
    for i in range(1000):
        table.find(i, b"")
    assert table.size == 1000 * grace_dedup.ENTRY_BYTES


def test_dedup_of_long_texts_in_small_tables(spark):
    rng = random.Random(1)
    long = words(rng, 200_000)
    texts = [long, long, long + "x", *ODD, *ODD, *[str(i % 50) for i in range(400)]]
    assert len(long) > 1 << 20
    got = {r["doc_id"]: r for r in exact_duplicates(docs_of(spark, texts), table_bytes=5_000).collect()}
    last = {t or "": i for i, t in enumerate(texts)}
    assert {i: r["keep_id"] for i, r in got.items()} == {i: last[t or ""] for i, t in enumerate(texts)}


def forward(model, text):
    """Score by plain loops over words, widths and filters."""
    ids = toxicity.bucketed(text)
    n = max(1, len(ids))
    padded = np.zeros((n + max(toxicity.WIDTHS) - 1, toxicity.ROWS), int)
    padded[: len(ids)] = ids
    embedded = np.array([sum(model.rows[r].astype(float) for r in row) for row in padded])
    hidden = []
    for weights in model.filters:
        for f in range(weights.shape[2]):
            hidden.append(max(sum(float(embedded[at + o] @ weights[o, :, f]) for o in range(weights.shape[0])) for at in range(n)))
    z = sum(max(h + b, 0) * o for h, b, o in zip(hidden, model.bias, model.out)) + model.constant
    spoken = 0
    if model.words.shape[1] > 1:
        spoken = int(np.argmax([sum(float(model.words[i, k]) for i in ids[:, 0]) for k in range(model.words.shape[1])]))
    return 1 / (1 + np.exp(-np.clip(model.scale * (z - model.shifts[spoken]), -40, 40)))


def test_classifier_against_loops(spark):
    rng = random.Random(2)
    rows = [((words(rng, rng.randrange(1, 12), 40) + (" vile idiot" if i % 2 else " kind friend")).encode(), i % 2, rng.choice(["en", "de", None])) for i in range(200)]
    model = toxicity.fit(rows, epochs=2)
    texts = [words(rng, n, 60) for n in (1, 2, 3, 7, 40)] + ODD + ["vile idiot", "kind friend"]
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs_of(spark, texts).withColumn("score", F.lit("old")), model).collect()}
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(forward(model, (text or "").encode()), abs=1e-4), text
    long = "kind friend " * 100_000 + "vile idiot"
    assert len(long) > 1 << 20
    assert 0 <= toxicity.scored(docs_of(spark, [long]), model).first()["score"] <= 1


@pytest.mark.parametrize("seed", range(5))
def test_threshold_is_the_best_cut(seed):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, 2, 60)
    labels[:2] = 0, 1
    z = np.round(rng.normal(size=60) + labels, 1 + seed % 2)
    rate = lambda cut: (labels[z > cut] == 1).sum() / labels.sum() + (labels[z <= cut] == 0).sum() / (1 - labels).sum()
    found = toxicity._threshold(z, labels)
    if len(set(z)) == len(z):
        assert rate(found) == pytest.approx(max(rate(c) for c in [z.min() - 1, *z]))


def test_labels_that_disagree_are_settled(spark):
    rng = random.Random(4)
    texts = [words(rng, 5) + (" vile" if i % 2 else " kind") for i in range(120)]
    docs = docs_of(spark, texts + texts[:3], [*range(120), 0, 1, 2])
    labels = [(i, i % 2) for i in range(120)] + [(1, 0), (3, 0), (0, None), (None, 1)]
    one, two = (
        toxicity.learn(docs, spark.createDataFrame(rows, "doc_id BIGINT, toxic INT").repartition(n), epochs=1)
        for rows, n in ((labels, 1), (labels[::-1], 5))
    )
    plain = toxicity.learn(docs_of(spark, texts), spark.createDataFrame(labels[:120], "doc_id BIGINT, toxic INT"), epochs=1)
    for other in (two, plain):
        assert np.array_equal(one.rows, other.rows) and np.array_equal(one.out, other.out)


def test_all_labelled_rows_teach(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["sun", "tree", "road", "milk", "gold"], 9)) + (" vile" if i % 4 == 0 else "") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id BIGINT, toxic INT")
    whole = toxicity.learn(docs_of(spark, texts), labels, epochs=3)
    alone = toxicity.fit([(texts[i].encode(), int(i % 4 == 0), None) for i in sorted(range(400), key=str)], epochs=3)
    unseen = [toxicity.bucketed(t) for t in (b"sun gold milk", b"milk vile road", b"")]
    assert np.allclose(toxicity.scores(whole, unseen), toxicity.scores(alone, unseen), atol=1e-5)
    shared = toxicity.learn(docs_of(spark, texts), labels, part_rows=100, epochs=3)
    assert (toxicity.scores(shared, unseen) >= 0.5).tolist() == [False, True, False]
