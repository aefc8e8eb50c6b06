"""Whole texts in pieces: token ids as the library gives them, n-grams of long texts, positions of repeated rows."""

from __future__ import annotations

import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_exact import ODD, docs_of, words
from tilewright.llm import catalog, language, token_frames
from tilewright.llm.language import codes, identified, learn, ranked, tallied
from tilewright.llm.mixture import by_position, in_training_order, mixed
from tilewright.llm.token_frames import Encoder

ALPHABET = list("abzABZ019 \n\t.,;:!?'\"()-_") + ["İ", "ı", "Σ", "ς", "ß", "é", "é", "́", "̇", "क़", "क", "़", "中", "文", "ﬁ", "Ⅷ", "ʼ", "ـ", " ", " ", "'s", "'LL", "가", "가", "😀", "Å", "K", "²", "‍", "ͅ"]


def ids(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(4))
def test_ids_equal_the_library(seed):
    encoder, rng = Encoder(catalog.tokenizer_path()), random.Random(seed)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(14))) for _ in range(25_000)]
    for at in range(0, len(texts), 500):
        part = texts[at : at + 500]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_all(part)]
        want = [e.ids for e in encoder.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        assert got == want, next((t, g, w) for t, g, w in zip(part, got, want) if g != w)


def test_ids_of_named_cases():
    encoder = Encoder(catalog.tokenizer_path())
    for text in ["DEMİRCİ.", "BELEDİYESİ,", "İstanbul'S", "İ." * 40, "O'neil's, it's!", "á, b", "क़, x", "", " ", "\n\n", *[t for t in ODD if t]]:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(encoder, text), text


def test_long_texts_are_cut_at_blanks(monkeypatch):
    encoder, rng = Encoder(catalog.tokenizer_path()), random.Random(9)
    text = words(rng, 200_000) + "\n" + "x" * 400_000 + "! " + words(rng, 5)
    assert len(text) > 1_000_000
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(encoder, text)
    monkeypatch.setattr(token_frames, "PIECE", 7)
    for _ in range(200):
        text = "".join(rng.choices(ALPHABET, k=60))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == ids(encoder, text)


def test_other_tokenizers_are_refused():
    own = Path(catalog.tokenizer_path())
    # Byte-level tokenizers join blanks to words.
    others = [p for p in sorted(own.parent.glob("*.json")) if p != own and '"ByteLevel"' in p.read_text() and '"</w>"' not in p.read_text()]
    assert others
    with pytest.raises(ValueError):
        Encoder(str(others[0]))


def plain_ranks(text, size):
    """Rank order by counting substrings."""
    import re

    cleaned = re.sub(r"[\W\d_]+", " ", f" {text.lower()} ")
    count = Counter(cleaned[i : i + n] for n in (1, 2, 3) for i in range(len(cleaned) - n + 1))
    del count[" "]
    # Equal counts by order, then code points.
    return sorted(count, key=lambda g: (-count[g], len(g), [ord(c) for c in g]))[:size]


@pytest.mark.parametrize("stretch", [1 << 18, 5, 1])
def test_ranks_whatever_the_stretch(monkeypatch, stretch):
    monkeypatch.setattr(language, "STRETCH", stretch)
    rng = random.Random(stretch)
    for _ in range(30):
        text = "".join(rng.choices("abcABÉ 1.é中", k=rng.randrange(1, 200))) + "a"
        want = plain_ranks(text, 300)
        packed = [sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g)) for g in want]
        got = ranked(text).tolist()
        assert Counter(got) == Counter(packed)
        values, counts = tallied(codes(text))
        held = dict(zip(values.tolist(), counts.tolist()))
        assert [held[g] for g in got] == sorted((held[g] for g in got), reverse=True)


def out_of_place(text, profiles, size):
    """Language and score by the definition."""
    own = ranked(text, size).tolist()
    far = {}
    for name, grams in profiles.items():
        place = {g: i for i, g in enumerate(grams.tolist())}
        far[name] = sum(min(size, abs(place[g] - i)) if g in place else size for i, g in enumerate(own))
    best = min(far, key=lambda name: (far[name], name))
    return best, 1 - far[best] / (size * len(own))


def test_language_brute_force(spark, sf):
    docs = catalog.table(spark, sf, "documents")
    profiles = learn(docs, size=60)
    odd = docs_of(spark, [*ODD, "x" * 1_200_000, "wort und satz " * 90_000]).withColumn("lang_pred", F.lit("old")).withColumn("score", F.lit(9))
    for table, n in ((docs.select("doc_id", "text"), 200), (odd, len(ODD) + 2)):
        rows = identified(table, profiles, size=60).collect()
        assert len(rows) == n
        for r in rows:
            if not r["text"] or not any(c.isalpha() for c in r["text"]):
                assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            else:
                want = out_of_place(r["text"], profiles, 60)
                assert r["lang_pred"] == want[0] and r["score"] == pytest.approx(want[1], abs=1e-12)


def test_language_of_empty_tables(spark):
    none = docs_of(spark, [])
    assert learn(none) == {} and identified(none, {}).count() == 0
    assert identified(docs_of(spark, ["a word"]), {}).first()["lang_pred"] == "und"


def test_repeated_rows_share_positions(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(0, 30)) for _ in range(80)] + ["same words here"] * 3 + ["same words here", None, None, ""]
    keys = [*range(80), 7, 7, 7, 8, 9, 9, None]
    docs = docs_of(spark, texts, keys, [rng.choice("abc") for _ in texts]).withColumn("train_at", F.lit("old"))
    mix = mixed(docs)
    plan = by_position(mix).collect()
    assert len(plan) == len(texts)
    assert all((r["train_at"] is None) == (not r["times"]) and (not r["times"] or r["train_at"] == r["times"][0]) for r in plan)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, t) for r in plan for t in r["times"])
    got = in_training_order(docs, mix).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["train_at"]) for r in got) == want
    assert [r["train_at"] for r in got] == sorted(r["train_at"] for r in got) and all(0 <= r["train_at"] <= 1 for r in got)
    assert in_training_order(docs.limit(0), mixed(docs.limit(0))).count() == 0
