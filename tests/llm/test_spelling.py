"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_exact import ODD, docs_of
from tilewright.llm import spelling
from tilewright.llm.spelling import Pairs, class_counts, group_counts, search, variants

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(x, y):
    if x == y or abs(len(x) - len(y)) > 1:
        return False
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    x, y = sorted((x, y), key=len)
    return any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def expected(ids, texts):
    count = Counter()
    for i, t in zip(ids, texts):
        for run in RUN.findall(t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= 7
    n = {w: c for w, c in count.items() if c >= 2}
    rows, forms = {}, {}
    for w in n:
        found = [v for v in n if near(v, w)]
        top = min(found, key=lambda v: (-n[v], v), default=None)
        if top and n[top] >= 10 * n[w]:
            forms[w] = top
        rows[w] = [forms.get(w), None, n[w], len(found), n[forms[w]] if w in forms else None]
    for w in rows:
        root = w
        while root in forms:
            root = forms[root]
        rows[w][1] = root
    return {w: tuple(r) for w, r in rows.items()}


def outcome(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = df.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def edited(rng, word, letters):
    at, how = rng.randrange(len(word)), rng.randrange(3)
    return word[:at] + ("" if how == 0 else rng.choice(letters)) + word[at + (how < 2) :]


def a_vocabulary(rng, size, letters="abcdeÀéÿ", lengths=(6, 9)):
    out = {"".join(rng.choice(letters) for _ in range(rng.randrange(*lengths))) for _ in range(size)}
    while len(out) < 3 * size:
        out.add(edited(rng, rng.choice(sorted(out)), letters))
    return sorted(out)


def test_search_follows_budgets():
    rng = np.random.default_rng(2)
    for _ in range(20):
        home, visitors = (rng.integers(0, 3, (int(rng.integers(1, 300)), 4)) for _ in range(2))
        more, less = (rng.integers(0, 2, len(visitors)) for _ in range(2))
        away = home[:, None] - visitors[None]
        fits = (np.maximum(away, 0).sum(axis=2) <= more) & (np.maximum(-away, 0).sum(axis=2) <= less)
        got = [p for a, b in search(home, visitors, more, less) for p in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == set(zip(*map(np.ndarray.tolist, np.nonzero(fits))))


def test_verified():
    rng = random.Random(3)
    words = [w for w in a_vocabulary(rng, 120, "abc", (1, 20)) if w] + ["x" * 70, "x" * 71, "x" * 69 + "y", "z" * 2000, "z" * 2001]
    a, b = (x.ravel() for x in np.indices((len(words), len(words))))
    keep = a != b
    a, b = a[keep], b[keep]
    good = Pairs(words, words).verified(a, b)
    assert len(good) == len(set(good.tolist()))
    assert set(good.tolist()) == {k for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())) if near(words[i], words[j])}
    assert group_counts(words).sum(axis=1).tolist() == class_counts(group_counts(words)).sum(axis=1).tolist() == [len(w) for w in words]
    wide = ["中文字", "中文字字", "中字文", "ab"]
    assert Pairs(wide, wide).verified(np.array([0, 0, 3]), np.array([1, 2, 0])).tolist() == [0]


@pytest.mark.parametrize("cell", [20_000, 7])
def test_variants_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(spelling, "CELL_WORDS", cell)
    monkeypatch.setattr(spelling, "_SMALL", 16)
    rng = random.Random(cell)
    vocabulary = a_vocabulary(rng, 150)
    weights = [10 ** rng.uniform(0, 3) for _ in vocabulary]
    texts = [" ".join(x.upper() if rng.random() < 0.1 else x for x in rng.choices(vocabulary, weights, k=rng.randrange(200))) for _ in range(120)]
    # A chain of forms, each ten times as usual as the one before, and a tie.
    texts += [f"{'aaaaaaab ' * 2}{'aaaaaabb ' * 25}{'aaaaabbb ' * 400}{'aaaabbbb ' * 6000}", "zzzzzzza " * 100 + "zzzzzzzb " * 100 + "zzzzzzzc " * 3]
    texts += [*ODD, *ODD, "l'été--ÉTÉÉTÉÉ étéétéé straßenbahn straßenbahm" * 3]
    ids = [*range(len(texts) - 2), 5, None]
    got, want = outcome(variants(docs_of(spark, texts, ids))), expected(ids, texts)
    assert got == want
    assert sum(r[0] is not None for r in want.values()) > 5 and any(r[0] != r[1] and r[0] for r in want.values())


def test_anagrams_meet_in_cells(spark, monkeypatch):
    monkeypatch.setattr(spelling, "CELL_WORDS", 50)
    rng = random.Random(9)
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(400)} | {"".join(rng.sample("abcdefgi", 8)) for _ in range(200)}
    texts = [" ".join(words)] * 4
    assert outcome(variants(docs_of(spark, texts))) == expected(range(4), texts)


def test_very_long_text_and_word(spark):
    rng = random.Random(10)
    texts = [" ".join(rng.choices(a_vocabulary(rng, 60), k=150_000)), "q" * 1_300_000, "q" * 1_300_000, "q" * 1_300_001 + " " + "q" * 1_300_001]
    got = outcome(variants(docs_of(spark, texts)))
    want = expected([0], texts[:1])
    assert {w: r for w, r in got.items() if len(w) < 100} == want
    long = Counter()
    for i in (1, 2, 3):
        h = zlib.crc32(f"{i}:{RUN.findall(texts[i])[0]}".encode())
        long[len(RUN.findall(texts[i])[0]) - (h % 31 == 0)] += len(RUN.findall(texts[i]))
    assert {len(w): r[2] for w, r in got.items() if len(w) > 100} == {k: c for k, c in long.items() if c >= 2}


def test_empty_tables(spark):
    assert outcome(variants(docs_of(spark, []))) == {}
    assert outcome(variants(docs_of(spark, [None, "", "word word"]))) == {}
    with pytest.raises(ValueError):
        variants(docs_of(spark, []), ratio=1)
