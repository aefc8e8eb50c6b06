"""Operators whose results are fixed: brute force, round trips and odd rows."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import Counter, defaultdict

import pytest

from tests.compare import compare, duck
from tilewright.llm import catalog, oracle
from tilewright.llm.chat import (
    MAPPINGS, canonical_turns, digests, escape, fingerprint, format_conversations, paths_of, registry, unescape,
)
from tilewright.llm.decontaminate import contamination, judged
from tilewright.llm.grace_dedup import Table, exact_duplicates
from tilewright.llm.mixture import in_training_order, mixed
from tilewright.llm.suffix_dedup import Trie, common, prefix_sets, suffix_order, without_repeats
from tilewright.llm.url_rules import judged_urls

DOCS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, key STRING, node STRING, size INT"
ODD = [None, "", " ", "###", "word", "Ünï 中文 x", "\x00a\x00", "a" * 700, "na " * 900]


def docs_of(spark, texts, ids=None, sources=None):
    """Documents with extra columns whose names the operators use themselves."""
    rows = [
        ((ids or range(len(texts)))[i], t, "en", (sources or ["s"] * len(texts))[i], 0, "k", "n", 1) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_against_sql(spark, sf, name):
    assert compare(spark, sf, catalog.QUERIES[name], oracle.ORACLE[name], duck(sf))[0] is None


# ---------------------------------------------------------------- decontamination


def test_contamination_brute_force(spark):
    rng = random.Random(1)
    items = [words(rng, n) for n in (40, 13, 14, 12, 5, 1, 30)] + [None, "", "..."]
    items.append(items[0])
    texts = [*ODD]
    for i in range(60):
        a, cut = words(rng, rng.randrange(0, 80)), rng.choice(items[:7]).split()
        at = rng.randrange(len(cut))
        texts.append(f"{a} {' '.join(cut[at : at + rng.randrange(1, 45)])} {words(rng, 9)}")
    texts += [items[0].upper() + "!! " + items[0], texts[-1], texts[-1]]
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    expected = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for k, item in enumerate(items):
            b = cut(item)
            n = min(13, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
            for i in range(len(w) - n + 1 if n else 0):
                if tuple(w[i : i + n]) in wins:
                    hit.update(range(i, i + n))
                    found.add(str(k))
        expected.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id BIGINT, text STRING")
    for limit in (1_000_000, 1):
        got = judged(contamination(docs_of(spark, texts), bench, broadcast_rows=limit)).collect()
        assert {r[0]: tuple(r[1:6]) for r in got} == dict(enumerate(expected))


def test_contamination_odd_tables(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id BIGINT, text STRING")
    assert judged(contamination(docs_of(spark, []), bench)).count() == 0
    rows = docs_of(spark, ["x a b c", "x a b c", "none", "a b c"], [None, None, 7, 7])
    got = Counter((r.doc_id, r.n_hit) for r in judged(contamination(rows, bench)).collect())
    assert got == {(None, 3): 2, (7, 0): 1, (7, 3): 1}
    assert {r.n_hit for r in judged(contamination(rows, bench.limit(0))).collect()} == {0}


# ---------------------------------------------------------------- exact duplicates


@pytest.mark.parametrize("table_bytes", [32 << 20, 200])
def test_exact_duplicates(spark, table_bytes):
    rng = random.Random(2)
    texts = [*ODD, *(words(rng, 5, 3) for _ in range(300)), *["hot"] * 200]
    want = defaultdict(list)
    for i, t in enumerate(texts):
        want[t or ""].append(i)
    got = exact_duplicates(docs_of(spark, texts), table_bytes, fan_out=3).collect()
    assert len(got) == len(texts)
    for r in got:
        own = want[texts[r.doc_id] or ""]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))
        assert r.text_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_exact_duplicates_keep_one_row(spark):
    got = exact_duplicates(docs_of(spark, ["a", "a", "a", "b", "b", None], [3, 3, 1, None, None, None])).collect()
    assert sorted((r.text_sha256, r.keep_id is None, r.group_size) for r in got if r.kept) == sorted(
        (hashlib.sha256(t.encode()).hexdigest(), none, n) for t, none, n in (("a", False, 3), ("b", True, 2), ("", True, 1))
    )
    assert exact_duplicates(docs_of(spark, [])).count() == 0


def test_table_compares_content():
    table = Table(4)
    assert [table.find(5, t) for t in (b"a", b"b", b"a", b"c", b"b")] == [0, 1, 0, 2, 1]


# ---------------------------------------------------------------- suffixes


def stripped(rows, length):
    seen = Counter(t[i : i + length] for t in rows for i in range(len(t) - length + 1))
    out = []
    for t in rows:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((bytes(c for c, g in zip(t, gone) if not g), len(re.findall(b"\1+", bytes(gone)))))
    return out


@pytest.mark.parametrize("limit", [20_000, 2])
def test_repeats_brute_force(spark, limit):
    rng = random.Random(3)
    letters = lambda n, k=4: "".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    passages = [letters(n) for n in (19, 20, 21, 35, 60)]
    texts = [*ODD, "é" * 30]
    for _ in range(120):
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        texts.append(letters(rng.randrange(40)) + p[a // 2 :] + letters(rng.randrange(40)) + p[: a + 1])
    texts += [letters(40, 1), letters(300, 2), texts[30], texts[30]]
    want = stripped([(t or "").encode() for t in texts], 20)
    got = without_repeats(docs_of(spark, texts), length=20, gram=8, group_limit=limit).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (bytes(r.kept), len(r.spans)) == want[r.doc_id], (r.doc_id, texts[r.doc_id])


def test_repeats_odd_tables(spark):
    assert without_repeats(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, ["x" + "ab" * 200, "other " * 3, "x" + "ab" * 200], [None, None, None])
    assert sorted(len(r.kept) for r in without_repeats(rows).collect()) == [0, 0, 18]


def test_blind_trie_orders_suffixes():
    rng = random.Random(4)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(200)]
    listed = list(Trie(strings).ordered())
    assert [strings[i] for i, _ in listed] == sorted(strings)
    assert [d for _, d in listed[1:]] == [common(strings[i], strings[j]) for (i, _), (j, _) in zip(listed, listed[1:])]


@pytest.mark.parametrize("gram, shallow", [(0, 8), (2, 8), (2, 32)])
def test_suffix_order(gram, shallow):
    rng = random.Random(gram + shallow)
    for _ in range(60):
        strings = [b"ab"[:gram] + bytes(rng.choice([0, 97, 98, 255]) for _ in range(rng.randrange(0, rng.choice([3, 14, 50])))) for _ in range(rng.randrange(1, 40))]
        strings += strings[:3]
        order, shared = suffix_order(strings, gram, shallow)
        assert [strings[i] for i in order] == sorted(strings)
        assert shared == [0] + [common(strings[i], strings[j]) for i, j in zip(order, order[1:])]
        sets = {(d, frozenset(order[a:b])) for d, a, b in prefix_sets(shared)}
        want = set()
        for i in range(len(strings)):
            for d in range(len(strings[i]) + 1):
                own = frozenset(j for j, s in enumerate(strings) if s[:d] == strings[i][:d] and len(s) >= d)
                if len(own) > 1 and min(common(strings[x], strings[y]) for x in own for y in own if x != y) == d:
                    want.add((d, own))
        assert sets == want


# ---------------------------------------------------------------- urls


def test_url_rules_brute_force(spark):
    rng = random.Random(5)
    labels = ["a", "b", "com", "net", "x-y", ""]
    host = lambda n: ".".join(rng.choice(labels) for _ in range(n))
    rules = [(host(rng.randrange(1, 4)), rng.choice(["", "/", "/p", "/p/", "/p/q/", "/z"]), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [(None, "/", "block"), ("com", None, "block"), ("com", "/p/", "allow"), ("com", "/p/", "block")]
    urls = [f"http://{host(rng.randrange(1, 5))}{rng.choice(['', '/', '/p/q/r', '/p/', '/P/', '/z?x=/p/', '?q', '#/p/'])}" for _ in range(400)]
    urls += [None, "", "no scheme.com/p/", "://COM/p/", "x://y://a.com/p/", "http://", urls[0], urls[0]]
    verdicts = {}
    for h, p, v in rules:
        if h is not None and p is not None:
            verdicts[h, p] = "block" if "block" in (v, verdicts.get((h, p))) else v
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id BIGINT, url STRING").repartition(3)
    got = judged_urls(pages, spark.createDataFrame(rules, "host STRING, path STRING, verdict STRING")).collect()
    assert len(got) == len(urls)
    for r in got:
        rest = (r.url or "").partition("://")[2]
        h = re.match("[^/?#]*", rest)[0]
        path, h = re.match("[^?#]*", rest[len(h) :])[0], h.lower()
        fits = [(len(a) + len(b), len(a), verdicts[a, b], a + b) for a, b in verdicts if h and (h == a or h.endswith("." + a)) and path.startswith(b)]
        best = max(fits, default=None)
        assert (r.host, r.path) == (h, path)
        assert (r.rule, r.verdict) == ((best[3], best[2]) if best else (None, "allow")), r.url


def test_url_rules_stay_native(spark, sf):
    plan = catalog.op7_url_filter(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan


# ---------------------------------------------------------------- chat


def test_escapes_are_reversible():
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "|", "\\", "im_end", ">", "<|im_end|>", "x"]) for _ in range(rng.randrange(12)))
        assert unescape(escape(text)) == text and "<|" not in escape(text)


def test_fingerprints_select_mappings(spark):
    layouts = [
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"output": "o", "instruction": "i", "input": "x"}, [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": None, "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}, [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"}, [("system", "s"), ("user", "a"), ("assistant", "b")]),
        ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"role": "user", "text": "t"}, [("user", "t")]),
        ({"unheard": {"of": 1}}, [(None, "unheard.of")]),
    ]
    rows = [(i, json.dumps(record)) for i, (record, _) in enumerate(layouts)] + [(90, None), (91, "{broken"), (92, "[1]"), (93, "{}")]
    turns = canonical_turns(spark.createDataFrame(rows, "id INT, record STRING"), ["id"]).collect()
    got = defaultdict(list)
    for r in sorted(turns, key=lambda r: (r.id, r.turn_no or 0)):
        got[r.id].append((r.role, r.text))
    assert [got[i] for i in range(len(layouts))] == [want for _, want in layouts]
    assert got[90] == got[91] == got[92] == [(None, "")] and got[93] == [("", "")]
    assert fingerprint(paths_of({"b": [1, 2], "a": 1})) == fingerprint(paths_of({"a": "x", "b": ["y"]}))
    assert {m.name for m in registry().values()} == {m.name for m in MAPPINGS}


def test_conversations_round_trip(spark):
    texts = [None, "", "<|im_end|>", "a<\\\\|b<|im_start|>user\n", "ü\n\n", "x" * 5000]
    rows = [(c, t, role, text) for c in (1, 2, None) for t, (role, text) in enumerate([(r, x) for r in ("user", "assistant", None) for x in texts])]
    rows += [(1, 3, "user", "tie"), (1, 3, "user", "tie"), (5, None, "assistant", "only")]
    frame = spark.createDataFrame(rows, "conv_id BIGINT, turn BIGINT, role STRING, text STRING").repartition(3)
    got = {r.conv_id: r for r in digests(format_conversations(frame), "conv_id", ["turn", "role", "text"]).collect()}
    for conv in (1, 2, None, 5):
        own = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# ---------------------------------------------------------------- mixture


def test_mixture_meets_targets(spark):
    rng = random.Random(7)
    sources = [rng.choice(["a", "b", "hot", "hot", "hot", None]) for _ in range(3000)]
    texts = [words(rng, rng.randrange(60)) for _ in sources]
    frame = docs_of(spark, texts, None, sources)
    mix = mixed(frame).collect()
    assert len(mix) == len(texts)
    size, taken, target = Counter(), Counter(), {}
    for r in mix:
        assert r.size == len(texts[r.doc_id].split()) and r.takes <= 2 and len(r.times) == r.takes
        assert all(0 <= t <= 1 for t in r.times)
        size[r.source] += r.size
        taken[r.source] += r.size * r.takes
        target[r.source] = r.target
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6 * sum(size.values())
    assert all(abs(taken[s] - target[s]) <= 60 and target[s] <= 2 * size[s] for s in size)
    assert sorted(map(tuple, mixed(frame).collect()), key=str) == sorted(map(tuple, mix), key=str)
    ordered = in_training_order(frame, mixed(frame))
    assert Counter(r.doc_id for r in ordered.collect()) == {r.doc_id: r.takes for r in mix if r.takes}
    at = [r.train_at for r in ordered.collect()]
    assert at == sorted(at)


def test_mixture_odd_tables(spark):
    assert mixed(docs_of(spark, [])).count() == 0
    got = mixed(docs_of(spark, [None, "", "x", "x"], [1, 2, None, None], [None, "a", None, None])).collect()
    assert sorted(r.size for r in got) == [0, 0, 1, 1] and sum(r.size * r.takes for r in got) in (2, 3, 4)
    twice = docs_of(spark, ["a b", "a b", "c d"], [1, 1, 2])
    assert in_training_order(twice, mixed(twice)).count() == sum(r.takes for r in mixed(twice).collect())
