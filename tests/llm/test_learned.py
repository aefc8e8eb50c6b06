"""Signatures, profiles, classifier, token files and the pipeline."""

from __future__ import annotations

import io
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_exact import ODD, docs_of, words
from tilewright.llm import catalog, toxicity
from tilewright.llm.dart_minhash import near_classes, signatures, similarities
from tilewright.llm.language import _counted, codes, identified, learn, ranked
from tilewright.llm.token_frames import Encoder, FrameReader, FrameWriter, read_tokens, write_tokens
from tilewright.llm.words import distinct_parts, word_parts


# ---------------------------------------------------------------- near duplicates


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    universe = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = (rng.integers(0, 4, len(universe)) + rng.random(len(universe)) for _ in range(2))
    sig = signatures([(universe, a), (universe, b), (universe[:0], a[:0])], 2048)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 0.05 and not sig[2].any() and sig[:2].all()


def brute_classes(texts, shingle=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        k = min(shingle, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("blocks", [(1500, 400), (3, 2)])
def test_near_classes_brute_force(spark, blocks):
    rng = random.Random(2)
    texts = [None, "", "one", "one", "One", "two words"]
    for _ in range(12):
        base = words(rng, 150).split()
        for _ in range(rng.randrange(1, 14)):
            own = list(base)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(own))
    texts += [texts[20]] * 30
    rng.shuffle(texts)
    got = {r.doc_id: r for r in near_classes(docs_of(spark, texts), blocks=blocks).collect()}
    assert [got[i].class_id for i in range(len(texts))] == brute_classes(texts)
    assert all(r.kept == (r.class_id == i) for i, r in got.items())


def test_near_classes_odd_tables(spark):
    assert near_classes(docs_of(spark, [])).count() == 0
    got = near_classes(docs_of(spark, ["a b c", "a b c", "a b c", "z", "y"], [None, 4, 2, 9, 9])).collect()
    assert Counter((r.doc_id, r.class_id, r.kept) for r in got) == {(None, None, True): 1, (4, 2, False): 1, (2, 2, True): 1, (9, 9, True): 2}
    assert near_classes(docs_of(spark, ODD)).count() == len(ODD)
    assert near_classes(docs_of(spark, ["x y " * 40, "x y " * 40, "x y"]), by_count=True).filter("kept").count() == 2


def test_similarities_are_exact():
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(n)], np.int64)) for n in (1, 20, 30, 40, 40)]
    got = similarities(sets)
    for i, a in enumerate(map(set, sets)):
        for j, b in enumerate(map(set, sets)):
            assert got[i, j] == pytest.approx(len(a & b) / len(a | b))


# ---------------------------------------------------------------- language


def test_languages_are_held_out_accurate(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.op2_language(spark, sf).join(catalog.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out AND lang IS NOT NULL").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in held)


def test_language_of_odd_rows(spark):
    profiles = learn(docs_of(spark, ["the cat sat on the mat", None], None))
    got = {r.doc_id: r.lang_pred for r in identified(docs_of(spark, [*ODD, "123 !?", "\n"]), profiles).collect()}
    assert [got[i] for i in range(len(ODD) + 2)] == ["und", "und", "und", "und", *["en"] * 5, "und", "und"]
    assert {r.lang_pred for r in identified(docs_of(spark, ["abc"]), learn(docs_of(spark, []))).collect()} == {"und"}
    assert identified(docs_of(spark, []), profiles).count() == 0


def test_ranks_follow_counts():
    grams = ranked("bab")
    assert [chr(g & 0x1FFFFF) for g in grams if g < 1 << 21][0] == "b" and len(set(grams.tolist())) == len(grams)


# ---------------------------------------------------------------- toxicity


def test_toxicity_is_held_out_accurate(spark):
    sf = "/root/testdata/sf0.1"
    labels = catalog.table(spark, sf, "labels")
    got = catalog.op9_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    bad = [r for r in got if r.toxic == 1]
    assert sum(r.predicted for r in bad) >= 0.8 * len(bad)
    assert sum(r.predicted for r in got if r.toxic == 0) <= 0.03 * len(got)


def test_toxicity_of_odd_rows(spark):
    model = toxicity.fit([(b"bad idiot", 1, "en"), (b"nice day", 0, None), (None, 0, "de")] * 20, epochs=2)
    got = toxicity.scored(docs_of(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.scored(docs_of(spark, []), model).count() == 0
    alone = toxicity.scores(model, [toxicity.bucketed(b"a bad idiot here")])
    among = toxicity.scores(model, [toxicity.bucketed(t) for t in (b"x " * 50, b"a bad idiot here", b"")])
    assert alone[0] == pytest.approx(among[1], rel=1e-4)


# ---------------------------------------------------------------- token files


def test_repeated_words_meet_the_filters_once(monkeypatch):
    rng = random.Random(4)
    texts = [None, b"", b"one", b"One tWo \xc3\xa9t\xc3\xa9 two", b"w " * 5000, *(words(rng, 300).encode() for _ in range(20)), b"x" * 3000, b" . "]
    plain = [word_parts(t, toxicity.PREFIXES) for t in texts]
    for piece, slots in ((1 << 18, 1 << 17), (64, 4)):
        monkeypatch.setattr("tilewright.llm.words.PIECE", piece)
        monkeypatch.setattr("tilewright.llm.words.SLOTS", slots)
        parts, place, lengths = distinct_parts(texts, toxicity.PREFIXES)
        assert lengths.tolist() == [len(x) for x in plain]
        assert np.array_equal(parts[place], np.concatenate(plain))
    monkeypatch.undo()
    assert len(toxicity.looked_up([b"sun gold " * 2000])[0]) == 2
    model = toxicity.fit([(b"bad idiot", 1, "en"), (b"nice day", 0, "de")] * 20, epochs=2)
    one_by_one = np.concatenate([toxicity.scores(model, [toxicity.bucketed(t)]) for t in texts])
    assert np.allclose(toxicity._calibrated_scores(model, toxicity.looked_up(texts)), one_by_one, atol=1e-6)


def test_ngrams_are_counted_in_small_lots():
    texts = ["sun gold milk " * 40, "a b", "", "milk road " * 30, "b\u00e9 " * 20]
    batch = pa.record_batch([pa.array(["en", "de", "de", "en", "en"]), pa.array(texts)], names=["lang", "text"])
    want = Counter((n, int(g)) for n, t in zip(batch.column(0).to_pylist(), texts) for part in codes(t) for g in part)
    for most, lots in ((10**6, 2), (200, 2), (3, 5)):
        found = list(_counted(iter([batch, batch]), most))
        got = Counter()
        for names, grams, counts in found:
            got.update({(n, g): c for n, g, c in zip(names, grams.tolist(), counts.tolist())})
        assert got == Counter({k: 2 * n for k, n in want.items()})
        # A language's n-grams leave a task once, unless too many are distinct.
        assert len(found) == lots if most > 3 else len(found) > lots


def test_remembered_words_change_no_id():
    from tokenizers import Tokenizer

    encoder, tokenizer = Encoder(catalog.tokenizer_path()), Tokenizer.from_file(catalog.tokenizer_path())
    texts = [t or "" for t in ODD] + [
        "İstanbul'S it's I'll 'tis don't. ΟΔΥΣΣΕΥΣ, a<|endoftext|>b <|startoftext|>", "é ﬁ ½ Ⅷ 12ab_3", "a\tb\xa0c\x1cd \x85",
        "Word word. WORD, wörd!! x'ss''", "日本 😀 zero\u200dwidth ǅ ª",
    ]
    for text in texts * 2:
        assert encoder.encode(text) == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    texts = [*ODD, *(words(rng, rng.randrange(90)) for _ in range(200))]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    ids[3] = ids[4] = None
    ids[6] = ids[5]
    manifest = write_tokens(docs_of(spark, texts, ids), catalog.tokenizer_path(), str(tmp_path), frame_bytes=500, file_bytes=4000)
    got = sorted(read_tokens(manifest).collect(), key=lambda r: (r.file_no, r.row_no))
    assert manifest.count() > 3 and len(got) == len(texts)
    tokenizer, start = Tokenizer.from_file(catalog.tokenizer_path()), 0
    order = sorted(range(len(texts)), key=lambda i: (ids[i] is not None, ids[i] or 0, (texts[i] or "").encode()))
    for i, r in zip(order, got):
        want = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (ids[i], start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)
    assert read_tokens(write_tokens(docs_of(spark, []), catalog.tokenizer_path(), str(tmp_path))).count() == 0


class Kept(io.BytesIO):
    def close(self):
        pass


def test_readers_decompress_only_what_they_need():
    stream = Kept()
    writer = FrameWriter(stream, frame_bytes=200)
    for i in range(100):
        writer.add(i, np.arange(i % 7, dtype="<u4").tobytes())
    writer.close()
    data = stream.getvalue()
    reader = FrameReader(io.BytesIO(data), len(data))
    assert [(d, len(x)) for d, x in reader.documents({41, 42})] == [(41, 6), (42, 0)] and reader.frames_read <= 2 < len(reader.table)
    import zstandard

    out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert len(out) == sum(size for _, size, _ in reader.table)
    broken = bytearray(data)
    broken[len(data) - 9 - 12 + 8] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(FrameReader(io.BytesIO(bytes(broken)), len(data)).documents())


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, sf):
    docs = catalog.table(spark, sf, "documents")
    extra = [(10**6, None, "en", "src0", 0), (10**6 + 1, "123 456", None, None, 7), (0, docs.filter("doc_id = 0").first().text, "en", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, sf)
        rows = out.collect()
        if name == "language ID":
            assert {r.doc_id for r in rows} == {r.doc_id for r in seen.collect()} - {10**6, 10**6 + 1}
        if name == "MinHash near-dedup":
            classes = near_classes(seen).collect()
            assert sorted(r.doc_id for r in rows) == sorted({r.class_id for r in classes})
        if name == "mixing to target weights":
            assert max(Counter(r.doc_id for r in rows).values()) <= 2
        if name != "token output":
            assert out.columns == docs.columns and all(texts[r.doc_id] == r.text for r in rows)
            out = spark.createDataFrame(rows, docs.schema)
        else:
            assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in seen.collect())
        seen = out
    assert corpus_pipeline.run(spark, sf).count() > 0
