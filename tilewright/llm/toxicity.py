"""Toxicity scores by a convolutional text classifier.

A word's embedding is the sum of hashed rows: two for the word, so that other
words share both only if both hashes collide, and one for each of its
beginnings of 4, 5, 6 and 8 bytes, so that forms of one stem are related. Filters of several widths slide over
the whole text; each filter's maximum is kept, and a logistic layer weighs the
maxima. The network is trained in numpy on all labelled rows: these are dealt to
parts of about ``PART_ROWS``, every part trains in a task of its own, and after
each pass the parts' networks are averaged.

Thresholds are calibrated by language. The language is guessed from the text
(naive Bayes over hashed words, counted over all rows that teach), and each
language's logits are shifted so that its best threshold on held-back rows, a
fifth of all, scores 0.5; languages with too few such rows use the common one.

Null and empty texts are scored as a text without words. Rows are scored one
by one, repeated or not. Rows with a null label teach nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.shared import hinted, map_batches
from tilewright.llm.words import distinct_parts, mix

BUCKETS = 1 << 17
PREFIXES = (4, 5, 6, 8)
ROWS = 2 + len(PREFIXES)
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Labelled rows that one task trains on, about.
PART_ROWS = 8_000
#: Passes over the rows, by one part and by each of several.
EPOCHS, SHARED_EPOCHS = 12, 4
#: Held-back rows of the rarer label that a language needs for a threshold of its own.
LEAST = 25
_SALT = np.arange(1, 1 + len(PREFIXES), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_PAD = max(WIDTHS) - 1
_CHUNK = 120_000
#: Bytes of texts that are looked up together.
_BYTES = 1 << 19


@dataclass
class Model:
    rows: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    constant: float
    words: np.ndarray
    shifts: np.ndarray
    scale: float = 1.0


def looked_up(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embedding rows of the distinct words, ``ROWS`` columns, the place of every word among them, and words per text; row 0 is padding."""
    h, place, lengths = distinct_parts(texts, PREFIXES)
    h = np.concatenate([h[:, :1], mix(h[:, :1] + np.uint64(7)), mix(h[:, 1:] + _SALT)], axis=1)
    return (h % np.uint64(BUCKETS - 1)).astype(np.int32) + 1, place, lengths


def bucketed(text: bytes | None) -> np.ndarray:
    """Embedding rows of each word, ``ROWS`` columns; row 0 is padding."""
    return bucketed_all([text])[0]


def bucketed_all(texts: list[bytes | None]) -> list[np.ndarray]:
    """``bucketed`` of each text."""
    out = []
    for some in _grouped(texts):
        ids, place, lengths = looked_up(some)
        out += np.split(ids[place], np.cumsum(lengths)[:-1])
    return out


def _grouped(texts):
    """Lists of texts of ``_BYTES`` together, or of one that is longer."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or b"")
        if size > _BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _starts(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each document starts and ends in one row of all, with padding after each; one without words has one place."""
    lengths = np.maximum(1, lengths)
    starts = np.cumsum(lengths + _PAD) - lengths - _PAD
    return starts, starts + lengths


def _laid_out(docs: list[np.ndarray]):
    """All documents in one row with padding after each, and where each starts and ends."""
    starts, ends = _starts(np.array([len(d) for d in docs]))
    ids = np.zeros((int(ends[-1]) + _PAD, ROWS), np.int32)
    for at, d in zip(starts, docs):
        ids[at : at + len(d)] = d
    return ids, starts, ends


def _embedded(model: Model, ids: np.ndarray) -> np.ndarray:
    out = model.rows[ids[:, 0]]
    for k in range(1, ROWS):
        out += model.rows[ids[:, k]]
    return out


def _greatest(y: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Maxima of each document's places."""
    cuts = np.stack([starts, ends], axis=1).ravel()
    # The last cut may be the end of the row.
    padded = y if cuts[-1] < len(y) else np.concatenate([y, np.full((1 + cuts[-1] - len(y), y.shape[1]), -np.inf, y.dtype)])
    return np.maximum.reduceat(padded, cuts)[::2]


def _convolved(model: Model, ids, starts, ends):
    """Per width, the responses at every position; and each document's maxima."""
    embedded = _embedded(model, ids)
    responses, maxima = [], []
    for weights in model.filters:
        width = weights.shape[0]
        n = len(embedded) - width + 1
        y = embedded[:n] @ weights[0]
        for o in range(1, width):
            y += embedded[o : o + n] @ weights[o]
        maxima.append(_greatest(y, starts, ends))
        responses.append(y)
    return embedded, responses, np.concatenate(maxima, axis=1)


def _logits(model: Model, ids: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logits of documents, from distinct words and each word's place among them; a distinct word meets the filters once."""
    starts, ends = _starts(lengths)
    laid = np.zeros(int(ends[-1]) + _PAD, np.int64)
    laid[np.arange(len(place)) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)] = place + 1
    embedded = _embedded(model, np.concatenate([np.zeros((1, ROWS), ids.dtype), ids]))
    maxima = []
    for weights in model.filters:
        n = len(laid) - weights.shape[0] + 1
        y = (embedded @ weights[0]).take(laid[:n], axis=0)
        for o in range(1, len(weights)):
            y += (embedded @ weights[o]).take(laid[o : o + n], axis=0)
        maxima.append(_greatest(y, starts, ends))
    return np.maximum(np.concatenate(maxima, axis=1) + model.bias, 0) @ model.out + model.constant


def _languages(model: Model, ids: np.ndarray, place: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Number of the likeliest language of each document."""
    out, own = np.zeros(len(lengths), int), np.flatnonzero(lengths)
    if model.words.shape[1] > 1 and len(own):
        sums = np.add.reduceat(model.words[ids[:, 0]].take(place, axis=0), (np.cumsum(lengths) - lengths)[own])
        out[own] = sums.argmax(axis=1)
    return out


def _flattened(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents by embedding rows in the form of ``looked_up``."""
    ids = np.concatenate(docs)
    return ids, np.arange(len(ids)), np.array([len(d) for d in docs])


def _chunks(docs):
    at = 0
    while at < len(docs):
        end, held = at, 0
        while end < len(docs) and (end == at or held + len(docs[end]) <= _CHUNK):
            held += len(docs[end])
            end += 1
        yield slice(at, end)
        at = end


def _calibrated_scores(model: Model, words) -> np.ndarray:
    """Scores of documents in the form of ``looked_up``, 0 to 1."""
    z = _logits(model, *words) - model.shifts[_languages(model, *words)]
    return 1 / (1 + np.exp(-np.clip(model.scale * z, -40, 40)))


def scores(model: Model, docs: list[np.ndarray]) -> np.ndarray:
    """Calibrated scores, 0 to 1."""
    return np.concatenate([np.zeros(0), *(_calibrated_scores(model, _flattened(docs[part])) for part in _chunks(docs))])


def _untrained(rng: np.random.Generator) -> tuple[Model, dict, list[np.ndarray]]:
    """A network before training, and the sums of squared steps that training keeps."""
    total = FILTERS * len(WIDTHS)
    model = Model(
        rng.normal(0, 0.06, (BUCKETS, DIM)).astype(np.float32),
        [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.zeros(total, np.float32), rng.normal(0, 0.1, total).astype(np.float32), 0.0,
        np.zeros((BUCKETS, 1), np.float32), np.zeros(1),
    )
    model.rows[0] = 0
    sums = {"rows": np.zeros(BUCKETS), "out": np.zeros(total), "bias": np.zeros(total), "constant": np.zeros(1)}
    return model, sums, [np.zeros_like(f) for f in model.filters]


def _flat(model: Model, sums: dict, filter_sums: list[np.ndarray]) -> np.ndarray:
    """A network and its sums as one vector."""
    arrays = [model.rows, *model.filters, model.bias, model.out, np.array([model.constant]), *sums.values(), *filter_sums]
    return np.concatenate([np.asarray(x, np.float32).ravel() for x in arrays])


def _unflat(flat: np.ndarray) -> tuple[Model, dict, list[np.ndarray]]:
    model, sums, filter_sums = _untrained(np.random.default_rng(0))
    at = 0

    def take(like):
        nonlocal at
        at += np.size(like)
        return flat[at - np.size(like) : at].reshape(np.shape(like)).astype(like.dtype)

    model.rows, model.filters = take(model.rows), [take(f) for f in model.filters]
    model.bias, model.out, model.constant = take(model.bias), take(model.out), float(take(np.zeros(1))[0])
    sums = {key: take(x) for key, x in sums.items()}
    return model, sums, [take(f) for f in filter_sums]


def _trained(docs, labels: np.ndarray, epochs: int, seed: int, state=None) -> tuple[Model, dict, list[np.ndarray]]:
    """Minibatch training, maybe on from a state; only the positions of the maxima carry gradients."""
    rng = np.random.default_rng(seed)
    model, sums, filter_sums = state or _untrained(rng)
    positive = max(1, int(labels.sum()))
    weight = np.where(labels == 1, (len(labels) - positive) / positive if positive < len(labels) else 1.0, 1.0)

    def step(grad, key, rate=0.1):
        sums[key] += grad**2
        return rate * grad / (np.sqrt(sums[key]) + 1e-6)

    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), 32):
            chosen = order[at : at + 32]
            ids, starts, ends = _laid_out([docs[i] for i in chosen])
            embedded, responses, top = _convolved(model, ids, starts, ends)
            hidden = np.maximum(top + model.bias, 0)
            z = np.clip(hidden @ model.out + model.constant, -30, 30)
            error = ((1 / (1 + np.exp(-z)) - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
            back = np.outer(error, model.out) * (hidden > 0)
            model.out -= step(hidden.T @ error + 1e-4 * model.out, "out").astype(np.float32)
            model.constant -= float(step(np.array([error.sum()]), "constant")[0])
            model.bias -= step(back.sum(axis=0), "bias").astype(np.float32)
            rows, grads = [], []
            for k, (filters, y) in enumerate(zip(model.filters, responses)):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                places = np.array([s + np.argmax(y[s:e], axis=0) for s, e in zip(starts, ends)])
                for o in range(filters.shape[0]):
                    seen = embedded[np.minimum(places + o, len(embedded) - 1)]
                    g = np.einsum("df,dfe->ef", back[:, own], seen)
                    rows.append(np.minimum(places + o, len(ids) - 1).ravel())
                    grads.append((back[:, own, None] * filters[o].T[None]).reshape(-1, DIM))
                    filter_sums[k][o] += g**2
                    filters[o] -= 0.05 * g / (np.sqrt(filter_sums[k][o]) + 1e-6)
            rows, grads = ids[np.concatenate(rows)], np.concatenate(grads)
            used, which = np.unique(rows.ravel(), return_inverse=True)
            grad = np.zeros((len(used), DIM), np.float32)
            # One number per cell, which numpy adds up faster than rows.
            cells = (which.reshape(-1, 1) * DIM + np.arange(DIM)).ravel()
            np.add.at(grad.ravel(), cells, np.repeat(grads, ROWS, axis=0).ravel())
            grad[used == 0] = 0
            sums["rows"][used] += (grad**2).mean(axis=1)
            model.rows[used] -= (0.1 * grad / (np.sqrt(sums["rows"][used])[:, None] + 1e-6)).astype(np.float32)
    return model, sums, filter_sums


def _threshold(z: np.ndarray, labels: np.ndarray) -> float:
    """Middle of the gap at which the mean of both labels' hit rates is best."""
    order = np.argsort(z)
    z, labels = z[order], labels[order]
    missed = np.concatenate([[0], np.cumsum(labels)]) / max(1, labels.sum())
    passed = np.concatenate([[0], np.cumsum(1 - labels)]) / max(1, (1 - labels).sum())
    gain = passed - missed
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    # Of equally good cuts, the widest gap.
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    cut = max(best, key=lambda i: edges[i + 1] - edges[i])
    return float((edges[cut] + edges[cut + 1]) / 2)


def _word_counts(docs, langs, names: list[str]) -> np.ndarray:
    """Words of each bucket, by language."""
    counts = np.zeros((BUCKETS, max(1, len(names))))
    for words, lang in zip(docs, langs):
        if lang is not None:
            np.add.at(counts[:, names.index(lang)], words[:, 0], 1)
    return counts


def _with_words(model: Model, counts: np.ndarray) -> Model:
    counts = counts + 0.1
    counts[0] = 1
    model.words = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    return model


def _judged(model: Model, docs) -> tuple[np.ndarray, np.ndarray]:
    """Logit and guessed language of each document."""
    words = [_flattened(docs[part]) for part in _chunks(docs)]
    parts = [(_logits(model, *x), _languages(model, *x)) for x in words]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0), np.zeros(0, int))


def _calibrated(model: Model, z: np.ndarray, spoken: np.ndarray, truth: np.ndarray, names: list[str]) -> Model:
    """The model with the thresholds that suit the held-back rows."""
    model.shifts = np.zeros(max(1, len(names)))
    if min(truth.sum(), (1 - truth).sum()) >= LEAST:
        common = _threshold(z, truth)
        model.shifts += common
        for k in range(len(names)):
            own = spoken == k
            if min(truth[own].sum(), (1 - truth[own]).sum()) >= LEAST:
                model.shifts[k] = _threshold(z[own], truth[own])
        model.scale = 4 / max(1e-3, float(np.abs(z - common).mean()))
    return model


def _held_back(n: int) -> np.ndarray:
    """Which rows of a part set thresholds instead of teaching."""
    return np.arange(n) % 5 == 4


def fit(rows: list[tuple[bytes | None, int, str | None]], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """A model from (text, label, language) rows; a fifth of them sets the thresholds."""
    docs = bucketed_all([text for text, _, _ in rows])
    labels = np.array([label for _, label, _ in rows], float)
    names = sorted({lang for _, _, lang in rows if lang is not None})
    back = _held_back(len(rows))
    teach = np.flatnonzero(~back)
    model, _, _ = _trained([docs[i] for i in teach], labels[teach], epochs, seed)
    _with_words(model, _word_counts([docs[i] for i in teach], [rows[i][2] for i in teach], names))
    return _calibrated(model, *_judged(model, [docs[i] for i in np.flatnonzero(back)]), labels[back], names)


#: Slices of a network that are averaged each on its own.
SLICES = 32


def _by_part(parted: DataFrame, each, schema: str, read=bucketed_all) -> DataFrame:
    """What ``each`` yields for a part, from its number, texts as ``read``, labels and languages in order of ids."""

    def run(batches):
        # Of rows with one id, the least text; nulls are least.
        found, number = {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, text, toxic, lang, number = (batch.column(c)[i].as_py() for c in ("doc_id", "text", "toxic", "lang", "part"))
                key = (text is not None, text or b"", lang is not None, (lang or "").encode())
                if doc_id not in found or key < found[doc_id][0]:
                    found[doc_id] = key, text, toxic, lang
        if found:
            order = sorted(found, key=str)
            texts, labels, langs = ([found[i][k] for i in order] for k in (1, 2, 3))
            found.clear()
            yield from each(number, read(texts), np.array(labels, float), langs)

    return map_batches(parted, run, schema)


def _averaged(flats: DataFrame, mean: bool = True) -> np.ndarray:
    """Mean or sum of vectors that come in slices ``place, part, piece``, added up in the order of parts."""

    def add(batches):
        held = {}
        for batch in batches:
            for place, part, piece in zip(*(batch.column(i).to_pylist() for i in range(3))):
                total, n = held.get(place, (0, 0))
                held[place] = total + np.frombuffer(piece, np.float32).astype(float), n + 1
        for place, (total, n) in sorted(held.items()):
            yield [place], [(total / n if mean else total).tobytes()]

    dealt = flats.repartition(SLICES, "place").sortWithinPartitions("place", "part")
    found = sorted((r["place"], r["piece"]) for r in map_batches(dealt, add, "place INT, piece BINARY").collect())
    return np.concatenate([np.zeros(0), *(np.frombuffer(piece) for _, piece in found)])


def _sliced(number: int, flat: np.ndarray):
    for place, piece in enumerate(np.array_split(np.asarray(flat, np.float32), SLICES)):
        yield [place], [number], [piece.tobytes()]


def learn(docs: DataFrame, labels: DataFrame, part_rows: int = PART_ROWS, epochs: int | None = None) -> Model:
    """Fits on all labelled rows.

    ``docs`` has doc_id, text and lang, ``labels`` doc_id and toxic; null labels
    and ids teach nothing. The driver gets the averaged network after each
    pass, word counts per bucket and language, and one logit per held-back row.
    """
    # A document labelled twice is toxic if one label says so.
    marked = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.expr("max(toxic) AS toxic"))
    spark, parts = docs.sparkSession, -(-marked.count() // part_rows)
    if not parts:
        return fit([], 0)
    passes = epochs or (EPOCHS if parts == 1 else SHARED_EPOCHS)
    rows = docs.join(hinted(marked), "doc_id").selectExpr("doc_id", "toxic", "CAST(text AS BINARY) AS text", "lang")
    parted = rows.withColumn("part", F.expr(f"CAST(pmod(xxhash64(doc_id), {parts}) AS INT)")).repartitionById(parts, F.col("part"))
    # Dealt once, read by every pass.
    parted = parted.persist(StorageLevel.DISK_ONLY)
    try:
        return _learned(spark, parted, parts, passes)
    finally:
        parted.unpersist()


def _learned(spark: SparkSession, parted: DataFrame, parts: int, passes: int) -> Model:
    def known(part, texts, truth, langs):
        yield (sorted({lang for lang in langs if lang is not None}),)

    found = _by_part(parted, known, "lang STRING", read=list)
    names = sorted(r["lang"] for r in found.distinct().collect())
    slices, state = "place INT, part INT, piece BINARY", _flat(*_untrained(np.random.default_rng(11)))
    # One part takes all passes at once.
    for number in range(passes if parts > 1 else 1):
        shared = spark.sparkContext.broadcast(state)

        def train(part, texts, truth, langs, number=number, shared=shared):
            teach = np.flatnonzero(~_held_back(len(texts)))
            start = _unflat(shared.value) if number else None
            own = _trained([texts[i] for i in teach], truth[teach], 1 if parts > 1 else passes, 11 + number, start)
            # Steps are sent, not places: words that a part does not have are zeros, which shrink.
            yield from _sliced(part, _flat(*own) - shared.value)

        steps = _averaged(_by_part(parted, train, slices))
        if not len(steps):
            return fit([], 0)
        state = (state + steps).astype(np.float32)

    def count(part, texts, truth, langs):
        teach = np.flatnonzero(~_held_back(len(texts)))
        yield from _sliced(part, _word_counts([texts[i] for i in teach], [langs[i] for i in teach], names).ravel())

    words = _averaged(_by_part(parted, count, slices), mean=False).reshape(BUCKETS, -1)
    model = _with_words(_unflat(state)[0], words)
    ready = spark.sparkContext.broadcast(model)

    def judge(part, texts, truth, langs):
        back = np.flatnonzero(_held_back(len(texts)))
        if len(back):
            z, spoken = _judged(ready.value, [texts[i] for i in back])
            yield z.astype(float), spoken.astype(np.int32), truth[back].astype(np.int32)

    found = _by_part(parted, judge, "z DOUBLE, spoken INT, truth INT").toArrow()
    z, spoken, truth = (found.column(i).to_numpy() for i in range(3))
    return _calibrated(model, z, spoken, truth.astype(float), names)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score`` from the whole text; a column of that name is replaced.

    Null and wordless texts score like one word that says nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts):
        import pyarrow as pa

        # Some texts after another, so that a batch is never held as Python objects.
        some = _grouped(texts[i].as_py() for i in range(len(texts)))
        return pa.array(np.concatenate([np.zeros(0), *(_calibrated_scores(shared.value, looked_up(x)) for x in some)]))

    return docs.withColumn("score", score(F.expr("CAST(text AS BINARY)")))
