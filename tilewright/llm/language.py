"""Language identification by rank-order profiles of character n-grams.

Texts are lower-cased and everything but letters becomes one blank, also at
both ends. A profile lists the most frequent n-grams (n = 1 to 3) of a
language by falling frequency; a document has such a list of its own. The
out-of-place distance sums, over the document's list, how far each n-gram
stands from its place in the profile; absent n-grams count as the whole
profile's length. The nearest profile wins, ties going to the smaller name.

Null texts and texts without a letter are ``und`` with score 0. A null
``lang`` teaches nothing. Rows are judged one by one, repeated or not. Columns
named ``lang_pred`` or ``score`` are replaced; ``_language`` may not be one.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import map_batches, written

ORDERS = (1, 2, 3)
PROFILE = 300
#: About so many labelled documents per language teach the profiles.
SAMPLE = 20_000
UNDETERMINED = "und"
#: Characters whose n-grams are laid out at once.
STRETCH = 1 << 18
#: N-grams of a language that a task holds before it counts them, and distinct ones before it passes them on.
GRAMS = 500_000
_OTHER = re.compile(r"[\W\d_]+")
_BITS = 21


def codes(text: str):
    """Packed n-grams (order in the top bits, one code point per 20 bits), a stretch of the text at a time."""
    cleaned = _OTHER.sub(" ", f" {text.lower()} ")
    longest = max(ORDERS)
    for at in range(0, len(cleaned), STRETCH):
        # N-grams that begin in this stretch; the longest reach into the next.
        points = np.frombuffer(cleaned[at : at + STRETCH + longest - 1].encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        out, packed = [], np.zeros(len(points), np.int64)
        for n in range(1, longest + 1):
            packed = packed[: len(points) - n + 1]
            if not len(packed):
                break
            packed = (packed << _BITS) | points[n - 1 :]
            if n in ORDERS:
                own = packed[:STRETCH]
                # A lone blank says nothing about a language.
                out.append(own[own != 32] if n == 1 else own)
        yield np.concatenate(out)


def tallied(parts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of several arrays, ascending, and how often each occurs."""
    values, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in parts:
        found, number = np.unique(part, return_counts=True)
        if not len(values):
            values, counts = found, number
            continue
        both, place = np.unique(np.concatenate([values, found]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, number]), minlength=len(both)).astype(np.int64)
        values = both
    return values, counts


def ranked(text: str, size: int = PROFILE) -> np.ndarray:
    """The text's n-grams by falling count, equal counts by code; at most ``size``."""
    values, counts = tallied(codes(text))
    if len(values) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.argsort(-counts, kind="stable")][:size]


def _counted(batches, most: int = GRAMS):
    """How often each n-gram occurs, per language and task; if many are distinct, in several parts."""
    held: dict[str, list[np.ndarray]] = {}
    sizes: dict[str, int] = {}
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def settle(name):
        values, counts = np.unique(np.concatenate(held.pop(name)), return_counts=True)
        sizes.pop(name)
        if name in totals:
            both, place = np.unique(np.concatenate([totals[name][0], values]), return_inverse=True)
            summed = np.zeros(len(both), np.int64)
            summed[place[: len(totals[name][0])]] = totals[name][1]
            summed[place[len(totals[name][0]) :]] += counts
            values, counts = both, summed
        totals[name] = values, counts

    def passed_on(name):
        values, counts = totals.pop(name)
        return [name] * len(values), values, counts

    for batch in batches:
        texts = batch.column(1)
        for i, name in enumerate(batch.column(0).to_pylist()):
            for part in codes(texts[i].as_py()):
                held.setdefault(name, []).append(part)
                sizes[name] = sizes.get(name, 0) + len(part)
                if sizes[name] > most:
                    settle(name)
                    if len(totals[name][0]) > most:
                        yield passed_on(name)
    for name in list(held):
        settle(name)
    for name in list(totals):
        yield passed_on(name)


def learn(examples: DataFrame, size: int = PROFILE, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Profiles from ``lang, text``: a hashed sample of about ``sample`` documents per language.

    The sample bounds the work of fitting. What reaches the driver is ``size``
    n-grams per language.
    """
    examples = examples.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in examples.groupBy("lang").agg(F.expr("count(1) AS n")).collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, sample / n))])
    picked = examples.withColumn("share", share[F.col("lang")]).filter("pmod(xxhash64(text), 1000000) < share * 1000000")
    grams = map_batches(picked.select("lang", "text"), _counted, "lang STRING, gram BIGINT, n BIGINT")
    totals = grams.groupBy("lang", "gram").agg(F.expr("sum(n) AS n"))
    best = totals.withColumn("r", F.expr("row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram)")).filter(f"r <= {size}")
    profiles: dict[str, np.ndarray] = {}
    for row in best.groupBy("lang").agg(F.expr("array_sort(collect_list(struct(r, gram))) AS g")).collect():
        profiles[row["lang"]] = np.array([x["gram"] for x in row["g"]], np.int64)
    return dict(sorted(profiles.items()))


def distances(text: str, vocabulary: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """Out-of-place distance to every profile, and the largest one possible."""
    own = ranked(text, size)
    at = np.minimum(np.searchsorted(vocabulary, own), len(vocabulary) - 1)
    place = np.where((vocabulary[at] == own)[:, None], places[at], -1)
    away = np.abs(place - np.arange(len(own))[:, None])
    return np.where(place < 0, size, np.minimum(away, size)).sum(axis=0), size * len(own)


def identified(docs: DataFrame, profiles: dict[str, np.ndarray], size: int = PROFILE) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (1 less the relative distance, 0 to 1)."""
    names = list(profiles)
    vocabulary = np.unique(np.concatenate(list(profiles.values()))) if names else np.zeros(1, np.int64)
    places = np.full((len(vocabulary), max(1, len(names))), -1, np.int32)
    for i, grams in enumerate(profiles.values()):
        places[np.searchsorted(vocabulary, grams), i] = np.arange(len(grams))

    @F.arrow_udf("lang STRING, score DOUBLE")
    def judge(texts):
        import pyarrow as pa

        langs, scores = [], []
        # One text after another, so that a batch is never held as Python objects.
        for i in range(len(texts)):
            text = texts[i].as_py()
            if not names or text is None:
                langs.append(UNDETERMINED)
                scores.append(0.0)
                continue
            far, most = distances(text, vocabulary, places, size)
            best = int(np.argmin(far))
            langs.append(names[best])
            scores.append(1.0 - float(far[best]) / most)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    # Letters are judged on the JVM; only texts that have one reach Python as text.
    columns = [f"`{c}`" for c in docs.columns if c not in ("lang_pred", "score")]
    lettered = docs.select(*columns, judge(F.expr(r"CASE WHEN text RLIKE '\\p{L}' THEN text END")).alias("_language"))
    return lettered.selectExpr(*columns, "_language.lang AS lang_pred", "_language.score AS score")
