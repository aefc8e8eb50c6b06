"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is a weighted set of word shingles. Every element owns a strip of
the (weight, rank) plane into which darts are thrown by hashing: unit columns
of weight, each with arrivals of unit rate along the rank axis. A document
catches the darts that lie below its weight; each dart belongs to one of the
signature's coordinates, and the earliest dart of each coordinate is kept. Two
documents agree on a coordinate with probability equal to their weighted
Jaccard similarity. Only about ``coords * ln(coords)`` darts are looked at per
document, whatever its size; if a coordinate stays empty the rank limit is
doubled, which never changes coordinates already filled.

Documents that agree on all coordinates of a band share a bucket. Inside a
bucket, signatures are compared (one byte per coordinate travels along) and
pairs whose agreement comes near the threshold connect documents to groups;
documents that only share some passage fall apart here. Inside a group, exact
similarities of the shingle sets make the links, and classes are the connected
components of the links. Both comparisons run in numpy inside tasks and emit a
spanning forest only, never the pairs. Buckets and groups beyond a block size
are cut into blocks, and every two blocks meet in a task of their own, so no
task holds more than two blocks and no pair is left out.

Texts with equal word sequences are one node from the start, named by the hash
of that sequence. Texts of fewer words than a shingle are one shingle; texts
without words, nulls among them, stay alone. Rows without a ``doc_id`` take no
part: their class is null and they are kept. Rows that repeat a ``doc_id`` are
judged one by one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import list_column, map_batches, written
from tilewright.llm.words import gram_hashes, mix, word_hashes
from tilewright.operators.components import contract_links

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 4
#: How far below the threshold an estimated similarity may lie, in standard deviations.
SLACK = 4.5
#: Nodes of a bucket, and of a group, that one side of a task compares.
BUCKET_BLOCK = 1_500
GROUP_BLOCK = 400
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order, with how often each occurs."""
    if not len(words):
        return words, np.zeros(0, np.int64)
    return np.unique(gram_hashes(words, min(k, len(words))), return_counts=True)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def throw(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, limit: np.ndarray):
    """Darts under the weights and below each owner's rank limit: (owner, dart id, rank).

    ``elements``, ``weights`` and ``owner`` run in parallel; ``limit`` is by owner.
    """
    columns = np.ceil(weights).astype(np.int64)
    row = np.repeat(np.arange(len(elements)), columns)
    column = np.arange(len(row)) - np.repeat(np.cumsum(columns) - columns, columns)
    state = mix(mix(elements)[row] + (column.astype(np.uint64) + np.uint64(1)) * _GOLD)
    # Part of the column that the weight covers: 1 but for the last.
    cover = np.minimum(1.0, weights[row] - column)
    who, rank = owner[row], np.zeros(len(row))
    found = []
    while len(who):
        state = mix(state + _GOLD)
        rank = rank - np.log(_uniform(state))
        go = rank < limit[who]
        state, rank, who, cover = state[go], rank[go], who[go], cover[go]
        if cover.min(initial=1.0) < 1.0:
            inside = _uniform(mix(state ^ _GOLD)) < cover
            found.append((who[inside], state[inside], rank[inside]))
        else:
            found.append((who, state, rank))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*found))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], coords: int) -> np.ndarray:
    """One row of ``coords`` dart ids per non-empty weighted set; rows of empty sets are 0."""
    out = np.zeros((len(sets), coords), np.uint64)
    todo = np.array([i for i, (e, _) in enumerate(sets) if len(e)], np.int64)
    total = np.array([float(w.sum()) for _, w in sets])
    darts = coords * (math.log(coords) + 3)
    while len(todo):
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo]).astype(np.float64)
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        who, dart, rank = throw(elements, weights, owner, darts / total[todo])
        # The dart's id also names its coordinate. Writing by falling rank leaves the earliest.
        slot = who * coords + (mix(dart) % np.uint64(coords)).astype(np.int64)
        order = np.argsort(-rank, kind="stable")
        flat = np.zeros(len(todo) * coords, np.uint64)
        flat[slot[order]] = dart[order] | np.uint64(1)
        flat = flat.reshape(-1, coords)
        full = (flat != 0).all(axis=1)
        out[todo[full]] = flat[full]
        todo = todo[~full]
        darts *= 2
    return out


def _signed(shingle: int, bands: int, rows: int, by_count: bool):
    def run(batches):
        for batch in batches:
            n, keep, texts = 0, [], batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                sets, seqs, sizes, end = [], [], [], at
                while end < len(texts) and n < 300_000:
                    words = word_hashes(texts[end])
                    elements, counts = shingles(words, shingle)
                    sets.append((elements, counts if by_count else np.ones(len(elements))))
                    seqs.append(_sequence(words))
                    sizes.append(float(sets[-1][1].sum()))
                    n += len(elements)
                    end += 1
                n = 0
                sig = signatures(sets, bands * rows)
                folded = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    folded = (folded + sig[:, r::rows]) * _GOLD
                folded = mix(folded).view(np.int64)
                has = np.array([s > 0 for s in sizes])
                short = [row.tobytes() for row in (sig >> np.uint64(32)).astype(np.uint8)]
                yield batch.column(0).slice(at, end - at), seqs, sizes, list_column(folded[has].ravel(), has * bands, pa.int64()), short
                at = end

    return run


def _sequence(words: np.ndarray) -> int:
    """Hash of the whole word sequence (0 without words)."""
    if not len(words):
        return 0
    place = mix(np.arange(len(words), dtype=np.uint64) + _GOLD)
    return int(mix(np.array([np.sum(mix(words ^ place), dtype=np.uint64)])).view(np.int64)[0])


def signed(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, by_count: bool = False) -> DataFrame:
    """``doc_id, seq, weight, bands, sig``: word-sequence hash, total weight, a hash per band, a byte per coordinate."""
    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(
        docs.select("doc_id", F.expr("CAST(text AS BINARY)")), _signed(shingle, bands, rows, by_count),
        f"doc_id {kind}, seq BIGINT, weight DOUBLE, bands ARRAY<BIGINT>, sig BINARY",
    )


def expanded(words: np.ndarray, shingle: int, by_count: bool) -> np.ndarray:
    """Sorted elements; by count, the n-th occurrence of a shingle is an element of its own."""
    elements, counts = shingles(words, shingle)
    if not by_count:
        return elements
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.unique(mix(np.repeat(elements, counts) + nth.astype(np.uint64) * _GOLD))


def _kept_sets(shingle: int, by_count: bool):
    def run(batches):
        for batch in batches:
            parts = []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text)
                # A repeated doc_id may bring another text than the node's.
                parts.append(expanded(words if _sequence(words) == node else words[:0], shingle, by_count))
            if parts:
                sets = list_column(np.concatenate(parts).view(np.int64), [len(e) for e in parts], pa.int64())
                yield batch.column(0), sets, batch.column(2), batch.column(3)

    return run


def forest(near: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """First node and all other nodes of each component of two or more."""
    unseen, out = np.ones(len(near), bool), []
    for first in np.flatnonzero(near.sum(axis=1) > near.diagonal()):
        if not unseen[first]:
            continue
        unseen[first] = False
        front, found = np.array([first]), []
        while len(front):
            front = np.flatnonzero(near[front].any(axis=0) & unseen)
            unseen[front] = False
            found.append(front)
        out.append((int(first), np.concatenate(found)))
    return out


def agreements(sigs: np.ndarray) -> np.ndarray:
    """Share of equal coordinates of every two signatures, corrected for chance equality of bytes."""
    out = np.empty((len(sigs), len(sigs)), np.float32)
    for at in range(0, len(sigs), 64):
        out[at : at + 64] = (sigs[at : at + 64, None, :] == sigs[None]).mean(axis=2)
    return (out - 1 / 256) / (1 - 1 / 256)


def similarities(sets: list[np.ndarray]) -> np.ndarray:
    """Exact Jaccard similarity of every two sets, by incidence products over slices of the elements."""
    sizes = np.array([len(e) for e in sets], np.float32)
    values, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(int))
    # Elements of one set alone add nothing to any intersection.
    place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[which]
    owner, place = owner[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both = np.zeros((len(sets), len(sets)), np.float32)
    step = max(256, 4_000_000 // len(sets))
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [at, at + step])
        incidence = np.zeros((len(sets), step), np.float32)
        incidence[owner[a:b], place[a:b] - at] = 1
        both += incidence @ incidence.T
    np.fill_diagonal(both, sizes)
    return both / np.maximum(sizes[:, None] + sizes[None] - both, 1)


def _linked(make):
    """Streams rows (k, node, payload) sorted by k; per k a spanning forest of what ``make`` finds near."""

    def run(batches):
        key, nodes, payloads, out = None, [], [], ([], [])

        def close():
            if len(nodes) > 1:
                for first, others in forest(make(payloads)):
                    out[0].extend([nodes[first]] * len(others))
                    out[1].extend([nodes[i] for i in others])

        for batch in batches:
            for k, node, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if k != key:
                    close()
                    key, nodes, payloads = k, [], []
                nodes.append(node)
                payloads.append(payload)
            if len(out[0]) > 10_000:
                yield [list(x) for x in out]
                out = ([], [])
        close()
        if out[0]:
            yield list(out)

    return run


def _paired_blocks(rows: DataFrame, group: str, block: int) -> DataFrame:
    """``k, node, payload``: rows dealt to tasks so that every two nodes of a group meet in one.

    ``rows`` has the group, its size ``n``, node and payload. Groups of at most
    ``block`` nodes are one task's; others have blocks, and a key per two blocks.
    """
    cut = rows.withColumn("nb", F.expr(f"CAST(ceil(n / {block}) AS INT)")).withColumn("b", F.expr("pmod(xxhash64(node), nb)"))
    met = cut.withColumn("c", F.explode(F.expr("CASE WHEN nb = 1 THEN array(0) ELSE sequence(0, nb - 1) END")))
    met = met.selectExpr(f"xxhash64({group}, least(b, c), greatest(b, c)) AS k", "node", "payload")
    return met.repartition("k").sortWithinPartitions("k", "node")


def near_links(nodes: DataFrame, docs: DataFrame, similarity: float, shingle: int, by_count: bool, blocks: tuple[int, int]) -> DataFrame:
    """``u, v``: links that connect every class of near nodes."""
    buckets = nodes.selectExpr("node", "sig AS payload", "posexplode(bands) AS (band, h)").selectExpr(
        "xxhash64(band, h) AS bucket", "node", "payload"
    )
    sized = buckets.groupBy("bucket").agg(F.expr("count(1) AS n")).filter("n > 1")
    met = _paired_blocks(buckets.join(sized, "bucket"), "bucket", blocks[0])

    def alike(payloads):
        sigs = np.frombuffer(b"".join(p.as_py() for p in payloads), np.uint8).reshape(len(payloads), -1)
        low = similarity - SLACK * math.sqrt(similarity * (1 - similarity) / sigs.shape[1])
        return agreements(sigs) >= low

    drawn = map_batches(met, _linked(alike), "u BIGINT, v BIGINT").distinct()
    groups = written(contract_links(written(drawn, "near-drawn"), []), "near-groups")
    sizes = groups.groupBy("root").agg(F.expr("count(1) + 1 AS n"))
    listed = groups.selectExpr("u AS node", "root").unionByName(sizes.selectExpr("root AS node", "root"))
    listed = listed.join(sizes, "root").join(nodes.select("node", "doc"), "node")
    texts = docs.join(listed.withColumnRenamed("doc", "doc_id"), "doc_id").selectExpr(
        "node", "root", "n", "CAST(text AS BINARY) AS text"
    )
    sets = map_batches(texts.selectExpr("node", "text", "root", "n"), _kept_sets(shingle, by_count), "node BIGINT, payload ARRAY<BIGINT>, root BIGINT, n BIGINT")
    met = _paired_blocks(sets.filter("size(payload) > 0"), "root", blocks[1])

    def near(payloads):
        return similarities([p.values.to_numpy() for p in payloads]) >= similarity

    return map_batches(met, _linked(near), "u BIGINT, v BIGINT").filter("u <> v")


def near_classes(
    docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS,
    by_count: bool = False, blocks: tuple[int, int] = (BUCKET_BLOCK, GROUP_BLOCK),
) -> DataFrame:
    """``doc_id, class_id, kept``: one row per document row; the smallest doc_id of a class stays.

    Links are exact similarities of at least ``similarity`` among banded
    candidates. A pair at the threshold shares no bucket with probability
    ``(1 - similarity^rows)^bands``, 3e-6 with the defaults, and is estimated
    too low with about the same.
    """
    docs = docs.select("doc_id", "text")
    marks = written(signed(docs, shingle, bands, rows, by_count), "near-marks")
    nodes = marks.filter("weight > 0 AND doc_id IS NOT NULL").groupBy("seq").agg(
        F.expr("min_by(struct(doc_id, bands, sig), doc_id) AS m")
    ).selectExpr("seq AS node", "m.doc_id AS doc", "m.bands AS bands", "m.sig AS sig")
    nodes = written(nodes, "near-nodes")
    links = written(near_links(nodes, docs, similarity, shingle, by_count, blocks), "near-links")
    classes = written(contract_links(links, []), "near-roots").withColumnRenamed("u", "node")
    rooted = nodes.select("node", "doc").join(classes, "node", "left").selectExpr("node AS seq", "doc", "coalesce(root, node) AS root")
    names = rooted.groupBy("root").agg(F.expr("min(doc) AS class_id"))
    rooted = rooted.join(names, "root").select("seq", "class_id")
    worded = marks.filter("weight > 0 AND doc_id IS NOT NULL").select("doc_id", "seq").join(rooted, "seq").select("doc_id", "class_id")
    alone = marks.filter("weight = 0 OR doc_id IS NULL").selectExpr("doc_id", "doc_id AS class_id")
    return worded.unionByName(alone).selectExpr("doc_id", "class_id", "(doc_id IS NULL OR doc_id = class_id) AS kept")
