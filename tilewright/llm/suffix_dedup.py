"""Repeated substrings removed by suffix sorting, deep-shallow.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else is removed. Comparing all suffixes of a corpus is out of reach, so sorting
is confined to the suffixes that can decide anything:

1. Anchors. In every window of ``length`` bytes the k-gram of smallest hash is
   an anchor. Equal windows hold the same anchor at the same place, so two
   repeated strings always share an anchor, and an anchor that occurs once lies
   in no repeated string.
2. Contexts. Around an anchor, no more than ``length - k`` bytes before and
   ``length`` bytes from it on matter. Anchors of equal contexts are classes;
   where a class has two members all of its context is repeated.
3. Suffix sorting. Anchors of one k-gram with different contexts are compared
   by sorting the suffixes that start at them: multikey quicksort of the
   ``SHALLOW`` bytes after the k-gram, then a blind trie for each group that is
   still together. Neighbours in this order with a common prefix of r bytes
   are a set; the best match to the left within the set, l, is found by sorting
   what precedes the anchors backwards. Where l + r reaches ``length`` the bytes from l before
   to r after the anchor are repeated.

Groups of more than ``group_limit`` contexts are split without loss: strings
that start at most ``mid`` bytes before the anchor share more bytes after it,
and the others share more bytes before it, so each half of the offsets has a
longer key of its own; halves are split again until groups are small, or only
one offset is left and all strings are equal.

Matches never cross documents; null is the empty text. Rows are told apart by
(doc_id, text): rows that repeat both are occurrences of each other's strings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.shared import map_batches, small_enough, written
from tilewright.llm.words import BYTE_VALUE, merge_spans, mix, powers, sliding_min

LENGTH = 200
GRAM = 64
GROUP_LIMIT = 20_000
SHALLOW = 32
CONTEXTS_PER_TASK = 30_000
_PIECE = 1 << 19


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM):
    """(positions, k-gram hashes, context hashes) of the anchors of one text."""
    data = np.frombuffer(text, np.uint8)
    none = np.zeros(0, np.uint64)
    if len(data) < length:
        return np.zeros(0, np.int64), none, none
    width, before = length - gram + 1, length - gram
    found = []
    # Pieces by where windows start; neighbours overlap by what their contexts need.
    for at in range(0, len(data) - length + 1, _PIECE):
        low, high = max(0, at - before), min(len(data), at + _PIECE + 2 * length)
        part = data[low:high]
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[part] * up, out=total[1:])
        first, last = at - low, min(at + _PIECE + length - 1, len(data)) - low
        hashes = mix((total[first + gram : last + 1] - total[first : last + 1 - gram]) * down[first : last + 1 - gram])
        lows = sliding_min(hashes, width)
        pad = np.zeros(width - 1, np.uint64)
        highest = ~sliding_min(~np.concatenate([pad, lows, pad]), width)
        p = np.flatnonzero(hashes == highest)
        keys = hashes[p]
        p = p + first
        left, right = np.minimum(p, before), np.minimum(len(part) - p, length)
        start, end = p - left, p + right
        context = mix((total[end] - total[start]) * down[start]) ^ mix((left * 4096 + right).astype(np.uint64))
        found.append((p + low, keys, mix(context)))
    place, keys, contexts = (np.concatenate(x) for x in zip(*found))
    place, first = np.unique(place, return_index=True)
    return place, keys[first], contexts[first]


def _anchored(length: int, gram: int):
    def run(batches):
        for batch in batches:
            own, sizes, parts, held = [], [], [], 0
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for i, (key, text) in enumerate(rows):
                found = anchors(text, length, gram)
                own.append(key)
                sizes.append(len(found[0]))
                parts.append(found)
                held += sizes[-1]
                if held and (held > 200_000 or i == len(rows) - 1):
                    p, g, c = (np.concatenate(x) for x in zip(*parts))
                    yield np.repeat(np.array(own, np.int64), sizes), p.astype(np.int32), g.view(np.int64), c.view(np.int64)
                    own, sizes, parts, held = [], [], [], 0

    return run


def _contexts(length: int, gram: int):
    """Bytes before and from each wanted anchor on."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for key, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for w in wanted:
                    p = w["p"]
                    row = (w["hk"], key, p, w["n"], text[max(0, p - (length - gram)) : p], text[p : p + length])
                    for column, value in zip(out, row):
                        column.append(value)
            if out[0]:
                yield out

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def shallow_groups(keys: np.ndarray) -> list[np.ndarray]:
    """Multikey quicksort of rows of integer digits; rows equal in all digits stay together, in order."""
    done: list[np.ndarray] = []
    stack = [(np.arange(len(keys)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) < 2 or depth == keys.shape[1]:
            if len(rows):
                done.append(rows)
            continue
        digits = keys[rows, depth]
        pivot = np.sort(digits[[0, len(digits) // 2, -1]])[1]
        same = digits == pivot
        stack.append((rows[digits > pivot], depth))
        stack.append((rows[same], depth + 1))
        stack.append((rows[digits < pivot], depth))
    return done


class Trie:
    """Blind trie: inner nodes know only a depth and the characters that branch there."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None
        #: Members of each leaf, by its first string.
        self.leaves: dict[int, list[int]] = {}
        for i in range(len(strings)):
            self._add(i)

    def _char(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def _add(self, i: int) -> None:
        if self.root is None:
            self.root = i
            self.leaves[i] = [i]
            return
        # Down blindly, by the branching characters alone, to some leaf.
        node = self.root
        while isinstance(node, list):
            node = node[1].get(self._char(i, node[0])) if self._char(i, node[0]) in node[1] else next(iter(node[1].values()))
        shared = common(self.strings[i], self.strings[node])
        if shared == len(self.strings[i]) == len(self.strings[node]):
            self.leaves[node].append(i)
            return
        # Down again, to where the true common prefix ends.
        parent, edge, at = None, None, self.root
        while isinstance(at, list) and at[0] < shared:
            parent, edge = at, self._char(i, at[0])
            at = at[1][edge]
        self.leaves[i] = [i]
        if isinstance(at, list) and at[0] == shared:
            at[1][self._char(i, shared)] = i
            return
        new = [shared, {self._char(node, shared): at, self._char(i, shared): i}]
        if parent is None:
            self.root = new
        else:
            parent[1][edge] = new

    def ordered(self):
        """(member, bytes it shares with the one before it) in suffix order; 0 for the first."""
        work = [(self.root, 0)]
        while work:
            node, shared = work.pop()
            if isinstance(node, list):
                first, *others = sorted(node[1])
                work += [(node[1][c], node[0]) for c in reversed(others)]
                work.append((node[1][first], shared))
                continue
            for member in self.leaves[node]:
                yield member, shared
                shared = len(self.strings[node])


def suffix_order(strings: list[bytes], gram: int, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Strings in order, and how many bytes each shares with the one before it.

    All begin with the same ``gram`` bytes. The next ``shallow`` bytes are sorted
    by multikey quicksort, eight at a time (missing ones as zeros); strings that
    agree so far go into a blind trie.
    """
    width = -(-shallow // 8) * 8
    digits = np.frombuffer(b"".join([s[gram : gram + width].ljust(width, b"\0") for s in strings]), ">u8")
    order, shared = [], []
    for group in shallow_groups(digits.reshape(len(strings), width // 8).astype(np.uint64)):
        start = len(order)
        for member, depth in Trie([strings[i] for i in group]).ordered():
            row = int(group[member])
            # The first of a group shares with the last of the group before it.
            first = len(order) == start
            shared.append(common(strings[order[-1]], strings[row]) if first and order else depth)
            order.append(row)
    return order, shared


def prefix_sets(shared: list[int]):
    """(common prefix length, first, end) of every set of two or more neighbours in suffix order."""
    stack: list[tuple[int, int]] = []
    for at in range(1, len(shared) + 1):
        depth, first = shared[at] if at < len(shared) else -1, at - 1
        while stack and stack[-1][0] > depth:
            length, first = stack.pop()
            yield length, first, at
        if at < len(shared) and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def matched(lefts: list[bytes], rights: list[bytes], low: int, high: int, length: int, gram: int = 0) -> list[tuple[int, int]]:
    """Per context how far repeated strings reach before and after its anchor; (0, 0) if there are none.

    Only strings starting ``low`` to ``high`` bytes before the anchor are asked for.
    """
    back = [s[::-1] for s in lefts]
    rank = {m: r for r, m in enumerate(sorted(range(len(back)), key=back.__getitem__))}
    best = [(0, 0)] * len(lefts)
    suffixes, shared = suffix_order(rights, gram)
    for depth, first, end in prefix_sets(shared):
        r = min(depth, length - low)
        if r + high < length:
            continue
        order = sorted(suffixes[first:end], key=rank.__getitem__)
        near = [min(common(back[x], back[y]), high) for x, y in zip(order, order[1:])]
        for i, m in enumerate(order):
            l = max(near[i - 1] if i else 0, near[i] if i < len(near) else 0)
            if l + r >= length:
                best[m] = (max(best[m][0], l), max(best[m][1], r))
    return best


def _sorted_contexts(length: int, gram: int):
    """All groups of one task, told apart by multikey quicksort, then their suffixes sorted."""

    def run(batches):
        rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(8)))]
        if not rows:
            return
        groups = np.array([r[0] for r in rows], np.int64).view(np.uint64)
        spans = np.array([[r[1], r[2]] for r in rows], np.uint64)
        out = []
        for at in shallow_groups(np.concatenate([groups[:, None], spans], axis=1)):
            own = [rows[i] for i in at]
            if len(own) < 2:
                continue
            found = matched([r[6] for r in own], [r[7] for r in own], own[0][1], own[0][2], length, gram)
            # Contexts with several members are repeated throughout, which is known already.
            out += [(r[3], r[4] - l, r[4] + e) for r, (l, e) in zip(own, found) if e and r[5] == 1]
        if out:
            yield list(zip(*out))

    return run


def _split_hot(contexts: DataFrame, limit: int, length: int) -> tuple[DataFrame, list[DataFrame]]:
    """Contexts in groups of at most ``limit`` rows, and the spans found while splitting."""
    done, spans = [], []
    while True:
        sizes = contexts.groupBy("g").agg(F.expr("count(1) AS m"))
        hot = written(sizes.filter(f"m > {limit}").select("g"), "suffix-hot")
        if hot.isEmpty():
            done.append(contexts)
            break
        # Hot groups are fewer than contexts / limit.
        hot = F.broadcast(hot) if small_enough(hot) else hot
        done.append(contexts.join(hot, "g", "left_anti"))
        mid = "CAST(floor((lo + hi) / 2) AS INT)"
        halves = contexts.join(hot, "g", "left_semi").filter("hi > lo").withColumn(
            "half", F.expr(f"explode(array(struct(lo AS a, {mid} AS b), struct({mid} + 1 AS a, hi AS b)))")
        ).withColumns({"lo": F.col("half.a"), "hi": F.col("half.b")}).drop("half")
        # A half needs lo bytes before the anchor and length - hi from it on in common.
        halves = halves.filter(f"octet_length(before) >= lo AND octet_length(after) >= {length} - hi").withColumns({
            "g": F.expr(f"xxhash64(g, lo, hi, substring(before, octet_length(before) - lo + 1, lo), substring(after, 1, {length} - hi))"),
            "same": F.expr(
                f"xxhash64(substring(before, greatest(octet_length(before) - hi + 1, 1), hi), least(octet_length(before), hi), substring(after, 1, {length} - lo))"
            ),
        })
        halves = written(halves, "suffix-halves")
        equal = halves.groupBy("g", "same").agg(F.expr("count(1) AS k"), F.expr("min(struct(key, p)) AS one"))
        marked = halves.join(equal, ["g", "same"])
        reach_l, reach_r = "least(octet_length(before), hi)", f"least(octet_length(after), {length} - lo)"
        spans.append(marked.filter(f"k > 1 AND n = 1 AND {reach_l} + {reach_r} >= {length}").selectExpr(
            "key", f"p - {reach_l} AS a", f"p + {reach_r} AS b"))
        contexts = marked.filter("key = one.key AND p = one.p").withColumn("n", F.expr("CASE WHEN k > 1 THEN k ELSE n END"))
        contexts = written(contexts.select("g", "lo", "hi", "key", "p", "n", "before", "after"), "suffix-contexts")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out, spans


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """``key, spans``: byte spans (a, b) to remove, for each ``key`` of docs (key, text BINARY) that has any.

    Spans may overlap and end beyond the text.
    """
    marks = written(
        map_batches(docs.filter(f"octet_length(text) >= {length}").select("key", "text"), _anchored(length, gram), "key BIGINT, p INT, hk BIGINT, hc BIGINT"),
        "suffix-anchors",
    )
    often = marks.groupBy("hk").agg(F.expr("count(1) AS k")).filter("k > 1").select("hk")
    members = written(marks.join(often, "hk"), "suffix-members")
    classes = written(
        members.groupBy("hk", "hc").agg(F.expr("count(1) AS n"), F.expr("min(struct(key, p)) AS one")), "suffix-classes"
    )
    before = length - gram
    whole = members.join(classes.filter("n > 1").select("hk", "hc"), ["hk", "hc"]).selectExpr(
        "key", f"greatest(p - {before}, 0) AS a", f"p + {length} AS b"
    )
    # Groups with several contexts, at least one of them met once.
    groups = classes.groupBy("hk").agg(F.expr("count(1) AS m"), F.expr("min(n) AS least")).filter("m > 1 AND least = 1").select("hk")
    wanted = written(classes.join(groups, "hk").selectExpr("hk", "n", "one.key AS key", "one.p AS p"), "suffix-wanted")
    by_doc = wanted.groupBy("key").agg(F.expr("collect_list(struct(p, hk, n)) AS wanted"))
    texts = docs.select("key", "text").join(by_doc, "key").select("key", "text", "wanted")
    contexts = map_batches(texts, _contexts(length, gram), "g BIGINT, key BIGINT, p INT, n BIGINT, before BINARY, after BINARY")
    # Rows that repeat a key bring the same contexts again.
    contexts = contexts.selectExpr("g", "0 AS lo", f"{before} AS hi", "key", "p", "n", "before", "after").dropDuplicates(["g", "key", "p"])
    contexts, spans = _split_hot(written(contexts, "suffix-contexts"), group_limit, length)
    tasks = max(contexts.sparkSession.sparkContext.defaultParallelism, -(-contexts.count() // CONTEXTS_PER_TASK))
    dealt = contexts.select("g", "lo", "hi", "key", "p", "n", "before", "after").repartition(int(tasks), "g")
    spans.append(map_batches(dealt, _sorted_contexts(length, gram), "key BIGINT, a INT, b INT"))
    out = whole
    for part in spans:
        out = out.unionByName(part)
    return out.groupBy("key").agg(F.expr("collect_list(struct(a, b)) AS spans"))


def _removed(batches):
    for batch in batches:
        out = [[], [], []]
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            starts = np.array([s["a"] for s in spans or ()], np.int64)
            ends = np.minimum(np.array([s["b"] for s in spans or ()], np.int64), len(text))
            starts, ends = merge_spans(starts, ends)
            kept, at = [], 0
            for a, b in zip(starts.tolist(), ends.tolist()):
                kept.append(text[at:a])
                at = b
            kept.append(text[at:])
            out[0].append(len(text))
            out[1].append([{"a": a, "b": b} for a, b in zip(starts.tolist(), ends.tolist())])
            out[2].append(b"".join(kept))
        if out[0]:
            yield batch.column(0), *out


def without_repeats(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_limit: int = GROUP_LIMIT
) -> DataFrame:
    """``doc_id, n_bytes, spans, kept``: removed byte spans (a, b) and what is left of every text."""
    rows = docs.selectExpr(
        "doc_id", "xxhash64(doc_id, coalesce(text, '')) AS key", "CAST(coalesce(text, '') AS BINARY) AS text"
    )
    spans = written(repeated_spans(rows.select("key", "text"), length, gram, group_limit), "suffix-spans")
    joined = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(joined, _removed, f"doc_id {kind}, n_bytes BIGINT, spans ARRAY<STRUCT<a: INT, b: INT>>, kept BINARY")
