"""Spelling variants: words one edit apart, found in a frequency-vector trie.

A word's vector counts its letters per letter group: one group for each of
a-z, and a few that share all other letters. One inserted or deleted letter
changes one count by one; one replaced letter moves one from a group to
another, or changes nothing. Words are arranged in a trie by successive counts,
first of ``TOP`` classes of groups, then of the groups themselves. A depth-first
search follows, from a node, children whose count is the same, or one more
while a surplus of one is unspent, or one less while a deficit of one is. Words
that reach a leaf together are verified letter by letter.

The counts of classes deal the words out: every word stays in the branch of its
own class counts and visits the later branches that its budget reaches, so a
pair meets in one branch only. A branch with many words is searched in cells of
bounded size; nothing in it is capped.

Words are lower-cased (A-Z only) runs of letters with at least ``least`` code
points that occur at least ``occurrences`` times. Null and wordless texts have
none; a null doc_id is the empty text where an id is hashed. Repeated rows
count again. Ties go to the word that comes first by code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.cells import in_cells
from tilewright.llm.shared import map_batches, written

# A-z by about falling frequency, so that the first counts of the trie tell most apart.
FREQUENT = "eaisnrtoludcmpghbvfykzjwxq"
OTHERS, TOP = 6, 3
GROUPS = len(FREQUENT) + OTHERS
LEAST, OCCURRENCES, RATIO, DAMAGED = 7, 2, 10, 31
#: Words at home and visitors of a cell, and letters compared at once.
CELL_WORDS, _HELD = 8192, 1 << 20
#: Pairs of rows that are compared without a further level.
_SMALL = 4096
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, damaged: int = DAMAGED) -> DataFrame:
    """``word, n`` over all documents, one run in ``damaged`` having lost a letter.

    Counts are added up inside tasks before words move.
    """
    runs = docs.select(F.expr("coalesce(CAST(doc_id AS STRING), '') AS doc"), F.expr(f"explode(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{{least},}}', 0)) AS run"))
    lowered = runs.selectExpr("doc", f"translate(run, '{_UPPER}', '{_LOWER}') AS run")
    hashed = lowered.selectExpr("run", "crc32(CAST(concat(doc, ':', run) AS BINARY)) AS h")
    cut = "concat(left(run, CAST(h % char_length(run) AS INT)), substring(run, CAST(h % char_length(run) AS INT) + 2))"
    words = hashed.selectExpr(f"CASE WHEN h % {damaged} = 0 THEN {cut} ELSE run END AS word").filter(f"char_length(word) >= {least}")
    return words.groupBy("word").agg(F.expr("count(1) AS n")).filter(f"n >= {occurrences}")


_GROUP = np.array([FREQUENT.index(chr(c)) if chr(c) in FREQUENT else len(FREQUENT) + c % OTHERS for c in range(128)])


def group_counts(words: list[str]) -> np.ndarray:
    """Letters of each word per letter group."""
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    groups = np.where(letters < 128, _GROUP[np.minimum(letters, 127)], len(FREQUENT) + letters % OTHERS)
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(owner * GROUPS + groups, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)


def class_counts(counts: np.ndarray) -> np.ndarray:
    """Letters of each word per class of groups."""
    return np.stack([counts[:, k::TOP].sum(axis=1) for k in range(TOP)], axis=1)


def search(home: np.ndarray, visitors: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(home, visitor) rows whose counts differ by no more than the visitors' budgets.

    The home rows' trie is their sorted order: a node is a range of rows equal
    in the counts so far. All visitors of a node go down together. Small nodes
    are not divided further; their rows are compared as they are.
    """
    order = np.lexsort(home.T[::-1])
    home, levels = home[order], home.shape[1]
    # Letters from each level on; what small counts need is enough for the differences.
    left, wanted = (np.cumsum(x[:, ::-1], axis=1)[:, ::-1] for x in (home, visitors))
    if max(home.max(initial=0), visitors.max(initial=0)) < 64:
        home, visitors = home.astype(np.int8), visitors.astype(np.int8)
    stack = [(0, 0, len(home), np.arange(len(visitors)), surplus, deficit)]
    while stack:
        level, low, high, who, more, less = stack.pop()
        if level == levels:
            v, h = (x.ravel() for x in np.indices((len(who), high - low)))
            yield order[low + h], who[v]
            continue
        if (high - low) * len(who) <= _SMALL or high - low == 1:
            step = max(1, _HELD // ((high - low) * (levels - level)))
            for at in range(0, len(who), step):
                part = who[at : at + step]
                apart = np.abs(home[None, low:high, level:] - visitors[part, None, level:]).sum(axis=2, dtype=np.int64)
                net = left[None, low:high, level] - wanted[part, None, level]
                v, h = np.nonzero((apart + net <= 2 * more[at : at + step, None]) & (apart - net <= 2 * less[at : at + step, None]))
                if len(v):
                    yield order[low + h], part[v]
            continue
        column = home[low:high, level]
        cuts = np.flatnonzero(np.diff(column)) + 1
        asked = visitors[who, level]
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), high - low]):
            away = column[start] - asked
            go = np.flatnonzero((away == 0) | ((away == 1) & (more > 0)) | ((away == -1) & (less > 0)))
            if len(go):
                stack.append((level + 1, low + start, low + end, who[go], more[go] - (away[go] > 0), less[go] - (away[go] < 0)))


def letters(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each word from the left and from the right, filled with zeros, and its length.

    Words longer than ``width`` are left blank.
    """
    held = [w if len(w) <= width else "" for w in words]
    text = "".join(held)
    coding, kind = ("latin-1", np.uint8) if text.isascii() or max(text, default="") <= "\xff" else ("utf-32-le", np.uint32)
    sides = [np.frombuffer("".join([fill(w, width, "\0") for w in held]).encode(coding), kind).reshape(len(words), width) for fill in (str.ljust, str.rjust)]
    return *sides, np.array([len(w) for w in words], np.int64)


def one_edit(first, second, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs (row a of the first letters, row b of the second) of different words are one edit apart."""
    ahead, behind = first[0][a] == second[0][b], first[1][a] == second[1][b]
    # The equal letters from both ends must leave out no more than the edited one.
    equal = ahead.argmin(axis=1) + behind[:, ::-1].argmin(axis=1)
    return equal >= np.maximum(first[2][a], second[2][b]) - 1


class Pairs:
    """Two lists of words of which pairs are verified."""

    #: Words up to so many letters are laid out once, longer ones as they are asked for.
    USUAL = 16

    def __init__(self, words: list[str], others: list[str]):
        self.words, self.others = words, others
        self.first, self.second = letters(words, self.USUAL), letters(others, self.USUAL)

    def verified(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the pairs (words[a], others[b]) of different words, the numbers of those exactly one edit apart."""
        size, other = self.first[2][a], self.second[2][b]
        widest = np.where(np.abs(size - other) <= 1, np.maximum(size, other), 0)
        kept, low = [], 0
        # Long words apart, so that a few of them do not widen all rows.
        for width in (self.USUAL, 64, 1024, 1 << 62):
            near = np.flatnonzero((widest > low) & (widest <= width))
            low = width
            if not len(near):
                continue
            width = min(width, int(widest[near].max()))
            step = max(1, _HELD // width)
            for at in range(0, len(near), step):
                part = near[at : at + step]
                if width <= self.USUAL:
                    good = one_edit(self.first, self.second, a[part], b[part])
                else:
                    used, i = np.unique(a[part], return_inverse=True)
                    met, j = np.unique(b[part], return_inverse=True)
                    good = one_edit(letters([self.words[x] for x in used], width), letters([self.others[x] for x in met], width), i, j)
                kept.append(part[good])
        return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def _branch(counts: np.ndarray) -> np.ndarray:
    """The class counts of each row as one number, in their order (very large ones share one)."""
    out = np.zeros(len(counts), np.int64)
    for level in range(counts.shape[1]):
        out = out * (1 << 20) + np.minimum(counts[:, level], (1 << 20) - 2) + 1
    return out


def _changes(top: int) -> list[np.ndarray]:
    """Changes of the class counts that a surplus and a deficit of one can pay for."""
    none = np.zeros(top, np.int64)
    one = [none, *np.eye(top, dtype=np.int64)]
    return [up - down for up in one for down in one if not (up is none and down is none) and (up is none or down is none or (up != down).any())]


def _at_home(batches):
    for batch in batches:
        word, n = batch.column("word"), batch.column("n")
        yield word, n, _branch(class_counts(group_counts(word.to_pylist())))


def _visiting(batches):
    for batch in batches:
        word, n = batch.column("word"), batch.column("n")
        top = class_counts(group_counts(word.to_pylist()))
        own = _branch(top)
        yield word, n, own
        for change in _changes(TOP):
            there = _branch(top + change)
            go = np.flatnonzero(((top + change) >= 0).all(axis=1) & (there > own))
            yield word.take(pa.array(go)), n.take(pa.array(go)), there[go]


def _met(home: pa.Table, guests: pa.Table) -> pa.Table:
    """Near pairs of a cell, both ways round."""
    schema = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])
    if not home.num_rows or not guests.num_rows:
        return schema.empty_table()
    words, others = home.column("word").to_pylist(), guests.column("word").to_pylist()
    counts, wanted = group_counts(words), group_counts(others)
    away = _branch(class_counts(wanted)) != home.column("branch")[0].as_py()
    place = {word: i for i, word in enumerate(sorted({*words, *others}))}
    first, second = (np.array([place[w] for w in side], np.int64) for side in (words, others))
    del place
    compared, one = Pairs(words, others), np.ones(len(others), np.int64)
    pairs, held, out = [], 0, []

    def settle():
        a, b = (np.concatenate([p[i] for p in pairs]) for i in range(2))
        # In their own branch two words meet twice, in others once.
        once = away[b] | (second[b] < first[a])
        a, b = a[once], b[once]
        good = compared.verified(a, b)
        out.append((a[good], b[good]))

    for a, b in search(counts, wanted, one, one):
        pairs.append((a, b))
        held += len(a)
        if held > 1 << 17:
            settle()
            pairs, held = [], 0
    if pairs:
        settle()
    a, b = (np.concatenate([o[i] for o in out] or [np.zeros(0, np.int64)]) for i in range(2))
    take = lambda table, column, rows: table.column(column).combine_chunks().take(pa.array(rows))
    there = pa.table([take(home, "word", a), take(guests, "word", b), take(guests, "n", b)], schema=schema)
    back = pa.table([take(guests, "word", b), take(home, "word", a), take(home, "n", a)], schema=schema)
    return pa.concat_tables([there, back])


def near_words(words: DataFrame) -> DataFrame:
    """``word, near, near_n``: all ordered pairs one edit apart, with the second's count.

    A word has at most some 90 near words per letter, so the pairs grow with the words.
    """
    narrow = words.select("word", "n")
    home = map_batches(narrow, _at_home, "word STRING, n BIGINT, branch BIGINT")
    guests = map_batches(narrow, _visiting, "word STRING, n BIGINT, branch BIGINT")
    return in_cells(home, guests, "branch", "word", "word", CELL_WORDS, CELL_WORDS).applyInArrow(_met, "word STRING, near STRING, near_n BIGINT")


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: forms followed to the last by pointer doubling.

    A form has at least ``RATIO`` times the count, so chains are short and a few rounds do.
    """
    current = written(forms.selectExpr("word", "form AS root"), "spelling-roots")
    while True:
        ahead = current.selectExpr("word AS _word", "root AS _root")
        stepped = current.join(ahead, F.expr("root = _word"), "left").selectExpr("word", "coalesce(_root, root) AS root", "_root IS NOT NULL AS moved")
        stepped = written(stepped, "spelling-roots")
        if stepped.filter("moved").isEmpty():
            return current
        current = stepped.select("word", "root")


def variants(
    docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, ratio: int = RATIO, damaged: int = DAMAGED
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word.

    The form is the near word of the largest count if that is at least
    ``ratio`` (2 or more) times the word's; the root follows forms to the last.
    """
    if ratio < 2:
        raise ValueError("forms must have larger counts than their words")
    words = written(vocabulary(docs, least, occurrences, damaged), "spelling-words")
    summed = near_words(words).groupBy("word").agg(F.expr("count(1) AS n_near"), F.expr("min(struct(-near_n AS neg, near AS near)) AS top"))
    fits = f"-top.neg >= {ratio} * n"
    judged = words.join(summed, "word", "left").selectExpr(
        "word", f"CASE WHEN {fits} THEN top.near END AS form", "n", "coalesce(n_near, 0) AS n_near", f"CASE WHEN {fits} THEN -top.neg END AS form_n"
    )
    judged = written(judged, "spelling-forms")
    roots = _roots(judged.filter("form IS NOT NULL"))
    return judged.join(roots, "word", "left").selectExpr("word", "form", "coalesce(root, word) AS root", "n", "n_near", "form_n")
