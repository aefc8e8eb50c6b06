"""Words, hashes and sliding minima over UTF-8 bytes, in numpy, for use inside Arrow tasks.

Words are runs of ASCII digits, letters (A-Z lower-cased) and all bytes from
0x80 up, which is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on lower-cased text.
Hashes are 64 bits wide and the same on every machine and in every run.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 20
#: Bytes of several texts that are hashed at once, and slots in which their words are told apart.
PIECE, SLOTS = 1 << 18, 1 << 17
_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = np.arange(256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[48:58] = _IS_WORD[65:91] = _IS_WORD[97:123] = _IS_WORD[128:] = True
BYTE_VALUE = mix(_BYTES * _MULT + np.uint64(1))
_LOWER_VALUE = BYTE_VALUE[_LOWER]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the (odd) base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for i, base in enumerate((int(_MULT), pow(int(_MULT), -1, 1 << 64))):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _powers[i] = np.cumprod(out, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def _segments(data: np.ndarray, size: int = SEGMENT):
    """Pieces of about a megabyte, or ``size``, that never cut a word."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        if end < len(data):
            gaps = np.flatnonzero(~_IS_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                rest = np.flatnonzero(~_IS_WORD[data[end:]])
                end = end + int(rest[0]) + 1 if len(rest) else len(data)
        yield data[at:end]
        at = end


def word_hashes(text: bytes | None) -> np.ndarray:
    """One hash per word of the whole text."""
    return word_parts(text)[:, 0]


def _spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    return runs_of(_IS_WORD[data])


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums over the first so many bytes, each by its power of the base."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER_VALUE[data] * powers(len(data))[0], out=total[1:])
    return total


def _hashed(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((total[ends] - total[starts]) * powers(len(total) - 1)[1][starts] + (ends - starts).astype(np.uint64))


def word_parts(text: bytes | None, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """Per word its hash, and the hashes of its first so many bytes (of the word, if shorter)."""
    parts = []
    for data in _segments(np.frombuffer(text or b"", np.uint8)):
        starts, ends = _spans(data)
        if not len(starts):
            continue
        total = _sums(data)
        parts.append(np.stack([_hashed(total, starts, c) for c in (ends, *(np.minimum(starts + n, ends) for n in prefixes))], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, 1 + len(prefixes)), np.uint64)


def _representatives(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of one hash of each value, and the number of each hash's own among them; where slots collide, a value has several."""
    own = np.arange(len(hashes))
    slots = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
    held = np.empty(SLOTS, np.int64)
    held[slots] = own
    place = held[slots]
    other = hashes[place] != hashes
    place[other] = own[other]
    first = place == own
    return np.flatnonzero(first), (np.cumsum(first) - 1)[place]


def distinct_parts(texts: list[bytes | None], prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``word_parts`` of the distinct words of several texts (some listed twice), each word's place among them, and words per text."""
    joined = np.frombuffer(b"\0".join(t or b"" for t in texts), np.uint8)
    bounds = np.cumsum([len(t or b"") + 1 for t in texts])
    parts, places, begins, listed, at = [np.zeros((0, 1 + len(prefixes)), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for data in _segments(joined, PIECE):
        starts, ends = _spans(data)
        if len(starts):
            total = _sums(data)
            words = _hashed(total, starts, ends)
            first, place = _representatives(words)
            s, e = starts[first], ends[first]
            parts.append(np.stack([words[first], *(_hashed(total, s, np.minimum(s + n, e)) for n in prefixes)], axis=1))
            places.append(place + listed)
            begins.append(starts + at)
            listed += len(first)
        at += len(data)
    lengths = np.diff(np.searchsorted(np.concatenate(begins), bounds), prepend=0)
    return np.concatenate(parts), np.concatenate(places), lengths


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k items."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h + words[i : i + n]) * _MULT
    return mix(h)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` items, by doubling."""
    if len(a) < width:
        return a[:0]
    out, have = a, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edges = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def merge_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans; spans that touch become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    first = np.concatenate([[True], starts[1:] > ends[:-1]])
    last = np.concatenate([np.flatnonzero(first)[1:] - 1, [len(starts) - 1]])
    return starts[first], ends[last]
