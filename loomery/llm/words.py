"""Words and word shingles of a batch of texts, as arrays."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[65:91] = True
_WORD[128:] = True
SHINGLE = 5
_SALTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers; one-to-one."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to the nth."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 19)
        for i, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


class SpanHashes:
    """64-bit hashes of spans of data, the same wherever the bytes stand."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.total[ends] - self.total[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHashes(data)(starts, ends)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The text and hash of each word, in order; words are runs of letters and digits, whatever their case."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    size = np.array([len(b) for b in raw], np.int64)
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    edge = np.diff(np.concatenate(([False], _WORD[data])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.repeat(np.arange(len(raw), dtype=np.int64), size + 1)[starts]
    return doc, span_hash(data, starts, ends)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of five words: text, hash and count of each, by text, then hash.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    doc, h = word_hashes(texts)
    n = len(texts)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    place = np.arange(len(h)) - first[doc]
    left = count[doc] - place  # words from here to the end of the text
    start = np.flatnonzero((left >= SHINGLE) | (place == 0))
    value = np.zeros(len(start), np.uint64)
    for j in range(SHINGLE):
        value += np.where(left[start] > j, padded[start + j] * _SALTS[j], np.uint64(0))
    value, of = mix(value), doc[start]
    order = np.lexsort((value, of))
    value, of = value[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    return of[at], value[at], np.diff(np.append(at, len(of)))


def slices(texts: list[str], most: int = 300_000):
    """(start, end) of runs of texts of about `most` characters, one text at least."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= most):
            size += len(texts[upto])
            upto += 1
        yield at, upto
        at = upto
