"""Words and word shingles of a text as 64-bit hashes, without a Python loop
over words.  A word is a run of letters, digits and underscores, in lower case."""

from __future__ import annotations

import numpy as np

U = np.uint64
CHUNK = 1 << 20
PIECE = 1 << 17     # letters of texts hashed together

_WORD: list[np.ndarray] = []
_POWERS: list[np.ndarray] = []
_LETTER = 0xD6E8FEB86659FD93
_BASE = 0x9E3779B97F4A7C15      # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def _word_letters() -> np.ndarray:
    if not _WORD:
        _WORD.append(np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)),
                                 bool, 0x110000))
    return _WORD[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """letter * base**i and base**-i for i < n at least, modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(4096, 1 << (n - 1).bit_length())
        _POWERS[:] = [np.cumprod(np.concatenate([[U(a)], np.full(size - 1, U(b))]))
                      for a, b in ((_LETTER, _BASE), (1, _INVERSE))]
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased text, starts and ends of its words."""
    return _spans(text.lower())


def _spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(text.encode("ascii"), np.uint8) if text.isascii() else \
        np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = _word_letters()[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return a, edges[::2], edges[1::2]


def _hash_spans(a: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, U)
    power, inverse = _powers(len(a))
    sums = np.zeros(len(a) + 1, U)
    np.cumsum((a.astype(U) + U(1)) * power[:len(a)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))


def word_hashes(text: str) -> np.ndarray:
    """One value per word, in order; equal words have equal values."""
    a, start, end = word_spans(text)
    if len(a) <= CHUNK:
        return _hash_spans(a, start, end)
    out, at = [], 0
    while at < len(start):  # pieces of about CHUNK letters, cut between words
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK, side="right")))
        lo, hi = start[at], end[to - 1]
        out.append(_hash_spans(a[lo:hi], start[at:to] - lo, end[at:to] - lo))
        at = to
    return np.concatenate(out) if out else np.zeros(0, U)


def pieces(texts: list[str]):
    """(i, j) of runs of texts of about ``PIECE`` letters together."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if j > i and size + len(t) > PIECE:
            yield i, j
            i, size = j, 0
        size += len(t)
    if texts:
        yield i, len(texts)


def batch_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of all texts on end, and where each begins, with the end."""
    if len(texts) == 1:
        words = word_hashes(texts[0])
        return words, np.array([0, len(words)])
    lower = [t.lower() for t in texts]
    a, start, end = _spans("\n".join(lower))
    first = np.cumsum([0, *(len(t) + 1 for t in lower)])
    return _hash_spans(a, start, end), np.searchsorted(start, first)


class Finder:
    """Where values are in a sorted array of different hashes, as
    ``np.searchsorted`` tells it, by way of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        bits = min(20, len(hashes).bit_length() + 5)
        self.shift = U(64 - bits)
        slot = (hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange(1 << bits)).astype(np.int32)
        self.most = int(np.bincount(slot, minlength=1).max())
        # past the end stands the last one again, which no value sent there equals
        self.hashes = np.concatenate([hashes, np.repeat(hashes[-1:], self.most)])

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the values, and which of them are in the array."""
        if not len(self.hashes):
            return np.zeros(len(x), np.int32), np.zeros(len(x), bool)
        at = self.first[(x >> self.shift).astype(np.int64)]
        for _ in range(self.most - 1):
            at += self.hashes[at] < x
        return at, self.hashes[at] == x


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """One value per run of ``k`` words; a shorter text is one shingle."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, U)
    for i in range(k):
        out = out * U(0x100000001B3) + words[i:n - k + 1 + i]
    return mix(out + U(k))


def occurrences(x: np.ndarray) -> np.ndarray:
    """How often each value has stood before in ``x``."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    new = np.ones(len(x), bool)
    new[1:] = s[1:] != s[:-1]
    first = np.flatnonzero(new)
    out = np.empty(len(x), np.int64)
    out[order] = np.arange(len(x)) - first[np.cumsum(new) - 1]
    return out
