"""Whole-batch word hashing with numpy.

The bytes of many texts are laid end to end; one cumulative sum of table-mapped
bytes times odd powers gives each word's 64-bit fingerprint as a difference of
two prefix sums, so the cost is a few array operations a byte and none a word.
Words are lower-cased in A-Z only. A null text is an empty one.
"""

from __future__ import annotations

import numpy as np

#: Bytes 0x20 and 0x09-0x0D part words.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but letters and digits parts words; bytes of longer UTF-8 characters belong to them.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEED = np.random.default_rng(20240501)
_TABLE = _SEED.integers(1, 2**64 - 1, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_powers: tuple[np.ndarray, np.ndarray] | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, 1 << 20)
        up = np.full(size, _BASE, np.uint64)
        down = np.full(size, pow(_BASE, -1, 2**64), np.uint64)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def word_hashes(texts: list[bytes | None], parts: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words in order, and where each text's words begin (one more entry at the end)."""
    lens = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(lens)))
    raw = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
    gap = parts[raw]
    step = np.diff(np.concatenate(([True], gap, [True])).view(np.int8))
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    terms = _TABLE[raw]
    terms *= up[: len(raw)]
    np.cumsum(terms, out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, at)


def word_spans(texts: list[bytes | None], parts: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte offsets (start, end) of the same words inside their own text, and where each text's words begin."""
    lens = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(lens)))
    raw = np.frombuffer(b" ".join([t or b"" for t in texts]) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
    step = np.diff(np.concatenate(([True], parts[raw], [True])).view(np.int8))
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    first = np.searchsorted(starts, at)
    own = np.repeat(at[:-1], np.diff(first))
    return starts - own, ends - own, first


def grams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of n words inside one text, and where each text's runs begin."""
    counts = np.maximum(np.diff(first) - (n - 1), 0)
    begin = np.concatenate(([0], np.cumsum(counts)))
    total = int(begin[-1])
    if not total:
        return np.zeros(0, np.uint64), begin
    at = np.arange(total) - np.repeat(begin[:-1] - first[:-1], counts)
    out = words[at]
    for k in range(1, n):
        out = mix(out) + words[at + k]
    return mix(out), begin
