"""Vectorised hashing of words and word n-grams over UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. Those separators are single ASCII bytes, so words of the bytes are
words of the text. All hashes are 64-bit and depend on the content alone.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
#: One odd multiplier for bytes in a word, another for words in an n-gram.
BYTE_BASE, WORD_BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
SLICE = 4 << 20
EMPTY = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A random value for each byte; separators count as nothing.
BYTE_VALUE = np.where(SEPARATOR, np.uint64(0), mix(np.arange(1, 257, dtype=np.uint64) * BYTE_BASE))
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, BYTE_BASE)]))
    return _powers[:n]


def spans(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    edge = np.diff(np.concatenate([[0], (~SEPARATOR[b]).view(np.int8), [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hash_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return EMPTY
    first, last = int(starts[0]), int(ends[-1])
    nexts = np.append(starts[1:], last)
    offsets = np.arange(first, last) - np.repeat(starts, nexts - starts)
    values = BYTE_VALUE[b[first:last]] * powers(int(offsets.max()) + 1)[offsets]
    sums = np.add.reduceat(values, starts - first)
    return mix(sums + (ends - starts).astype(np.uint64) * WORD_BASE)


def words_and_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words; long texts go through in slices cut between words, so
    the working memory is that of a slice (or of one word, if that is longer)."""
    b = np.frombuffer(data, np.uint8)
    starts, ends = spans(b)
    if len(b) <= SLICE:
        return starts, ends, hash_spans(b, starts, ends)
    parts, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + SLICE)))
        parts.append(hash_spans(b, starts[i:j], ends[i:j]))
        i = j
    return starts, ends, np.concatenate(parts) if parts else EMPTY


def word_hashes(data: bytes) -> np.ndarray:
    return words_and_hashes(data)[2]


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return EMPTY
    h = np.zeros(m, np.uint64)
    for j in range(n):
        h = h * WORD_BASE + words[j : j + m]
    return mix(h + np.uint64(n))


def lowered(text: str | None) -> bytes:
    """UTF-8 with only A-Z lower-cased."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass").lower()


def raw(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def shingle_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole word sequence if it is shorter."""
    words = word_hashes(lowered(text))
    if not len(words):
        return EMPTY
    return np.unique(ngram_hashes(words, min(n, len(words))))
