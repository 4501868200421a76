"""Vectorised word and n-gram hashing over Arrow string buffers.

Texts stay in the Arrow buffer; numpy works on its bytes.  A word is a run of bytes outside
``[\\x20\\x09-\\x0D]`` (all of them single bytes in UTF-8).  Word and n-gram hashes are
polynomials modulo 2**64 taken from one running sum, passed through a finaliser.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_pow: dict[int, np.ndarray] = {}


def _inverse(x: int) -> int:
    return pow(int(x), -1, 2**64)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    have = _pow.get(int(base))
    if have is None or len(have) < n:
        full = np.full(max(n, 1 << 16), base, np.uint64)
        full[0] = 1
        have = _pow[int(base)] = np.multiply.accumulate(full)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if not len(texts) or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most `most` bytes, one row at least."""
    first, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(lengths):
        yield first, len(lengths)


class Words:
    """Words of some texts: start, end (bytes), doc (row), hash; first[i]:first[i+1] are row i's."""

    __slots__ = ("data", "start", "end", "doc", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, hashes: bool = True):
        rows = len(offsets) - 1
        if lower:
            data = LOWER[data]
        self.data = data
        n = len(data)
        if n == 0:
            self.start = self.end = self.doc = np.empty(0, np.int64)
            self.hash, self.first = np.empty(0, np.uint64), np.zeros(rows + 1, np.int64)
            return
        word = ~SPACE[data]
        edge = offsets[(offsets > 0) & (offsets < n)]
        before = np.empty(n, bool)
        before[0], before[1:] = False, word[:-1]
        before[edge] = False
        self.start = np.flatnonzero(word & ~before)
        after = np.empty(n, bool)
        after[-1], after[:-1] = False, word[1:]
        after[edge - 1] = False
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(rows), np.diff(self.first))
        if hashes:
            run = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTE[data] * powers(_BASE, n), out=run[1:])
            back = powers(np.uint64(_inverse(_BASE)), n + 1)
            self.hash = mix((run[self.end] - run[self.start]) * back[self.start] + (self.end - self.start).astype(np.uint64))
        else:
            self.hash = np.empty(0, np.uint64)


def ngrams(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on, len(words)-n+1 of them; texts are not told apart."""
    m = len(words)
    if m < n:
        return np.empty(0, np.uint64)
    run = np.zeros(m + 1, np.uint64)
    np.cumsum(words * powers(_STEP, m), out=run[1:])
    return mix((run[n:] - run[:-n]) * powers(np.uint64(_inverse(_STEP)), m - n + 1))
