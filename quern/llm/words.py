"""Words and word shingles of whole texts, read straight from Arrow string buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D, with A-Z
lower-cased. Everything here is array arithmetic over the UTF-8 buffer: no
Python object is made per word. Words are identified by 64-bit multilinear
hashes. A null text counts as empty; an empty text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5
BLOCK_BYTES = 4 << 20
_CHUNK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: All of ASCII but letters and digits: for features that punctuation should not change.
PUNCTUATION = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd 64-bit numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + np.uint64(seed)) | np.uint64(1)


_WEIGHTS = draws(256, 11)
_PLACES = draws(16, 12)


def _weights(n: int) -> np.ndarray:
    global _WEIGHTS
    if n > len(_WEIGHTS):
        _WEIGHTS = draws(2 * n, 11)
    return _WEIGHTS


class Words:
    """The words of a block of texts. Text i has words first[i] to first[i+1].

    gaps: which of the 256 byte values separate words.
    """

    __slots__ = ("end", "first", "low", "start", "_solid")

    def __init__(self, texts: pa.Array, gaps: np.ndarray = _SPACE):
        texts = pc.fill_null(texts, "") if texts.null_count else texts
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int32)
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(texts) else np.zeros(0, np.uint8)
        off = (off - off[0]).astype(np.int64)
        self.low = _LOWER[raw]
        solid = ~gaps[raw]
        begins, ends = solid.copy(), solid.copy()
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        full = off[:-1] < off[1:]
        at = off[:-1][full]
        begins[at] = solid[at]
        at = off[1:][full] - 1
        ends[at] = solid[at]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self._solid = solid

    def hashes(self) -> np.ndarray:
        """One 64-bit number for each word; equal for equal words."""
        out = np.empty(len(self.start), np.uint64)
        for a in range(0, len(out), _CHUNK):
            s, e = self.start[a : a + _CHUNK], self.end[a : a + _CHUNK]
            size = e - s
            packed = self.low[s[0] : e[-1]][self._solid[s[0] : e[-1]]].astype(np.uint64) + np.uint64(1)
            head = np.cumsum(size) - size
            packed *= _weights(int(size.max()))[np.arange(len(packed)) - np.repeat(head, size)]
            out[a : a + _CHUNK] = np.add.reduceat(packed, head) + size.astype(np.uint64)
        return mix(out)

    def stems(self, sizes: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each size: which words are longer, and a number for their first bytes."""
        out, at, acc = [], self.start, np.zeros(len(self.start), np.uint64)
        length, index = self.end - self.start, np.arange(len(self.start))
        for j in range(max(sizes)):
            longer = length[index] > j + 1
            index, at, acc = index[longer], at[longer], acc[longer]
            acc = acc + (self.low[at + j].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[j]
            if j + 1 in sizes:
                out.append((index, mix(acc + np.uint64((j + 1) << 32))))
        return out

    def word(self, i: int) -> bytes:
        return self.low[self.start[i] : self.end[i]].tobytes()


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows in text order, repeats included, and where each text's begin.

    A text with fewer than k words, but at least one, has its whole sequence
    as its only shingle.
    """
    h, first = words.hashes(), words.first
    n = np.diff(first)
    m = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(m)])
    acc = np.zeros(len(h), np.uint64)
    whole = max(0, len(h) - k + 1)
    for j in range(k):
        acc[:whole] += h[j : j + whole] * _PLACES[j]
    for c in range(1, k):
        head = first[:-1][n == c]
        acc[head] = np.uint64(c)
        for j in range(c):
            acc[head] += h[head + j] * _PLACES[j]
    pick = np.arange(at[-1]) + np.repeat(first[:-1] - at[:-1], m)
    return mix(acc[pick]), at


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about `limit` bytes of text each; one text is never divided."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    group = np.cumsum(sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)
