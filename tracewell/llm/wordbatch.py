"""Words and shingles of whole Arrow batches as numpy arrays: the common ground of the operators on word sequences.

A ``Words`` holds the words of many texts one after the other.  A word is a run of bytes other than space and tab to
carriage return; A-Z count as a-z.  It is represented by a 64-bit hash of its bytes, so that a shingle is a few vector
operations and no Python object is made for a word.  Two different words share a hash with a chance of 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are in work at once; a longer text is a slice of its own.
SLICE = 4 << 20
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of a 64-bit value into every other one."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words:
    """``hashes`` of all words, ``starts`` and ``ends`` of their bytes, and ``first``: the words of text i are first[i]:first[i+1]."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        whole = texts.buffers()[2]
        low, high = int(offsets[0]), int(offsets[-1])
        raw = whole.slice(low, high - low).to_pybytes() if whole is not None and high > low else b""
        self.offsets = offsets - low
        self.n = len(texts)
        self.bytes, self.lowered = raw, raw.translate(_LOWER)
        data = np.frombuffer(self.lowered + bytes(8), dtype=np.uint8)
        size = len(raw)
        inside = ~_BLANK[data[:size]]
        before = np.zeros(size, dtype=bool)
        before[1:] = inside[:-1]
        cuts = self.offsets[1:-1]
        before[cuts[cuts < size]] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(size, dtype=bool)
        after[:-1] = inside[1:]
        cuts = cuts[cuts > 0]
        after[cuts - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hash(data)

    def _hash(self, data: np.ndarray) -> np.ndarray:
        eight = np.ndarray(shape=(max(len(data) - 7, 0),), dtype="<u8", buffer=data, strides=(1,))
        length = self.ends - self.starts
        out = length.astype(np.uint64) * _Q
        todo, at = np.arange(len(length)), 0
        while len(todo):
            left = length[todo] - at
            part = eight[self.starts[todo] + at] & _MASKS[np.minimum(left, 8)]
            h = (out[todo] ^ part) * _P
            out[todo] = h ^ (h >> np.uint64(29))
            todo, at = todo[left > 8], at + 8
        return mix(out)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The number of the text of each word."""
        return np.repeat(np.arange(self.n), self.counts())

    def text(self, begin: int, end: int) -> str:
        """The bytes from word ``begin`` up to word ``end`` (excluded), as they were written."""
        return self.bytes[self.starts[begin]:self.ends[end - 1]].decode() if end > begin else ""


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words, by its first word."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(31))) * _P + hashes[k:k + n]
    return mix(out)


def within(first: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which runs of ``width`` of ``n`` words lie in one text, as a mask over their first words, and how many each text has."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    mask = np.zeros(max(n - width + 1, 0) + 1, dtype=np.int64)
    begin = first[:-1][counts > 0]
    np.add.at(mask, begin, 1)
    np.add.at(mask, begin + counts[counts > 0], -1)
    return np.cumsum(mask)[:-1] > 0, counts


def distinct_sorted(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run values[offsets[i]:offsets[i+1]] sorted and without repeats, as (offsets, values)."""
    values = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    new[offsets[:-1][offsets[:-1] < len(values)]] = True
    return np.concatenate([[0], np.cumsum(new)])[offsets], values[new]


def shingle_sets(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values): text i has the sorted distinct shingles values[offsets[i]:offsets[i+1]].

    A text of fewer words has its whole sequence as one shingle, a text without words none.
    """
    mask, counts = within(words.first, width, len(words.hashes))
    values = shingles(words.hashes, width)[mask]
    number = words.counts()
    short = np.flatnonzero((number > 0) & (number < width))
    whole = np.zeros(len(short), dtype=np.uint64)
    for k in range(width - 1):
        has = number[short] > k
        at = words.first[:-1][short[has]] + k
        whole[has] = (whole[has] ^ (whole[has] >> np.uint64(31))) * _P + words.hashes[at]
    counts[short] = 1
    offsets = np.concatenate([[0], np.cumsum(counts)])
    every = np.empty(offsets[-1], dtype=np.uint64)
    single = np.zeros(offsets[-1], dtype=bool)
    single[offsets[short]] = True
    every[single], every[~single] = mix(whole ^ _Q), values
    return distinct_sorted(every, offsets)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices of about ``limit`` bytes of text."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_binary()).fill_null(b"")
        ends = np.frombuffer(sizes.buffers()[1], dtype=np.int64)[sizes.offset:sizes.offset + len(sizes) + 1] if len(sizes) else np.zeros(1, np.int64)
        at = 0
        while at < len(sizes):
            stop = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def binaries(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """Each text's run of ``values`` as one binary."""
    where = (offsets * values.itemsize).astype(np.int64)
    kept = np.ascontiguousarray(values)
    wide = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(where.tobytes()), pa.py_buffer(kept.tobytes())])
    return wide.cast(pa.binary())
