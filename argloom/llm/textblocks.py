"""Vectorised word splitting and hashing over Arrow string columns.

Texts are handled as UTF-8 bytes in blocks of a few megabytes, so memory stays bounded
whatever the batch; a single text longer than a block is a block of its own.
Null texts count as empty. Words never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_STEP = np.uint64(0xD1342543DE82EF95)
#: Spans up to so many bytes are hashed eight bytes at a time, all spans at once; longer ones by a cryptographic hash.
LANE_BYTES = 64
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: Bytes that are not part of a word for `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The same for `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` once A-Z is lower-cased.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chain(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive hashes (len - k + 1 of them)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _STEP + hashes[i : i + n]
    return mix(out + np.uint64(k))


class Block:
    """Consecutive texts: `data` bytes, `bounds` of each text, and where words start and end."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, breaks: np.ndarray = SPACE, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.bounds = bounds
        self.n = len(bounds) - 1
        self._eights: tuple[np.ndarray, np.ndarray] | None = None
        word = ~breaks[self.data]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        before = np.empty(len(data) + 1, bool)
        before[0] = False
        before[1:] = word
        before &= ~first
        after = np.zeros(len(data) + 1, bool)
        after[: len(data)] = word
        after &= ~first
        self.starts = np.flatnonzero(word & ~before[:-1])
        self.ends = np.flatnonzero(word & ~after[1:]) + 1
        self.doc = np.searchsorted(bounds, self.starts, "right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)
        self.word_at = np.concatenate([[0], np.cumsum(self.n_words)])

    def _lanes(self) -> np.ndarray:
        """The eight bytes from each place on, as one number; zeros follow the last one."""
        if self._eights is None:
            padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
            self._eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(self.data) + 1,), (1,)), padded
        return self._eights[0]

    def spans_hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each span; equal bytes give equal hashes anywhere."""
        size, lanes = ends - starts, self._lanes()
        out = mix(size.astype(np.uint64) + _STEP)
        long = np.flatnonzero(size > LANE_BYTES)
        todo = np.flatnonzero((size <= LANE_BYTES) & (size > 0))
        at = 0
        while len(todo):
            left = size[todo] - at
            out[todo] = mix(out[todo] * _STEP ^ lanes[starts[todo] + at] & _MASKS[np.minimum(left, 8)])
            at += 8
            todo = todo[left > 8]
        for i in long.tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i] : ends[i]], digest_size=8).digest(), "little")
        return out

    def same_words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b, pair by pair, have the same bytes."""
        (x, y), (n, m) = (self.starts[a], self.starts[b]), (self.ends[a] - self.starts[a], self.ends[b] - self.starts[b])
        same, lanes = n == m, self._lanes()
        todo, at = np.flatnonzero(same & (n <= LANE_BYTES) & (a != b)), 0
        while len(todo):
            left = n[todo] - at
            same[todo] &= (lanes[x[todo] + at] ^ lanes[y[todo] + at]) & _MASKS[np.minimum(left, 8)] == 0
            at += 8
            todo = todo[left > 8]
        for i in np.flatnonzero(same & (n > LANE_BYTES) & (a != b)).tolist():
            same[i] = self.data[x[i] : x[i] + n[i]].tobytes() == self.data[y[i] : y[i] + n[i]].tobytes()
        return same

    def word_hash(self) -> np.ndarray:
        return self.spans_hash(self.starts, self.ends)

    def word_bytes(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def word(self, i: int) -> str:
        return self.word_bytes(i).decode("utf-8", "replace")

    def grams(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of k consecutive words of one text, and the index of their first word."""
        out = chain(hashes, k)
        at = np.flatnonzero(self.doc[: len(out)] == self.doc[k - 1 :]) if len(out) else np.empty(0, np.int64)
        return out[at], at

    def per_doc(self, flags: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=flags, minlength=self.n).astype(np.int64)


def as_strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    return pc.fill_null(column.cast(pa.large_string()), "")


def blocks(column: pa.Array, breaks: np.ndarray = SPACE, lower: bool = False, size: int | None = None) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, Block) over a string column; blocks of about `size` bytes (BLOCK_BYTES)."""
    size = size or BLOCK_BYTES
    column = as_strings(column)
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi, Block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], breaks, lower)
        lo = hi
