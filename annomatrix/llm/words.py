"""Words of many texts as 128-bit hashes, computed on the bytes of Arrow columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Up to SHORT bytes it is taken as it is, with its length, and a
longer one by its BLAKE2b hash; a bijection of 128 bits spreads either over two lanes of 64 bits. So no two short words
agree in both lanes, and others only where BLAKE2b fails. A run of words has a hash per lane as well: those of 2, 4, 8, ... words are
mixed from their halves, and a run of any length is mixed from the longest such blocks at its two ends and its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of a word that its 128 bits hold as they are, beside its length.
SHORT = 15
KEYS = tuple(np.uint64(k) for k in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))
ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each text begins and ends; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data, ends


def hashes_of(letters: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Both lanes of each word's hash; letters holds the words' bytes end to end."""
    n, ends = len(lengths), np.cumsum(lengths)
    place = np.arange(len(letters)) - np.repeat(ends - lengths, lengths)
    packed = np.zeros((n, 16), dtype=np.uint8)
    packed.ravel()[(np.repeat(np.arange(0, 16 * n, 16), lengths) + place)[place < SHORT]] = letters[place < SHORT]
    packed[:, SHORT] = np.minimum(lengths, SHORT)
    for i in np.flatnonzero(lengths > SHORT).tolist():
        packed[i] = np.frombuffer(blake2b(letters[ends[i] - lengths[i] : ends[i]].tobytes(), digest_size=16).digest(), dtype=np.uint8)
    x, y = np.ascontiguousarray(packed.view("<u8").T).astype(np.uint64)
    x = x ^ mix(y + KEYS[0])
    y = y ^ mix(x + KEYS[1])
    x = x ^ mix(y + KEYS[2])
    return np.stack([x, y ^ mix(x + KEYS[3])], 1)


def chunks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes in two lanes, bounds) for runs of texts of some CHUNK_BYTES; text i of the run has the
    words from bounds[i] to bounds[i + 1]."""
    data, ends = texts_of(column)
    lo, n = 0, len(ends) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CHUNK_BYTES, side="right")) - 1)
        own = data[ends[lo] : ends[hi]]
        begins = ends[lo : hi + 1] - ends[lo]
        if lower:
            own = LOWER[own]
        inside = ~SPACE[own]
        edge = np.zeros(len(own) + 1, dtype=bool)
        edge[begins] = True
        first = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
        last = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        yield lo, hashes_of(own[inside], last - first), np.searchsorted(first, begins)
        lo = hi


class Runs:
    """Hashes of runs of words in one lane."""

    def __init__(self, hashes: np.ndarray, lane: int):
        self.odd = ODD[lane]
        self.levels = [np.ascontiguousarray(hashes[:, lane])]  # of 1, 2, 4, ... words from each place on

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            half, below = 1 << (len(self.levels) - 1), self.levels[-1]
            n = max(0, len(below) - half)
            self.levels.append(mix((below[:n] ^ (below[:n] >> np.uint64(29))) * self.odd + below[half : half + n]))
        return self.levels[k]

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of the words from begin to end, of which there is one at least."""
        out = np.zeros(len(begin), dtype=np.uint64)
        length = end - begin
        if not len(out):
            return out
        size = np.frexp(length.astype(np.float64))[1] - 1
        for k in range(int(size.min()), int(size.max()) + 1):
            at = slice(None) if size.min() == size.max() else np.flatnonzero(size == k)
            a, b = self.level(k)[begin[at]], self.level(k)[end[at] - (1 << k)]
            out[at] = mix(mix((a ^ (a >> np.uint64(29))) * self.odd + b) + length[at].astype(np.uint64))
        return out


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
