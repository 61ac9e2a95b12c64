"""Canonical length-limited Huffman coding of token ids, in blocks that decode on their own.

A block holds whole documents. Its header has, for each document, its id and number of ids, and a bit offset for every
LANE ids of the block; the payload is one bit string. A decoder looks LIMIT bits up in one table and follows all lanes
of a block side by side. The code itself is the length of each id's code word, from the counts of the whole corpus.
"""

from __future__ import annotations

import heapq

import numpy as np

LIMIT = 16
LANE = 64


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths under the limit for the ids that occur, by package-merge; 0 for the others. A single id gets
    length 1."""
    counts = np.asarray(counts, dtype=np.int64)
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 2**limit:
        raise ValueError(f"{len(used)} ids have no code of at most {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = [(int(counts[i]), (int(k),)) for k, i in enumerate(order)]
    if _longest(counts[order]) <= limit:
        lengths[order] = _unlimited(counts[order])
        return lengths
    # A coin is (weight, number of times each leaf is in it); sorted lists of coins are merged level by level.
    n = len(order)
    weights = np.array([w for w, _ in leaves], dtype=np.int64)
    level_w = weights
    picks = []  # for each level, whether its sorted coins are leaves
    for _ in range(limit - 1):
        pairs = level_w[: len(level_w) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([weights, pairs])
        rank = np.argsort(merged, kind="stable")
        picks.append(rank < n)
        level_w = merged[rank]
    depth = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(picks):
        chosen = is_leaf[:take]
        own = int(chosen.sum())
        depth[:own] += 1
        take = 2 * (take - own)
    depth[:take] += 1
    lengths[order] = depth
    return lengths


def _unlimited(sorted_counts: np.ndarray) -> np.ndarray:
    """Plain Huffman lengths for counts in rising order."""
    n = len(sorted_counts)
    heap = [(int(c), i) for i, c in enumerate(sorted_counts)]
    heapq.heapify(heap)
    parent = np.zeros(2 * n - 1, dtype=np.int64)
    for k in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = k
        heapq.heappush(heap, (a[0] + b[0], k))
    depth = np.zeros(2 * n - 1, dtype=np.int64)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


def _longest(sorted_counts: np.ndarray) -> int:
    return int(_unlimited(sorted_counts).max())


class Code:
    """Code words from lengths alone: shorter first, then by id."""

    def __init__(self, lengths: np.ndarray, limit: int = LIMIT):
        self.limit = limit
        self.lengths = np.asarray(lengths, dtype=np.int64)
        used = np.flatnonzero(self.lengths)
        ordered = used[np.lexsort((used, self.lengths[used]))]
        size = np.left_shift(1, limit - self.lengths[ordered])
        start = np.concatenate([[0], np.cumsum(size)])
        if start[-1] > 2**limit:
            raise ValueError("the lengths are no prefix code")
        self.words = np.zeros(len(self.lengths), dtype=np.int64)
        self.words[ordered] = start[:-1] >> (limit - self.lengths[ordered])
        self.symbol = np.zeros(2**limit, dtype=np.uint32)
        self.symbol[: start[-1]] = np.repeat(ordered, size)
        self.step = self.lengths[self.symbol]

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bit string, and the bit offset of every LANE-th id."""
        if not len(ids):
            return b"", np.zeros(0, dtype=np.int64)
        n = self.lengths[ids]
        if not n.all():
            raise ValueError("an id has no code")
        ends = np.cumsum(n)
        begins = ends - n
        first = begins >> 3
        wide = self.words[ids] << (24 - (begins & 7) - n)  # at most 7 + LIMIT bits: three bytes
        size = int(ends[-1] + 7) // 8
        out = np.zeros(size + 3)
        for k, shift in enumerate((16, 8, 0)):  # bits of different ids never meet, so that adding is or-ing
            part = np.bincount(first, weights=(wide >> shift) & 255)
            out[k : k + len(part)] += part
        return out[:size].astype(np.uint8).tobytes(), begins[::LANE]

    def decode(self, payload: bytes, offsets: np.ndarray, count: int) -> np.ndarray:
        """All ids of a block; every lane is followed at once, an id at a time."""
        if not count:
            return np.zeros(0, dtype=np.uint32)
        data = np.frombuffer(payload + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
        windows = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
        at = np.array(offsets, dtype=np.int64)
        out = np.zeros((LANE, len(at)), dtype=np.uint32)
        last = windows.size - 1
        mask, spare = 2**self.limit - 1, 24 - self.limit
        for k in range(LANE):
            peek = (windows[np.minimum(at >> 3, last)] >> (spare - (at & 7))) & mask
            out[k] = self.symbol[peek]
            at += self.step[peek]
        return out.T.reshape(-1)[:count]
