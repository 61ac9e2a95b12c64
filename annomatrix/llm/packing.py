"""Sequences of at most CAPACITY tokens from whole documents, by sum-of-squares packing.

Full sequences are cut off the front of a document first. The rest goes, online, to the fill level that makes the sum
over levels of squared counts of partly filled sequences least. Levels are QUANTUM tokens wide, so that a few dozen open
sequences are enough for pieces to meet their match: what exceeds a sequence by less than a level is cut off and placed
next. The state is one count and one stack per level.

At most MAX_OPEN sequences are open; beyond that those of the most frequent level are laid end to end, and at the end of
a partition all that are open, into full ones, so that at most one sequence of a partition is padded, and none where its
length is a power of two. Partitions are packed apart, so the padding grows with partitions and not with documents.

A null text has only its end id. A null doc_id is kept as it is, and one of any size. Rows that share a doc_id, repeated
rows too, are packed as separate documents. A text of any length is packed whole. An empty table gives no piece. Other
columns, whatever their names, are not read. Sequence ids are unique: the partition in the upper bits, a running number
from 0 in the lower 40.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import materialize, scratch

CAPACITY = 1024
QUANTUM = 32
MAX_OPEN = 1024
PART_BITS = 40
Piece = tuple[object, int, int, int, int]


class SumOfSquares:
    """Open sequences by fill level. A level holds the fills above the next lower multiple of quantum up to its own."""

    def __init__(self, capacity: int, quantum: int = 1):
        self.capacity, self.quantum = capacity, quantum
        self.n = [0] * (self.level(capacity) + 1)
        self.open: list[list[tuple[int, int]]] = [[] for _ in self.n]  # (fill, sequence)
        self.next = 0
        self.sequence = -1

    def level(self, fill: int) -> int:
        return -(-fill // self.quantum)

    @property
    def counts(self) -> np.ndarray:
        return np.array(self.n, dtype=np.int64)

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def put(self, fill: int, sequence: int) -> None:
        at = self.level(fill)
        self.n[at] += 1
        self.open[at].append((fill, sequence))

    def place(self, size: int) -> int:
        """The fill at which a piece goes into self.sequence; 0 opens one. Moving a sequence from level a to b changes
        the sum by 2 (N[b] - N[a] + 1), filling it up by 1 - 2 N[a], a new one by 2 N[b] + 1. Ties go to the fullest."""
        n, top, beyond = self.n, self.capacity, self.capacity + self.quantum
        best, at = 2 * n[self.level(size)] + 1 if size < top else 0, -1
        for a, held in enumerate(self.open):
            if not held:
                continue
            after = held[-1][0] + size
            if after >= beyond:
                break  # fuller levels have no room either
            b = self.level(after)
            change = 1 - 2 * n[a] if after >= top else 2 * (n[b] - n[a] + 1) if a != b else 0
            if change <= best:
                best, at = change, a
        if at < 0:
            fill, self.sequence = 0, self.number()
        else:
            fill, self.sequence = self.open[at].pop()
            n[at] -= 1
        if fill + size < top:
            self.put(fill + size, self.sequence)
        return fill

    def fullest(self) -> list[int]:
        """Takes out the sequences of the most frequent level."""
        at = self.n.index(max(self.n))
        out, self.open[at], self.n[at] = [s for _, s in self.open[at]], [], 0
        return out


def _end_to_end(pieces: list[tuple], sequences: list[int], capacity: int) -> Iterator[list[Piece]]:
    """The pieces of some sequences in as few of them: full ones, and one more at the end."""
    numbers, row, fill = iter(sequences), [], capacity
    for key, start, length in pieces:
        while length:
            if fill == capacity:
                if row:
                    yield row
                s, fill, row = next(numbers), 0, []
            cut = min(length, capacity - fill)
            row.append((key, start, cut, s, fill))
            start, length, fill = start + cut, length - cut, fill + cut
    if row:
        yield row


def pack_partition(sizes: Iterator[tuple[object, int]], capacity: int, quantum: int = QUANTUM, max_open: int = MAX_OPEN, tally: Counter | None = None) -> Iterator[Piece]:
    """sizes: (key, tokens) of each document. Yields (key, start, length, sequence, offset). tally counts sequences
    closed by being placed into, of one document's own tokens (whole), and laid end to end (relaid)."""
    levels = SumOfSquares(capacity, quantum)
    pieces: dict[int, list[tuple]] = {}  # of open sequences: key, start, length
    tally = Counter() if tally is None else tally

    def relay(some: list[int], end: bool) -> Iterator[Piece]:
        flat = [p for s in some for p in pieces.pop(s)]
        for row in _end_to_end(flat, some, capacity):
            *_, length, s, offset = row[-1]
            if offset + length < capacity and not end:
                pieces[s] = [p[:3] for p in row]
                levels.put(offset + length, s)
                return
            tally["relaid"] += 1
            yield from row

    for key, n in sizes:
        start = 0
        while n - start >= capacity:
            yield key, start, capacity, levels.number(), 0
            start += capacity
            tally["whole"] += 1
        while start < n:
            fill = levels.place(n - start)
            length, s = min(n - start, capacity - fill), levels.sequence
            pieces.setdefault(s, []).append((key, start, length))
            start += length
            if fill + length == capacity:
                tally["placed"] += 1
                at = 0
                for k, first, size in pieces.pop(s):
                    yield k, first, size, s, at
                    at += size
        if len(pieces) > max_open:
            yield from relay(levels.fullest(), False)
    yield from relay(sorted(pieces), True)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    No shuffle: each partition packs what it reads, a batch's ids at a time, and holds besides these the ids of open
    sequences. Runs when called, so that batches are bounded by bytes whoever reads the pieces, and writes them."""
    path = tokenizer or tokens.tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all = tokens.encoder(path, 2).encode_all
        end = tokens.END_ID.to_bytes(2, "little")
        base = TaskContext.get().partitionId() << PART_BITS
        held: dict[int, list] = {}  # row number: doc_id, ids from some token on, that token, all tokens, those not yet given out

        def sizes() -> Iterator[tuple[int, int]]:
            row = 0
            for batch in batches:
                for d, text_ids in zip(batch.column("doc_id").to_pylist(), encode_all(batch.column("text")), strict=True):
                    ids = text_ids + end
                    held[row] = [d, ids, 0, len(ids) // 2, len(ids) // 2]
                    yield row, len(ids) // 2
                    row += 1

        out: list[tuple] = []
        size = 0
        for row, start, length, s, offset in pack_partition(sizes(), capacity):
            own = held[row]
            d, ids, skipped, total, left = own
            at = 2 * (start - skipped)
            piece = np.frombuffer(ids[at : at + 2 * length], dtype="<u2").astype("<u4").tobytes()
            out.append((d, start, length, piece, total, base + s, offset))
            if left == length:
                del held[row]
            else:
                own[4] = left - length
                if left - length < capacity and len(ids) > 2 * capacity:  # the last full sequence: keep what is behind it
                    own[1:3] = ids[at + 2 * length :], start + length
            size += length
            if size > 1 << 20:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = source.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    with scratch(docs.sparkSession) as kept:
        pieces = materialize(pieces, "packed")
        kept.append(pieces)
    return pieces


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs the whole documents table."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))
