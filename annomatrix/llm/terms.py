"""Terms of many texts, cut from the bytes of Arrow columns.

A term is a longest run of letters (or of letters and digits) and characters beyond ASCII, with A-Z lower-cased. As every
byte of a character beyond ASCII is above 0x7F, bytes decide, and no character is ever split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import LOWER, texts_of

LETTERS = np.zeros(256, dtype=bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True
#: Bytes of the texts that are cut together.
RUN_BYTES = 1 << 23


def terms_of(column: pa.Array, inside: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts of a column end to end, and bounds: text i has those from bounds[i] to bounds[i + 1]. A
    null text has none. inside marks the bytes that terms are made of."""
    data, ends = texts_of(column)
    own = LOWER[data[ends[0] : ends[-1]]]
    begins = ends - ends[0]
    held = inside[own]
    edge = np.zeros(len(own) + 1, dtype=bool)
    edge[begins] = True
    first = np.flatnonzero(held & (edge[:-1] | ~np.concatenate([[False], held[:-1]])))
    last = np.flatnonzero(held & (edge[1:] | ~np.concatenate([held[1:], [False]]))) + 1
    offsets = np.concatenate([[0], np.cumsum(last - first)])
    found = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(own[held]))
    return found.dictionary_encode(), np.searchsorted(first, begins)


def runs(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = RUN_BYTES) -> Iterator[pa.Table]:
    """The rows of several batches together, up to some size bytes of the column; a longer text is a run of its own."""
    held, total = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        total += batch.column(column).nbytes
        if total >= size:
            yield pa.Table.from_batches(held).combine_chunks()
            held, total = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def per_text(terms: pa.DictionaryArray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, times) of each distinct term of each text, in the order of texts and codes."""
    codes = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(terms.dictionary))
    key = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) * width + codes
    key, times = np.unique(key, return_counts=True)
    return key // width, key % width, times
