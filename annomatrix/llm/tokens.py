"""Token ids of whole texts, by a public tokenizer.

The tokenizer encodes a text in pieces of its own: mostly a space and the word behind it. Pieces repeat a lot, so a run
of texts looks each distinct word up once, and each worker remembers the ids of the ones it met lately, up to a fixed
number, and asks the tokenizers library for the rest. What the library gives for a piece does not depend on its
surroundings as long as no run of white space is cut; texts with longer runs, and those that hold a special token, are
split or encoded another way with the same result.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

FILE = "byte_bpe_50k.json"
END_ID = 0
#: The characters that the tokenizer's pattern takes as white space.
SPACE = "\t-\r \x85\xa0  -     　"
CHUNK = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
AFTER_SPACE = re.compile(f"[{SPACE}] ")
ANY_SPACE = re.compile(f"[{SPACE}]")
#: Pieces that a worker remembers, some 150 bytes each.
REMEMBERED = 500_000
LONGEST = 64
#: Bytes of the texts whose words are looked up together.
RUN_BYTES = 1 << 22


def tokenizer_path(name: str = FILE) -> str:
    return public_tokenizers.path(name)


class Encoder(dict):
    """Word of Latin letters to the ids of a space and that word, as little-endian unsigned bytes of the given width."""

    def __init__(self, path: str, width: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 256**width:
            raise ValueError(f"{self.tokenizer.get_vocab_size()} ids do not fit {width} bytes")
        self.split, self.model = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.model.tokenize
        self.width, self.code = width, {2: "H", 4: "I"}[width]
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Texts that do not fall apart at single spaces.
        self.odd = "|".join([*map(re.escape, self.specials), f"[{SPACE}] ", r" \z"])
        self.lead = self.split(" a")[0][0][:-1]
        #: How the library writes the letters of Latin scripts, byte by byte.
        self.letters = {c: self.split(chr(c))[0][0] for c in range(128, 592) if chr(c).isalpha()}
        self.latin = re.compile("[A-Za-z" + "".join(map(chr, self.letters)) + "]+").fullmatch
        self.marks = {c: self.pieces(c) for c in ".,!?:;"}
        #: Words with other characters, and line breaks with a word.
        self.others: dict[str, bytes] = {}
        self.forgone = 0

    def packed(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def pieces(self, chunk: str) -> bytes:
        """Ids of a chunk, from the library's own split and model."""
        return self.packed([t.id for part, _ in self.split(chunk) for t in self.model(part)])

    def keep(self, key: str, ids: bytes) -> bytes:
        """Remembers the first pieces, and starts anew once many others have come by."""
        if len(self) < REMEMBERED:
            if len(key) <= LONGEST:
                self[key] = ids
        else:
            self.forgone += 1
            if self.forgone > 8 * REMEMBERED:
                self.forgone = 0
                self.clear()
        return ids

    def keep_other(self, key: str) -> bytes:
        if (ids := self.others.get(key)) is None:
            ids = self.pieces(key)
            if len(self.others) < REMEMBERED // 4 and len(key) <= LONGEST:
                self.others[key] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        marked = word and word[-1] in self.marks
        if marked and (ids := self.get(word[:-1])) is not None:
            return ids + self.marks[word[-1]]
        if self.latin(word):
            ids = [t.id for t in self.model(self.lead + (word if word.isascii() else word.translate(self.letters)))]
            return self.keep(word, self.packed(ids))
        if marked and self.latin(word[:-1]):
            return self[word[:-1]] + self.marks[word[-1]]
        if ANY_SPACE.search(word):
            return b"".join(map(self.chunk, CHUNK.findall(" " + word)))
        return self.keep_other(" " + word)

    def chunk(self, chunk: str) -> bytes:
        """White space and the run behind it. A line break and a word are remembered as one."""
        head = chunk[0]
        if len(chunk) > 1 and (head == " " or head == "\n") and not ANY_SPACE.match(chunk[1]):
            if head == " ":
                return self[chunk[1:]]
            return self.keep_other(chunk)
        return self.pieces(chunk)

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text, without an end id. A null text has none."""
        if not text:
            return b""
        if any(s in text for s in self.specials):
            return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if text[-1] == " " or "  " in text or AFTER_SPACE.search(text):
            return b"".join(map(self.chunk, CHUNK.findall(text)))
        first, *words = text.split(" ")
        return self.first(first) + b"".join(map(self.__getitem__, words))

    def first(self, word: str) -> bytes:
        """Ids of a text's first word, which has no space before it."""
        return b"".join(map(self.chunk, CHUNK.findall(word)))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of every text, in runs of some RUN_BYTES."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(ends):
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + RUN_BYTES, side="right")))
            yield from self._run(texts[lo:hi])
            lo = hi

    def _run(self, texts: pa.Array) -> list[bytes]:
        odd = pc.fill_null(pc.match_substring_regex(texts, self.odd), False).to_numpy(zero_copy_only=False)
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False).to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        for i in np.flatnonzero(odd):
            out[i] = self.encode(texts[int(i)].as_py())
        plain = np.flatnonzero(some & ~odd)
        if not len(plain):
            return out
        lists = pc.split_pattern(texts.take(pa.array(plain)), " ")
        bounds, words = lists.offsets.to_numpy(), lists.flatten()
        heads = bounds[:-1]
        coded = words.dictionary_encode()
        distinct = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py().split(" ")
        known = [*map(self.__getitem__, distinct), *map(self.first, words.take(pa.array(heads)).to_pylist())]
        which = coded.indices.to_numpy().copy()
        which[heads] = len(distinct) + np.arange(len(heads))
        ids, size = np.frombuffer(b"".join(known), dtype=f"<u{self.width}"), np.fromiter(map(len, known), np.int64, len(known)) // self.width
        n = size[which]
        ends = np.cumsum(n)
        source = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[which] - (ends - n), n)
        stops = np.concatenate([[0], ends])[bounds]
        joined = ids[source].tobytes()
        for i, a, b in zip(plain.tolist(), (stops[:-1] * self.width).tolist(), (stops[1:] * self.width).tolist(), strict=True):
            out[i] = joined[a:b]
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, width: int = 2) -> Encoder:
    """The worker's own encoder; tasks that share a worker share what it remembers."""
    if (path, width) not in _encoders:
        _encoders[path, width] = Encoder(path, width)
    return _encoders[path, width]
