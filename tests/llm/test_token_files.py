import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from annomatrix.llm import token_files, tokens
from annomatrix.llm.huffman import Code, code_lengths
from annomatrix.llm.shared import table_path


def library():
    t = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


ALPHABET = ["a", "b", "Zé", "ß", " ", " ", " ", "  ", "\n", " \n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", "　", "​"]
ALPHABET += [".", ",", "'s", "'ll", "1", "٣", "½", "中文", "🙂", "<|endoftext|>", "$", "_", "-", "é", "̀", "ʰ", "Ⅷ"]


def test_encoder_equals_the_library():
    encode, plain, rng = tokens.encoder(tokens.tokenizer_path()).encode, library(), random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(14)))
        assert np.frombuffer(encode(text), "<u2").tolist() == plain(text), repr(text)


def test_runs_of_texts_equal_the_library(monkeypatch):
    monkeypatch.setattr(tokens, "RUN_BYTES", 200)
    encoder, plain, rng = tokens.encoder(tokens.tokenizer_path()), library(), random.Random(4)
    texts = [None, "", " ", "one", *("".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40))) for _ in range(2000)), "x y, " * 200 + "z", None]
    for column in (pa.array(texts, pa.string()), pa.array(["cut", *texts])[1:]):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode_all(column)] == [plain(t) for t in texts]
    assert list(encoder.encode_all(pa.array([], pa.string()))) == []


@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60))
@settings(deadline=None, max_examples=60)
def test_code_is_a_short_prefix_code(counts):
    lengths = code_lengths(np.array(counts), 7)
    used = np.flatnonzero(counts)
    assert set(np.flatnonzero(lengths)) == set(used)
    if len(used) > 1:
        assert sum(2.0 ** -int(n) for n in lengths[used]) == 1.0 and lengths.max() <= 7
        free = code_lengths(np.array(counts), 40)
        cost = lambda n: int((n.astype(np.int64) * counts).sum())
        assert cost(free) <= cost(lengths)
        if free.max() <= 7:
            assert cost(free) == cost(lengths)
    ids = np.repeat(used, 3)
    code = Code(lengths, 7)
    payload, offsets = code.encode(ids)
    assert np.array_equal(code.decode(payload, offsets, len(ids)), ids)


def test_skewed_counts_hit_the_limit():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377, 610, 987, 1597, 2584, 4181, 6765])
    lengths = code_lengths(counts, 8)
    assert lengths.max() == 8 and sum(2.0 ** -int(n) for n in lengths) == 1.0
    ids = np.random.default_rng(1).integers(0, 20, 10_000)
    code = Code(lengths)
    payload, offsets = code.encode(ids)
    assert np.array_equal(code.decode(payload, offsets, len(ids)), ids)


@pytest.mark.parametrize("block", [4, 1 << 18])
def test_round_trip(spark, make_docs, edges, block):
    path, plain = table_path(spark, "t"), library()
    token_files.write(make_docs(edges).repartition(3), path, block_ids=block)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((d for d, _ in edges), key=lambda d: (d is not None, d))
    texts, start = {d: t for d, t in edges}, 0
    for r in got:
        want = [*plain(texts[r.doc_id]), 0]
        assert r.start == start and r.n_tokens == len(want) and np.frombuffer(r.ids, "<u4").tolist() == want
        start += len(want)


def test_ids_beyond_doubles_beside_nulls(spark, make_docs):
    rows = [(2**53 + 1, "a"), (None, "b"), (2**53 + 3, None), (-(2**53) - 1, "c"), *[(7, f"copy {i % 3}") for i in range(50)]]
    path = table_path(spark, "t")
    token_files.write(make_docs(rows, extra="hash").repartition(4), path, block_ids=16)
    got = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -(2**53) - 1, *[7] * 50, 2**53 + 1, 2**53 + 3]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()


def test_empty_table(spark, make_docs):
    path = table_path(spark, "t")
    token_files.write(make_docs([]), path)
    assert token_files.read(spark, path).count() == 0


def test_query_checksums(spark):
    from compare import DIR, duck

    plain, start = library(), 0
    got = {r.doc_id: r for r in token_files.query(spark, DIR).collect()}
    for d, text in duck().execute("select doc_id, text from documents order by doc_id").fetchall():
        ids = np.array([*plain(text), 0], dtype="<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(duck().execute("select 1 from documents").fetchall())
