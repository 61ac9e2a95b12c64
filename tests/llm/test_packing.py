import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from annomatrix.llm import packing, tokens


def check(rows, capacity):
    """rows: (key, start, length, sequence, offset); every id once, sequences without gaps."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for key, start, length, s, offset in rows:
        assert length > 0
        docs[key].append((start, length))
        seqs[s].append((offset, length))
    for parts in (*docs.values(), *seqs.values()):
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
    fills = [sum(n for _, n in p) for p in seqs.values()]
    assert max(fills, default=0) <= capacity
    return {k: sum(n for _, n in p) for k, p in docs.items()}, fills


def test_places_by_the_least_sum_of_squares():
    rng, ss = random.Random(2), packing.SumOfSquares(16)
    for _ in range(500):
        size, counts = rng.randint(1, 15), ss.counts.copy()
        best = None
        for h in range(17 - size):
            if h and not counts[h]:
                continue
            c = counts.copy()
            c[h] -= h > 0
            c[h + size] += h + size < 16
            best = min(best or (c @ c, -h), (c @ c, -h))
        assert ss.place(size) == -best[1] and ss.counts @ ss.counts == best[0]


@pytest.mark.parametrize("sizes", [[], [1], [1024], [5000, 1, 1023, 3, 2048], [300] * 50])
def test_pieces_cover_documents(sizes):
    got, fills = check(packing.pack_partition(iter(enumerate(sizes)), 1024), 1024)
    assert got == {i: n for i, n in enumerate(sizes)}
    assert sum(f < 1024 for f in fills) <= 1


def placed_share(tally):
    return tally["placed"] / max(1, tally["placed"] + tally["relaid"])


def test_small_partitions_are_packed_by_the_method():
    """32 partitions of some 300 documents of a table's sizes."""
    rng = np.random.default_rng(3)
    sizes = np.exp(rng.normal(6.44, 0.98, 10_000)).astype(int) + 1
    tally, padded = Counter(), 0
    for part in np.array_split(sizes, 32):
        got, fills = check(packing.pack_partition(iter(enumerate(part.tolist())), 1024, tally=tally), 1024)
        assert got == dict(enumerate(part.tolist()))
        padded += sum(f < 1024 for f in fills)
    assert placed_share(tally) > 0.75 and padded <= 32


@pytest.mark.parametrize("size", [600, 513, 1000, 1])
def test_open_sequences_are_bounded(size):
    """Pieces that never pair up are laid end to end before too many are held."""
    given = []
    most = 0

    def sizes():
        for i in range(3000):
            given.append(i)
            yield i, size

    done = set()
    rows = []
    for row in packing.pack_partition(sizes(), 1024, max_open=50):
        rows.append(row)
        done.add(row[0])
        if given[-1] < 2999:
            most = max(most, len(given) - len(done))
    got, fills = check(rows, 1024)
    assert got == dict.fromkeys(range(3000), size) and sum(f < 1024 for f in fills) <= 1
    assert most <= 51 * (1024 // size + 1)


def test_ids_beyond_doubles_beside_nulls(spark, make_docs):
    rows = [(2**53 + 1, "a b"), (None, None), (2**53 + 3, "c " * 3000)]
    got = packing.pack(make_docs(rows, extra="sequence_id").coalesce(1)).collect()
    assert {r.doc_id for r in got} == {2**53 + 1, None, 2**53 + 3}
    assert {r.doc_id: r.doc_tokens for r in got}[None] == 1


def test_spark_pack(spark, make_docs, edges):
    docs = make_docs(edges).repartition(2)
    rows = packing.pack(docs, 64).collect()
    encode = tokens.encoder(tokens.tokenizer_path()).encode
    texts = defaultdict(list)
    for d, t in edges:
        texts[d].append(np.append(np.frombuffer(encode(t), "<u2"), 0).astype("<u4"))
    _, fills = check([((r.sequence_id, r.offset), 0, r.length, r.sequence_id, r.offset) for r in rows], 64)
    assert sum(f < 64 for f in fills) <= 2
    assert sum(r.length for r in rows) == sum(len(x) for t in texts.values() for x in t)
    for r in rows:
        want = texts[r.doc_id][0]
        assert r.doc_tokens == len(want) and r.ids == want[r.start : r.start + r.length].tobytes()
    crc = {(r.sequence_id, r.offset): r.ids_crc32 for r in packing.digest(packing.pack(docs, 64)).collect()}
    assert all(crc[r.sequence_id, r.offset] == zlib.crc32(r.ids) for r in rows)
    assert packing.pack(make_docs([])).count() == 0


def test_pieces_are_written_in_small_batches(spark, monkeypatch):
    """What a Python worker gets at once is bounded by bytes while packing runs, whoever reads the pieces."""
    bounds = []
    materialize = packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: bounds.append(name) or materialize(df, name))
    docs = spark.createDataFrame([(i, "some words " * 300) for i in range(9)], "doc_id long, text string")
    pieces = packing.pack(docs)
    assert bounds == ["packed"] and {r.doc_id for r in pieces.collect()} == set(range(9))
