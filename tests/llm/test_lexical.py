"""Ranks against a plain version, treaps against their definition, and how little of them is looked at."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from annomatrix.llm import lexical, treaps
from annomatrix.llm.catalogue import oracle_sql, queries
from tests.compare import assert_same

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(docs, items, k=20):
    own = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in own:
            m = 100 - 25 + (25 * sum(c.values()) * n) // length
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return out


def made(seed, n_docs, n_items, vocabulary=80):
    r = random.Random(seed)
    word = lambda: f"w{min(int(r.expovariate(0.08)), vocabulary)}é"
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(n_docs)]
    return docs, [(i, " ".join(word() for _ in range(r.randrange(1, 12)))) for i in range(n_items)]


def key(rows):
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("k,shard,block", [(5, 1 << 20, 1 << 23), (20, 40, 300), (1, 500, 1 << 23)])
def test_plain_version(spark, k, shard, block):
    docs, items = made(k, 300, 25)
    docs += docs[:40]
    got = lexical.lexical(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), k, shard, block)
    assert key(got.collect()) == key(plain(docs, items, k))


def test_edges(spark, make_docs, edges):
    docs = [*edges, (None, "one two"), (9, "one One ONE 1one"), (10, "Straße ÜBER")]
    items = [(1, "one six STRASSE Straße"), (1, "one six STRASSE Straße"), (2, None), (3, ""), (4, "nowhere"), (5, "word one one"), (None, "a text x"), (6, "x" * 30000)]
    made_items = spark.createDataFrame([(*r, 3, "s") for r in items], "item_id long, text string, score int, rank string")
    got = lexical.lexical(make_docs(docs, "rank"), made_items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert key(got.collect()) == key(plain(docs, items))
    assert lexical.lexical(make_docs(docs).limit(0), made_items).collect() == []
    assert lexical.lexical(make_docs(docs), made_items.limit(0)).collect() == []


def test_treaps_are_in_both_orders():
    r = np.random.default_rng(3)
    held = r.random((7, 200)) < np.array([0.02, 0.1, 0.3, 0.5, 0.9, 1, 0])[:, None]
    doc, term = np.nonzero(held.T)
    t = treaps.build(term, doc, r.integers(1, 9, len(term)), 7, 200)

    def walk(node, top):
        if node < 0:
            return []
        assert t.impact[node] <= top
        return [*walk(t.left[node], t.impact[node]), t.doc[node], *walk(t.right[node], t.impact[node])]

    for i in range(7):
        assert walk(t.root[i], 99) == np.flatnonzero(held[i]).tolist()


def test_equal_impacts_stay_shallow():
    n = 4096
    t = treaps.build(np.zeros(n, dtype=int), np.arange(n), np.ones(n, dtype=int), 1, n)
    level, depth = np.array([t.root[0]]), 0
    while len(level):
        depth, level = depth + 1, np.concatenate([t.left[level], t.right[level]])
        level = level[level >= 0]
    assert depth <= 13


def test_most_states_are_ruled_out():
    """Documents that hold the whole query leave little of the others to look at."""
    r, n = np.random.default_rng(0), 5000
    held = r.random((30, n)) < 0.2
    held[:, ::200] = True
    doc, term = np.nonzero(held.T)
    t = treaps.build(term, doc, r.integers(50, 100, len(term)), 30, n)
    best = treaps.Best(1, 20)
    seen = treaps.search(t, treaps.Queries(np.array([0, 30]), np.arange(30), np.ones(30, dtype=int)), np.arange(n), np.zeros(n, dtype=bool), best)
    assert set(best.id) <= set(range(0, n, 200)) and seen < n


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql(spark, sf):
    assert_same(spark, queries()["op13_lexical"], oracle_sql()["op13_lexical"], f"/root/testdata/sf{sf}")
