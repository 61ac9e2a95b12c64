import random
import re

import numpy as np
import pytest

from annomatrix.llm import near
from annomatrix.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute(rows, percent=85):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}
    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if d is not None and e is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((root(parent, d), root(parent, e)))
                parent[b] = a
    out = [(d, len(s), None if d is None else root(parent, d)) for d, s in sets]
    return sorted(((d, n, c, d == c) for d, n, c in out), key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=repr)


def corpus(seed, n):
    """Chains of edited copies around the threshold, in several groups."""
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(3000)}" for _ in range(k)]
    bases, rows = [say(rng.randint(40, 120)) for _ in range(5)], []
    for i in range(n):
        if rng.random() < 0.2:
            flat = say(rng.randint(0, 60))
        else:
            flat = list(rng.choice(bases))
            for _ in range(rng.randint(0, 3)):
                flat[rng.randrange(len(flat))] = f"w{rng.randrange(3000)}"
            if rng.random() < 0.3:
                bases.append(flat)
        rows.append((i, rng.choice([str.upper, str.lower])(rng.choice([" ", "\n\t"]).join(flat))))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 8)])
def test_against_brute_force(spark, make_docs, seed, block):
    rows = corpus(seed, 150)
    got = near.near_classes(make_docs(rows, extra="kept").repartition(3), block_docs=block)
    assert result(got) == brute(rows)


def test_edges(spark, make_docs, edges):
    rows = [*edges, (20, "a b c"), (21, "A B  c"), (22, "a b"), (23, None)]
    assert result(near.near_classes(make_docs(rows))) == brute(rows)
    assert near.near_classes(make_docs([])).count() == 0
    kept = near.keep(make_docs(rows, extra="component_id"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 7, None, 8, 20, 22, 23]))
    assert kept.columns == make_docs([], extra="component_id").columns


def test_ids_of_several_texts(spark, make_docs):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, b), (4, b), (4, a), (5, a), (5, ""), (6, c), (6, c + " end"), (7, c), (7, a), (9, None), (9, b), (None, a)]
    rows += [(10, "u v w x y z"), (10, "z y x w v u"), (11, "z y x w v u")]
    docs = make_docs(rows)
    assert result(near.near_classes(docs)) == brute(rows)
    kept = {(r.doc_id, r.text) for r in near.keep(docs).collect()}
    (of_c,) = {x for x in kept if x[0] == 6}
    assert of_c[1].startswith(c)
    want = {(3, b), (4, a), (5, ""), of_c, (9, None), (None, a), (10, rows[-3][1]), (10, rows[-2][1])}
    assert kept == want and near.keep(docs).count() == len(want)


def test_linked_matrix_and_forest():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(30)] + [np.zeros(0, dtype=np.uint64)]
    got = near.linked(sets, 50)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert got[i, j] == (len(a) > 0 and len(b) > 0 and 100 * both >= 50 * (len(a) + len(b) - both))
    chain = np.eye(6, k=1, dtype=bool)
    chain[3, 4] = False
    assert near.forest(chain | chain.T) == [(1, 0), (2, 0), (3, 0), (5, 4)]


@pytest.mark.parametrize("many", [0, 1 << 20])
def test_components(spark, monkeypatch, many):
    monkeypatch.setattr("annomatrix.llm.components.MANY", many)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)] + [(2000, i) for i in range(2001, 2500)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        lo, hi = sorted((root(parent, a), root(parent, b)))
        parent[hi] = lo
    want = {x: root(parent, x) for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_bands():
    for percent in (80, 85, 90):
        rows, bands = near.plan(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= 1e-6


def test_words_that_a_polynomial_hash_confuses(spark, make_docs):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, other), (3, other + " " + one), (4, one + " " + other)]
    assert result(near.near_classes(make_docs(rows))) == brute(rows)


def test_boilerplate_is_ruled_out_by_signatures(spark, make_docs, monkeypatch):
    """Pages that share two thirds of their words chain by bands; few of their pairs are compared on whole sets."""
    rng = random.Random(9)
    say = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    frame, rows = say(120), []
    for i in range(300):
        rows.append((i, " ".join(frame + say(60))))
        if i % 50 == 0:
            rows += [(1000 + 10 * i + k, rows[-1][1] + f" end{k}") for k in range(5)]
    compared, real = [], near._confirm

    def counted(tasks, texts, by, *rest):
        groups = tasks.groupBy(*by).agg({"*": "count"}).collect()
        compared.append(sum(r["count(1)"] ** 2 for r in groups))
        return real(tasks, texts, by, *rest)

    monkeypatch.setattr(near, "_confirm", counted)
    got = near.near_classes(make_docs(rows).repartition(3), block_docs=16)
    assert result(got) == brute(rows)
    assert len(compared) == 2 and sum(compared) < 0.05 * len(rows) ** 2


def test_signatures_lose_few_links():
    for percent in (80, 85, 95, 100):
        rows, bands = near.plan(percent)
        bits = near.apart(percent, rows * bands)
        draws = np.random.default_rng(1).binomial(rows * bands, (1 - percent / 100) / 2, 10**6)
        assert (draws > bits).mean() <= 1e-5 and bits < rows * bands / 4


def test_own_names_and_large_ids(spark):
    """Columns named as the operator's own stay as they are, and ids keep all bits beside a null."""
    names = ["id", "row", "set", "d1", "_kept", "_nth", "component", "n", "node"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2**53 + 1, text), (2**53 + 3, text + " x"), (None, text), (2**53 + 5, None), (2**53 + 1, text)]
    docs = spark.createDataFrame([(*r, *[i] * len(names)) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    assert result(near.near_classes(docs)) == brute(rows)
    kept = near.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2**53 + 1, None, 2**53 + 5]))


def test_query_on_the_table(spark):
    from compare import DIR, duck

    rows = duck().execute("select doc_id, text from documents").fetchall()
    assert result(near.query(spark, DIR)) == brute(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    from compare import assert_same

    assert_same(spark, near.query, near.ORACLE, f"/root/testdata/{sf}")
