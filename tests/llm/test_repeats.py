import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from annomatrix.llm import repeats, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, window):
    lists = [(d, WORD.findall((t or "").encode())) for d, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in lists for i in range(len(w) - window + 1))
    out = []
    for d, w in lists:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=repr)


def corpus(seed, n=60, alphabet=12):
    """Few different words, so that windows, anchors and ties repeat in every way."""
    rng = random.Random(seed)
    say = lambda k: [f"w{rng.randrange(alphabet)}" for _ in range(k)]
    passages = [say(rng.randint(5, 40)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else say(rng.randint(0, 15)) for _ in range(rng.randint(0, 5))]
        flat = [w for p in parts for w in p]
        if flat and rng.random() < 0.4:
            flat[rng.randrange(len(flat))] = "edit"
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(flat)))
    return rows


@pytest.mark.parametrize("seed,window,anchor,alphabet", [(1, 12, 4, 12), (2, 12, 4, 2), (3, 9, 9, 3), (4, 8, 1, 2)])
def test_against_brute_force(spark, make_docs, seed, window, anchor, alphabet):
    rows = corpus(seed, alphabet=alphabet)
    got = repeats.remove_repeats(make_docs(rows, extra="n_words").repartition(3), window, anchor)
    assert result(got) == brute(rows, window)


def test_edges(spark, make_docs, edges):
    rows = [*edges, (9, "a b " * 3), (10, "same " * 34), (11, "same " * 35), (12, " ".join(f"é{i}" for i in range(60))), (13, "x " + " ".join(f"é{i}" for i in range(20, 60)))]
    got = repeats.remove_repeats(make_docs(rows))
    assert result(got) == brute(rows, 35)
    assert set(got.columns) >= {"ids", "source", "lang"} and next(r.text for r in got.where("doc_id = 4").collect()) == "  \t\n "
    assert repeats.remove_repeats(make_docs([])).count() == 0


def test_words_that_a_polynomial_hash_confuses(spark, make_docs):
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(34)]
    rows = [(i, " ".join([*around[:17], x, *around[17:]])) for i, x in enumerate((one, other, "z" * 16, "z" * 15))]
    pair = lambda a, b: " ".join((a, b)[i.bit_count() % 2] for i in range(64))
    rows += [(10, pair("x", "y") + " p"), (11, pair("y", "x") + " q"), (12, one), (13, other)]
    got = result(repeats.remove_repeats(make_docs(rows)))
    assert got == brute(rows, 35) and not any(n for d, _, n, _ in got if d < 4)


def test_own_names_and_large_ids(spark):
    """Columns named as the operator's own stay as they are, and ids keep all bits beside a null."""
    names = ["_id", "_mark", "_text", "_ranges", "row", "ranges", "first", "many"]
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(2**53 + 1, text), (2**53 + 3, text + " x"), (None, text), (2**53 + 5, None)]
    docs = spark.createDataFrame([(*r, *[i] * len(names)) for i, r in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = repeats.remove_repeats(docs)
    assert result(got) == brute(rows, 35) and got.columns == [*docs.columns, *repeats.ADDED]
    assert {r.doc_id: r._text for r in got.collect()} == {r[0]: i for i, r in enumerate(rows)}


def test_query_on_the_table(spark):
    from compare import DIR, duck

    rows = duck().execute("select doc_id, text from documents").fetchall()
    assert result(repeats.query(spark, DIR)) == brute(rows, 35)


def test_words_do_not_depend_on_chunks(monkeypatch):
    texts = ["Ab  c\u000bd", "", None, "e", "ab c d", "Ab", " x" * 50]
    whole = [(lo, h.tolist(), b.tolist()) for lo, h, b in words.chunks(pa.array(texts))]
    assert len(whole) == 1
    monkeypatch.setattr(words, "CHUNK_BYTES", 1)
    parts = list(words.chunks(pa.array(texts)))
    assert np.concatenate([h for _, h, _ in parts]).tolist() == whole[0][1]
    assert np.diff(whole[0][2]).tolist() == [len((t or "").encode().split()) for t in texts]
    lower = next(iter(words.chunks(pa.array(["Ab É"]), lower=True)))
    assert len(lower[1]) == 2


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    from compare import assert_same

    assert_same(spark, repeats.query, repeats.ORACLE, f"/root/testdata/{sf}")
