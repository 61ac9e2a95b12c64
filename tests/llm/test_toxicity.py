import random

import numpy as np
import pytest

from annomatrix.llm import toxicity

BAD = ["grumble", "snarl", "vex", "scoff", "jeer", "sneer"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        flat = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(20, 60))]
        toxic = rng.random() < 0.2
        for _ in range(rng.randint(1, 8) if toxic else 0):
            flat[rng.randrange(len(flat))] = rng.choice(BAD).upper() + ","
        rows.append((i, " ".join(flat), toxic and any(w.lower()[:-1] in BAD for w in flat)))
    return rows


def test_ordinal_fit_finds_order():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 6)) < 0.3
    w = np.array([2.0, 1.0, 0.0, -1.0, 3.0, 0.5])
    latent = x @ w + rng.logistic(size=3000)
    grades = np.searchsorted([1.0, 2.5, 4.0], latent)
    r, c = np.nonzero(x)
    got, t = toxicity.fit_ordinal(r, c, grades, 6, 3)
    assert np.allclose(got, w, atol=0.35) and np.allclose(t, [1.0, 2.5, 4.0], atol=0.35) and (np.diff(t) > 0).all()


def test_held_out_accuracy(spark, make_docs):
    rows = corpus(900, 4)
    docs = make_docs([r[:2] for r in rows], extra="severity")
    labels = spark.createDataFrame([(i, 1, int(t)) for i, _, t in rows[:500]] + [(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [(got[i].rejected, t) for i, _, t in rows[500:]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    many = [got[i].severity for i, x, t in rows[500:] if t and sum(x.lower().count(b) for b in BAD) >= 5]
    few = [got[i].severity for i, x, t in rows[500:] if t and sum(x.lower().count(b) for b in BAD) == 1]
    assert np.mean(many) > np.mean(few)  # severity is ordered
    kept = toxicity.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in got.values())


def test_training_rows_are_bounded(spark, make_docs, monkeypatch):
    rows = [(i, ("snarl " if i % 2 else "calm ") + f"w{i}", i % 2) for i in range(40)]
    docs = make_docs([r[:2] for r in rows] + [(1, "snarl again")] * 300)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(i, 0) for i in range(1000, 3000)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.fit_ordinal
    monkeypatch.setattr(toxicity, "fit_ordinal", lambda r, c, grades, *a, **b: seen.append(len(grades)) or fit(r, c, grades, *a, **b))
    toxicity.fit(docs, labels, max_train=30)
    assert seen == [30]


def test_edges(spark, make_docs, edges):
    docs = make_docs(edges)
    schema = "doc_id long, toxic int"
    for labels in ([], [(1, 0), (2, 0)], [(1, 1)]):
        got = toxicity.score(docs, spark.createDataFrame(labels, schema)).collect()
        assert len(got) == len(edges) and not any(r.rejected for r in got)
    assert toxicity.score(make_docs([]), spark.createDataFrame([(1, 1), (2, 0)], schema)).count() == 0
    got = toxicity.score(docs, spark.createDataFrame([(1, 0), (5, 1), (5, 0), (7, 0)], schema)).collect()
    assert len(got) == len(edges)


def test_accuracy_on_the_tables(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    half = labels.where("doc_id % 2 = 0")
    got = toxicity.score(docs, half).join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r.toxic, r.rejected): r["count"] for r in got}
    recall = n.get((1, True), 0) / (n.get((1, True), 0) + n.get((1, False), 0))
    false = n.get((0, True), 0) / (n.get((0, True), 0) + n.get((0, False), 0))
    print(n, recall, false)
    assert recall >= 0.8 and false <= 0.01  # 2,000 labelled documents in four languages
