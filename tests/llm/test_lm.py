"""The model against its definition and its derivatives, base scores against a plain version, and held-out accuracy."""

import math
import re
import zlib
from collections import Counter
from copy import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from annomatrix.llm import attention, lm
from annomatrix.llm.catalogue import queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def small():
    r = np.random.default_rng(5)
    prior = attention.Prior(r.integers(0, 9, (12, 12)).astype(float), 3)
    params = attention.start(12, 3, 1)
    for c in ("class", "member"):
        params[c] = r.normal(size=params[c].shape).astype(np.float32)
    lengths = np.array([1, 30, 0, 8, 9, 77])
    last, target = r.integers(0, 12, (2, lengths.sum()))
    return attention.Model(params, prior), (last, target, lengths)


def plain_log_prob(model, last, target):
    """One position after the other, in doubles, with the window's context only."""
    p, out = {c: v.astype(float) for c, v in model.p.items()}, []
    for i in range(len(last)):
        block = i - i % attention.STRIDE
        at = np.arange(max(0, block - attention.CONTEXT), i + 1)
        mixed = []
        for h in range(attention.HEADS):
            s = p["key"][h][last[at]] @ p["query"][h][last[i]] / attention.WIDTH**0.5 + p["lag"][h][i - at]
            w = np.exp(s) / np.exp(s).sum()
            mixed.append(w @ p["value"][h][last[at]])
        x = np.maximum(np.concatenate(mixed) + p["own"][last[i]], 0)
        c, m = divmod(target[i], model.members)
        top = model.prior.of_class[last[i]] + x @ p["class"]
        low = model.prior.of_member[last[i] * model.classes + c] + x @ p["member"][c]
        out.append(top[c] - np.log(np.exp(top).sum()) + low[m] - np.log(np.exp(low).sum()))
    return np.array(out)


def batched(model, texts, size=7):
    return np.concatenate([model.log_probs(*b) for b in attention.batches(texts, size)])


def test_batches_are_the_plain_model(small):
    model, texts = small
    ends = np.cumsum(texts[2])
    want = [plain_log_prob(model, texts[0][e - n : e], texts[1][e - n : e]) for e, n in zip(ends, texts[2], strict=True)]
    for size in (1, 7, 1000):
        assert np.allclose(batched(model, texts, size), np.concatenate(want), atol=1e-4)


def test_probabilities_sum_to_one_and_look_back_only(small):
    model, (last, target, lengths) = small
    total = sum(np.exp(batched(model, (last, np.full_like(target, t), lengths))) for t in range(12))
    assert np.allclose(total, 1, atol=1e-4)
    changed = last.copy()
    changed[-20:] = (changed[-20:] + 5) % 12
    was, now = (batched(model, (x, target, lengths)) for x in (last, changed))
    assert np.allclose(was[:-20], now[:-20], atol=1e-5) and not np.allclose(was[-20:], now[-20:], atol=1e-3)


def test_derivatives(small):
    model, texts = small
    prior = copy(model.prior)
    prior.of_class, prior.of_member = prior.of_class.astype(float), prior.of_member.astype(float)
    model = attention.Model({c: x.astype(float) for c, x in model.p.items()}, prior)
    batch = next(attention.batches(texts, 1000))
    _, g = model.gradient(*batch)
    r = np.random.default_rng(0)
    for c, x in model.p.items():
        for _ in range(12):
            at = tuple(r.integers(0, n) for n in x.shape)
            kept, ends = x[at], []
            for step in (1e-5, -1e-5):
                x[at] = kept + step
                ends.append(-model.log_probs(*batch).astype(float).mean())
            x[at] = kept
            assert abs((ends[0] - ends[1]) / 2e-5 - g[c][at]) < 1e-4, c


def words(text):
    return re.findall("[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 5 == 1


def plain_base(rows):
    c = Counter(w for d, t in rows if not held(d) for w in [*words(t), "\n"])
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(words(t)) + 1, sum(w in c for w in [*words(t), "\n"]), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(t), "\n"])) for d, t in rows]


def same(got, rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted((tuple(r)[:6] for r in got), key=order), sorted(plain_base(rows), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9, atol=1e-8)


@pytest.mark.parametrize("frequent", [1, 40, 1 << 20])
def test_edges(spark, make_docs, edges, frequent):
    rows = [*edges, *[(i, f"common words {i % 3} rare{i}") for i in range(20, 60)]]
    got = lm.scores(make_docs(rows, "score"), rounds=1, frequent=frequent).collect()
    same(got, rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_nothing_to_learn_from(spark, make_docs):
    rows = [(i, "a b") for i in range(100) if held(i)][:3]
    same(lm.scores(make_docs(rows)).collect(), rows)
    assert lm.scores(make_docs(rows).limit(0)).collect() == []


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    same(queries()["op12_lm"](spark, "/root/testdata/sf0.001").collect(), rows)


def test_held_out_texts(spark):
    """On texts it has not seen, the model beats the counts of words, where 3 million words are there to learn from."""
    new = queries()["op12_lm"](spark, "/root/testdata/sf0.1").where("held_out").collect()
    assert sum(r.score for r in new) > 0.96 * sum(r.base_score for r in new)
    few = [r for r in new if r.n_tokens > 50 and r.n_known < 0.9 * r.n_tokens]
    assert sum(r.score > r.base_score for r in few) > 0.9 * len(few) > 0


def test_order_matters(spark, make_docs):
    """A text with its words in another order has the same base score and another score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    some = docs.where("doc_id < 300")
    turned = some.select((F.col("doc_id") + 10**6).alias("doc_id"), F.array_join(F.reverse(F.split(F.trim(F.regexp_replace("text", r"[ \t-\r]+", " ")), " ")), " ").alias("text"))
    got = {r.doc_id: r for r in lm.scores(some.unionByName(turned), rounds=1).collect()}
    pairs = [(got[d], got[d + 10**6]) for d in range(300) if d in got and got[d].n_tokens > 20]
    assert all(math.isclose(a.base_score, b.base_score, rel_tol=1e-9) for a, b in pairs)
    assert sum(a.score != b.score for a, b in pairs) > 0.95 * len(pairs)


def test_every_window_is_trained_on(spark, monkeypatch):
    """The rounds of a fit take each target of the training texts once."""
    r = np.random.default_rng(3)
    texts = [r.integers(0, 40, n).astype("<u2").tobytes() for n in (1, 9, 200, 75)]
    counted = []
    averaged = lm._averaged

    def counting(ids, params, prior, slots, every, nth):
        trained = ids.mapInArrow(lm._trained(params, prior, slots, every, nth), "chunk long, n long, sums binary")
        counted.append(trained.where("chunk = 0").agg(F.sum("n")).first()[0] or 0)
        return averaged(ids, params, prior, slots, every, nth)

    monkeypatch.setattr(lm, "_averaged", counting)
    lm.fit(spark.createDataFrame([(t,) for t in texts], "ids binary"), 40, 0, 16, 4, rounds=3)
    assert len(counted) == 3 and sum(counted) == 285


def test_steps_are_plain_steps_over_one_vector():
    r = np.random.default_rng(1)
    params = {c: x.astype(np.float32) for c, x in attention.start(12, 3, 1).items()}
    want = {c: x.astype(float) for c, x in params.items()}
    m, v = ({c: np.zeros_like(x) for c, x in want.items()} for _ in range(2))
    adam, (a, b) = attention.Adam(params), attention.DECAY
    assert all(np.shares_memory(x, adam.flat) for x in params.values())
    for t in range(1, 30):
        g = {c: (r.normal(size=x.shape) * (r.random(x.shape) < 0.5)).astype(np.float32) for c, x in params.items()}
        adam.step(params, g)
        for c, x in want.items():
            m[c], v[c] = a * m[c] + (1 - a) * g[c], b * v[c] + (1 - b) * g[c].astype(float) ** 2
            x -= attention.RATE * m[c] / (1 - a**t) / (np.sqrt(v[c] / (1 - b**t)) + 1e-8 / (1 - b**t) ** 0.5)
            if c in ("query", "key", "lag"):
                np.clip(x, *((-30, 10) if c == "lag" else (-attention.LARGEST, attention.LARGEST)), out=x)
    assert all(np.allclose(params[c], x, atol=1e-5) for c, x in want.items())


def test_sums_by_slot(small):
    model, _ = small
    r = np.random.default_rng(2)
    slots = r.integers(0, 12, (9, 5))
    for kind in (np.float32, np.float64):
        rows = r.normal(size=(9, 5, 4)).astype(kind)
        want = np.stack([rows[slots == s].sum(0) for s in range(12)])
        got = model._by_slot(slots, rows)
        assert got.dtype == kind and np.allclose(got, want, atol=1e-5)


def test_only_words_that_are_not_frequent_are_sorted(spark, monkeypatch):
    """Coding a text sorts no word whose count every task has."""
    import pyarrow as pa

    table = pa.table({"row": [0, 1, 2], "doc_id": [0, 1, 2], "held_out": [False] * 3, "text": ["a b a rare", None, "b new b"]})
    sorted_words, per_text = [], lm.per_text
    monkeypatch.setattr(lm, "per_text", lambda terms, bounds: sorted_words.extend(terms.to_pylist()) or per_text(terms, bounds))

    class Few:
        value = (pa.array(["a", "b"], pa.large_string()), np.array([2, 3]))

    (out,) = lm._code(Few, (9, 5, 3), lm.tokenizer_path())(iter(table.to_batches()))
    assert sorted_words == ["rare", "new"]
    assert out.column("words").to_pylist() == [["rare"], [], ["new"]] and out.column("times").to_pylist() == [[1], [], [1]]
    assert out.column("n_known").to_pylist() == [4, 1, 3] and out.column("n_tokens").to_pylist() == [5, 1, 4]
