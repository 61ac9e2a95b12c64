import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import DIR
from test_near import brute as near_brute
from test_repeats import brute as repeats_brute
from tokenizers import Tokenizer

import corpus_pipeline
from annomatrix.llm import mixing, tokens
from annomatrix.llm.shared import materialize


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DIR), f"test-{name}")
        after[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    clean = [(r.doc_id, r.text) for r in after["toxicity"]]
    assert 150 < len(clean) < 200
    want = {d for d, _, _, kept in near_brute(clean, 80) if kept}
    assert {r.doc_id for r in after["near_dedup"]} == want
    left = [(r.doc_id, r.text) for r in after["near_dedup"]]
    removed = {d: n for d, _, n, _ in repeats_brute(left, 35)}
    for r in after["substring_dedup"]:
        before = dict(left)[r.doc_id]
        assert len(before.split()) - len(r.text.split()) == removed[r.doc_id]
    words = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    assert 0.9 * words(after["substring_dedup"]) <= words(after["mixing"]) <= words(after["substring_dedup"])
    assert max(Counter(r.doc_id for r in after["mixing"]).values()) <= 3
    t = Tokenizer.from_file(tokens.tokenizer_path())
    texts = {r.doc_id: r.text for r in after["mixing"]}
    total, ids = 0, {}
    for r in after["packing"]:
        if r.doc_id not in ids:
            ids[r.doc_id] = np.array([*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 0], dtype="<u4")
        assert r.ids == ids[r.doc_id][r.start : r.start + r.length].tobytes()
        total += r.length
    assert total == sum(len(ids[r.doc_id]) for r in after["mixing"])


def test_mixing_stage_takes_what_the_mix_says(spark, make_docs):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 2] if i % 5 else None) for i in range(200)]
    rows += [(7, "same text", "a")] * 4 + [(None, "no id", "b"), (300, None, "a"), (301, " ", "b")]
    docs = make_docs(rows, extra="times").repartition(3)
    want = Counter()
    for r in mixing.mix(docs).collect():
        if r.size:
            want[r.doc_id, r.source, r.mark] += r.taken // r.size
    out = corpus_pipeline.mix_sources(spark, docs, DIR)
    mark = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.source, mark(r.text)) for r in out.collect()) == +want
    assert out.columns == docs.columns


OWN = {
    "toxicity": ["severity", "rejected", "grade", "id", "toxic"],
    "near_dedup": ["_kept", "_nth", "row", "set", "component", "d1", "n", "node", "stay"],
    "substring_dedup": ["_id", "_mark", "_text", "_ranges", "row", "others", "n_words", "n_removed", "kept_sha256", "ranges"],
    "mixing": ["_d", "_m", "_s", "_times", "_turn", "times", "rows", "mark", "own_doc_id", "row", "size", "taken", "place"],
    "packing": ["ids", "start", "length", "sequence_id", "offset", "doc_tokens"],
}


@pytest.mark.parametrize("name", list(OWN))
def test_columns_named_as_a_stages_own(spark, edges, name):
    """They pass unchanged, and ids above 2**53 keep their bits."""
    names = OWN[name]
    base = [(2**53 + 1, "an id beyond doubles"), *edges]
    rows = [(d, t, "en", "s", len(t or ""), *[f"{d}-{t and t[:9]}"] * len(names)) for d, t in base]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    out = dict(corpus_pipeline.STAGES)[name](spark, docs, DIR)
    got = out.collect()
    assert 2**53 + 1 in {r.doc_id for r in got}
    if name != "packing":
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert all(r[n] == f"{r.doc_id}-{r.text and r.text[:9]}" for r in got for n in names if r.text)


def test_run_and_edges(spark, make_docs, edges):
    assert corpus_pipeline.run(spark, DIR).count() > 0
    for rows in ([], edges):
        docs = make_docs([(*r, None if i % 3 else "s") for i, r in enumerate(rows)], extra="taken")
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, DIR), "test-edges")
        seqs = defaultdict(int)
        for r in docs.collect():
            seqs[r.sequence_id] += r.length
        assert all(n <= 1024 for n in seqs.values())


def test_columns_of_any_name(spark):
    """Every stage but the last keeps columns with dots, backticks, spaces and names of its own, with their values."""
    names = ["a.b", "of.`it`", "row", "others", "size", "word count", "doc_id.x", "kept", "ranges"]
    docs = spark.createDataFrame([(i, f"w{i} " * 8 + "and so on", "en", f"s{i % 3}", 9, *[f"{c}{i}" for c in names]) for i in range(40)], ["doc_id", "text", "lang", "source", "n_chars", *names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, DIR), f"names-{name}")
        assert out.columns == docs.columns
        assert out.count() and all(r[names.index(c) + 5] == f"{c}{r[0]}" for r in out.collect() for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() >= 40
