"""Distances of sources against a plain version, for every split of heavy and light terms and every size of tile."""

import random
import re
from collections import Counter, defaultdict
from math import isqrt

import pytest

from annomatrix.llm import divergence as D
from annomatrix.llm.catalogue import oracle_sql, queries
from tests.compare import assert_same

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least, top=50):
    docs = [(i, lang or "", source or "", "".join(c.lower() if c.isascii() else c for c in text or "")) for i, (text, lang, source) in enumerate(rows)]
    df, n, groups = defaultdict(set), Counter(), {}
    for i, lang, source, text in docs:
        groups[lang, source] = 0
        for t in TERM.findall(text):
            df[lang, t].add(i)
            n[lang, source, t] += 1
            n[lang, None, t] += 1
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), d in df.items() if x == lang and len(d) >= least]
        own = [s for x, s in groups if x == lang]
        total = {s: sum(n[lang, s, t] for t in kept) + 5 * len(kept) for s in [*own, None]}
        p = {(s, t): 1 + 10**9 * (n[lang, s, t] + 5) // total[s] for s in total for t in kept}
        for s in own:
            far = sorted((-sum(abs(p[s, t] - p[o, t]) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -v, i) for i, (v, o) in enumerate(far, 1)]
            most = sorted((p[None, t] - p[s, t], t.encode()) for t in kept if n[lang, s, t] and p[s, t] > p[None, t])[:top]
            out += [(lang, s, "term", t.decode(), -v, i) for i, (v, t) in enumerate(most, 1)]
    return sorted(out)


def made(spark, rows, extra=""):
    return spark.createDataFrame(rows, "text string, lang string, source string" + extra)


def texts(seed, many, sources):
    r = random.Random(seed)
    words = [f"w{chr(97 + isqrt(i))}{chr(97 + i % 26)}é" for i in range(60)]
    out = []
    for _ in range(many):
        k = min(int(r.expovariate(0.3)), sources - 1)
        out.append((" ".join(r.choice(words[: 5 + 9 * (k % 7)]) for _ in range(r.randrange(30))), r.choice(["en", "de", None]), f"s{k}" if k else None))
    return out


@pytest.mark.parametrize("share,light_max,block,tile", [(4, 256, 256, 4096), (1, 256, 3, 5), (10**9, 256, 4, 7), (2, 3, 2, 1), (3, 10**6, 5, 1000)])
def test_plain_version(spark, share, light_max, block, tile):
    rows = texts(share + block, 150, 12)
    got = D.divergence(made(spark, rows), 4, 6, share, light_max, block, tile).collect()
    assert sorted(map(tuple, got)) == plain(rows, 4, 6)


def test_edges(spark):
    long = "Ünï-Cödé x1y " * 20000
    rows = [(None, None, None), ("", "en", "a"), ("Aa aA", "en", "a"), ("aa b", "en", "b"), ("aa b", "en", "b"), (long, "en", None), ("  \t 12 ", "fr", "only"), ("aa", "", "z")]
    got = D.divergence(made(spark, [(*r, 7, "k") for r in rows], ", term int, value string"), 2).collect()
    assert sorted(map(tuple, got)) == plain(rows, 2)
    assert {r.value for r in D.divergence(made(spark, rows), 100).collect()} == {0}
    assert D.divergence(made(spark, rows).limit(0)).collect() == []


def test_large_counts_stay_exact(spark):
    sql = D._share("n", "total")
    cases = [(0, 5), (9 * 10**14, 9 * 10**14 + 77), (123456789012, 9 * 10**15), (3, 10**6 + 7)]
    got = spark.createDataFrame(cases, "n long, total long").selectExpr("n", "total", f"{sql} as p").collect()
    assert [r.p for r in got] == [1 + 10**9 * (n + 5) // total for n, total in cases]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql(spark, sf):
    assert_same(spark, queries()["op11_divergence"], oracle_sql()["op11_divergence"], f"/root/testdata/sf{sf}")
