import hashlib
from collections import Counter, defaultdict

import pytest

from annomatrix.llm import mixing


def brute_targets(sizes):
    """By repeated sharing, as the text of the rule has it."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.discard(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 40}, {"x": 7}, {"é": 0, "z": 30, "B": 3}, {"a": 0, None: 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == {k: pytest.approx(v) for k, v in brute_targets(sizes).items()}


def test_mix_comes_near_targets(spark, make_docs):
    rows = [(i, "w " * (1 + i % 7), ["hot", "hot", "hot", "a", "b", None][i % 6]) for i in range(1200)]
    docs = make_docs(rows, extra="taken")
    got = mixing.mix(docs, slice_rows=100).collect()
    again = mixing.mix(docs.repartition(5), slice_rows=100).collect()
    key = lambda r: (r.doc_id, r.taken, r.target)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == 1200
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.taken
        assert r.size == 1 + r.doc_id % 7 and 0 <= r.taken <= 3 * r.size and r.taken % r.size == 0
    targets = {r.source: r.target for r in got}
    assert sum(by.values()) <= sum(r.size for r in got)
    assert all(abs(by[s] - targets[s]) <= 14 for s in by)


def test_edges(spark, make_docs, edges):
    got = mixing.mix(make_docs(edges)).collect()
    assert len(got) == len(edges)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size) for r in got)[0] == (False, 0, 5)
    assert all(r.taken <= 3 * r.size for r in got)
    assert sum(r.taken for r in got) == sum(r.size for r in got)
    assert mixing.mix(make_docs([])).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(make_docs([(1, None), (2, " ")])).collect()] == [(0.0, 0)] * 2


def test_every_source_comes_near_its_target(spark):
    """Within 2 % or half of the source's longest document."""
    sf = "/root/testdata/sf0.1"
    by = defaultdict(list)
    for r in mixing.mix(spark.read.parquet(f"{sf}/documents.parquet")).collect():
        by[r.source].append(r)
    for rows in by.values():
        off = abs(sum(r.taken for r in rows) - rows[0].target)
        assert off <= max(0.02 * rows[0].target, max(r.size for r in rows) / 2)


def brute_queue(rows):
    """Copies of every source in the order of their middle finish times, until the budget is spent."""
    sizes, of = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r.source] += r.size
        of[r.source].append(r)
    goal, copies = brute_targets(sizes), []
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    for number, s in enumerate(names):
        place = lambda r: hashlib.md5(f"17|{'null' if r.doc_id is None else r.doc_id}|{r.mark}".encode()).hexdigest()[:15]
        queue, upto = sorted(of[s], key=lambda r: (place(r), r.doc_id is not None, r.doc_id)), 0
        for turn in range(3):
            for r in queue:
                upto += r.size
                if r.size:
                    copies.append(((upto - r.size / 2) / goal[s], number, place(r), r.doc_id is not None, r.doc_id, turn, r))
    spent, budget, out = 0, sum(sizes.values()), Counter()
    for *_, r in sorted(copies, key=lambda c: c[:-1]):
        spent += r.size
        if spent > budget:
            break
        out[r.doc_id, r.mark, r.source] += r.size
    return out


def test_queue_by_its_definition(spark, make_docs):
    rows = [(i % 190 if i else None, "w " * (1 + i * i % 41), ["hot", "hot", "x", None, "y"][i % 5]) for i in range(300)]
    rows += [(500, "long " * 2000, "y"), (501, None, "x"), (502, "", "void")]
    rows.append((2**53 + 1, "a", "x"))
    got = mixing.mix(make_docs(rows, extra="upto").repartition(3)).collect()
    taken = Counter()
    for r in got:
        taken[r.doc_id, r.mark, r.source] += r.taken
    want = brute_queue(got)
    assert {k: n for k, n in taken.items() if n} == dict(want) and len(got) == len(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_sql(spark, sf):
    from compare import assert_same

    assert_same(spark, mixing.query, mixing.ORACLE, f"/root/testdata/{sf}")
