import math

import numpy as np
import pytest

from annomatrix.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score int"


def brute(rows, k, every):
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries, out = {}, set()
    for i, v in use:
        if i % every == 0:
            queries[i] = min(v, queries.get(i, v))
    clip = lambda s: max(topk.LEAST, min(topk.MOST, s))
    for q, v in queries.items():
        found = sorted((-clip(sum(a * b for a, b in zip(v, w))), i) for i, w in use if i != q)[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(found)}
    return out


@pytest.mark.parametrize("shard", [7, 300])
def test_against_brute_force(spark, shard):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(200)]  # many ties
    rows += [(300, rng.normal(size=3).tolist()), (305, []), (310, None), (315, [1.0, None]), (320, [math.nan]), (325, [math.inf, 1.0]), (None, [1.0] * 5)]
    rows += [(5, rows[7][1]), (10, rows[10][1]), (330, rows[10][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)
    got = {tuple(r) for r in topk.top_k(df, every=5, shard_rows=shard, query_rows=16).collect()}
    assert got == brute(rows, 5, 5)


def test_few_empty_and_huge(spark):
    few = [(0, [1.0]), (1, [2.0]), (3, [1e30])]
    df = spark.createDataFrame([(*r, 1) for r in few], SCHEMA)
    assert {tuple(r) for r in topk.top_k(df).collect()} == brute(few, 5, 50)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 1")).count() == 0


def test_tree_prunes():
    rng = np.random.default_rng(1)
    points = np.repeat(rng.normal(size=(20, 4)) * 5000, 200, 0) + rng.normal(size=(4000, 4)) * 10
    points = np.floor(points)
    tree = topk.build(points, 64)
    asked = []
    real = topk.scores
    topk.scores = lambda q, p: asked.append(len(q) * len(p)) or real(q, p)
    try:
        topk.search(tree, points, np.arange(4000), points[:50], np.arange(50), np.full(50, topk.LEAST))
    finally:
        topk.scores = real
    assert sum(asked) < 0.4 * 50 * 4000


def test_near_vectors_share_shards_and_most_pairs_are_ruled_out(spark, monkeypatch):
    rng = np.random.default_rng(2)
    points = np.repeat(rng.normal(size=(30, 6)) * 40, 60, 0) + rng.normal(size=(1800, 6)) * 0.1
    rows = [(int(i), v.tolist()) for i, v in enumerate(points)]
    pairs, real = [], topk._meet_roots
    monkeypatch.setattr(topk, "_meet_roots", lambda a, s, n: pairs.append((real(a, s, n).count(), a.count() * n)) or real(a, s, n))
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(4)
    got = {tuple(r) for r in topk.top_k(df, every=10, shard_rows=50, query_rows=8).collect()}
    assert got == brute(rows, 5, 10)
    assert pairs[1][0] < 0.6 * pairs[1][1]


def test_components_near_the_largest_double(spark):
    rows = [(0, [1.0, 0.0]), (1, [1e308, -1e308]), (2, [-1e308, 1.0]), (3, [0.5, 0.25]), (50, [1e308, 1.0]), (51, [1.0, 1.0])]
    got = {tuple(r) for r in topk.top_k(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect()}
    big = 1.7976931348623157e308 / 256  # what 256 carries to the largest double
    assert got == brute([(i, [max(-big, min(big, x)) for x in v]) for i, v in rows], 5, 50)


def test_query_matches_sql(spark):
    from compare import assert_same

    assert_same(spark, topk.query, topk.ORACLE)


def test_long_vectors_make_small_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=10_000).tolist()) for i in range(60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(2)
    sizes = []
    monkeypatch.setattr(topk, "BLOCK_BYTES", 10 * 10_000 * 8)
    run, schema = topk._blocks(topk.SHARD_ROWS, True)
    for r in topk.vectors(df).coalesce(1).mapInPandas(run, schema).select("ids", "points").collect():
        sizes.append((len(r.ids) // 8, len(r.points)))
    assert sum(n for n, _ in sizes) == 60 and max(b for _, b in sizes) <= topk.BLOCK_BYTES and max(n for n, _ in sizes) == 10
    assert {tuple(r) for r in topk.top_k(df, every=20).collect()} == brute(rows, 5, 20)


def test_a_vector_above_the_bound_has_its_own_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 64)
    rows = [(i, [float(i + j) for j in range(2 if i % 3 else 50)]) for i in range(30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    assert {tuple(r) for r in topk.top_k(df, every=5).collect()} == brute(rows, 5, 5)


def test_numbers_of_shards_have_no_gaps(spark):
    blocks = spark.createDataFrame([((p << 32) + n,) for p, many in ((0, 3), (2, 1), (7, 4)) for n in range(many)], "block long")
    got = [r.shard for r in topk._numbered(blocks).orderBy("block").collect()]
    assert got == list(range(8))
