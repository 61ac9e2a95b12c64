"""Neighbours, perplexities and the gradient against plain versions, and what the result keeps of neighbourhoods."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from annomatrix import operators as O
from annomatrix.operators import embedding as T
from annomatrix.operators.neighbors import nearest
from annomatrix.plans.matrices import vectors

SF = "/root/testdata/sf0.01"


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "obs_idx long, vec array<double>")


def squared(x):
    return ((x[:, None] - x) ** 2).sum(2)


def recall(found, x, k):
    d = squared(x)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, 1, kind="stable")[:, :k]
    return np.mean([len({n.other for n in r.near} & set(true[r.obs_idx].tolist())) / k for r in found])


def clusters(n=400, dims=6, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(8, dims))[r.integers(0, 8, n)] * 6 + r.normal(size=(n, dims))


def test_one_centre_is_exact(spark):
    x = clusters(120)
    found = nearest(points(spark, x), 7, centres=1).collect()
    assert recall(found, x, 7) == 1.0
    assert all([n.d2 for n in r.near] == sorted(n.d2 for n in r.near) and r.obs_idx not in {n.other for n in r.near} for r in found)


def test_one_centre_is_exact_beyond_a_block(spark):
    x = clusters(500)
    found = nearest(points(spark, x), 7, centres=1, cell_points=60).collect()
    assert len(found) == 500 and recall(found, x, 7) == 1.0


def shuffled(spark):
    """Records that all stages so far have written for shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_one_centre_shuffles_in_proportion(spark):
    """Four times the points, and blocks, take four times the shuffle, not sixteen times."""
    grown = []
    for n in (250, 1000):
        before = shuffled(spark)
        assert nearest(points(spark, clusters(n)), 7, centres=1, cell_points=60).count() == n
        grown.append(shuffled(spark) - before)
    assert grown[1] < 5 * grown[0]


def test_one_centre_is_exact_in_hard_places(spark):
    """Far from the origin single precision has no digits left and a product few; equal points are at no distance; points without
    a length are near to none."""
    x = np.vstack([clusters(200) + 1e6, np.zeros((300, 6)), np.full((1, 6), np.nan)])
    found = nearest(points(spark, x), 7, centres=1, cell_points=60).collect()
    d = np.sort(np.where(np.eye(500) > 0, np.inf, squared(x[:500])), 1)[:, :7]
    assert sorted(r.obs_idx for r in found) == list(range(500))
    assert all(np.allclose([n.d2 for n in r.near], d[r.obs_idx], rtol=1e-12, atol=0) for r in found)


def test_recall_of_cells(spark):
    x = clusters(3000)
    assert recall(nearest(points(spark, x), 15, centres=40).collect(), x, 15) >= 0.9


def test_crowded_cells_are_dealt(spark):
    """Equal points, in parts of 50: every point still has its neighbours, all at no distance."""
    x = np.vstack([np.zeros((900, 3)), clusters(100, 3)])
    found = nearest(points(spark, x), 5, centres=10, cell_points=50).collect()
    assert len(found) == 1000 and all(len(r.near) == 5 for r in found)
    assert all(n.d2 == 0 for r in found if r.obs_idx < 900 for n in r.near)


def test_perplexity(spark):
    x = clusters(150)
    edges = T.affinities(nearest(points(spark, x), 30, centres=1), 10.0).collect()
    p = {(e.i, e.j): e.p for e in edges}
    assert abs(sum(p.values()) - 1) < 1e-9 and all(abs(p[j, i] - v) < 1e-15 for (i, j), v in p.items())
    one = points(spark, x).where("obs_idx < 0")
    assert T.affinities(nearest(one, 3), 10.0).collect() == []


def plain_gradient(y, p):
    q = 1 / (1 + squared(y))
    np.fill_diagonal(q, 0)
    w = (p - q / q.sum()) * q
    return 4 * (w.sum(1)[:, None] * y - w @ y)


@pytest.mark.parametrize("scale", [0.01, 20.0])
def test_gradient(spark, scale):
    r, n = np.random.default_rng(4), 300
    y, p = r.normal(size=(n, 2)) * scale, np.zeros((n, n))
    i, j = r.integers(0, n, (2, 4000))
    p[i, j] = 1
    np.fill_diagonal(p, 0)
    p = (p + p.T) / (p + p.T).sum()
    i, j = np.nonzero(p)
    edges = spark.createDataFrame([(int(a), int(b), float(p[a, b])) for a, b in zip(i, j, strict=True)], "i long, j long, p double")
    state = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(y)], "obs_idx long, x double, y double")
    got = np.zeros((n, 2))
    for row in T.gradient(state, edges).collect():
        got[row.obs_idx] = row.gx, row.gy
    want = plain_gradient(y, p)
    assert np.abs(got - want).max() < 0.02 * np.abs(want).max()


def test_embedding_keeps_neighbourhoods(spark):
    x = clusters(240)
    kind = np.argmin(((x[:, None] - np.stack([x[k] for k in range(240)])) ** 2).sum(2) + np.eye(240) * 1e9, 1)
    am = vectors(spark, SF)
    am = type(am)(am.x, points(spark, x).select("obs_idx"), am.var, obsm={"X_pca": points(spark, x)})
    out = O.tsne(am, perplexity=12, rounds=12).obsm["X_tsne"].collect()
    y = np.zeros((240, 2))
    for row in out:
        y[row.obs_idx] = row.vec
    assert len(out) == 240 and np.isfinite(y).all()
    d = squared(y)
    np.fill_diagonal(d, np.inf)
    close = np.argsort(d, 1)[:, :24]
    assert np.mean([kind[i] in close[i] for i in range(240)]) > 0.4  # 24 of 239 by chance


def test_edges(spark):
    am = vectors(spark, SF)
    with pytest.raises(ValueError):
        O.tsne(am)
    few = points(spark, np.eye(3)).unionByName(spark.createDataFrame([(9, None)], "obs_idx long, vec array<double>"))
    am = type(am)(am.x, few.select("obs_idx"), am.var, obsm={"X_pca": few})
    assert sorted(r.obs_idx for r in O.tsne(am, rounds=2).obsm["X_tsne"].collect()) == [0, 1, 2]
    am = type(am)(am.x, few.select("obs_idx"), am.var, obsm={"X_pca": few.where(F.col("obs_idx") > 99)})
    assert O.tsne(am, rounds=2).obsm["X_tsne"].collect() == []
