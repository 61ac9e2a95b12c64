import math
import os
import pickle
import sys
import zlib

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from annomatrix import Absolute, AnnotatedMatrix, ComputationMode, Direction, FeatureSelection, FileScope, Relative, Unbounded
from annomatrix import operators as O
from annomatrix.operators.positions import reindex
from annomatrix.operators.limits import bracketed, quantile_row
from annomatrix.operators.pca import leading
from annomatrix.plotting import PcaPlotSettings, plot_pca
from annomatrix.sources import from_dense, from_triplets, read_matrix, write_matrix
from annomatrix.sources.h5ad import read_h5ad
from annomatrix.streaming import read_entry_stream, streaming_axis_stats

ROW, COLUMN = Direction.ROW, Direction.COLUMN


def matrix(spark, entries, n_obs, n_var, layout="csr", unique=False):
    x = spark.createDataFrame(entries, "obs_idx long, var_idx long, value double")
    ids = lambda key, n: spark.range(n).withColumnRenamed("id", key)
    return from_triplets(x, ids("obs_idx", n_obs), ids("var_idx", n_var), layout=layout, unique=unique)


SMALL = [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 0.0), (1, 0, 5.0), (2, 3, 2.0), (2, 0, -2.0)]  # (1, 0) comes twice


def by_key(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("layout", ["csr", "csc"])
def test_statistics_of_stored_entries(spark, layout):
    am = matrix(spark, SMALL, 4, 4, layout)
    rows, cols = by_key(O.axis_stats(am, ROW)), by_key(O.axis_stats(am, COLUMN))
    assert rows[0] == (2, 4.0, 1.0, 1.0, 1.0, 3.0)
    assert rows[1] == (1, 5.0, 0.0, 0.0, 5.0, 5.0)
    assert rows[3][:2] == (0, 0.0) and rows[3][4:] == (math.inf, -math.inf)
    assert math.isnan(rows[3][2]) == (layout == "csr")
    assert math.isnan(cols[2][2]) == (layout == "csc")
    assert cols[0][:2] == (3, 4.0)


def test_stored_zeros_and_nan(spark):
    am = matrix(spark, [(0, 0, 0.0), (0, 1, 4.0), (1, 0, math.nan), (1, 1, 1.0)], 2, 2)
    rows = by_key(O.axis_stats(am, ROW))
    assert rows[0] == (2, 4.0, 4.0, 2.0, 0.0, 4.0)
    assert math.isnan(rows[1][1]) and rows[1][4:] == (1.0, 1.0)
    chosen = O.select_features(am, FeatureSelection.top_variance(2)).collect()
    assert [r.var_idx for r in sorted(chosen, key=lambda r: r.out_pos)] == [1, 0]  # NaN comes last
    assert [r.var_idx for r in O.select_features(am, FeatureSelection.variance_above(0.1)).collect()] == [1]


def test_chunked_equals_whole_and_qc_replaces_columns(spark):
    am = matrix(spark, SMALL, 4, 4)
    assert by_key(O.compute_number(am, ROW, ComputationMode.chunked(2))) == by_key(O.compute_number(am, ROW, ComputationMode.whole()))
    twice = O.qc(O.qc(am))
    assert twice.obs.columns.count("num_genes_per_cell") == 1
    assert {r.obs_idx: r.num_genes_per_cell for r in twice.obs.collect()} == {0: 2, 1: 1, 2: 2, 3: 0}
    with pytest.raises(ValueError):
        ComputationMode.chunked(0)


def expected_filter(counts, sums, lower, upper):
    keep = np.ones(len(counts), bool)
    for limit, sign in ((lower, 1), (upper, -1)):
        if isinstance(limit, Absolute):
            keep &= sign * (counts - limit.value) >= 0
        elif isinstance(limit, Relative):
            keep &= sign * (sums - np.quantile(sums, limit.p)) >= 0
    return set(np.flatnonzero(keep))


@pytest.mark.parametrize("direction", [ROW, COLUMN])
@pytest.mark.parametrize("lower", [Absolute(5), Relative(0.1), Unbounded()])
@pytest.mark.parametrize("upper", [Absolute(9), Relative(0.9), Unbounded()])
def test_limits(spark, direction, lower, upper):
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((30, 40)) < 0.2, rng.integers(0, 50, (30, 40)), 0).astype(float)
    am = matrix(spark, [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))], 30, 40, unique=True)
    axis = 1 if direction.is_row else 0
    f = O.filter_obs if direction.is_row else O.filter_var
    wanted = expected_filter((dense != 0).sum(axis), dense.sum(axis), lower, upper)
    for huge in (False, True):
        out = f(am, lower, upper, huge_axis=huge)
        assert {r[0] for r in out.axis(direction).select(direction.key).collect()} == wanted
        assert {r[0] for r in out.x.select(direction.key).distinct().collect()} <= wanted


def test_bracketed_quantile_is_exact(spark):
    rng = np.random.default_rng(5)
    v = np.round(rng.exponential(10, 5000), 1)
    df = spark.createDataFrame([(float(x),) for x in v], "s double")
    for p in (0.0, 0.1, 0.333, 0.5, 0.99, 1.0):
        assert bracketed(df, "s", p, accuracy=200) == pytest.approx(np.quantile(v, p), abs=1e-9)
    assert bracketed(df.limit(0), "s", 0.5) is None


@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.floats(0.5, 50)), min_size=1, max_size=20, unique_by=lambda t: t[:2]))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_normalized_groups_sum_to_the_target(spark, entries):
    am = matrix(spark, entries, 6, 6, unique=True)
    for d in Direction:
        for count, total in by_key(O.axis_stats(O.normalize_total(am, 1e4, d), d, ("count", "sum"))).values():
            assert total == pytest.approx(1e4 if count else 0.0)


def test_zero_sum_groups_and_log(spark):
    am = matrix(spark, [(0, 0, 1.0), (0, 1, -1.0), (1, 0, -1.0), (1, 1, -2.0), (1, 2, 1.0)], 2, 3)
    assert [r.value for r in O.normalize_total(am).x.where("obs_idx = 0").collect()] == [0.0, 0.0]
    logs = {(r.obs_idx, r.var_idx): r.value for r in O.log1p(am).x.collect()}
    assert logs[1, 0] == -math.inf and math.isnan(logs[1, 1]) and logs[1, 2] == pytest.approx(math.log(2))


def test_selections_and_dense(spark):
    am = matrix(spark, SMALL, 4, 4)
    full = np.zeros((4, 4))
    for i, j, v in SMALL:
        full[i, j] += v
    got = by_key(O.to_dense(am))
    assert all(np.array_equal(got[i][0], full[i]) for i in range(4))
    got = by_key(O.to_dense_selected(am, O.select_indices(am, COLUMN, [3, 0]), am.obs.where("obs_idx >= 2")))
    assert {k: v[0] for k, v in got.items()} == {2: [2.0, -2.0], 3: [0.0, 0.0]}
    assert [r[0] for r in O.select_slice(am, ROW, 1, 4, 2).orderBy("obs_idx").collect()] == [1, 3]
    for bad in ([9], [1, 1]):
        with pytest.raises((IndexError, ValueError)):
            O.select_indices(am, COLUMN, bad)
    with pytest.raises(IndexError):
        O.select_slice(am, ROW, 0, 9)
    kept = am.subset(ROW, am.obs.where("obs_idx in (1, 3)"))
    assert {tuple(r) for r in reindex(kept, ROW).collect()} == {(1, 0), (3, 1)}


def test_flag_column(spark):
    am = matrix(spark, SMALL, 4, 4)
    flags = spark.createDataFrame([(0, True), (1, None), (2, False)], "var_idx long, hv boolean")
    am = am.with_axis(COLUMN, am.var.join(flags, "var_idx", "left"))
    assert [r.var_idx for r in O.select_features(am, FeatureSelection.flagged("hv")).collect()] == [0]
    for bad in ("var_name", "nothing"):
        with pytest.raises((TypeError, ValueError)):
            O.select_features(am, FeatureSelection.flagged(bad))


def test_random_choice_ignores_partitioning(spark):
    am = matrix(spark, SMALL, 4, 50)
    how = FeatureSelection.randomized(10, seed=4)
    again = am.with_axis(COLUMN, am.var.repartition(7))
    pick = lambda m: [tuple(r) for r in O.select_features(m, how).orderBy("out_pos").collect()]
    assert pick(am) == pick(again) and len(pick(am)) == 10


@pytest.mark.parametrize("center", [True, False])
@pytest.mark.parametrize("scale", [True, False])
def test_pca_against_svd(spark, center, scale):
    rng = np.random.default_rng(1)
    dense = np.where(rng.random((60, 8)) < 0.5, rng.normal(3, 2, (60, 8)), 0.0)
    dense[:, 5] = 2.0  # constant
    am = matrix(spark, [(i, j, float(dense[i, j])) for i in range(60) for j in range(8) if dense[i, j]], 60, 8, unique=True)
    out = O.pca(am, 3, center, scale)
    z = dense - (dense.mean(0) if center else 0)
    sd = dense.std(0)
    if scale:
        z = np.where(sd > 0, z / np.where(sd > 0, sd, 1), 0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert out.explained_variance == pytest.approx((s**2 / 59)[:3])
    assert out.explained_variance_ratio == pytest.approx((s**2 / (s**2).sum())[:3])
    got = by_key(out.matrix.obsm["X_pca"])
    got = np.array([got[i][0] for i in range(60)])
    assert np.allclose(np.abs(got), np.abs(z @ vt[:3].T), atol=1e-8)
    load = by_key(out.matrix.varm["PCA_loadings"])
    want = np.abs(vt[:3].T * (sd[:, None] if scale else 1))
    assert np.allclose(np.abs([load[j][0] for j in range(8)]), want, atol=1e-8)


def test_pca_limits(spark):
    am = matrix(spark, SMALL, 4, 4)
    with pytest.raises(ValueError):
        O.pca(am, 2, max_features=2)
    with pytest.raises(ValueError):
        O.pca(am, 2, features=FeatureSelection.variance_above(1e9))


@pytest.mark.parametrize("center,scale", [(True, True), (False, False)])
def test_pca_of_many_variables(spark, center, scale):
    rng = np.random.default_rng(2)
    dense = np.where(rng.random((50, 40)) < 0.3, rng.normal(1, 2, (50, 40)), 0.0)
    dense[7] = dense[:, 11] = 0.0  # no entries
    am = matrix(spark, [(i, j, float(dense[i, j])) for i in range(50) for j in range(40) if dense[i, j]], 50, 40, unique=True)
    whole, thin = O.pca(am, 3, center, scale), O.pca(am, 3, center, scale, max_cross=8)
    assert thin.explained_variance == pytest.approx(whole.explained_variance)
    assert thin.explained_variance_ratio == pytest.approx(whole.explained_variance_ratio)
    for a, b in ((whole.matrix.obsm["X_pca"], thin.matrix.obsm["X_pca"]), (whole.matrix.varm["PCA_loadings"], thin.matrix.varm["PCA_loadings"])):
        a, b = by_key(a), by_key(b)
        assert a.keys() == b.keys() and np.allclose([a[i][0] for i in a], [b[i][0] for i in a], atol=1e-6)


def test_leading_eigenpairs():
    rng = np.random.default_rng(3)
    for width, k in ((1, 1), (12, 10), (300, 5)):
        a = rng.standard_normal((80, width))
        values, vectors = leading(lambda q: a.T @ (a @ q), width, k)  # noqa: B023
        assert np.allclose(values, np.linalg.eigvalsh(a.T @ a)[::-1][:k]) and np.allclose(a.T @ (a @ vectors), vectors * values, atol=1e-5)
    assert np.allclose(leading(lambda q: 0 * q, 5, 2)[0], 0)
    with pytest.warns(UserWarning):
        leading(lambda q: a.T @ (a @ q), 300, 5, rounds=2)


def test_plot(spark, tmp_path):
    am = matrix(spark, SMALL, 4, 4)
    am = O.pca(am, 2).matrix
    am = am.with_axis(ROW, am.obs.selectExpr("*", "obs_idx % 2 as side"))
    path = str(tmp_path / "p.png")
    style = PcaPlotSettings().with_dimensions(200, 160).with_title("t").with_labels("a", "b").with_point_size(3).with_axes(0, 1)
    colors = plot_pca(am, path, "side", style.with_background_color((0, 0, 0)).with_point_color((9, 9, 9)))
    assert sorted(colors) == ["0", "1"] and open(path, "rb").read(8) == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(KeyError):
        plot_pca(matrix(spark, SMALL, 4, 4), path)


def test_parquet_round_trip_and_stream(spark, tmp_path):
    am = O.pca(matrix(spark, SMALL, 4, 4), 2).matrix
    path = str(tmp_path / "m")
    write_matrix(am, path)
    back = read_matrix(spark, path, FileScope.READ, cache=True, obsm=("X_pca",), varm=("PCA_loadings",))
    assert by_key(O.axis_stats(back, ROW, ("count", "sum"))) == by_key(O.axis_stats(am, ROW, ("count", "sum")))
    assert back.obsm["X_pca"].count() == 4 and "X_pca" in back.describe() and back.unpersist().copy().n_vars() == 4
    totals = streaming_axis_stats(read_entry_stream(spark, f"{path}/x"), ROW)
    q = totals.writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    stored = {k: v for k, v in by_key(O.axis_stats(am, ROW, ("count", "sum"))).items() if v[0]}
    assert by_key(spark.table("totals")) == stored


def test_sources_reject_and_pivot(spark):
    wide = spark.createDataFrame([(5, 1.0, None), (6, 0.0, 2.0)], "id long, a double, b double")
    am = from_dense(wide, "id", ["a", "b"])
    assert {tuple(r) for r in am.x.collect()} == {(5, 0, 1.0), (6, 0, 0.0), (6, 1, 2.0)}
    assert [r.var_name for r in am.var_names().orderBy("var_idx").collect()] == ["a", "b"]
    text = spark.createDataFrame([(1, 1, "x")], "obs_idx long, var_idx long, value string")
    with pytest.raises(TypeError):
        from_triplets(text)
    with pytest.raises(ValueError):
        AnnotatedMatrix(am.x, am.obs, am.var, layout="dense")


def test_empty_matrix(spark):
    am = matrix(spark, [], 0, 0)
    assert O.filter_obs(am, Relative(0.1), Relative(0.9)).n_obs() == 0
    assert O.to_dense(am).count() == 0 and O.normalize_total(am).x.count() == 0
    assert matrix(spark, [], 2, 2).x.count() == 0 and len(by_key(O.to_dense(matrix(spark, [], 2, 2)))[0][0]) == 2


def test_h5ad_needs_h5py(spark, tmp_path):
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError):
            read_h5ad(spark, os.fspath(tmp_path / "a.h5ad"))


#: Stands in for h5py, which is not installed: a file is a pickled tree of (attributes, children or array).
H5 = """
import pickle


class Group(dict):
    attrs = {}

    def __enter__(self):
        return self

    def __exit__(self, *_):
        pass


class Data:
    attrs = {}

    def __init__(self, values):
        self.values, self.shape, self.dtype = values, values.shape, values.dtype

    def __getitem__(self, at):
        return self.values[at]


def build(node):
    attrs, inside = node
    out = Group({k: build(v) for k, v in inside.items()}) if isinstance(inside, dict) else Data(inside)
    out.attrs = attrs
    return out


def File(path, mode):
    with open(path, "rb") as f:
        return build(pickle.load(f))
"""


def h5_tree(kind="csr_matrix", **more):
    data = lambda v, **attrs: (attrs, np.array(v))
    obs = {
        "names": data([b"a", b"b", b"c"]),
        "depth": data([1.5, 2.5, 3.5]),
        "cell": ({}, {"codes": data([1, -1, 0]), "categories": data([b"x", b"y"])}),
        "old": data([0, 1, -1]),
        "__categories": ({}, {"old": data([7, 9])}),
        "maybe": ({}, {"values": data([2**53 + 1, 0, 5]), "mask": data([False, True, False])}),
    }
    x = {"indptr": data([0, 2, 2, 3]), "indices": data([0, 1, 1]), "data": data([4.0, 0.0, 6.0])}
    parts = {
        "X": ({"encoding-type": kind}, x),
        "obs": ({"_index": "names"}, obs | more),
        "var": ({}, {"_index": data([b"g", b"h"] if kind == "csr_matrix" else [b"g", b"h", b"i"])}),
        "obsm": ({}, {"X_pca": data([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])}),
        "varm": ({}, {}),
    }
    return {}, parts


def test_h5ad_reads_every_column(spark, tmp_path, monkeypatch):
    (tmp_path / "h5py.py").write_text(H5)
    monkeypatch.setattr(sys, "path", [*sys.path])
    monkeypatch.setitem(sys.modules, "h5py", None)
    monkeypatch.delitem(sys.modules, "h5py")
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    path = str(tmp_path / "m.h5ad")

    def stored(tree):
        with open(path, "wb") as f:
            pickle.dump(tree, f)

    stored(h5_tree())
    am = read_h5ad(spark, path, cache=True)
    got = [tuple(r) for r in am.obs.select("obs_idx", "obs_name", "depth", "cell", "old", "maybe").orderBy("obs_idx").collect()]
    assert got == [(0, "a", 1.5, "y", 7, 2**53 + 1), (1, "b", 2.5, None, 9, None), (2, "c", 3.5, "x", None, 5)]
    assert sorted(tuple(r) for r in am.x.collect()) == [(0, 0, 4.0), (0, 1, 0.0), (2, 1, 6.0)]
    assert by_key(am.obsm["X_pca"]) == {0: ([1.0, 2.0],), 1: ([3.0, 4.0],), 2: ([5.0, 6.0],)} and am.varm == {}
    am.unpersist()
    stored(h5_tree("csc_matrix"))
    am = read_h5ad(spark, path)
    assert am.layout == "csc" and sorted(tuple(r) for r in am.x.collect()) == [(0, 0, 4.0), (1, 0, 0.0), (1, 2, 6.0)]
    stored(h5_tree(nested=({}, {"deep": ({}, {})})))
    with pytest.raises(ValueError, match="obs/nested"):
        read_h5ad(spark, path)
    assert "nested" not in read_h5ad(spark, path, skip=("obs/nested",)).obs.columns


@pytest.mark.parametrize("p", [0.0, 0.013, 0.5, 0.97, 1.0])
def test_quantile_in_the_plan_is_exact(spark, p):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(0, 5, 3000).round(1), np.full(2000, 1.5), [np.inf]])
    df = spark.createDataFrame([(float(x),) for x in v], "sum double").repartition(5)
    want = lambda q: np.quantile(v, q, method="lower" if q in (0, 1) else "linear")
    row = quantile_row(df, Relative(p), Relative(1 - p), accuracy=200).first()
    assert (row.q_lower, row.q_upper) == pytest.approx((want(p), want(1 - p)))
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "sum double")
    row = quantile_row(nan, Relative(0.5), Relative(1.0)).first()
    assert row.q_lower == 2.0 and np.isnan(row.q_upper)
    assert quantile_row(df.limit(0), Relative(p), Unbounded()).first().q_lower is None


def test_plot_draws_text(spark, tmp_path):
    am = O.pca(matrix(spark, SMALL, 4, 4), 2).matrix
    plain, full = str(tmp_path / "a.png"), str(tmp_path / "b.png")
    plot_pca(am, plain, settings=PcaPlotSettings().with_title("").with_labels("", ""))
    plot_pca(am, full, settings=PcaPlotSettings().with_title("A title").with_labels("first", "second"))

    def pixels(path):
        raw = open(path, "rb").read()
        at = raw.index(b"IDAT")
        size = int.from_bytes(raw[at - 4 : at], "big")
        rows = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + size]), dtype="uint8")
        return rows.reshape(600, -1)[:, 1:].reshape(600, 800, 3)

    differ = (pixels(plain) != pixels(full)).any(2)
    assert differ[:40].sum() > 50 and differ[-40:].sum() > 20 and differ[40:560, :40].sum() > 20
    assert not differ[40:560, 40:].any()


def test_entries_are_dealt_by_the_size_of_the_files(spark, monkeypatch):
    """However few bytes the entries take compressed, a task groups those of PART_BYTES of the files, and row statistics
    need no shuffle of entries beside that one."""
    from annomatrix.plans.matrices import orders_by_part
    from pyspark.sql import functions as F

    from annomatrix.sources import triplets

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(triplets, "PART_BYTES", 4096)
    x = orders_by_part(spark, sf).x
    want = -(-os.path.getsize(f"{sf}/lineitem.parquet") // 4096)
    assert want > 8 and x.rdd.getNumPartitions() == want
    assert x.groupBy("obs_idx").agg(F.sum("value")).rdd.getNumPartitions() == want
