import numpy as np
import pytest

from annomatrix import FeatureSelection
from annomatrix import operators as O
from annomatrix.operators.components import PrincipalComponents, PrincipalComponentsModel
from annomatrix.operators.rows import FAN, known_variables, observations, tall_qr
from annomatrix.plans.matrices import orders_by_part, vectors
from annomatrix.sources import from_arrays

SF001 = "/root/testdata/sf0.01"


def from_dense(spark, dense, parts=3):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(dense)]
    return from_arrays(spark.createDataFrame(rows, "id long, v array<double>").repartition(parts), "id", "v")


def vecs(df, n):
    got = {r.obs_idx: r.vec for r in df.collect()}
    assert len(got) == n
    return np.array([got[i] for i in sorted(got)])


def conditioned(rng, n, p, worst):
    u, v = np.linalg.qr(rng.standard_normal((n, p)))[0], np.linalg.qr(rng.standard_normal((p, p)))[0]
    s = np.logspace(0, -np.log10(worst), p)
    return (u * s) @ v.T, s


def test_singular_values_that_a_cross_product_loses(spark):
    dense, s = conditioned(np.random.default_rng(1), 400, 6, 1e9)
    out = O.svd(from_dense(spark, dense, 20), 6)
    assert np.abs(np.array(out.singular_values) - s).max() < 1e-12
    squared = np.linalg.eigvalsh(dense.T @ dense)[::-1]
    assert np.abs(np.sqrt(np.maximum(squared, 0)) - s).max() > 1e-10  # what the squared matrix keeps
    left, right = vecs(out.matrix.obsm["X_svd"], 400), {r[0]: r[1] for r in out.matrix.varm["SVD_vectors"].collect()}
    right = np.array([right[j] for j in range(6)])
    assert np.allclose((left * out.singular_values) @ right.T, dense, atol=1e-13)


def test_variance_beside_a_large_mean(spark):
    rng = np.random.default_rng(2)
    dense = 1e7 + rng.standard_normal((300, 4))
    model = O.fit_components(from_dense(spark, dense), 4, True, False)
    want = np.linalg.svd(dense - dense.mean(0), compute_uv=False)
    assert model.singular == pytest.approx(want, rel=1e-7)


def test_tree_of_several_rounds(spark):
    dense = np.random.default_rng(3).standard_normal((FAN * FAN + 20, 3))
    rows = observations(from_dense(spark, dense)).repartitionByRange(FAN * FAN + 9, "obs_idx")
    factor = tall_qr(rows, "entries", np.arange(3))
    assert factor.n == len(dense) and np.allclose(factor.mean, dense.mean(0)) and np.allclose(factor.deviation, dense.std(0))


@pytest.mark.parametrize("center", [True, False])
@pytest.mark.parametrize("scale", [True, False])
def test_model_on_new_rows(spark, tmp_path, center, scale):
    rng = np.random.default_rng(4)
    dense = np.where(rng.random((80, 6)) < 0.6, rng.normal(2, 1, (80, 6)), 0.0)
    dense[:, 4] = 3.0
    fresh = np.where(rng.random((30, 6)) < 0.6, rng.normal(2, 1, (30, 6)), 0.0)
    fresh[5] = 0.0
    model = O.fit_components(from_dense(spark, dense), 3, center, scale)
    path = (tmp_path / "model").as_uri()
    model.save(path)
    back = PrincipalComponentsModel.load(path)
    assert back.uid == model.uid and back.explained_variance == model.explained_variance and back.getOrDefault("k") == 3
    with pytest.raises(Exception):  # noqa: B017
        model.save(path)
    model.write().overwrite().save(path)
    sd = dense.std(0)
    prepare = lambda a: (a - dense.mean(0) * center) * (np.divide(1, sd, out=np.zeros(6), where=sd > 1e-9) if scale else 1)
    _, s, vt = np.linalg.svd(prepare(dense), full_matrices=False)
    assert np.allclose(model.explained_variance, s[:3] ** 2 / 79)
    assert np.allclose(model.explained_variance_ratio, s[:3] ** 2 / (s**2).sum())
    got = vecs(O.apply_components(from_dense(spark, fresh), back).obsm["X_pca"], 30)
    assert np.allclose(np.abs(got), np.abs(prepare(fresh) @ vt[:3].T), atol=1e-9)


def test_stage_parameters_and_edges(spark, tmp_path):
    schema = "obs_idx long, `e.x` array<struct<var_idx:bigint,value:double>>, obs string"
    rows = [(0, [(5, 1.0), (5, 2.0), (9, None)], "a"), (1, None, "b"), (2, [], None), (3, [(9, 4.0), (None, 7.0)], "a")]
    df = spark.createDataFrame(rows, schema).withColumnRenamed("e.x", "entries")
    stage = PrincipalComponents(k=9, scale=False)
    stage.save((tmp_path / "stage").as_uri())
    stage = PrincipalComponents.load((tmp_path / "stage").as_uri())
    assert stage.getOrDefault("k") == 9 and not stage.getOrDefault("scale")
    model = stage.fit(df)
    dense = np.array([[3.0, 0], [0, 0], [0, 0], [0, 4.0]])
    want = np.linalg.svd(dense - dense.mean(0), compute_uv=False)
    assert model.ids.tolist() == [5, 9] and model.n == 4 and np.allclose(model.singular, want)
    unknown = spark.createDataFrame([(0, [(77, 5.0)], "z")], schema).withColumnRenamed("e.x", "entries")
    zero = spark.createDataFrame([(0, None, "z")], schema).withColumnRenamed("e.x", "entries")
    assert model.transform(unknown).first().scores == model.transform(zero).first().scores
    assert model.transform(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="no rows"):
        stage.fit(df.limit(0))
    with pytest.raises(ValueError, match="two observations"):
        stage.fit(df.where("obs_idx = 0"))
    with pytest.raises(ValueError, match="more than 1"):
        known_variables(df, "entries", 1)
    bad = spark.createDataFrame([(0, [(1, float("nan"))], ""), (1, [(1, 2.0)], "")], schema).withColumnRenamed("e.x", "entries")
    with pytest.raises(ValueError, match="finite"):
        stage.fit(bad)
    nothing = stage.fit(df.where("obs_idx in (1, 2)"))
    assert nothing.transform(df).first().scores == [] and nothing.explained_variance == []


def pandas_matrix(am, columns=None):
    x = am.x.toPandas()
    x = x if columns is None else x[x.var_idx.isin(columns)]
    table = x.pivot(index="obs_idx", columns="var_idx", values="value")
    return table.reindex(sorted(r[0] for r in am.obs.select("obs_idx").collect())).fillna(0.0).to_numpy()


def check_against_numpy(spark, am, dense, features=None):
    z = (dense - dense.mean(0)) / dense.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    want = np.abs(z @ vt[:5].T)
    model = O.fit_components(am, 5, features=features)
    assert np.allclose(model.singular, s[:5], rtol=1e-12)
    assert np.allclose(np.abs(vecs(O.apply_components(am, model).obsm["X_pca"], len(dense))), want, atol=1e-7)
    other = O.pca(am, 5, features=features)
    assert np.allclose(other.explained_variance, s[:5] ** 2 / (len(z) - 1), rtol=1e-9)
    assert np.allclose(np.abs(vecs(other.matrix.obsm["X_pca"], len(dense))), want, atol=1e-6)


def test_whole_vectors_at_sf001(spark):
    am = vectors(spark, SF001)
    check_against_numpy(spark, am, pandas_matrix(am))


def test_whole_orders_at_sf001(spark):
    am, how = orders_by_part(spark, SF001).persist(), FeatureSelection.top_variance(25)
    chosen = [r.var_idx for r in O.select_features(am, how).collect()]
    check_against_numpy(spark, am, pandas_matrix(am, chosen), how)
    am.unpersist()
