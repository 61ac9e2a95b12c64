"""Principal components as a stage of pyspark.ml: fitted on one matrix, saved, loaded and applied to others."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import AnnotatedMatrix
from ..params import FeatureSelection
from .dense import DENSE_CELLS
from .features import chosen_features
from .pca import MAX_FEATURES
from .rows import dense_rows, known_variables, observations, tall_qr


class _Shared(HasInputCol, HasOutputCol):
    k = Param(Params._dummy(), "k", "number of components", TypeConverters.toInt)
    center = Param(Params._dummy(), "center", "whether means are subtracted", TypeConverters.toBoolean)
    scale = Param(Params._dummy(), "scale", "whether variables are divided by their deviations", TypeConverters.toBoolean)
    maxFeatures = Param(Params._dummy(), "maxFeatures", "most variables that a fit takes", TypeConverters.toInt)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(k=2, center=True, scale=True, maxFeatures=MAX_FEATURES, inputCol="entries", outputCol="scores")


class PrincipalComponents(Estimator, _Shared, DefaultParamsReadable, DefaultParamsWritable):
    """Fits components on a column of entries (array of (var_idx, value), see rows.observations), one row per observation;
    null and empty arrays are observations of zeros. A variable that never occurs is constant, and takes no part."""

    @keyword_only
    def __init__(self, *, k: int = 2, center: bool = True, scale: bool = True, maxFeatures: int = MAX_FEATURES, inputCol: str = "entries", outputCol: str = "scores") -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> PrincipalComponentsModel:
        get = self.getOrDefault
        if get(self.k) < 1:
            raise ValueError("one component at least")
        ids = known_variables(dataset, get(self.inputCol), get(self.maxFeatures))
        factor = tall_qr(dataset, get(self.inputCol), ids)
        if factor.n < 2:
            raise ValueError("two observations at least")
        small = factor.prepared(get(self.center), get(self.scale))
        _, values, vectors = np.linalg.svd(small, full_matrices=False)
        k = min(get(self.k), len(ids))
        vectors = vectors[:k].T
        if k:
            vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
        shift = factor.mean if get(self.center) else np.zeros(len(ids))
        model = PrincipalComponentsModel(ids, shift, factor.inverse(get(self.scale)), vectors, values[:k], float((small**2).sum()), factor.n)
        return self._copyValues(model)


class PrincipalComponentsModel(Model, _Shared, MLReadable, MLWritable):
    """Components of the variables ids. Adds outputCol, an array of k scores, to any frame with a column of entries.
    A variable that the model does not know is left out; one that a row lacks is zero, and so minus its mean."""

    def __init__(
        self, ids: np.ndarray | None = None, shift: np.ndarray | None = None, inverse: np.ndarray | None = None,
        vectors: np.ndarray | None = None, singular: np.ndarray | None = None, total: float = 0.0, n: int = 0,
    ) -> None:
        super().__init__()
        self.ids, self.shift, self.inverse, self.vectors, self.singular, self.total, self.n = ids, shift, inverse, vectors, singular, total, n

    @property
    def explained_variance(self) -> list[float]:
        return (self.singular**2 / (self.n - 1)).tolist()

    @property
    def explained_variance_ratio(self) -> list[float]:
        return (self.singular**2 / self.total if self.total > 0 else 0 * self.singular).tolist()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        ids, k = self.ids, self.vectors.shape[1]
        weight = self.vectors * self.inverse[:, None]
        offset = self.shift @ weight

        def scores(lists: pa.Array) -> pa.Array:
            step = max(1, DENSE_CELLS // max(1, len(ids)))
            parts = [dense_rows(lists.slice(lo, step), ids) @ weight - offset for lo in range(0, len(lists), step)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1) * k, pa.int32()), pa.array(flat))

        f = F.arrow_udf(scores, T.ArrayType(T.DoubleType()))
        return dataset.withColumn(self.getOrDefault(self.outputCol), f(dataset[self.getOrDefault(self.inputCol)]))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: PrincipalComponentsModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, self.sparkSession
        more = {"singular": m.singular.tolist(), "total": m.total, "n": m.n}
        DefaultParamsWriter.saveMetadata(m, path, spark, extraMetadata=more)
        rows = [(int(v), float(a), float(b), list(map(float, w))) for v, a, b, w in zip(m.ids, m.shift, m.inverse, m.vectors, strict=True)]
        spark.createDataFrame(rows, "var_idx long, shift double, inverse double, vec array<double>").coalesce(1).write.parquet(f"{path}/variables")


class _Reader(MLReader):
    def load(self, path: str) -> PrincipalComponentsModel:
        spark = self.sparkSession
        of = DefaultParamsReader.loadMetadata(path, spark)
        t = spark.read.parquet(f"{path}/variables").orderBy("var_idx").toArrow()
        ids, shift, inverse = (t.column(c).to_numpy() for c in ("var_idx", "shift", "inverse"))
        singular = np.array(of["singular"], dtype=float)
        vectors = np.array(t.column("vec").to_pylist(), dtype=float).reshape(len(ids), len(singular))
        model = PrincipalComponentsModel(ids, shift, inverse, vectors, singular, of["total"], of["n"])
        model._resetUid(of["uid"])
        DefaultParamsReader.getAndSetParams(model, of)
        return model


def fit_components(am: AnnotatedMatrix, k: int = 2, center: bool = True, scale: bool = True, features: FeatureSelection | None = None) -> PrincipalComponentsModel:
    """The model of a matrix, of all variables or of those chosen."""
    columns = None if features is None else chosen_features(am, features)[0]
    return PrincipalComponents(k=k, center=center, scale=scale).fit(observations(am, columns))


def apply_components(am: AnnotatedMatrix, model: PrincipalComponentsModel) -> AnnotatedMatrix:
    """The bundle with obsm X_pca: the scores of its observations by a model fitted on this matrix or on another."""
    known = F.broadcast(am.x.sparkSession.createDataFrame([(int(v),) for v in model.ids], "var_idx long"))  # at most maxFeatures ids
    out, given = model.getOrDefault(model.outputCol), model.getOrDefault(model.inputCol)
    rows = observations(am, known).withColumnRenamed("entries", given)
    return replace(am, obsm=am.obsm | {"X_pca": model.transform(rows).select("obs_idx", F.col(out).alias("vec"))})


@dataclass(frozen=True)
class SvdResult:
    matrix: AnnotatedMatrix
    singular_values: list[float]


def svd(am: AnnotatedMatrix, k: int = 2, features: FeatureSelection | None = None) -> SvdResult:
    """Singular values of the matrix as it is, obsm X_svd (left vectors) and varm SVD_vectors (right ones, zeros for
    variables that were not chosen). The left vector of a value at the level of rounding is given as zeros."""
    model = fit_components(am, k, False, False, features)
    s = model.singular
    least = np.finfo(float).eps * max(model.n, len(s)) * (s[0] if len(s) else 0.0)
    inverse = F.array(*[F.lit(float(1 / v) if v > least else 0.0) for v in s])
    left = apply_components(am, model).obsm["X_pca"].select("obs_idx", F.zip_with("vec", inverse, lambda a, b: a * b).alias("vec"))
    some = am.x.sparkSession.createDataFrame([(int(v), list(map(float, w))) for v, w in zip(model.ids, model.vectors, strict=True)], "var_idx long, vec array<double>")
    right = am.var.select("var_idx").join(F.broadcast(some), "var_idx", "left").select("var_idx", F.coalesce("vec", F.array(*[F.lit(0.0)] * len(s))).alias("vec"))
    return SvdResult(replace(am, obsm=am.obsm | {"X_svd": left}, varm=am.varm | {"SVD_vectors": right}), s.tolist())
