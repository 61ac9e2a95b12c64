"""Principal components: from one distributed cross-product of the chosen variables, or, for very many of them, by passes
that multiply a thin block."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..params import FeatureSelection
from .dense import DENSE_CELLS, cell_lists, scatter
from .features import chosen_features

#: Variables whose cross-product the driver takes whole.
MAX_FEATURES = 1024
#: Variables of which the driver takes a few numbers each.
MAX_WIDE = 1 << 16


@dataclass(frozen=True)
class PcaResult:
    matrix: AnnotatedMatrix
    explained_variance: list[float]
    explained_variance_ratio: list[float]
    cached: tuple[DataFrame, ...] = ()

    def release(self) -> PcaResult:
        """Gives back what the scores keep cached; they are still found, from the entries, when read again."""
        for df in self.cached:
            df.unpersist()
        return self


def _products(cells: DataFrame, width: int) -> DataFrame:
    """(i, j, g, s) for i <= j: partial sums over a task's rows of the products of columns i and j that meet in a row,
    and on the diagonal of column i itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, s, met = np.zeros((width, width)), np.zeros(width), np.zeros((width, width), dtype=bool)
        step = max(1, DENSE_CELLS // max(1, width))
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.column("cells").slice(lo, step)
                x = scatter(part, width)
                stored = np.zeros(x.shape, dtype=np.float32)
                many = pc.list_value_length(part).to_numpy(zero_copy_only=False)
                stored[np.repeat(np.arange(len(part)), many), part.flatten().field("out_pos").to_numpy()] = 1
                g += x.T @ x
                s += x.sum(0)
                met |= stored.T @ stored > 0
        i, j = np.nonzero(np.triu(met))
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(g[i, j]), pa.array(np.where(i == j, s[i], 0.0))], names=["i", "j", "g", "s"])

    return cells.select("cells").mapInArrow(run, "i long, j long, g double, s double")


def gram(am: AnnotatedMatrix, columns: DataFrame, max_block: int = 2 * MAX_FEATURES) -> DataFrame:
    """(i, j, g) for i <= j: the sum over observations of the product of the stored entries of columns i and j. Up to
    max_block columns, each task multiplies its own rows as a matrix and gives one sum per pair of columns; beyond that
    a self-join by observation, at the cost of the squared entries of a row, keeps nothing of the size of columns
    squared in one place."""
    xs = am.x.join(columns.select("var_idx", "out_pos"), "var_idx")
    width = columns.agg(F.coalesce(F.max("out_pos") + 1, F.lit(0))).first()[0]
    if width <= max_block:
        return _products(cell_lists(xs), width).groupBy("i", "j").agg(F.sum("g").alias("g"))
    left = xs.select("obs_idx", F.col("out_pos").alias("i"), F.col("value").alias("a"))
    right = xs.select("obs_idx", F.col("out_pos").alias("j"), F.col("value").alias("b"))
    return left.join(right, "obs_idx").where("i <= j").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("g"))


def _times(cells: DataFrame, w: np.ndarray) -> np.ndarray:
    """X'Xw, for one row of X per row of cells. Each task gives one row of sums for every variable that it meets."""
    width, k = w.shape
    names = [f"c{c}" for c in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, met = np.zeros((width, k)), np.zeros(width, dtype=bool)
        step = max(1, DENSE_CELLS // width)
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.column("cells").slice(lo, step)
                row = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy(zero_copy_only=False))
                at, value = (part.flatten().field(c).to_numpy() for c in ("out_pos", "value"))
                met[at] = True
                for c in range(k):
                    y = np.bincount(row, value * w[at, c], minlength=len(part))
                    m[:, c] += np.bincount(at, value * y[row], minlength=width)
        some = np.flatnonzero(met)
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(m[some, c]) for c in range(k)]], names=["i", *names])

    sums = cells.select("cells").mapInArrow(run, "i long, " + ", ".join(f"{c} double" for c in names))
    found = sums.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
    out = np.zeros((width, k))
    out[found.column("i").to_numpy()] = np.stack([found.column(c).to_numpy() for c in names], 1)
    return out


def leading(times: Callable[[np.ndarray], np.ndarray], width: int, k: int, tolerance: float = 1e-9, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues and their vectors of a symmetric matrix without negative ones, of which only products
    with thin blocks are known: a block Krylov space, restarted from its best vectors when it has grown to eight
    blocks. Ends when no residual is above tolerance times the largest eigenvalue, or with a warning after rounds."""
    block = min(width, k + 8)
    q = np.linalg.qr(np.random.Generator(np.random.PCG64(0)).standard_normal((width, block)))[0]
    v, av = np.zeros((width, 0)), np.zeros((width, 0))
    for _ in range(rounds):
        v, av = np.hstack([v, q]), np.hstack([av, times(q)])
        t = v.T @ av
        values, s = np.linalg.eigh((t + t.T) / 2)
        values, s = values[::-1][:block], s[:, ::-1][:, :block]
        best, image = v @ s, av @ s
        rest = image - best * values
        size = np.linalg.norm(rest, axis=0)
        if size[:k].max() <= tolerance * max(values[0], 1e-300):
            break
        if v.shape[1] >= 8 * block:
            v, av = best, image
        q = rest[:, size > 1e-14 * values[0]][:, : width - v.shape[1]]
        for _ in range(2):
            q = np.linalg.qr(q - v @ (v.T @ q))[0]
        if not q.shape[1]:
            break
    else:
        warnings.warn(f"components have a residual of {size[:k].max() / values[0]:.1e} after {rounds} rounds", stacklevel=3)
    return values[:k], best[:, :k]


def pca(
    am: AnnotatedMatrix,
    n_components: int = 2,
    center: bool = True,
    scale: bool = True,
    features: FeatureSelection | None = None,
    max_features: int = MAX_WIDE,
    max_cross: int = MAX_FEATURES,
) -> PcaResult:
    """Adds obsm X_pca (scores), varm PCA_loadings (all variables, zeros for those not chosen) and uns pca.

    Implicit zeros count here, unlike in the statistics: means and population deviations are over all observations. A
    constant column contributes nothing. Of up to max_cross chosen columns the driver gets the cross-product, max_cross
    squared numbers whatever the observations, and solves its eigenproblem. Beyond that, up to max_features columns, it
    finds the leading components alone, by one pass over the chosen entries per product with a block of n_components + 8
    vectors, and holds at most nine such blocks and their images. The sign of a component makes its largest loading
    positive."""
    if n_components < 1:
        raise ValueError("one component at least")
    spark = am.x.sparkSession
    ids = chosen_features(am, features or FeatureSelection.everything())[0].select("var_idx").limit(max_features + 1).collect()
    chosen = [(v, i) for i, v in enumerate(sorted(r.var_idx for r in ids))]
    if not chosen:
        raise ValueError("no variable is selected")
    if len(chosen) > max_features:
        raise ValueError(f"more than {max_features} variables are selected")
    p = len(chosen)
    columns = F.broadcast(spark.createDataFrame(chosen, "var_idx long, out_pos long"))
    ids = am.obs.select("obs_idx").persist()
    n = ids.count()
    if n < 2:
        raise ValueError("two observations at least")
    k = min(n_components, p)

    sums, squares, g = np.zeros(p), np.zeros(p), None
    # One pass over the entries, kept for what follows; a lost executor's part is computed again.
    cells = cell_lists(am.x.join(columns, "var_idx")).persist()
    if p <= max_cross:
        found = _products(cells, p).groupBy("i", "j").agg(F.sum("g").alias("g"), F.sum("s").alias("s")).toArrow()
        i, j, gs, s = (found.column(c).to_numpy() for c in ("i", "j", "g", "s"))
        g = np.zeros((p, p))
        g[i, j] = g[j, i] = gs
        sums[i[i == j]] = s[i == j]
        squares = np.diag(g)
    else:
        moments = cells.select(F.inline("cells")).groupBy("out_pos").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).toArrow()
        at = moments.column("out_pos").to_numpy()
        sums[at], squares[at] = moments.column("s").to_numpy(), moments.column("q").to_numpy()
    mean = sums / n
    std = np.sqrt(np.maximum(squares / n - mean**2, 0.0))
    shift = mean if center else np.zeros(p)
    divisor = np.where(std > 1e-12 * np.sqrt(np.maximum(squares / n, 1e-300)), std, 0.0) if scale else np.ones(p)
    inverse = np.divide(1.0, divisor, out=np.zeros(p), where=divisor > 0)
    total = ((squares - n * shift**2) * inverse**2).clip(0.0).sum() / (n - 1)
    if g is not None:
        values, vectors = np.linalg.eigh((g - n * np.outer(shift, shift)) / (n - 1) * np.outer(inverse, inverse))
        order = np.argsort(values)[::-1][:k]
        values, vectors = values[order], vectors[:, order]
    else:

        def covariance(q: np.ndarray) -> np.ndarray:
            w = q * inverse[:, None]
            return (_times(cells, w) - n * np.outer(shift, shift @ w)) * inverse[:, None] / (n - 1)

        values, vectors = leading(covariance, p, k)
    values = np.maximum(values, 0.0)
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(k)] < 0, -1.0, 1.0)
    ratio = (values / total if total > 0 else np.zeros(k)).tolist()

    weight = vectors * inverse[:, None]
    offset = shift @ weight

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DENSE_CELLS // p)
        for batch in batches:
            for lo in range(0, len(batch), step):
                part = batch.slice(lo, step)
                found = scatter(part.column("cells"), p) @ weight - offset
                offsets = pa.array(np.arange(0, found.size + 1, k), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("obs_idx"), pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["obs_idx", "vec"])

    scores = cells.mapInArrow(project, "obs_idx long, vec array<double>")
    nothing = F.array(*[F.lit(float(-o)) for o in offset])
    scores = ids.join(scores, "obs_idx", "left").select("obs_idx", F.coalesce("vec", nothing).alias("vec"))

    loading = vectors * (divisor[:, None] if scale else 1.0)
    some = spark.createDataFrame([(v, [float(y) for y in loading[i]]) for v, i in chosen], "var_idx long, vec array<double>")
    zero = F.array(*[F.lit(0.0)] * k)
    loadings = am.var.select("var_idx").join(F.broadcast(some), "var_idx", "left").select("var_idx", F.coalesce("vec", zero).alias("vec"))
    out = replace(
        am,
        obsm=am.obsm | {"X_pca": scores},
        varm=am.varm | {"PCA_loadings": loadings},
        uns=am.uns | {"pca": {"variance": values.tolist(), "variance_ratio": ratio}},
    )
    return PcaResult(out, values.tolist(), ratio, (ids, cells))
