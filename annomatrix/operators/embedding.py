"""t-SNE of an embedding such as the principal components: neighbours, perplexities, and rounds of gradient descent.

Attraction runs over the edges of the neighbour graph, joined with the positions of their ends. Repulsion is that of a grid:
each task spreads its points over the nodes of a regular grid by interpolation, the sums of all tasks are convolved
with the kernels on the driver, which holds the grid alone, and each point reads its potentials back. So a round is
linear in the observations and edges, and its cost does not depend on where the points lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..storage import drop, stored
from .neighbors import nearest

Batches = Iterator[pa.RecordBatch]
EXAGGERATION = 12.0
#: Nodes of the grid per interval; intervals on a side, two a unit of length up to 125 units; numbers a row of partial sums has.
NODES, INTERVALS, CHUNK = 3, (30, 250), 1 << 14


def _affinities(perplexity: float) -> Callable[[Batches], Batches]:
    """(i, j, p): each point's neighbours by a Gaussian whose width gives the perplexity, found by bisection."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            lists = batch.column("near")
            many = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(batch)), many)
            place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            cells = lists.flatten()
            d = np.full((len(batch), max(1, int(many.max(initial=0)))), np.inf)
            d[row, place] = cells.field("d2").to_numpy()
            d -= np.where(many, d.min(1), 0)[:, None]
            low, high = np.full(len(d), -50.0), np.full(len(d), 50.0)  # of the logarithm of the precision
            scale = np.where(np.isfinite(d), d, 0).sum(1) / np.maximum(many, 1)
            d /= np.where(scale > 0, scale, 1)[:, None]
            for _ in range(60):
                middle = (low + high) / 2
                p = np.exp(-d * np.exp(middle)[:, None])
                total = p.sum(1)
                spread = np.where(np.isfinite(d), d, 0)
                entropy = np.log(total) + np.exp(middle) * (spread * p).sum(1) / total
                flat = entropy > np.log(np.minimum(perplexity, np.maximum(many - 1, 1)))
                low, high = np.where(flat, middle, low), np.where(flat, high, middle)
            p /= total[:, None]
            yield pa.RecordBatch.from_arrays([batch.column("obs_idx").take(pa.array(row)), cells.field("other"), pa.array(p[row, place])], names=["i", "j", "p"])

    return run


def affinities(near: DataFrame, perplexity: float) -> DataFrame:
    """(i, j, p) in both directions; p adds up to 1."""
    one = near.select("obs_idx", "near").mapInArrow(_affinities(perplexity), "i long, j long, p double")
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "p"))
    n = F.lit(2.0 * max(1, near.count()))
    return stored(both.groupBy("i", "j").agg((F.sum("p") / n).alias("p")))


@dataclass(frozen=True)
class Grid:
    """A square of nodes over the points; low is its corner."""

    low: tuple[float, float]
    step: float
    side: int

    @classmethod
    def over(cls, low: tuple[float, float], high: tuple[float, float]) -> Grid:
        size = max(high[0] - low[0], high[1] - low[1], 1e-9) * 1.0001
        intervals = int(np.clip(np.ceil(2 * size), *INTERVALS))
        return cls(low, size / (intervals * NODES), intervals * NODES)

    def spread(self, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The NODES squared nodes around each point, and their Lagrange weights."""
        at, weights = [], []
        for axis in (0, 1):
            u = (xy[:, axis] - self.low[axis]) / self.step  # nodes lie at 0.5, 1.5, ...
            first = np.clip(np.floor(u / NODES).astype(np.int64) * NODES, 0, self.side - NODES)
            t = u - first - 0.5
            w = np.ones((len(u), NODES))
            for a in range(NODES):
                for b in range(NODES):
                    if a != b:
                        w[:, a] *= (t - b) / (a - b)
            at.append(first[:, None] + np.arange(NODES))
            weights.append(w)
        nodes = (at[0][:, :, None] * self.side + at[1][:, None, :]).reshape(len(xy), -1)
        return nodes, (weights[0][:, :, None] * weights[1][:, None, :]).reshape(len(xy), -1)

    def convolved(self, sums: np.ndarray) -> tuple[np.ndarray, float]:
        """Potentials of the squared kernel for the sums of 1, x and y, and the total of the plain kernel over all pairs."""
        lag = np.minimum(np.arange(2 * self.side), 2 * self.side - np.arange(2 * self.side)) * self.step
        kernel = 1 / (1 + lag[:, None] ** 2 + lag**2)
        grid = np.zeros((3, 2 * self.side, 2 * self.side))
        grid[:, : self.side, : self.side] = sums.reshape(3, self.side, self.side)
        spectrum = np.fft.rfft2(grid)
        back = lambda k, s: np.fft.irfft2(np.fft.rfft2(k) * s, s=kernel.shape)[..., : self.side, : self.side]
        plain = back(kernel, spectrum[0])
        return back(kernel**2, spectrum).reshape(3, -1), float((plain * sums[0].reshape(self.side, self.side)).sum())


def _xy(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy() for c in ("x", "y")], 1)


def _charges(grid: Grid) -> Callable[[Batches], Batches]:
    """A task's sums of 1, x and y on the nodes, in chunks."""

    def run(batches: Batches) -> Batches:
        sums = np.zeros((3, grid.side**2))
        for batch in batches:
            xy = _xy(batch)
            nodes, w = grid.spread(xy)
            for i, v in enumerate((None, xy[:, :1], xy[:, 1:])):
                sums[i] += np.bincount(nodes.ravel(), (w if v is None else w * v).ravel(), grid.side**2)
        flat = sums.ravel()
        parts = [flat[lo : lo + CHUNK] for lo in range(0, len(flat), CHUNK)]
        some = [i for i, p in enumerate(parts) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["chunk", "sums"])

    return run


def _added(batches: Batches) -> Batches:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, own in zip(batch.column("chunk").to_pylist(), batch.column("sums").to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(own)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], names=["chunk", "sums"])


def _potentials(grid: Grid, values: np.ndarray) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            nodes, w = grid.spread(_xy(batch))
            found = [pa.array((values[i][nodes] * w).sum(1)) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *found], names=[*batch.schema.names, "r0", "rx", "ry"])

    return run


def gradient(state: DataFrame, edges: DataFrame, exaggeration: float = 1.0) -> DataFrame:
    """state (obs_idx, x, y and more) with gx and gy, the gradient of the divergence of the positions from edges."""
    bounds = state.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.count(F.lit(1))).first()
    grid = Grid.over(bounds[:2], bounds[2:4])
    sums = np.zeros(3 * grid.side**2)
    for row in state.select("x", "y").mapInArrow(_charges(grid), "chunk long, sums binary").repartition("chunk").mapInArrow(_added, "chunk long, sums binary").collect():
        own = np.frombuffer(row.sums)
        sums[row.chunk * CHUNK : row.chunk * CHUNK + len(own)] = own
    values, total = grid.convolved(sums.reshape(3, -1))
    total = max(total - bounds[4], 1e-12)  # without the pairs of a point with itself
    kind = ", ".join(f"{c} {t}" for c, t in state.dtypes) + ", r0 double, rx double, ry double"
    ends = [state.select(F.col("obs_idx").alias(c), F.col("x").alias(f"x{c}"), F.col("y").alias(f"y{c}")) for c in "ij"]
    pull = edges.join(ends[0], "i").join(ends[1], "j").withColumn("w", F.expr("p / (1 + (xi - xj) * (xi - xj) + (yi - yj) * (yi - yj))"))
    pull = pull.groupBy(F.col("i").alias("obs_idx")).agg(F.sum(F.expr("w * (xi - xj)")).alias("ax"), F.sum(F.expr("w * (yi - yj)")).alias("ay"))
    both = state.mapInArrow(_potentials(grid, values), kind).join(pull, "obs_idx", "left")
    along = lambda c: F.lit(4.0) * (exaggeration * F.coalesce(F.col(f"a{c}"), F.lit(0.0)) - (F.col(c) * F.col("r0") - F.col(f"r{c}")) / total)
    return both.select(*state.columns, along("x").alias("gx"), along("y").alias("gy"))


def descend(state: DataFrame, edges: DataFrame, rounds: int, rate: float) -> DataFrame:
    """rounds of gradient descent with momentum and a gain per coordinate, the first quarter with exaggerated attraction.
    Each round's positions go to the shared folder, so that no round depends on what executors hold."""
    state = stored(state.select("obs_idx", "x", "y", *[F.lit(v).alias(c) for c, v in (("ux", 0.0), ("uy", 0.0), ("hx", 1.0), ("hy", 1.0))]))
    for r in range(rounds):
        early = 4 * r < rounds
        new = gradient(state, edges, EXAGGERATION if early else 1.0)
        for c in "xy":
            same = F.signum(f"g{c}") == F.signum(f"u{c}")
            new = new.withColumn(f"h{c}", F.greatest(F.when(same, F.col(f"h{c}") * 0.8).otherwise(F.col(f"h{c}") + 0.2), F.lit(0.01)))
            new = new.withColumn(f"u{c}", (0.5 if early else 0.8) * F.col(f"u{c}") - rate * F.col(f"h{c}") * F.col(f"g{c}"))
            new = new.withColumn(c, F.col(c) + F.col(f"u{c}"))
        last, state = state, stored(new.select(*state.columns))
        drop(last)
    return state


def tsne(am: AnnotatedMatrix, use: str = "X_pca", perplexity: float = 30.0, rounds: int = 500, rate: float | None = None, probes: int = 12) -> AnnotatedMatrix:
    """Adds obsm X_tsne: two coordinates for every observation of obsm[use], started from its first two columns.

    Neighbours are three times the perplexity. An observation without a vector has none here either; one without any
    neighbour is moved by repulsion alone. Runs its jobs when called: three or so a round. The positions stay in the shared
    folder; neighbours, edges and former positions are dropped."""
    if use not in am.obsm:
        raise ValueError(f"obsm has no {use}")
    if perplexity < 1 or rounds < 0:
        raise ValueError("a perplexity of 1 and no negative number of rounds at least")
    points = am.obsm[use].where("vec is not null").select("obs_idx", "vec")
    near = nearest(points, int(3 * perplexity), probes)
    edges = affinities(near, perplexity)
    drop(near)
    start = points.select("obs_idx", F.col("vec")[0].cast("double").alias("x"), F.coalesce(F.get("vec", F.lit(1)).cast("double"), F.lit(0.0)).alias("y"))
    spread = start.agg(F.stddev_pop("x"), F.count(F.lit(1))).first()
    start = start.select("obs_idx", *[(F.col(c) * (1e-2 / (spread[0] or 1.0))).alias(c) for c in "xy"])
    done = descend(start, edges, rounds, rate or max(spread[1] / EXAGGERATION / 4, 50.0)) if spread[1] else start
    drop(edges)
    return replace(am, obsm=am.obsm | {"X_tsne": done.select("obs_idx", F.array("x", "y").alias("vec"))})
