"""Nearest neighbours of every observation in a vector space, by cells around sampled centres."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import drop, stored

#: Centres at most; they are a sample of the points, and all points are searched. Points of a cell that meet at once.
MAX_CENTRES, CELL_POINTS = 4096, 4096
PROBES = 12
#: Components at most of a block of points (2 MB as doubles), or one point. Queries of a block that are multiplied at once.
BLOCK_COMPONENTS, TILE = 1 << 18, 256
Batches = Iterator[pa.RecordBatch]


def matrix_of(column: pa.Array) -> np.ndarray:
    """The equally long lists of a column as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1), 0)


def _cells(centres: np.ndarray, probes: int) -> Callable[[Batches], Batches]:
    """Each point's cells, the nearest centre's first."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for part in (batch.slice(lo, 1024) for lo in range(0, len(batch), 1024)):
                order = np.argsort(_squared(matrix_of(part.column("vec")), centres), 1, kind="stable")[:, :probes]
                offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * order.shape[1])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(offsets, pa.array(order.ravel().astype(np.int32)))], names=["obs_idx", "vec", "cells"])

    return run


def _search(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k nearest points of a cell's part to each of the queries that ask it."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        ids, asked = points.column("obs_idx").to_numpy(), queries.column("obs_idx").to_numpy()
        rows: list[tuple[np.ndarray, ...]] = []
        if len(ids) and len(asked):
            data = matrix_of(points.column("vec"))
            for lo in range(0, len(asked), 512):
                own = asked[lo : lo + 512]
                d = _squared(matrix_of(queries.column("vec").slice(lo, 512)), data)
                d[own[:, None] == ids] = np.inf
                near = np.argpartition(d, min(k, len(ids)) - 1, 1)[:, :k]
                dist = np.take_along_axis(d, near, 1)
                some = np.isfinite(dist)
                dist = ((matrix_of(queries.column("vec").slice(lo, 512))[:, None] - data[near]) ** 2).sum(2)  # without the product's rounding
                rows.append((np.broadcast_to(own[:, None], near.shape)[some], ids[near][some], dist[some]))
        one = [np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, dtype=t) for i, t in enumerate((np.int64, np.int64, float))]
        return pa.table({"obs_idx": one[0], "other": one[1], "d2": one[2]})

    return run


def _packed(kind: str, most: int) -> Callable[[Batches], Batches]:
    """Points as blocks of at most most points and BLOCK_COMPONENTS components, ids and components as bytes. Points without a
    finite length are near to none and are left out."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            if not len(batch):
                continue
            ids, data = batch.column("obs_idx").to_numpy(), matrix_of(batch.column("vec"))
            usable = np.isfinite((data * data).sum(1))
            ids, data = ids[usable], data[usable].astype(kind)
            pieces = -(-len(ids) // max(1, min(most, BLOCK_COMPONENTS // max(1, data.shape[1]))))
            for own, vecs in zip(np.array_split(ids, pieces), np.array_split(data, pieces), strict=True) if pieces else ():
                yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()]), pa.array([vecs.tobytes()])], names=["ids", "vecs"])

    return run


class _Nearest:
    """The k nearest of the points met so far, for each query of a block. Products of matrices, in single precision where their
    rounding leaves few candidates, rule points out; the distances of those that are left are summed in doubles."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, k: int) -> None:
        self.ids, self.vecs, self.k = ids, vecs, k
        self.length = (vecs * vecs).sum(1)
        self.factor = self._in_kinds(np.hstack([-2 * vecs, np.ones((len(ids), 1))]), self.length)
        self.d2, self.other = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), dtype=np.int64)

    @staticmethod
    def _in_kinds(factor: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        return {kind: factor.astype(kind) for kind in ("f4", "f8") if kind == "f8" or length.max() < 1e30}

    def meet(self, ids: np.ndarray, data: np.ndarray) -> None:
        length = (data * data).sum(1)
        factor = self._in_kinds(np.vstack([data.T, length]), length)
        kinds = [kind for kind in factor if kind in self.factor]
        # what a product's rounding can add; below the last term single precision has too few digits
        slack = {t: 4 * (data.shape[1] + 2) * np.finfo(t).eps * (self.length + length.max()) + (1e-30 if t == "f4" else 0) for t in kinds}
        product = {kind: np.empty((TILE, len(ids)), dtype=kind) for kind in kinds}
        hit = np.empty((TILE, len(ids)), dtype=bool)
        shared = len(np.intersect1d(ids, self.ids)) > 0
        some = min(len(ids), self.k + 16)
        for lo in range(0, len(self.ids), TILE):
            at = slice(lo, lo + TILE)
            worst = self.d2[at, -1]
            for kind in kinds if np.isfinite(worst).all() else ["f8"]:
                limit = np.where(worst > 0, worst - self.length[at] + slack[kind][at], -np.inf)
                d = np.matmul(self.factor[kind][at], factor[kind], out=product[kind][: len(worst)])  # less the query's own squared length
                if shared:
                    d[self.ids[at, None] == ids] = np.inf
                close = np.less_equal(d, limit.astype(kind)[:, None], out=hit[: len(worst)])
                if few := np.count_nonzero(close) <= some * len(worst):
                    break
            if few:
                row, col = np.divmod(np.flatnonzero(close), len(ids))
            else:  # at first, or where many are equally near
                col = np.argpartition(d, some - 1, 1)[:, :some].ravel()
                row = np.repeat(np.arange(len(d)), some)
                row, col = row[close[row, col]], col[close[row, col]]
            if len(row):
                self._add(lo + row, ids[col], np.where(np.isfinite(d[row, col]), ((self.vecs[lo + row] - data[col]) ** 2).sum(1), np.inf))

    def _add(self, row: np.ndarray, other: np.ndarray, d2: np.ndarray) -> None:
        rows = np.unique(row)
        row = np.concatenate([row, np.repeat(rows, self.k)])
        other, d2 = np.concatenate([other, self.other[rows].ravel()]), np.concatenate([d2, self.d2[rows].ravel()])
        order = np.lexsort((other, d2, row))
        first = order[np.searchsorted(row[order], rows)[:, None] + np.arange(self.k)]
        self.other[rows], self.d2[rows] = other[first], d2[first]

    def found(self) -> pa.RecordBatch:
        some = np.isfinite(self.d2)
        own = np.broadcast_to(self.ids[:, None], some.shape)
        return pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array(self.other[some]), pa.array(self.d2[some])], names=["obs_idx", "other", "d2"])


def _meeting(kind: str, k: int) -> Callable[[Batches], Batches]:
    """The k nearest of each query, for pairs of a block of points and one of queries."""

    def block_of(batch: pa.RecordBatch, i: int, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
        ids, vecs = (np.frombuffer(batch.column(prefix + c)[i].as_buffer(), dtype=t) for c, t in (("ids", np.int64), ("vecs", kind)))
        return ids, vecs.astype(float).reshape(len(ids), -1)

    def run(batches: Batches) -> Batches:
        queries: dict[int, _Nearest] = {}
        for batch in batches:
            for i, block in enumerate(batch.column("block").to_pylist()):
                if block not in queries:
                    ids, vecs = block_of(batch, i)
                    queries[block] = _Nearest(ids.copy(), vecs, k)
                queries[block].meet(*block_of(batch, i, "other_"))
        for block in queries.values():
            yield block.found()

    return run


def _all_pairs(points: DataFrame, n: int, k: int, block: int, best: Column) -> DataFrame:
    """(obs_idx, near): the k nearest of all points to each. Queries are dealt to tasks, some block of them or fewer each;
    a task keeps its own and lets all points, stored once, pass by. So neither disk nor a task's memory grows by pairs."""
    kind = "f4" if isinstance(points.schema["vec"].dataType.elementType, T.FloatType) else "f8"
    components = points.agg(F.sum(F.size("vec").cast("long"))).first()[0]  # one row
    parts = 1 + max(n // block, components // BLOCK_COMPONENTS)
    blocks = points.repartition(parts, "obs_idx").mapInArrow(_packed(kind, block), "ids binary, vecs binary")
    passing = stored(blocks)
    try:
        queries = blocks.withColumn("block", F.monotonically_increasing_id()).hint("shuffle_replicate_nl")
        pairs = passing.toDF("other_ids", "other_vecs").coalesce(1).crossJoin(queries)  # the right side is held, the left is not
        found = pairs.mapInArrow(_meeting(kind, k), "obs_idx long, other long, d2 double")
        return stored(found.groupBy("obs_idx").agg(best.alias("near")))
    finally:
        drop(passing)


def nearest(points: DataFrame, k: int, probes: int = PROBES, centres: int | None = None, cell_points: int = CELL_POINTS) -> DataFrame:
    """(obs_idx, near) for points (obs_idx, vec): up to k others by rising squared distance, as structs (d2, other).

    Points belong to the cell of their nearest centre and search the cells of their nearest probes centres. A cell that holds
    or is asked by many is dealt by hash to parts of some cell_points, of which a query asks one, so no task grows with a
    crowded place. With one centre the search is exact: all points pass by blocks of some cell_points queries, in time that grows
    with the squared number of points. Points whose id or vec is null take no part."""
    points = points.where("obs_idx is not null and vec is not null").select(F.col("obs_idx").cast("long").alias("obs_idx"), "vec")
    best = F.slice(F.array_sort(F.collect_list(F.struct("d2", "other"))), 1, k)  # at most k of each probe or block
    n = points.count()
    many = min(MAX_CENTRES, max(1, n // 256)) if centres is None else centres
    sample = points.orderBy(F.xxhash64("obs_idx"), "obs_idx").limit(many).select("vec").toArrow()
    kind = points.schema["vec"].dataType.simpleString()
    if not len(sample):
        return stored(points.select("obs_idx", F.lit(None).cast("array<struct<d2:double,other:bigint>>").alias("near")))
    if many == 1:
        return _all_pairs(points, n, k, cell_points, best)
    placed = points.mapInArrow(_cells(matrix_of(sample.column("vec")), probes), f"obs_idx long, vec {kind}, cells array<int>").persist()
    try:
        asked = placed.select("obs_idx", "vec", F.posexplode("cells").alias("turn", "cell"))
        sizes = asked.groupBy("cell").agg(F.sum(F.when(F.col("turn") == 0, 1).otherwise(0)).alias("own"), F.count(F.lit(1)).alias("asked")).collect()  # a row a centre
        parts = dict.fromkeys(range(many), 1) | {r.cell: 1 + max(r.own, r.asked // probes) // cell_points for r in sizes}
        of_cell = F.array(*[F.lit(parts[c]) for c in range(many)])[F.col("cell")]
        asked = asked.withColumn("part", F.pmod(F.xxhash64("obs_idx"), of_cell))
        names = ["cell", "part", "obs_idx", "vec"]
        own, asked = (df.select(*names).toDF(*names) for df in (asked.where("turn = 0"), asked))  # columns of their own on either side
        found = own.groupBy("cell", "part").cogroup(asked.groupBy("cell", "part"))
        found = found.applyInArrow(_search(k), "obs_idx long, other long, d2 double")
        return stored(found.groupBy("obs_idx").agg(best.alias("near")))
    finally:
        placed.unpersist()
