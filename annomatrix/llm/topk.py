"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Components become floor(256 x). Vectors are sorted by the nearest of some centres, found on a bounded sample, and by
their distance from it; shards are blocks of rows in this order, each with a tree of balls over its vectors, so that
near vectors share a ball. A block of queries visits a tree's nodes in the order of their upper bounds q.c + |q| r and
drops, node by node, the queries whose kth score so far is higher. The kth score is shared: a first round searches one
shard for each query block; its kth scores then meet the root balls of all shards, without the vectors, and only the
pairs of query block and shard whose bound reaches them go on to the second round, in which a task passes the scores on
from shard to shard. Queries meet shards in blocks through equi-joins, so a task holds one block of each.

Vectors that are null or hold null, NaN or infinite components, and rows of a null vec_id, take no part. Vectors of
different lengths are compared as if padded with zeros. A vec_id that comes twice among queries counts once, with the
smallest vector; candidates of the query's own vec_id are its own; other repeated candidates count each. Components that
256 carries beyond the largest double are taken as that, and scores beyond 64 bits saturate. Fewer than k candidates give
fewer rows, an empty table none. A vector of any length is read whole, and
blocks are bounded by bytes too. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize, scratch

K = 5
EVERY = 50
SCALE = 256
SHARD_ROWS = 8192
QUERY_ROWS = 512
#: Bytes of a block's components at most, unless one vector alone has more: long vectors make blocks of fewer rows.
BLOCK_BYTES = 1 << 25
LEAF = 256
#: Vectors from which the centres are found, those of the least hashes of their ids, and centres at most.
SAMPLE = 4096
CENTRES = 64
ROOTS = 1024
LARGEST = 1.7976931348623157e308
EXACT = float(2**53)
LEAST, MOST = -(2**63), 2**63 - 1


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def build(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list[tuple[int, int, int, int]], np.ndarray, np.ndarray]:
    """Order of the points, nodes (begin, end, left, right; -1 for none), centres and radii. A node is halved at the
    median along the line to its farthest point."""
    with np.errstate(over="ignore", invalid="ignore"):
        return _build(points, leaf)


def _build(points: np.ndarray, leaf: int):
    order = np.arange(len(points))
    nodes: list[list[int]] = [[0, len(points), -1, -1]]
    centres, radii = [], []
    at = 0
    while at < len(nodes):
        a, b = nodes[at][:2]
        own = points[order[a:b]]
        c = own.mean(0) if b > a else np.zeros(points.shape[1])
        far = np.sqrt(((own - c) ** 2).sum(1)) if b > a else np.zeros(1)
        centres.append(c)
        radii.append(float(far.max()))
        if b - a > leaf and far.max() > 0:
            along = np.nan_to_num((own - c) @ (own[far.argmax()] - c))
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(along, mid)]
            nodes[at][2:] = [len(nodes), len(nodes) + 1]
            nodes += [[a, a + mid, -1, -1], [a + mid, b, -1, -1]]
        at += 1
    return order, [tuple(n) for n in nodes], np.array(centres), np.array(radii)


def scores(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if not q.size or not p.size or np.abs(q).max() * np.abs(p).max() * q.shape[1] < EXACT:
        return (q @ p.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.clip(whole(q) @ whole(p).T, LEAST, MOST).astype(np.int64)


@np.errstate(over="ignore", invalid="ignore")
def upper(q: np.ndarray, norms: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Bounds of the inner products of each query with the points of each ball, with room for rounding."""
    b = q @ centres.T + norms[:, None] * radii
    b = b + 1e-6 * (np.abs(b) + norms[:, None] * np.sqrt((centres**2).sum(1)) + 1)
    return np.where(np.isfinite(b), b, np.inf)


@np.errstate(over="ignore", invalid="ignore")
def search(tree: tuple, points: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, kth: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of the shard for each query, as (query position, vec_id, score), among those that reach kth. kth is
    raised in place; ties go to the smaller vec_id."""
    order, nodes, centres, radii = tree
    norms = np.sqrt((queries**2).sum(1))
    best = np.full((len(queries), k), LEAST, dtype=np.int64)
    best_id = np.full((len(queries), k), MOST, dtype=np.int64)

    def bound(n: int, rows: np.ndarray) -> np.ndarray:
        return upper(queries[rows], norms[rows], centres[n : n + 1], radii[n : n + 1])[:, 0]

    everyone = np.arange(len(queries))
    heap = [(-float(bound(0, everyone).max(initial=-np.inf)), 0, everyone)]
    while heap:
        _, n, rows = heapq.heappop(heap)
        rows = rows[bound(n, rows) >= kth[rows]]
        if not len(rows):
            continue
        begin, end, left, right = nodes[n]
        if left >= 0:
            for child in (left, right):
                heapq.heappush(heap, (-float(bound(child, rows).max()), child, rows))
            continue
        own = order[begin:end]
        found = scores(queries[rows], points[own])
        found_ids = np.broadcast_to(ids[own], found.shape)
        merged = np.concatenate([best[rows], np.where(found_ids == query_ids[rows, None], LEAST, found)], 1)
        merged_ids = np.concatenate([best_id[rows], np.where(found_ids == query_ids[rows, None], MOST, found_ids)], 1)
        if merged.shape[1] > 8 * k:  # ties at the kth score all stay for the sort
            least = np.partition(merged, merged.shape[1] - k, axis=1)[:, merged.shape[1] - k]
            merged_ids = np.where(merged >= least[:, None], merged_ids, MOST)
            merged = np.where(merged >= least[:, None], merged, LEAST)
        rank = np.lexsort((merged_ids, -merged.astype(np.float64)), axis=1) if np.abs(found).max(initial=0) < EXACT else np.array([sorted(range(merged.shape[1]), key=lambda j: (-int(s[j]), i[j])) for s, i in zip(merged, merged_ids, strict=True)])
        rank = rank[:, :k]
        best[rows], best_id[rows] = np.take_along_axis(merged, rank, 1), np.take_along_axis(merged_ids, rank, 1)
        kth[rows] = np.maximum(kth[rows], best[rows, k - 1])
    row, col = np.nonzero(best_id != MOST)
    return row, best_id[row, col], best[row, col]


def vectors(df: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, with whole-numbered components."""
    v = F.col("embedding").cast("array<double>")
    # A power of two: exact; blocks take the floor.
    scaled = F.transform(v, lambda x: F.least(F.greatest(x * SCALE, F.lit(-LARGEST)), F.lit(LARGEST)))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"), fine.alias("fine")).where("vec_id is not null and v is not null and fine").select("vec_id", "v")


def centres_of(usable: DataFrame, sample: int = SAMPLE, most: int = CENTRES) -> np.ndarray:
    some = [r.v for r in usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    points = _matrix(some, max(map(len, some), default=0))
    if len(points) < 2 * most:
        return points[:0]
    _, nodes, balls, _ = build(points, -(-len(points) // most))
    return np.array([c for c, n in zip(balls, nodes, strict=True) if n[2] < 0])


def gathered(usable: DataFrame, centres: np.ndarray) -> DataFrame:
    """usable with near vectors next to each other: range-sorted by the nearest centre and the distance from it, which
    also splits what gathers around one centre."""
    if not centres.size:
        return usable
    width = centres.shape[1]

    @F.pandas_udf("near int, far double")
    def near(vectors: pd.Series) -> pd.DataFrame:
        v = _matrix([x[:width] for x in vectors], width)
        with np.errstate(over="ignore", invalid="ignore"):
            apart = np.nan_to_num((v**2).sum(1)[:, None] - 2 * v @ centres.T + (centres**2).sum(1), nan=np.inf)
        return pd.DataFrame({"near": apart.argmin(1), "far": apart.min(1, initial=np.inf)})

    placed = usable.withColumn("at", near("v")).select("vec_id", "v", "at.near", "at.far")
    order = ["near", "far", "vec_id"]
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).select("vec_id", "v")


def _blocks(rows: int, tree: bool):
    """Packs a partition's rows into blocks of so many, or of as many as BLOCK_BYTES hold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        held: list = []
        widest = 0

        def block() -> pd.DataFrame:
            nonlocal number
            width = max(map(len, held))
            m = np.floor(_matrix(held, width))
            row = {"block": base + number, "width": width, "ids": np.array(ids, dtype=np.int64).tobytes()}
            if tree:
                order, nodes, centres, radii = build(m)
                row |= {"root": centres[0].tobytes(), "radius": float(radii[0])}
                row |= {"order": order.tobytes(), "nodes": np.array(nodes, dtype=np.int64).tobytes(), "centres": centres.tobytes(), "radii": radii.tobytes()}
            row["points"] = m.tobytes()
            number += 1
            ids.clear()
            held.clear()
            return pd.DataFrame([row])

        for pdf in batches:
            for i, v in zip(pdf["vec_id"], pdf["v"], strict=True):
                if ids and (len(ids) == rows or (len(ids) + 1) * max(widest, len(v)) * 8 > BLOCK_BYTES):
                    yield block()
                    widest = 0
                ids.append(i)
                held.append(v)
                widest = max(widest, len(v))
        if ids:
            yield block()

    extra = "root binary, radius double, order binary, nodes binary, centres binary, radii binary, " if tree else ""
    return run, f"block long, width int, ids binary, {extra}points binary"


def top_k(df: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by every, against all others. The result is one
    table; those of the rounds are dropped."""
    with scratch(df.sparkSession) as kept:
        kept.append(materialize(_ranked(df, k, every, shard_rows, query_rows), "topk-ranked"))
    return kept[0]


def _numbered(shards: DataFrame) -> DataFrame:
    """shards with shard, numbers from 0 without gaps: a block's number in its partition follows on those of the partitions
    before."""
    part, within = F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    sizes = sorted((r.part, r["count"]) for r in shards.groupBy(part.alias("part")).count().collect())  # one row per partition
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = shards.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part long, start long")
    numbered = shards.withColumn("part", part).join(F.broadcast(offsets), "part")
    return numbered.withColumn("shard", F.col("start") + within).drop("part", "start")


def _ranked(df: DataFrame, k: int, every: int, shard_rows: int, query_rows: int) -> DataFrame:
    usable = vectors(df)
    centres = centres_of(usable)
    shards = materialize(gathered(usable, centres).mapInPandas(*_blocks(shard_rows, True)), "topk-shards")
    asked = usable.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialize(asked, "topk-queries")
    n_shards, n_queries = shards.count(), asked.count()
    asked = gathered(asked, centres) if centres.size else asked.repartition(max(1, -(-n_queries // query_rows)), "vec_id")
    asked = asked.mapInPandas(*_blocks(query_rows, False))
    asked = materialize(asked.select(F.col("block").alias("q"), F.col("width").alias("q_width"), F.col("ids").alias("q_ids"), F.col("points").alias("q_points")), "topk-blocks")
    shards = _numbered(shards)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[int, np.ndarray] = {}  # kth scores of the query blocks that this task met
        for pdf in batches:
            for r in pdf.itertuples():
                dim = max(r.width, r.q_width)
                wide = lambda raw, w: np.pad(np.frombuffer(raw).reshape(-1, w), ((0, 0), (0, dim - w)))  # noqa: B023, E731
                points, queries, centres = wide(r.points, r.width), wide(r.q_points, r.q_width), wide(r.centres, r.width)
                tree = (np.frombuffer(r.order, dtype=np.int64), np.frombuffer(r.nodes, dtype=np.int64).reshape(-1, 4).tolist(), centres, np.frombuffer(r.radii))
                query_ids = np.frombuffer(r.q_ids, dtype=np.int64)
                kth = kept.setdefault(r.q, np.full(len(query_ids), LEAST, dtype=np.int64))
                if r.kth is not None:
                    np.maximum(kth, np.frombuffer(r.kth, dtype=np.int64), out=kth)
                row, vec, score = search(tree, points, np.frombuffer(r.ids, dtype=np.int64), queries, query_ids, kth, k)
                yield pd.DataFrame({"q": r.q, "shard": r.shard, "place": row, "query_id": query_ids[row], "vec_id": vec, "score": score})
            if len(kept) > 4096:
                kept.clear()

    schema = "q long, shard long, place long, query_id long, vec_id long, score long"
    if not n_shards or not n_queries:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    promising = _meet_roots(asked.withColumns({"kth": F.lit(None).cast("binary"), "home": F.lit(-1).cast("long")}), shards, n_shards)
    home = promising.groupBy("q").agg(F.max_by("shard", F.struct("promise", "shard")).alias("home"))
    asked = materialize(asked.join(home, "q"), "topk-homes")
    first = asked.withColumnRenamed("home", "shard").withColumn("kth", F.lit(None).cast("binary")).join(shards, "shard").mapInPandas(run, schema)
    first = materialize(first, "topk-first")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["size"].iloc[0])
        kth = np.full(n, LEAST, dtype=np.int64)
        worst = pdf.dropna(subset=["place"]).groupby("place")["score"].agg(["size", "min"])
        worst = worst[worst["size"] == k]
        kth[worst.index.to_numpy(dtype=np.int64)] = worst["min"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"q": [pdf["q"].iloc[0]], "kth": [kth.tobytes()]})

    sizes = asked.select("q", (F.length("q_ids") / 8).cast("long").alias("size"))
    bounds = sizes.join(first.select("q", "place", "score"), "q", "left").groupBy("q").applyInPandas(pack, "q long, kth binary")  # a block has query_rows queries at most
    asking = materialize(asked.join(bounds, "q"), "topk-asking")
    open_pairs = materialize(_meet_roots(asking, shards, n_shards).select("q", "shard"), "topk-pairs")
    rest = open_pairs.join(asking.drop("home"), "q").join(shards, "shard").mapInPandas(run, schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    both = first.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")


def _meet_roots(asking: DataFrame, shards: DataFrame, n_shards: int) -> DataFrame:
    """(q, shard, promise): the shards, but for a query block's home, whose root ball may reach the kth score of one of
    its queries; where there are no such scores yet, the shard of each block of roots whose centre promises most. Roots
    come in blocks of ROOTS, so that a query block is sent once for each of these."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                dim = max(r.q_width, *(x["width"] for x in r.roots))
                queries = np.pad(np.frombuffer(r.q_points).reshape(-1, r.q_width), ((0, 0), (0, dim - r.q_width)))
                centres = np.array([np.pad(np.frombuffer(x["root"]), (0, dim - x["width"])) for x in r.roots])
                radii, shard = np.array([x["radius"] for x in r.roots]), np.array([x["shard"] for x in r.roots])
                with np.errstate(over="ignore", invalid="ignore"):
                    norms, promise = np.sqrt((queries**2).sum(1)), np.nan_to_num((queries @ centres.T).sum(0))
                if r.kth is None:
                    reach = np.arange(len(shard)) == promise.argmax()
                else:
                    reach = (upper(queries, norms, centres, radii) >= np.frombuffer(r.kth, dtype=np.int64)[:, None]).any(0)
                reach &= shard != r.home
                yield pd.DataFrame({"q": r.q, "shard": shard[reach], "promise": promise[reach]})

    root = F.struct("shard", "width", "root", "radius")
    some = F.floor(F.col("shard") / ROOTS).cast("long")
    packed = shards.groupBy(some.alias("some")).agg(F.collect_list(root).alias("roots"))  # ROOTS at most
    asking = asking.withColumn("some", F.explode(F.sequence(F.lit(0), F.lit((n_shards - 1) // ROOTS)).cast("array<long>")))
    return asking.join(packed, "some").select("q", "q_width", "q_points", "kth", "home", "roots").mapInPandas(run, "q long, shard long, promise double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest others of every fiftieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_dot_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5"""
