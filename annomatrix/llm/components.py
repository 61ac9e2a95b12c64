"""Connected components by alternating large-star and small-star steps.

Edges become stars around the smallest node of each component. A step is a minimum per node and a join; no node's
neighbours are ever gathered. Among more than MANY edges, nodes with a large share of all are joined by a bounded
broadcast, so that a hub's edges stay in the tasks that read them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, scratch
from .skew import HEAVY

#: Edges of one node that a task takes in a plain join.
MANY = 1 << 20


def _with_least(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (u, v) with m of their u from least (u, m, n); fewer than HEAVY nodes u are in more than one in HEAVY of
    all rows."""
    if total <= MANY:
        return rows.join(least.drop("n"), "u")
    hub = F.col("n") * HEAVY > total
    few = least.where(hub).drop("n")
    spread = rows.join(F.broadcast(few.select("u")), "u", "left_anti")
    return rows.join(F.broadcast(few), "u").unionByName(spread.join(least.where(~hub).drop("n"), "u"))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.select("u", F.least("u", "m").alias("m"), "n")
    return _with_least(both.where("v > u"), least, 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    rest = _with_least(down, least, total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of long ids; returns (node, component) for every node that has an edge, the component being its
    smallest node. Each round is written to the shared folder and the one before it dropped; the loop ends when a
    round changes no edge."""
    spark = edges.sparkSession
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    with scratch(spark) as kept:
        now = materialize(edges.select("u", "v").where("u <> v").distinct(), "edges")
        state = mark(now)
        kept.append(now)
    while state[0]:
        with scratch(spark) as kept:
            now = materialize(_small_star(_large_star(now, state[0]), state[0]), "stars")  # a large star adds no edge
            kept.append(now)
        after = mark(now)
        if after == state:
            break
        state = after
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
