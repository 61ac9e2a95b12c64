"""Dense positions of an axis, found without any task that sees all of it."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import AnnotatedMatrix
from ..params import Direction
from ..storage import stored


def numbered(ids: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): positions from 0 in ascending order of key; of equal keys each has its own, a null comes first. Runs
    jobs: ids are written once in ranges of the key, the driver adds up one count per range, and each range numbers its own
    rows. The ranges follow Spark's shuffle partitions."""
    ranged = stored(ids.select(key).repartitionByRange(key).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())  # one row per range
    starts = accumulate((n for _, n in sizes), initial=0)
    offsets = ids.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts)], "part int, start long")
    within = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    return ranged.join(F.broadcast(offsets), "part").select(key, (F.col("start") + within).alias(name))


def reindex(am: AnnotatedMatrix, direction: Direction) -> DataFrame:
    """(key, position): dense positions from 0 in the order of the ids, for exports that need them. Runs jobs."""
    return numbered(am.axis(direction), direction.key, "position")


def slice_positions(am: AnnotatedMatrix, direction: Direction, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    """(key, out_pos): of the axis in the order of its ids, the rows at start, start + step, ... below end, however the ids
    are spaced. Raises where the slice leaves the axis; an empty axis gives an empty selection. Runs jobs."""
    if start < 0 or step < 1 or (end is not None and end < start):
        raise ValueError("a slice needs 0 <= start <= end and step >= 1")
    n = am.axis(direction).count()
    if n and (start >= n or (end is not None and end > n)):
        raise IndexError("the slice lies outside the axis")
    at = F.col("position")
    keep = (at >= start) & (F.pmod(at - start, F.lit(step)) == 0)
    found = reindex(am, direction).where(keep if end is None else keep & (at < end))
    return found.select(direction.key, F.expr(f"(position - {start}) div {step}").alias("out_pos"))


def take_positions(am: AnnotatedMatrix, direction: Direction, positions: list[int]) -> DataFrame:
    """(key, out_pos): the rows at the given positions of the axis, in the order given. Raises for a position outside the
    axis or one that comes twice. Runs jobs."""
    if len(set(positions)) != len(positions):
        raise ValueError("a position comes twice")
    n = am.axis(direction).count()
    if any(not 0 <= p < n for p in positions):
        raise IndexError("a position lies outside the axis")
    asked = am.x.sparkSession.createDataFrame([(int(p), i) for i, p in enumerate(positions)], "position long, out_pos long")
    return reindex(am, direction).join(asked, "position").select(direction.key, "out_pos")
