"""Statistics of the stored entries of each observation or variable.

Hash aggregates, partial on the map side, compute whatever is asked for; a left join from the axis adds the groups without
entries. Implicit zeros take no part, stored ones do. Sums, variances and deviations have the same bits however the entries
are partitioned (functions.exact). Those of a group that holds NaN are NaN; minimum and maximum pass over NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exact, skip_nan
from ..functions.numeric import INF, NAN
from ..model import AnnotatedMatrix
from ..params import ComputationMode, Direction

STATISTICS = ("count", "sum", "variance", "std", "min", "max")
QC_NAMES = {
    Direction.ROW: {"count": "num_genes_per_cell", "sum": "sum_expr_per_cell", "variance": "var_expr_per_cell", "std": "std_dev_per_cell"},
    Direction.COLUMN: {"count": "num_cells_per_gene", "sum": "sum_expr_per_gene", "variance": "var_expr_per_gene", "std": "std_dev_per_gene"},
}


def _empty(name: str, native: bool) -> Column:
    """What a group without entries has. Along the layout's own axis its variance is NaN, across it 0."""
    return {
        "count": F.lit(0).cast("long"),
        "sum": F.lit(0.0),
        "variance": F.lit(NAN if native else 0.0),
        "std": F.lit(NAN if native else 0.0),
        "min": F.lit(INF),
        "max": F.lit(-INF),
    }[name]


def _squares(which: tuple[str, ...]) -> bool:
    return bool({"variance", "std"} & set(which))


def _extremes(which: tuple[str, ...]) -> list[str]:
    return [n for n in ("min", "max") if n in which]


def _plain() -> dict[str, Column]:
    v = F.col("value")
    return {"count": F.count(F.lit(1)), "min": F.min(skip_nan(v)), "max": F.max(skip_nan(v))}


def partial(x: DataFrame, key: str, which: tuple[str, ...] = STATISTICS) -> DataFrame:
    """One row per group and exponent bucket of its entries: what the statistics are put together from."""
    x = x.select(key, F.col("value").cast("double").alias("value"))
    v, a, plain = F.col("value"), F.col("a"), _plain()
    x = x.withColumn("b", exact.bucket(v))
    x = x.withColumn("a", exact.scaled(v, F.col("b")))
    lanes = exact.sum_lanes(a) + (exact.square_lanes(a) if _squares(which) else [])
    return x.groupBy(key, "b").agg(plain["count"].alias("n"), exact.not_finite(v).alias("odd"), *[plain[n].alias(n) for n in _extremes(which)], *lanes)


def combined(parts: DataFrame, key: str) -> DataFrame:
    """Rows of partial() of all statistics, over several sets of entries, as one set."""
    added = [F.sum(n).alias(n) for n in ("n", "odd", *exact.lane_names(True))]
    return parts.groupBy(key, "b").agg(*added, F.min("min").alias("min"), F.max("max").alias("max"))


def finished(parts: DataFrame, key: str, which: tuple[str, ...] = STATISTICS) -> DataFrame:
    """The statistics of each group in parts."""
    squares, asked = _squares(which), _extremes(which)
    joined = F.collect_list(F.struct("b", *exact.lane_names(squares))).alias("parts")
    groups = parts.groupBy(key).agg(F.sum("n").alias("n"), F.sum("odd").alias("odd"), joined, *[getattr(F, n)(n).alias(n) for n in asked])
    if squares:
        groups = groups.withColumn("variance", exact.variance(F.col("n"), F.col("parts"), F.col("odd").isNull()))
    made = {"count": F.col("n"), "sum": exact.total(F.col("parts"), F.col("odd")), "variance": F.col("variance"), "std": F.sqrt("variance")}
    return groups.select(key, *[(made[n] if n in made else F.col(n)).alias(n) for n in which])


def _found(x: DataFrame, key: str, which: tuple[str, ...]) -> DataFrame:
    """The statistics of the groups that have entries. What is exact in any order takes one aggregate; sums and variances
    take one by exponent bucket and another over each group's few buckets."""
    if not _squares(which) and "sum" not in which:
        return x.groupBy(key).agg(*[_plain()[n].alias(n) for n in which])
    return finished(partial(x, key, which), key, which)


def axis_stats(
    am: AnnotatedMatrix, direction: Direction, which: tuple[str, ...] = STATISTICS, mode: ComputationMode | None = None
) -> DataFrame:
    """One row per observation or variable: its key and the statistics in which, empty groups included."""
    if unknown := set(which) - set(STATISTICS):
        raise ValueError(f"no such statistics: {sorted(unknown)}")
    key = direction.key
    found = _found(am.x.select(key, F.col("value").cast("double").alias("value")), key, which)
    return empty_filled(am, direction, found, which)


def empty_filled(am: AnnotatedMatrix, direction: Direction, found: DataFrame, which: tuple[str, ...] = STATISTICS) -> DataFrame:
    """found for every row of the axis; groups that it lacks get the statistics of no entries."""
    key, native = direction.key, (am.layout == "csr") == direction.is_row
    out = am.axis(direction).select(key).join(found, key, "left")
    return out.select(key, *[F.coalesce(F.col(n), _empty(n, native)).alias(n) for n in which])


def compute_number(am: AnnotatedMatrix, direction: Direction, mode: ComputationMode | None = None) -> DataFrame:
    """Number of stored entries, zeros included."""
    return axis_stats(am, direction, ("count",), mode)


def compute_sum(am: AnnotatedMatrix, direction: Direction, mode: ComputationMode | None = None) -> DataFrame:
    return axis_stats(am, direction, ("sum",), mode)


def compute_variance(am: AnnotatedMatrix, direction: Direction) -> DataFrame:
    """Population variance: the divisor is the number of stored entries, not the length of the axis."""
    return axis_stats(am, direction, ("variance",))


def compute_std_dev(am: AnnotatedMatrix, direction: Direction) -> DataFrame:
    return axis_stats(am, direction, ("std",))


def compute_min_max(am: AnnotatedMatrix, direction: Direction) -> DataFrame:
    return axis_stats(am, direction, ("min", "max"))


def qc_variables(am: AnnotatedMatrix) -> tuple[DataFrame, DataFrame]:
    """Count, sum, variance and deviation per observation and per variable, under their usual column names."""
    frames = []
    for d in Direction:
        stats = axis_stats(am, d, tuple(QC_NAMES[d]))
        frames.append(stats.select(d.key, *[F.col(n).alias(c) for n, c in QC_NAMES[d].items()]))
    return frames[0], frames[1]


def annotate(am: AnnotatedMatrix, direction: Direction, columns: DataFrame) -> AnnotatedMatrix:
    """Joins columns to the axis table; those of the same name are replaced."""
    key = direction.key
    axis = am.axis(direction).drop(*[c for c in columns.columns if c != key])
    return am.with_axis(direction, axis.join(columns, key, "left"))


def qc(am: AnnotatedMatrix) -> AnnotatedMatrix:
    """The bundle with the quality columns in obs and var."""
    per_obs, per_var = qc_variables(am)
    return annotate(annotate(am, Direction.ROW, per_obs), Direction.COLUMN, per_var)
